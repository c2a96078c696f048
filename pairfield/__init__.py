"""Spark-first analytics over particles and their pairwise interactions."""
