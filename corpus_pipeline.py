"""A training-data pipeline over ``documents``: five stages, each one operator over all that the stage before kept.

Nulls and edges, in all stages: a null or empty text has no letter and is dropped by the first stage, so later ones get
texts; a null doc_id stays and is held against no other document; rows that repeat a doc_id are rows of their own, judged by their
own texts, in order of a hash of these; of equal texts the smallest doc_id stays, of equal rows one; a null source is a source of
its own; ties are decided as the operators say; an empty table gives an empty table; columns beyond those of documents end
with the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfield.llm import common, language_id, line_dedup, mixing, ngram_join, packing
from pairfield.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language models reject; ``lang`` becomes the predicted language."""
    common.give_back(ship(spark))
    model = language_id.train(docs.filter(language_id.fold(F.col("doc_id"), 3) != 1))
    judged = language_id.predict(docs, model, keep=COLUMNS)
    return judged.filter(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out lines that an earlier line matches; documents stay, ``n_chars`` follows."""
    common.give_back(spark)
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id; a document without words is no duplicate."""
    common.give_back(ship(spark))
    rows, key = common.by_row(docs, "text", "doc_id")
    gone = ngram_join.join(rows, doc_id=key).filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return rows.join(gone, F.col(key) == F.col("__gone"), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    common.give_back(spark)
    taken = mixing.mix(docs, keep=COLUMNS).filter("copies > 0")
    copies = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col(name).alias(c) for c, name in common.kept_as(COLUMNS, mixing.OWN).items()])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    common.give_back(ship(spark))
    return packing.pack(docs, packing.default_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder before the next one reads them."""
    docs = common.table(spark, sf_dir, "documents")
    home, last = common.shared_folder(spark), None
    for name, stage in STAGES[:-1]:
        to = f"{home}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if last:
            common.discard(spark, last)
        last = to
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models and the tokenizer are beyond SQL; the stages are tested one by one instead.
ORACLE_SQL = None
