"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its share by weight, at most ``cap`` times what it holds, the excess shared again
by weight until none is above. A document's expected copies are its source's target over its source's size. The whole
copies are certain; for the rest documents are ranked by random odds over inclusion odds, and the first in that order
that fill the source's remaining words are taken, so the sample has a fixed size and unequal inclusion probabilities
across sources (and, with ``preference``, within one).

The cut-off of a source is found from key histograms on two levels (4096 ranges each), so that the rows that are ranked in one
task are those of one range of one source and not a whole source. Random numbers come from md5 of the id, so reruns
and other engines agree.

Nulls and edges: a null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0; rows equal in all respects are told apart only by a row number and are interchangeable; an empty table gives
an empty mix. Columns other than the named ones are passed on by ``mix(..., keep=...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_row, cut, kept_as, table, words

WEIGHTS, CAP, SPAN = (1, 2, 3), 3, 4096
OWN = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, size): source, source_size, target. Rows as many as sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int")).cast("double")
    w = per.withColumn("w", weight).withColumn("top", cap * F.col("source_size").cast("double"))
    before = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = w.select(
        "source", "source_size", "w", "top",
        ((F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("level"),
    )
    # a source is capped if it fills up below the level that holds when all sources that fill up earlier are capped
    capped = F.col("top") < F.col("level") * F.col("w")
    share = F.coalesce(F.max(F.when(~capped, F.col("level"))).over(every), F.lit(0.0)) * F.col("w")
    return level.select("source", "source_size", F.when(capped, F.col("top")).otherwise(share).alias("target"))


def _key(doc_id: Column, odds: Column) -> Column:
    """Pareto rank as an integer of 48 bits, increasing in (u / (1 - u)) / odds."""
    u = (F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(281474976710656.0)
    q = u / (1.0 - u) / odds
    return F.floor(q / (1.0 + q) * F.lit(281474976710656.0)).cast("long")


def _narrow(rows: DataFrame, left: DataFrame, shift: int) -> DataFrame:
    """For each source in ``left`` (source, rest): the key range that holds the cut-off, and what is left there."""
    held = rows.groupBy("source", F.floor(F.col("key") / F.lit(1 << shift)).cast("long").alias("span")).agg(F.sum("size").alias("in_span"))
    run = Window.partitionBy("source").orderBy("span")
    joined = held.join(left, held["source"].eqNullSafe(left["s"])).drop("s")
    upto = joined.withColumn("upto", F.sum("in_span").over(run))
    # spans may be empty, so the last one that begins at or before the cut-off is the one
    begun = upto.filter(F.col("upto") - F.col("in_span") <= F.col("rest"))
    last = begun.groupBy("source").agg(F.max_by(F.struct("span", (F.col("rest") - F.col("upto") + F.col("in_span")).alias("rest")), "span").alias("x"))
    return last.select(F.col("source").alias("s"), F.col("x.span").alias("span"), F.col("x.rest").alias("rest"))


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, preference: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole documents taken) and taken (words), a row for each row of df.

    ``preference`` (positive) multiplies a document's residual inclusion odds. ``keep`` passes columns on, each row's own, with ``_in``
    behind names that are results.
    """
    if keep:
        rows, key = by_row(df, text, doc_id, nulls=True)
        mixed = _mix(rows, text, source, doc_id, weights, cap, preference, key).withColumnRenamed("row", "__mixed")
        names = kept_as(keep, OWN)
        return rows.select(F.col(key).alias("__key"), *[F.col(c).alias(n) for c, n in names.items()]).join(mixed, F.col("__key").eqNullSafe(F.col("__mixed"))).select(*OWN, *names.values())
    return _mix(df, text, source, doc_id, weights, cap, preference, doc_id).drop("row")


def _mix(df: DataFrame, text: str, source: str, doc_id: str, weights: tuple[int, ...], cap: int, preference: Column | None, row: str) -> DataFrame:
    """``mix`` with a column ``row`` beside its own."""
    sized = cut(df.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), (F.lit(1.0) if preference is None else preference.cast("double")).alias("preference")))
    goal = cut(targets(sized, weights, cap))
    g = goal.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumns({
        "rest": F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"),
        "p": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("whole")).otherwise(0.0),
    })
    odds = F.greatest(F.col("p"), F.lit(1e-12)) / F.greatest(1.0 - F.col("p"), F.lit(1e-12)) * F.col("preference")
    rows = sized.join(g, sized["source"].eqNullSafe(g["s"])).drop("s").withColumn("key", _key(F.col("doc_id"), odds))
    left = _narrow(rows, g.select("s", "rest"), 36)
    inner = rows.join(left.select("s", F.col("span").alias("at"), F.col("rest").alias("left")), rows["source"].eqNullSafe(F.col("s"))).drop("s")
    near = inner.filter(F.floor(F.col("key") / F.lit(1 << 36)) == F.col("at"))
    fine = cut(_narrow(near, left.select("s", "rest"), 24))
    cutoff = fine.select("s", F.col("span").alias("fine"), F.col("rest").alias("left"))
    placed = rows.join(cutoff, rows["source"].eqNullSafe(F.col("s")), "left").drop("s")
    span = F.floor(F.col("key") / F.lit(1 << 24))
    sure = placed.withColumn("extra", F.when(span < F.col("fine"), 1).when(span == F.col("fine"), F.lit(None).cast("int")).otherwise(0))
    last = Window.partitionBy("source", "fine").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = sure.filter(F.col("extra").isNull()).withColumn("extra", F.when(2 * F.sum("size").over(last) - F.col("size") <= 2 * F.col("left"), 1).otherwise(0))
    both = sure.filter(F.col("extra").isNotNull()).unionByName(edge)
    copies = (F.col("whole") + F.when(F.col("rest") > 0, F.col("extra")).otherwise(0)).cast("long")
    return both.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix with one running sum per source over (documents), as CTEs up to ``mixed``.
ORACLE_CTES = r"""
z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3 * source_size::DOUBLE AS top FROM s),
v AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(top) OVER b, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0::DOUBLE)) AS lvl
      FROM w WINDOW b AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN top < lvl * w THEN top ELSE coalesce(max(CASE WHEN top >= lvl * w THEN lvl END) OVER (), 0::DOUBLE) * w END AS target FROM v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
h AS (SELECT *, target - (whole * source_size)::DOUBLE AS rest, CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0::DOUBLE END AS p FROM g),
u AS (SELECT z.doc_id, z.source, z.size, h.source_size, h.target, h.whole, h.rest,
        greatest(h.p, 1e-12::DOUBLE) / greatest(1 - h.p, 1e-12::DOUBLE) AS odds,
        (('0x' || substr(md5(z.doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
      FROM z JOIN h ON z.source IS NOT DISTINCT FROM h.source),
q AS (SELECT *, u / (1 - u) / odds AS q FROM u),
k AS (SELECT *, floor(q / (1 + q) * 281474976710656::DOUBLE)::BIGINT AS k FROM q),
mixed AS (SELECT *, whole + CASE WHEN rest > 0 AND 2 * sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size <= 2 * rest THEN 1 ELSE 0 END AS copies FROM k)
"""
ORACLE = f"WITH {ORACLE_CTES} SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed"
