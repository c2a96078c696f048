"""Vector code compression: a vector's equal parts are each replaced by the nearest entry of a codebook of that part.

Components become whole numbers (``floor(scale * x)``), so every distance, mean and tie is exact and the same on any cluster.
The nearest entry is found by annular norm pruning: a codebook's entries are kept in order of their norms; the entries
beside a part's own norm give a first best distance d; binary search gives the interval of entries whose norm lies within
d of the part's (by the triangle inequality no other can be as near), both ends included; and only that annulus is evaluated
exactly. All parts of a block of rows are searched together.

A codebook starts as the parts of the first vectors in order of their ids; ``rounds`` times every part is assigned and each
entry becomes the componentwise floor of the mean of its parts. Tasks send one sum per entry and component, summed again by
Spark; the driver sees only these ``entries * dimension`` numbers, whatever the table holds, and codebooks of that size go out
with the code.

Nulls and edges: a vector that is null or holds a null, a NaN or an infinite component is dropped; so is one with a component
of 2^19 or more in size, whose squares would leave 64 bits, and one of another length than the first vector by id. Ties of
ids are ordered by the vectors, null ids come last. Where the length is no multiple of ``parts``, the first parts are one
component longer. With fewer vectors than entries the codebooks have as many entries as there are vectors; an empty table
gives no rows. Further columns are passed on by ``keep``, with ``_in`` behind names that are results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import kept, slices, store, table, trimmed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 2.0**19
#: Rows of a block that is searched at once.
BLOCK = 2048
#: Sums of up to so many labels are sent to all executors; more are joined by a shuffle.
LABELS = 100_000
OWN = ("code", "error")


class Part:
    """The codebook of one part, in order of norms."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(1)
        self.index = np.argsort(squares, kind="stable")
        self.entries = entries[self.index]
        self.norms = np.sqrt(squares[self.index].astype(float))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; of equal distances the lower entry."""
        n, k = len(x), len(self.norms)
        norm = np.sqrt((x * x).sum(1).astype(float))
        at, best = np.searchsorted(self.norms, norm), np.full(n, np.iinfo(np.int64).max)
        for beside in (-2, -1, 0, 1):
            gap = x - self.entries[np.clip(at + beside, 0, k - 1)]
            best = np.minimum(best, (gap * gap).sum(1))
        radius = np.sqrt(best.astype(float))
        radius += 1e-12 * (norm + radius + 1)  # more than what rounding can take away
        low = np.searchsorted(self.norms, norm - radius, "left")
        per = np.searchsorted(self.norms, norm + radius, "right") - low
        upto = np.cumsum(per)
        start = upto - per
        row = np.repeat(np.arange(n), per)
        entry = np.arange(upto[-1]) - np.repeat(start - low, per)
        gap = x[row] - self.entries[entry]
        square = (gap * gap).sum(1)
        least = np.minimum.reduceat(square, start)
        return np.minimum.reduceat(np.where(square == least[row], self.index[entry], k), start), least


@dataclass
class Codebooks:
    """``entries[p]``: the whole-number entries of part p, one row each."""

    entries: list[np.ndarray]
    scale: int = SCALE

    @property
    def dimension(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def sha256(self) -> str:
        """Of all components by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The middle of what a code stands for."""
        return [(v + 0.5) / self.scale for p, e in enumerate(self.entries) for v in e[int(code[2 * p : 2 * p + 2], 16)].tolist()]


def _usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False))), F.lit(False))


def _vectors(df: DataFrame, vector: str, dimension: int | None, *more: Column) -> DataFrame:
    rows = df.select(*more, F.col(vector).cast("array<double>").alias("vector")).filter(_usable(F.col("vector")))
    return rows if dimension is None else rows.filter(F.size("vector") == dimension)


def _whole(vectors: pa.Array, dimension: int, scale: int) -> np.ndarray:
    return np.floor(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dimension) * scale).astype(np.int64)


def _cuts(dimension: int, parts: int) -> list[int]:
    """Where the parts begin, and the end."""
    return [p * (dimension // parts) + min(p, dimension % parts) for p in range(parts + 1)]


def first(df: DataFrame, vector: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks:
    """The parts of the first vectors in order of their ids; at most ``entries`` rows come to the driver."""
    rows = _vectors(df, vector, None, F.col(order).alias("id"))
    by = F.col("id").asc_nulls_last(), F.col("vector")
    one = rows.orderBy(*by).limit(1).collect()
    if not one:
        return Codebooks([np.zeros((0, 0), np.int64)] * parts, scale)
    d = len(one[0]["vector"])
    got = rows.filter(F.size("vector") == d).orderBy(*by).limit(entries).collect()
    whole = np.floor(np.array([r["vector"] for r in got]).reshape(len(got), d) * scale).astype(np.int64)
    cuts = _cuts(d, parts)
    return Codebooks([whole[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)], scale)


def improved(df: DataFrame, books: Codebooks, vector: str = "embedding") -> Codebooks:
    """One round: all parts assigned, and each entry that has some becomes the floor of their mean."""
    d, cuts = books.dimension, _cuts(books.dimension, len(books.entries))
    sizes, scale, entries = [len(e) for e in books.entries], books.scale, books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(e) for e in entries]
        n, total = [np.zeros(k, np.int64) for k in sizes], [np.zeros_like(e) for e in entries]
        for batch in slices(batches, BLOCK):
            x = _whole(batch.column(0), d, scale)
            for p, part in enumerate(parts):
                own = x[:, cuts[p] : cuts[p + 1]]
                entry, _ = part.nearest(own)
                n[p] += np.bincount(entry, minlength=sizes[p])
                np.add.at(total[p], entry, own)
        rows = [(p, e, i, int(n[p][e]), int(total[p][e, i])) for p in range(len(parts)) for e in np.flatnonzero(n[p]).tolist() for i in range(total[p].shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["part", "entry", "at", "n", "total"])

    sums = _vectors(df, vector, d).mapInArrow(trimmed(run), "part bigint, entry bigint, at bigint, n bigint, total bigint")
    whole = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = [e.copy() for e in entries]
    for r in whole.collect():  # one row per entry and component
        new[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return Codebooks(new, scale)


def fit(df: DataFrame, vector: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("a code has one byte a part")
    books = first(df, vector, order, parts, entries, scale)
    for _ in range(rounds if len(books.entries[0]) else 0):
        books = improved(df, books, vector)
    return books


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns of every usable row, ``code`` (two hex digits a part) and ``error`` (the squared distance, in whole numbers)."""
    d, cuts = books.dimension, _cuts(books.dimension, len(books.entries))
    whole, outside = kept(keep, OWN)
    rows = _vectors(df, vector, d, whole)
    entries, scale = books.entries, books.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(e) for e in entries]
        for batch in slices(batches, BLOCK):
            x = _whole(batch.column(1), d, scale)
            code, error = np.zeros((len(x), len(parts)), np.uint8), np.zeros(len(x), np.int64)
            for p, part in enumerate(parts):
                code[:, p], off = part.nearest(x[:, cuts[p] : cuts[p + 1]])
                error += off
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["__kept", *OWN])

    schema = StructType([*rows.select("__kept").schema, *StructType.fromDDL("code string, error bigint")])
    if not len(entries[0]):
        return df.sparkSession.createDataFrame([], schema).select(*outside, *OWN)
    return rows.mapInArrow(trimmed(run), schema).select(*outside, *OWN)


def with_sums(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """df, whose rows are read twice, with the sum of a column over rows of an equal key, nulls together. Sums of up to ``LABELS`` keys
    are broadcast, so that a key with most of the rows stays where it is; beyond, the shuffled join is left to adaptive execution."""
    sums = df.groupBy(F.col(by).alias("__key")).agg(F.sum(value).alias(name))
    if sums.limit(LABELS + 1).count() <= LABELS:
        sums = F.broadcast(sums)
    return df.join(sums, F.col(by).eqNullSafe(F.col("__key"))).drop("__key")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = fit(vectors)
    codes, _ = store(encode(vectors, books, keep=("vec_id", "label")))
    return with_sums(codes, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The table's 64 components as 16 parts of 4; assignments compare all entries."""
    part = ", ".join(f"v[4 * p + {i}] AS x{i}" for i in range(1, 5))
    square = " + ".join(f"(x.x{i} - c.x{i}) * (x.x{i} - c.x{i})" for i in range(1, 5))
    mean = ", ".join(f"coalesce(m.x{i}, c.x{i}) AS x{i}" for i in range(1, 5))
    means = ", ".join(f"CAST(floor(CAST(sum(x{i}) AS DOUBLE) / count(*)) AS BIGINT) AS x{i}" for i in range(1, 5))
    sql = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256e0 * x) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, {part} FROM k, range(16) t(p)),
c0 AS (SELECT r AS e, p, x1, x2, x3, x4 FROM x WHERE r < 64)"""
    for i in range(3):
        sql += f""",
a{i} AS MATERIALIZED (SELECT x.r, x.p, min(({square}) * 64 + c.e) AS best FROM x JOIN c{i} c ON x.p = c.p GROUP BY x.r, x.p)"""
        if i < 2:
            sql += f""",
c{i + 1} AS MATERIALIZED (SELECT c.e, c.p, {mean} FROM c{i} c LEFT JOIN (SELECT a.p, a.best % 64 AS e, {means} FROM a{i} a JOIN x ON x.r = a.r AND x.p = a.p GROUP BY a.p, a.best % 64) m ON m.p = c.p AND m.e = c.e)"""
    return sql + """,
o AS (SELECT r, string_agg(format('{:02x}', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(x1 || ',' || x2 || ',' || x3 || ',' || x4, ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM k JOIN o ON o.r = k.r"""


ORACLE = _oracle()
