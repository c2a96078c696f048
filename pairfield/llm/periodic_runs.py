"""Periodic runs of words: maximal stretches that repeat with a period, at least ``fold`` times and ``least`` words long.

A text's words become whole numbers, and the array is compared with itself at every lag up to a ``fold``-th of its length:
true stretches of ``ids[i] == ids[i + lag]`` are the runs of that lag. A run that is long enough keeps the comparison true
for ``need`` places, so each lag is first looked at on every ``need / 2``-th place only, where such a stretch has to leave
two neighbouring hits; all lags between two powers of two share a step and are compared as one matrix. Hits are then
followed place by place to both ends of their stretch. A text of n words costs about n log n comparisons instead of n^2.

A stretch's smallest period divides its lag (the stretch is at least twice as long), so it is found by dividing the lag by
its prime factors, and the same run met at several lags is one run.

Texts whose comparisons exceed ``cells`` are dealt out: Spark spreads (text, range of lags) rows over the executors, each
range finds its runs on its own, and the runs of a text are united by its hash. Shorter texts are done where they are read,
without a shuffle.

Nulls and edges: a null or empty text has no words and no runs, and its collapsed text is empty; repeated rows have equal
results; overlapping runs each drop their words after the first period. ``keep`` passes columns on, with ``_in`` behind a
name that is one of the results. Bytes that are no white space are part of words, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import kept, partitions, slices, table, trimmed, words

LEAST, FOLD = 24, 3
#: Most comparisons of a task's row; a text that needs more is dealt out by ranges of lags.
CELLS = 1 << 17
#: Cells of a matrix of comparisons in memory.
MATRIX = 1 << 20
RUN = "struct<start: bigint, length: bigint, period: bigint>"
OWN = ("n_words", "runs", "collapsed")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(tokens: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, tokens, count()), np.int32, len(tokens))


def lag_blocks(n: int, least: int = LEAST, fold: int = FOLD) -> list[tuple[int, int, int]]:
    """(first lag, lag after the last, step): a run of any lag of the block leaves two neighbouring hits at this step; at step 0 one hit at any place."""
    out, a, top = [], 1, n // fold
    b = 2 * -(-least // fold)
    while a <= top and n >= least:
        need = min(max(least - p, (fold - 1) * p) for p in {a, b - 1, min(max(least // fold, a), b - 1), min(max(-(-least // fold), a), b - 1)})
        out.append((a, min(b, top + 1), need // 2))
        a, b = b, 2 * b
    return out


def lag_ranges(n: int, cells: int = CELLS, least: int = LEAST, fold: int = FOLD) -> list[tuple[int, int]]:
    """All lags of a text of n words, in ranges of at most about ``cells`` comparisons."""
    out, start, used = [], 1, 0
    for a, b, step in lag_blocks(n, least, fold):
        each = -(-n // max(step, 1))
        while a < b:
            more = max(1, min(b - a, (cells - used) // each))
            if used and used + each > cells:
                out.append((start, a))
                start, used = a, 0
                continue
            a, used = a + more, used + more * each
    return [*out, (start, max(start + 1, n // fold + 1))]


def _stretch(ids: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The range around ``at`` in which every place equals the one a lag later."""
    n = len(ids) - lag
    start = end = at
    size = 64
    while end < n:
        m = min(size, n - end)
        same = ids[end : end + m] == ids[end + lag : end + lag + m]
        k = int(same.argmin())
        if not same[k]:
            end += k
            break
        end, size = end + m, size * 2
    size = 64
    while start > 0:
        m = min(size, start)
        same = (ids[start - m : start] == ids[start + lag - m : start + lag])[::-1]
        k = int(same.argmin())
        if not same[k]:
            start -= k
            break
        start, size = start - m, size * 2
    return start, end


def _smallest(ids: np.ndarray, start: int, end: int, period: int) -> int:
    left, f = period, 2
    while left > 1:
        f = left if f * f > left else f
        if left % f:
            f += 1
            continue
        left //= f
        shorter = period // f
        if np.array_equal(ids[start : end - shorter], ids[start + shorter : end]):
            period = shorter
    return period


def scan(ids: np.ndarray, low: int = 1, high: int | None = None, least: int = LEAST, fold: int = FOLD) -> set[tuple[int, int, int]]:
    """Runs (start, end, smallest period) that show at a lag in [low, high)."""
    n = len(ids)
    high = n if high is None else high
    found: set[tuple[int, int, int]] = set()
    padded = np.concatenate([ids, np.full(n + 1, -1, ids.dtype)])
    item = padded.itemsize
    for a, b, step in lag_blocks(n, least, fold):
        a, b = max(a, low), min(b, high)
        if a >= b:
            continue
        here = ids[: n - a : max(step, 1)]
        rows = max(1, MATRIX // len(here))
        for c in range(a, b, rows):
            m = min(rows, b - c)
            there = np.lib.stride_tricks.as_strided(padded[c:], (m, len(here)), (item, item * max(step, 1)))
            same = there == here
            lag, at = np.nonzero(same[:, :-1] & same[:, 1:] if step else same)
            lag, at = lag + c, at * max(step, 1)
            for s, e, q in found:
                if len(lag):
                    open_ = (lag % q != 0) | (at < s) | (at + lag >= e)
                    lag, at = lag[open_], at[open_]
            i = 0
            while i < len(lag):
                p = int(lag[i])
                s, e = _stretch(ids, p, int(at[i]))
                e += p
                if e - s < max(least, fold * p):
                    i += 1
                    continue
                q = _smallest(ids, s, e, p)
                found.add((s, e, q))
                open_ = (lag % q != 0) | (at < s) | (at + lag >= e)
                open_[: i + 1] = False
                lag, at, i = lag[open_], at[open_], 0
    return found


def finish(tokens: list[bytes], runs: set[tuple[int, int, int]]) -> tuple[list[dict], bytes]:
    """Runs in order, and the words that no run repeats, joined by spaces."""
    if not runs:
        return [], b" ".join(tokens)
    keep = np.ones(len(tokens), bool)
    for s, e, q in runs:
        keep[s + q : e] = False
    ordered = sorted((s, q, e) for s, e, q in runs)
    return [{"start": s, "length": e - s, "period": q} for s, q, e in ordered], b" ".join([tokens[i] for i in np.flatnonzero(keep)])


def _rows(batch: pa.RecordBatch, done: list[tuple[int, list[dict], bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(_RUN)), pa.array([d[2] for d in done], pa.binary()).cast(pa.string())],
        ["__kept", *OWN],
    )


def _short(cells: int, least: int, fold: int) -> int:
    """Texts of fewer characters have no more than ``cells`` comparisons."""
    n = 2
    while sum((b - a) * -(-2 * n // max(s, 1)) for a, b, s in lag_blocks(2 * n, least, fold)) <= cells:
        n *= 2
    return 2 * n


def find_runs(df: DataFrame, text: str | Column = "text", keep: tuple[str, ...] = (), least: int = LEAST, fold: int = FOLD, cells: int = CELLS) -> DataFrame:
    """Per row: the kept columns, ``n_words``, ``runs`` by start and period, and ``collapsed``, the text without what runs repeat."""
    if least < 1 or fold < 2:
        raise ValueError("a run has a word and two periods at least")
    whole, outside = kept(keep, OWN)
    rows = df.select(whole, (F.col(text) if isinstance(text, str) else text).alias("text"))
    far = F.length("text") >= _short(cells, least, fold)
    schema = StructType([*rows.select("__kept").schema, *StructType.fromDDL(f"n_words bigint, runs array<{RUN}>, collapsed string")])

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                tokens = (t or b"").split()
                done.append((len(tokens), *finish(tokens, scan(numbered(tokens), least=least, fold=fold))))
            yield _rows(batch, done)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            key, tokens = batch.column(0)[0].as_py(), batch.column(1).cast(pa.binary())[0].as_py().split()
            ids = numbered(tokens).tobytes()
            for low, high in lag_ranges(len(tokens), cells, least, fold):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([ids], pa.binary())], ["key", "low", "high", "ids"])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            key, low, high, ids = (c[0].as_py() for c in batch.columns)
            got = [{"start": s, "length": e - s, "period": q} for s, e, q in scan(np.frombuffer(ids, np.int32), low, high, least, fold)]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.string()), pa.array(got, _RUN)], ["key", "run"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            done = []
            for t, runs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = t.split()
                done.append((len(tokens), *finish(tokens, {(r["start"], r["start"] + r["length"], r["period"]) for r in runs or ()})))
            yield _rows(batch, done)

    near = rows.filter(F.coalesce(~far, F.lit(True))).mapInArrow(trimmed(at_once), schema)
    long = rows.filter(far).withColumn("key", F.sha2("text", 256))
    parts = long.select("key", "text").dropDuplicates(["key"]).mapInArrow(trimmed(dealt), "key string, low bigint, high bigint, ids binary")
    runs = parts.repartition(4 * partitions(df.sparkSession), "key", "low").mapInArrow(trimmed(ranged), f"key string, run {RUN}")
    runs = runs.distinct().groupBy("key").agg(F.collect_list("run").alias("runs"))
    far_rows = long.join(runs, "key", "left").select("__kept", "text", "runs").mapInArrow(trimmed(united), schema)
    return near.unionByName(far_rows).select(*outside, *OWN)


def repeating(text: Column, doc_id: Column) -> Column:
    """A stated edit of one text in ten: from some word on, the words repeat with some period (words a to a + p, over and over)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def edited(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        cycle = F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int"))
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, F.lit(1), a.cast("int")), F.slice(F.flatten(cycle), F.lit(1), (n - a).cast("int"))))

    # a variable of a lambda is split into words once; a column would be at each mention
    return F.when(h % 10 == 0, F.coalesce(F.transform(F.array(words(text)), edited)[0], text)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeating(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(docs, "text", ("doc_id",))
    # runs come by start and period, so the first of equal exponents has the smallest start, then period
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.reduce("runs", F.lit(None).cast(RUN), better)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words"
    )


#: Equal words of a text are joined by their distance; islands of neighbouring places are stretches, and of those of one range the least distance is the period.
ORACLE = r"""
WITH crc AS (SELECT doc_id, text, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::UBIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS c FROM documents),
t AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(c, 4294967295::UBIGINT)::BIGINT END AS h,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM crc),
a AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
e AS MATERIALIZED (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM d),
s AS (SELECT x.r, x.i, y.i - x.i AS lag FROM e x JOIN e y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 3),
g AS (SELECT r, lag, min(i) AS start, max(i) + 1 + lag AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS k FROM s) GROUP BY r, lag, k),
u AS MATERIALIZED (SELECT r, start, stop - start AS length, min(lag) AS period FROM g WHERE stop - start >= greatest(24, 3 * lag) GROUP BY r, start, stop),
b AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
o AS (SELECT x.* FROM u x WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.r = x.r AND (y.length * x.period > x.length * y.period OR y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period)))),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = e.r AND e.i >= u.start + u.period AND e.i < u.start + u.length) GROUP BY r)
SELECT d.doc_id, coalesce(b.n_runs, 0) AS n_runs, o.start, o.length, o.period, o.length * 1000 // o.period AS exponent_milli,
    sha256(coalesce(b.lines, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256, d.n AS n_words
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN o ON o.r = d.r LEFT JOIN k ON k.r = d.r
"""
