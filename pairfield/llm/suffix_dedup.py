"""Suffix-array dedup of byte strings with difference-cover ranks.

Removes every byte that lies in a ``length``-byte string which also starts anywhere else in the table.

1. Anchors. In each ``length``-byte window the 64-byte string of least hash is an anchor (leftmost on ties). Equal windows
   have the same anchor at the same place, so only windows around anchors that occur twice can repeat; the rest of the
   corpus is never sorted. Anchors are counted over the whole table.
2. Buckets. All occurrences of one anchor, with the bytes around them, form a bucket. A window reaches at least half of what
   it has beside the anchor to one side, so an anchor of more than ``HOT`` occurrences falls into buckets by the bytes of
   that half, one set for either side; equal windows meet in one of them.
3. Suffixes. Buckets are taken in blocks of about ``ROWS`` rows that are laid out alike, anchor under anchor. One pass from
   the right gives the lexicographic order of the suffixes in the columns of a difference cover (mod ``COVER``), which
   alone are kept. Then the suffixes of one column at a time are sorted: by the few bytes up to the next cover column,
   ties by its ranks. Equal windows are neighbours in that order.
4. Starts of repeated windows become spans, merged per text.

Texts that occur as a whole more than once (by SHA-256) need no sorting: if long enough, all of their bytes go. Rows are
known by their texts, not by their ids, so rows that repeat a doc_id are judged each on its own.

Nulls and edges: a null text is empty; texts under ``length`` bytes keep all bytes; a null doc_id makes no difference; an
empty table gives an empty result; further columns are left aside. Neighbours are compared by 64-bit hashes of their
windows, texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut, discard, partitions, slices, store, table, tidy, trimmed
from .hashing import prefix_hash, range_hash

LENGTH, GRAM, COVER, ROWS, HOT = 400, 64, 64, 4096, 4096
#: Bytes of a passage of more than 50 words, shorter than which such a one hardly is: what ``n_passage_bytes`` counts.
PASSAGE = 256
#: A difference cover mod 64: every difference is a multiple of 8 less a number under 8.
SAMPLE = np.array(sorted({*range(8), *range(8, 64, 8)}))
#: Least step from each residue to the cover.
STEP = np.array([next(d for d in range(COVER) if (r + d) % COVER in set(SAMPLE.tolist())) for r in range(COVER)])


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, from minima that run forwards and backwards inside blocks of w."""
    n = len(v)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = v
    grid = full.reshape(-1, w)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def anchors(texts: list[bytes], lengths: tuple[int, ...] = (LENGTH,)) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text, length, places, keys) of the anchors of windows of each length; a text's strings are hashed once for all."""
    for a, b in blocks(texts):
        for i, length, places, keys in _anchors(texts[a:b], lengths):
            yield a + i, length, places, keys


def _anchors(texts: list[bytes], lengths: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < GRAM:
        return
    at = np.arange(len(data) - GRAM + 1)
    key = range_hash(prefix_hash(data), at, at + GRAM)
    # the upper half of a hash decides, of equal ones the first place: so what a window chooses depends on its bytes alone, in any block
    bits = np.uint64(32)
    placed = (key >> bits << bits) | at.astype(np.uint64)
    own = np.repeat(np.arange(len(texts)), sizes)
    for length in lengths:
        if len(data) < length:
            continue
        least = _sliding_min(placed, length - GRAM + 1)
        # windows stay inside one text
        inside = own[: len(least)] == own[length - 1 : length - 1 + len(least)]
        chosen = np.unique(least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        cuts = np.searchsorted(chosen, begin)
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if y > x:
                yield i, length, chosen[x:y] - begin[i], key[chosen[x:y]].view(np.int64)


class CoverRanks:
    """The lexicographic order of suffixes in cover columns, for rows of bytes laid out alike; ``columns`` holds the rows column by column."""

    def __init__(self, columns: np.ndarray, upto: int):
        self.columns = columns
        width, m = columns.shape
        cover = set(SAMPLE.tolist())
        self.order: dict[int, np.ndarray] = {}
        order = np.arange(m, dtype=np.int32)
        for c in range(width - 1, -1, -1):
            # the order behind this column, stably by this column's byte
            order = order[np.argsort(columns[c][order], kind="stable")]
            if c <= upto and c % COVER in cover:
                self.order[c] = order

    def sorted(self, c: int) -> np.ndarray:
        """The rows in the order of their suffixes from column c on: by the bytes before the next cover column, ties by the ranks there."""
        step = int(STEP[c % COVER])
        order = self.order[c + step]
        for k in range(step - 1, -1, -1):
            order = order[np.argsort(self.columns[c + k][order], kind="stable")]
        return order


def repeated_starts(rows: np.ndarray, left: np.ndarray, right: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """[row, column]: whether the window from that column on also stands in another row.

    rows hold ``length - GRAM`` bytes before the anchor and ``length`` from it on, of which left and right are real.
    """
    back = length - GRAM
    out = np.zeros((len(rows), back + 1), bool)
    columns = np.ascontiguousarray(rows.T)
    ranks = CoverRanks(columns, back + COVER)
    r = np.uint64(0x9E3779B97F4A7C15)
    far = np.uint64(pow(int(r), length, 1 << 64))
    window = np.zeros(len(rows), np.uint64)  # hash of each row's window from column c on, carried from right to left
    for c in range(len(columns) - 1, -1, -1):
        window = window * r + columns[c] + np.uint64(1)
        if c + length < len(columns):
            window -= far * (columns[c + length] + np.uint64(1))
        if c > back:
            continue
        order = ranks.sorted(c)
        order = order[((back - c <= left) & (length - back + c <= right))[order]]
        same = np.flatnonzero(window[order[1:]] == window[order[:-1]])
        out[order[same], c] = out[order[same + 1], c] = True
    return out


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, first column, end of the last window) of runs in a boolean grid."""
    padded = np.zeros((starts.shape[0], starts.shape[1] + 2), np.int8)
    padded[:, 1:-1] = starts
    turn = np.diff(padded, axis=1)
    r, a = np.nonzero(turn == 1)
    _, b = np.nonzero(turn == -1)
    return list(zip(r.tolist(), a.tolist(), (b - 1 + length).tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _node(text: Column) -> Column:
    return F.xxhash64(text)


def _docs(df: DataFrame, text: str, length: int) -> DataFrame:
    return df.select(F.col(text).cast("binary").alias("text")).filter(F.octet_length("text") >= length).select(_node(F.col("text")).alias("node"), "text")


def list_anchors(df: DataFrame, text: str, lengths: tuple[int, ...]) -> tuple[DataFrame, str]:
    """(length, key, node, at) as a table, and its path; of equal texts in a task the first."""

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            nodes, texts = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if d not in seen:
                    seen.add(d)
                    nodes.append(d)
                    texts.append(t)
            found = list(anchors(texts, lengths))
            if found:
                n = [len(p) for _, _, p, _ in found]
                columns = [np.repeat(np.array([x[1] for x in found], np.int32), n), np.concatenate([x[3] for x in found]), np.repeat(np.array([nodes[x[0]] for x in found], np.int64), n), np.concatenate([x[2] for x in found]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["length", "key", "node", "at"])

    return store(_docs(df, text, min(lengths)).mapInArrow(trimmed(anchor), "length int, key long, node long, at int"))


def find_spans(df: DataFrame, text: str, length: int, anchored: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """((node, start, end) of repeated runs, unmerged; (node, text) of all texts that may have one; the table that both read).

    A node is a text; ``anchored``: the rows of ``list_anchors``.
    """
    back = length - GRAM
    half = back // 2
    docs = _docs(df, text, length)
    listed = anchored.filter(F.col("length") == length)
    # behind a cut, so that both sides of the join are exchanges, whose hot keys Spark splits
    often = cut(listed.groupBy("key").count().filter("count > 1").select("key", (F.col("count") > HOT).alias("hot")))
    hits = listed.join(often, "key").groupBy("node").agg(F.collect_set(F.struct("at", "key", "hot")).alias("hits"))
    wanted, path = store(docs.join(hits, "node"))

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 32):
            out: tuple[list, ...] = ([], [], [], [], [])

            def add(bucket: int, node: int, at: int, left: int, body: bytes, out=out) -> None:
                for column, value in zip(out, (bucket, node, at, left, body), strict=True):
                    column.append(value)

            for d, t, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if d in seen:
                    continue  # a copy
                seen.add(d)
                for hit in own:
                    p, key = hit["at"], hit["key"]
                    if not hit["hot"]:
                        add(key, d, p, min(p, back), t[max(0, p - back) : p + length])
                        continue
                    after = t[p + GRAM : p + GRAM + back - half]
                    if len(after) == back - half:  # windows that reach so far to the right
                        add(_bucket(key, b"R", after), d, p, min(p, half), t[max(0, p - half) : p + length])
                    if p > half:  # and all others, which reach further to the left
                        add(_bucket(key, b"L", t[p - half - 1 : p]), d, p, min(p, back), t[max(0, p - back) : p + GRAM + back - half - 1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i == 4 else pa.int64()) for i, x in enumerate(out)], ["bucket", "node", "at", "left", "body"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # occurrences with the same bytes around them are sorted once: (bucket, left, bytes) to (node, place, ...)
        kinds: dict[tuple, array] = {}

        def done() -> pa.RecordBatch:
            per_key = Counter(key for key, _, _ in kinds)
            n = len(kinds)
            left = np.fromiter((k[1] for k in kinds), np.int64, n)
            right = np.fromiter((len(k[2]) - k[1] for k in kinds), np.int64, n)
            several = np.fromiter((len(x) > 2 for x in kinds.values()), bool, n)
            column = np.arange(back + 1)
            starts = several[:, None] & (back - column <= left[:, None]) & (length - back + column <= right[:, None])
            mixed = np.array([i for i, k in enumerate(kinds) if per_key[k[0]] > 1], np.int64)
            if len(mixed):
                every = list(kinds)
                grid = np.zeros((len(mixed), back + length), np.uint8)
                for j, i in enumerate(mixed.tolist()):
                    _, own, body = every[i]
                    grid[j, back - own : back - own + len(body)] = np.frombuffer(body, np.uint8)
                starts[mixed] |= repeated_starts(grid, left[mixed], right[mixed], length)
            members = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in kinds.values()]
            d, s, e = [], [], []
            for r, a, b in _runs(starts, length):
                d.append(members[r][:, 0])
                s.append(members[r][:, 1] - back + a)
                e.append(members[r][:, 1] - back + b)
            kinds.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (d, s, e)], ["node", "start", "end"])

        last = None
        for batch in slices(batches, 2048):
            for key, node, at, left, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if len(kinds) >= ROWS and key != last:
                    yield done()
                last = key
                kinds.setdefault((key, left, body), array("q")).extend((node, at))
        if kinds:
            yield done()

    around = wanted.mapInArrow(trimmed(context), "bucket long, node long, at long, left long, body binary")
    dealt = around.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(trimmed(sort), "node long, start long, end long"), wanted.select("node", "text"), path


def _bucket(key: int, side: bytes, beside: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(beside, digest_size=8, key=key.to_bytes(8, "little", signed=True), person=side).digest(), "little", signed=True)


def covered(df: DataFrame, text: str, length: int, anchored: DataFrame) -> DataFrame:
    """(node, n): bytes of a text that lie in strings of ``length`` bytes which also start elsewhere; only texts that have some."""
    spans, _, path = find_spans(df, text, length, anchored)
    per = spans.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))
    none = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate("found", none, lambda a, x: F.struct(F.greatest(a["upto"], x["end"]).alias("upto"), (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["upto"]), F.lit(0).cast("long"))).alias("n")))
    out = cut(per.select("node", total["n"].alias("n")))
    discard(df.sparkSession, path)
    return out


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (start, end; merged), kept_sha256; with ``passage`` also n_passage_bytes, the bytes in repeated strings of that length, which stay."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = cut(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), _node(body).alias("node"), F.sha2(body, 256).alias("sha")))
    copied = base.groupBy("sha").count().filter("count > 1").select(F.col("sha").alias("copied"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], []]
            for d, t, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = merged([(x["start"], x["end"]) for x in found])
                ends = [0, *(x for pair in own for x in pair), len(t)]
                out[0].append(d)
                out[1].append([{"start": a, "end": b} for a, b in own])
                out[2].append(hashlib.sha256(b"".join(t[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], pa.string())], ["node", "spans", "kept"])

    with tidy(df.sparkSession):
        anchored, anchor_path = list_anchors(df, text, (length,) if passage in (None, length) else (length, passage))
        spans, texts, path = find_spans(df, text, length, anchored)
        per = spans.groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("found"))
        judged = texts.join(per, "node").mapInArrow(trimmed(keep), "node long, spans array<struct<start:long,end:long>>, kept string")
        judged = cut(judged.dropDuplicates(["node"]))
        discard(df.sparkSession, path)
        also = None if passage is None else covered(df, text, passage, anchored)
        discard(df.sparkSession, anchor_path)
    rows = base.join(copied, base["sha"] == copied["copied"], "left").join(judged, "node", "left")
    again = lambda n: F.col("copied").isNotNull() & (F.col("n_bytes") >= n)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    out = [
        "doc_id", "n_bytes",
        F.when(again(length), whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))).alias("spans"),
        F.when(again(length), empty).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    ]
    if also is not None:
        rows = rows.join(also, "node", "left")
        out.append(F.when(again(passage), F.col("n_bytes")).otherwise(F.coalesce("n", F.lit(0).cast("long"))).alias("n_passage_bytes"))
    return rows.select(*out)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"), passage=PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_passage_bytes")
