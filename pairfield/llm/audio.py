"""Chroma audio fingerprints of a media column, and the alignment of recordings.

A recording (binary, unsigned 8-bit mono PCM) is cut into overlapping frames; each frame's spectrum is folded into 12
pitch classes. Over the image of frames and pitch classes, 16 filters compare sums of rectangles, read off an integral
image; each answer becomes two bits (Gray code), so every position gives one packed 32-bit code.

Alignment: two codes vote for the offset between them if at most ``VOTE_BITS`` of their bits differ; such codes have three of
five fields in common, by which they are found. Per query and recording the voted offsets form a histogram, and each of them is
judged by the bit errors over its whole overlap, of which the first half is enough to turn most away; among those within the bound the one with most equal bits is taken. An
overlap within the bound is missed only if none of its codes is that near. Against brute force over all offsets 127 of 139
alignments of texts read as sound were found (0.91; three bits would find 137, but one pair of codes in a few thousand is as
near by chance); the tests measure recall on noisy copies.
Queries are taken in blocks of a fixed number of codes, each an index that is broadcast
and meets all recordings. Recordings with equal codes are one class, which is compared once; the result carries its size.

The tables of this library's tests hold no audio, so the query reads each document's UTF-8 bytes as PCM. As in any search
here, the rows whose id is divisible by 100 are the queries, against all rows.

Nulls and edges: a null or empty recording, or one under 16 frames, has no codes and matches nothing; a null id is left
out; equal votes take the smallest offset; repeated rows are copies; an empty table gives no matches; further columns
are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, trimmed

RATE, FRAME, HOP, SPAN = 8000, 256, 64, 16
MOST_BIT_ERRORS, LEAST_OVERLAP = 0.15, 8
#: (kind, pitch class, height, width): by rule, so that kinds, places and sizes all vary.
FILTERS = tuple((k % 6, (5 * k) % 8, 1 + k % 4, (4, 8, 12, 16)[k * 7 % 4]) for k in range(16))
LEVELS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def _fold() -> np.ndarray:
    """[bin, pitch class] for bins from 60 Hz up."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12))
    heard = f >= 60
    note = np.round(12 * np.log2(np.maximum(f, 1) / 440)).astype(int) % 12
    out[np.flatnonzero(heard), note[heard]] = 1
    return out


_FOLD, _HANN = _fold(), np.hanning(FRAME)


#: Steps of a chroma value of 1: images are whole numbers, so sums over them are exact and do not depend on what else is summed.
STEPS = 1 << 20


def chroma(sounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The frames of all recordings, [frame, pitch class], each of unit length in STEPS; and the number of frames of each recording."""
    count = np.array([max(0, (len(s) - FRAME) // HOP + 1) for s in sounds], np.int64)
    image = np.zeros((int(count.sum()), 12), np.int64)
    data = np.concatenate([*sounds, np.zeros(0, np.uint8)]) if sounds else np.zeros(0, np.uint8)
    size = np.array([len(s) for s in sounds], np.int64)
    begin = np.cumsum(size) - size
    number = np.arange(len(image)) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(begin, count) + number * HOP
    for a in range(0, len(starts), 2048):
        frames = data[starts[a : a + 2048, None] + np.arange(FRAME)].astype(np.float64) - 128
        spectrum = np.fft.rfft(frames * _HANN, axis=1)
        classes = (spectrum.real**2 + spectrum.imag**2) @ _FOLD
        image[a : a + 2048] = np.rint(classes * (STEPS / np.maximum(np.sqrt((classes**2).sum(axis=1, keepdims=True)), 1e-6)))
    return image, count


def codes(image: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Per recording one packed code per position that has SPAN frames from it on."""
    positions = np.maximum(count - SPAN + 1, 0)
    upto = np.cumsum(positions)
    n = int(upto[-1]) if len(upto) else 0
    total = np.zeros((len(image) + 1, 13), np.int64)
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n) + np.repeat(np.cumsum(count) - count - (upto - positions), positions)

    def area(x: int, w: int, y: int, h: int) -> np.ndarray:
        return (total[t + x + w, y + h] - total[t + x, y + h] - total[t + x + w, y] + total[t + x, y]) / STEPS

    out = np.zeros(n, np.uint32)
    for k, (kind, y, h, w) in enumerate(FILTERS):
        whole = area(0, w, y, h)
        if kind == 0:  # a band against all pitch classes
            a, b = whole * 12 / h, area(0, w, 0, 12)
        elif kind == 1:  # upper against lower half band
            a, b = area(0, w, y + h // 2, h - h // 2), area(0, w, y, max(h // 2, 1))
        elif kind == 2:  # later against earlier half
            a, b = area(w // 2, w - w // 2, y, h), area(0, w // 2, y, h)
        elif kind == 3:  # middle third against the rest
            a = area(w // 3, w // 3, y, h) * 3
            b = (whole - a / 3) * 1.5
        elif kind == 4:  # crossed quarters
            a = area(0, w // 2, y, h) + area(w // 2, w - w // 2, (y + 4) % 9, h)
            b = area(w // 2, w - w // 2, y, h) + area(0, w // 2, (y + 4) % 9, h)
        else:  # a band against its neighbour
            a, b = whole, area(0, w, (y + 3) % 9, h)
        answer = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        out |= GRAY[np.digitize(answer, LEVELS)] << np.uint32(2 * k)
    return np.split(out.view(np.int32), upto[:-1]) if len(upto) else []


def fingerprints(df: DataFrame, audio: str, doc_id: str) -> DataFrame:
    """(doc_id, codes) per recording. Row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = codes(*chroma([np.frombuffer(x or b"", np.uint8) for x in batch.column(1).to_pylist()]))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], ["doc_id", "codes"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(audio).cast("binary").alias("audio"))
    return rows.mapInArrow(trimmed(run), "doc_id long, codes array<int>")


#: Bits in which codes that vote may differ; three of five fields are equal then.
VOTE_BITS = 2
#: (first bit, bits) of the fields of a code, and all choices of three: a key has 18 to 20 bits, so chance brings few codes together.
FIELDS = ((0, 6), (6, 6), (12, 6), (18, 7), (25, 7))
KEYS = tuple(combinations(FIELDS, 3))
#: Codes of a block of queries, and numbers that are handled at once, so that they stay in the processor's cache.
QUERY_CODES, AT_ONCE = 1 << 22, 1 << 16


def _ragged(counts: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Parts of rows with about AT_ONCE items in all: (the rows, each item's row in the part, its number in the row)."""
    upto = np.cumsum(counts)
    a = 0
    while a < len(counts):
        before = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, before + AT_ONCE, side="right")))
        n = counts[a:b]
        of = np.repeat(np.arange(b - a), n)
        yield slice(a, b), of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        a = b


def _twos(codes: np.ndarray) -> np.ndarray:
    """Each code with the one behind it."""
    behind = np.append(codes[1:], np.zeros(min(1, len(codes)), np.uint32))
    return codes.astype(np.uint64) | behind.astype(np.uint64) << np.uint64(32)


def _errors(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number of different bits of x[a : a + n] and y[b : b + n], two codes at a time."""
    out = np.zeros(len(n), np.int64)
    odd = np.flatnonzero(n % 2)
    out[odd] = np.bitwise_count(x[(a + n - 1)[odd]] ^ y[(b + n - 1)[odd]])
    xx, yy = _twos(x), _twos(y)
    for part, of, k in _ragged(n // 2):
        differ = np.bitwise_count(xx[a[part][of] + 2 * k] ^ yy[b[part][of] + 2 * k])
        out[part] += np.bincount(of, differ, part.stop - part.start).astype(np.int64)
    return out


class QueryIndex:
    """The codes of a block of queries, sorted by each three of their fields."""

    def __init__(self, codes: list[np.ndarray]):
        self.size = np.array([len(c) for c in codes], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        self.query = np.repeat(np.arange(len(codes)), self.size)
        self.tables = []
        for fields in KEYS:
            key = self.key(self.codes, fields)
            order = np.argsort(key, kind="stable")
            self.tables.append((order.astype(np.int32), np.searchsorted(key[order], np.arange((1 << sum(bits for _, bits in fields)) + 1)).astype(np.int32)))

    @staticmethod
    def key(codes: np.ndarray, fields: tuple[tuple[int, int], ...]) -> np.ndarray:
        out = np.zeros(len(codes), np.int64)
        for first, bits in fields:
            out = out << bits | (codes >> np.uint32(first)) & np.uint32((1 << bits) - 1)
        return out

    def histogram(self, rows: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, offset), each once, that pairs of codes with at most ``most`` different bits vote for."""
        size = np.array([len(r) for r in rows], np.int64)
        start = np.cumsum(size) - size
        codes, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
        far = int(self.size.max(initial=0))
        span = far + int(size.max()) + 1
        found = [np.zeros(0, np.int64)]
        for fields, (order, begins) in zip(KEYS, self.tables, strict=True):
            key = self.key(codes, fields)
            for part, at, k in _ragged((begins[key + 1] - begins[key]).astype(np.int64)):
                j = order[begins[key[part]][at] + k]
                near = np.bitwise_count(codes[part][at] ^ self.codes[j]) <= most
                i, j = at[near] + part.start, j[near]
                q = self.query[j]
                offset = i - start[of[i]] - j + self.start[q]
                found.append(np.unique((of[i] * len(self.size) + q) * span + offset + far))
        every = np.unique(np.concatenate(found))
        both, offset = every // span, every % span - far
        return both // len(self.size), both % len(self.size), offset

    def align(self, rows: list[np.ndarray], most_errors: float, least_overlap: int) -> tuple[np.ndarray, ...]:
        """(row, query, offset, votes, overlap, errors) of each pair's best offset within the bound."""
        row, query, offset = self.histogram(rows, VOTE_BITS)
        size = np.array([len(r) for r in rows], np.int64)
        start, codes = np.cumsum(size) - size, np.concatenate(rows)
        a, b = np.maximum(offset, 0), np.maximum(-offset, 0)
        overlap = np.minimum(size[row] - a, self.size[query] - b)
        long = overlap >= least_overlap
        row, query, offset, overlap, a, b = (x[long] for x in (row, query, offset, overlap, a, b))
        a, b = a + start[row], b + self.start[query]
        # the first half of an overlap has no more errors than all of it: most offsets end there
        half = overlap // 4 * 2
        errors = _errors(codes, self.codes, a, b, half)
        good = errors / (overlap * 32) <= most_errors
        row, query, offset, overlap, errors, a, b, half = (x[good] for x in (row, query, offset, overlap, errors, a, b, half))
        errors = errors + _errors(codes, self.codes, a + half, b + half, overlap - half)
        good = errors / (overlap * 32) <= most_errors
        row, query, offset, overlap, errors = (x[good] for x in (row, query, offset, overlap, errors))
        votes = overlap * 32 - 2 * errors
        order = np.lexsort((offset, -votes, query, row))
        order = order[(np.diff(row[order], prepend=-1) != 0) | (np.diff(query[order], prepend=-1) != 0)]
        return tuple(x[order] for x in (row, query, offset, votes, overlap, errors))


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of recordings with about 2^15 codes."""
    a = n = 0
    for i, s in enumerate(sizes.tolist()):
        n += s
        if n >= 1 << 15 or i + 1 == len(sizes):
            yield a, i + 1
            a, n = i + 1, 0


def search(prints: DataFrame, is_query, most_errors: float = MOST_BIT_ERRORS, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """(query_id, doc_id, copies, offset, votes, overlap, bit_error): classes that align with the class of a query.

    query_id and doc_id are the smallest ids of the classes (query_id: among the queries); a class does not match itself.
    """
    spark = prints.sparkSession
    coded = prints.filter(F.col("doc_id").isNotNull() & (F.size("codes") > 0)).withColumn("sign", F.sha2(F.array_join("codes", ","), 256))
    classes = coded.groupBy("sign").agg(F.min("doc_id").alias("doc_id"), F.min(F.when(is_query, F.col("doc_id"))).alias("query_id"), F.count("*").alias("copies"), F.first("codes").alias("codes"))
    classes = cut(classes.filter(F.size("codes") >= least_overlap).drop("sign"))
    asked = classes.filter("query_id is not null").select("query_id", F.col("doc_id").alias("own"), "codes")
    held = asked.agg(F.sum(F.size("codes"))).first()[0] or 0
    blocks = -(-held // QUERY_CODES)
    # every class meets all queries of a block: dealt out evenly, not by size of the files
    spread = classes.select("doc_id", "copies", "codes").repartition(4 * spark.sparkContext.defaultParallelism)
    schema = "query_id long, doc_id long, copies long, offset int, votes long, overlap int, bit_error double"
    out = None
    for block in range(max(blocks, 1)):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1))) == block).toArrow()  # about QUERY_CODES codes
        queries = tuple(rows[x].to_numpy() for x in ("query_id", "own")), [np.asarray(x.values).view(np.uint32) for x in rows["codes"]]
        shared = spark.sparkContext.broadcast((queries[0], QueryIndex(queries[1])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (query_id, own), index = shared.value
            for batch in batches:
                doc, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                codes = [np.asarray(x.values).view(np.uint32) for x in batch.column(2)]
                for a, b in _parts(np.array([len(x) for x in codes])):
                    if not len(index.size):
                        continue
                    row, q, at, votes, overlap, errors = index.align(codes[a:b], most_errors, least_overlap)
                    other = doc[row + a] != own[q]
                    row, q, at, votes, overlap, errors = (v[other] for v in (row + a, q, at, votes, overlap, errors))
                    found = [query_id[q], doc[row], copies[row], at.astype(np.int32), votes, overlap.astype(np.int32), errors / (overlap * 32)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["query_id", "doc_id", "copies", "offset", "votes", "overlap", "bit_error"])

        part = spread.mapInArrow(trimmed(run), schema)
        out = part if out is None else out.union(part)
    return out


#: A class with one row of so many is sent to where its rows are; there are at most as many such classes.
HOT = 200


def _to_rows(rows: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Rows with what is known of their class. Classes with much of the table are broadcast, at most ``HOT``, so that no task has all rows of
    one; all others are joined by a shuffle."""
    columns = [c for c in known.columns if c not in ("sign", "held")]
    large = known.filter(F.col("held") * HOT >= n)
    held = rows.join(F.broadcast(large.select("sign", F.struct(*columns).alias("large"))), "sign", "left")
    here = held.filter("large IS NOT NULL").select("doc_id", "n_codes", "large.*")
    rest = held.filter("large IS NULL").drop("large").join(known.filter(F.col("held") * HOT < n), "sign", "left").select("doc_id", "n_codes", *columns)
    out = here.unionByName(rest)
    return out.select("doc_id", "n_codes", "class_id", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), *[F.col(f"b.{c}").alias(c) for c in ("query_id", "offset", "overlap", "bit_error")], F.coalesce("partners", F.array()).alias("partners"))


def op4_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_codes, class_id (smallest id of equal codes), the query class it aligns with best, if any, and
    ``partners``: every query class it aligns with, by id."""
    prints = cut(fingerprints(table(spark, sf_dir, "documents"), "text", "doc_id"))
    found = search(prints, F.col("doc_id") % 100 == 0)
    best = found.groupBy("doc_id").agg(F.min(F.struct("bit_error", "query_id", "offset", "overlap")).alias("b"), F.count("*").alias("n_queries"), F.array_sort(F.collect_list(F.struct("query_id", "offset", "votes", "overlap", "bit_error"))).alias("partners"))
    rows = prints.select("doc_id", F.size("codes").cast("long").alias("n_codes"), F.when(F.size("codes") > 0, F.sha2(F.array_join("codes", ","), 256)).alias("sign"))
    classes = rows.filter("sign is not null").groupBy("sign").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("held"))
    # what a class has found is joined to it first, and then goes to its rows
    known = cut(classes.join(best.withColumnRenamed("doc_id", "class_id"), "class_id", "left"))
    return _to_rows(rows, known, rows.count())
