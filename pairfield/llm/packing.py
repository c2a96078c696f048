"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of token ids. Service goes in cycles of one window's worth of ids: in every cycle a queue may send its
quantum, its share of all ids; what a quantum leaves as a fraction of an id stays as the queue's deficit for the next
cycle. After c cycles queue s has sent floor(c * T_s / C) ids, C cycles in all, so the deficits need no running state:
where an id goes follows from its place in its queue, on any executor, and deficits carry over windows and partitions
alike. A queue whose quantum is under ``least`` ids sends about that many at once: it has one turn in k cycles, of k quanta. Such
queues take turns in different cycles, and to begin with each has credit for the cycles between its first turn and the k-th
cycle, so that every cycle sends a window's worth. So documents of small sources
are not cut into single ids, however many sources there are, and a window is off its proportions by no more than ``least`` ids
a source. Windows are cut off this service order every ``size`` ids; the ids after the last full window make sequences
whose lengths are powers of two, so nothing is padded.

With target weights a queue's quantum is its weight's share among the queues that still hold ids. The service then falls
into phases, one for each time a queue runs empty; each phase is served as above, with what its queues send in it for T_s.
Without weights every queue lasts to the end and there is one phase.

Two passes: ids are made once and cut to the shared folder by chunk (a task's rows); then each chunk gets the places
at which its part of each queue begins (one row per chunk and queue; Spark broadcasts it only below its size threshold
and else joins by shuffle), and cuts its own documents into pieces. Documents are not gathered by source, so a hot source
is spread like any other.

Every source has a queue of its own, at any number of sources. The names and totals of the queues, one of each a source,
are gathered and broadcast; the sums over all queues are made for blocks of cycles, so that they stay in a few MB.

Nulls and edges: a null text is empty and gives the closing id alone; a null source is a source of its own; repeated
rows are packed as often as they occur; an empty table gives no pieces; further columns are left aside.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, trimmed
from .tokens import encoder

SIZE, CLOSING = 4096, 2
#: Ids that a queue of a small source gathers before it sends.
LEAST = 64
#: Numbers (queues times cycles) that a block of a document's cycles may hold.
BLOCK = 1 << 19
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def encode(df: DataFrame, path: str, text: str = "text", source: str = "source", doc_id: str = "doc_id", closing: int = CLOSING) -> DataFrame:
    """(chunk, queue, start, n, doc_id, source, ids): start is the document's place in its queue within the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sent = TaskContext.get().partitionId(), defaultdict(int)
        own = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                ids = [np.append(x, np.uint32(closing)) for x in own.encode([t or "" for t in batch.column(2).to_pylist()])]
                queue = [known.value[s] for s in batch.column(1).to_pylist()]
                start = []
                for q, x in zip(queue, ids, strict=True):
                    start.append(sent[q])
                    sent[q] += len(x)
                # 16 bits an id where the vocabulary allows
                packed = [(x.astype(np.uint16) if x.max() < 65536 else x).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(ids), pa.int32()), pa.array(queue, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                    ["chunk", "queue", "start", "n", "doc_id", "source", "ids"],
                )

    names = df.select(F.col(source).cast("string").alias("source")).distinct().orderBy("source").collect()  # one row a source
    known = df.sparkSession.sparkContext.broadcast({r["source"]: i for i, r in enumerate(names)})
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(run), "chunk int, queue int, start long, n long, doc_id long, source string, ids binary")


def phases(totals: list[int], weights: list[int] | None) -> list[list[int]]:
    """Per phase, what each queue sends in it."""
    if weights is None:
        return [list(totals)]
    out, left = [], list(totals)
    while any(left):
        time = min(Fraction(n, w) for n, w in zip(left, weights, strict=True) if n)
        sends = [min(n, int(w * time)) for n, w in zip(left, weights, strict=True)]
        out.append(sends)
        left = [n - x for n, x in zip(left, sends, strict=True)]
    return out


class Phase:
    """The service order of queues that send ``totals`` ids."""

    def __init__(self, totals: list[int], size: int, least: int = LEAST):
        self.total = sum(totals)
        self.cycles = max(1, min(-(-self.total // size), 1 << 31))
        self.totals = totals
        t = np.array(totals, np.int64)[:, None]
        self.whole, self.part = t // self.cycles, t % self.cycles
        #: A queue has a turn in one cycle of so many, and how far its turns are moved against those of others.
        self.every = np.clip(-(-least * self.cycles // np.maximum(t, 1)), 1, self.cycles)
        self.moved = np.arange(len(totals))[:, None] % self.every

    def sent(self, cycle: np.ndarray, queue: int | slice = slice(None)) -> np.ndarray:
        """Ids sent by each queue (rows) before each cycle (columns); exact in 64 bits, as cycles are at most 2^31."""
        k, o = self.every[queue], self.moved[queue]
        # cycles that the queue's turns so far have served; in the last cycle everything goes
        served = np.where(cycle >= self.cycles, self.cycles, np.minimum((cycle + o) // k * k, self.cycles))
        return self.whole[queue] * served + self.part[queue] * served // self.cycles

    def runs(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(begin in the queue, place in the service order, length) of what is sent of [start, start + n)."""
        t, k, o = self.totals[queue], int(self.every[queue, 0]), int(self.moved[queue, 0])
        # the cycles whose quanta hold the first and the last id, and the turns that send them
        first, last = ((start + 1) * self.cycles - 1) // t, ((start + n) * self.cycles - 1) // t
        turn = np.arange(first // k + 1, last // k + 2)
        # the turns rise, so only those at the end can fall together
        cycle = turn * k - o - 1
        if cycle[-1] >= self.cycles:
            cycle = np.append(cycle[cycle < self.cycles - 1], self.cycles - 1)
        if k == 1 and (len(cycle) + 1) * len(self.totals) <= BLOCK:
            # cycles in a row: what each ends with, the next begins with
            sent = self.sent(np.append(cycle, cycle[-1] + 1))
            own, then = sent[queue, :-1], sent[queue, 1:]
            begin, end = np.maximum(own, start), np.minimum(then, start + n)
            place = sent[:queue, 1:].sum(axis=0) + sent[queue:, :-1].sum(axis=0) + begin - own
            return ((b, p, e - b) for b, p, e in zip(begin.tolist(), place.tolist(), end.tolist(), strict=True) if e > b)
        own, then = self.sent(cycle, queue), self.sent(cycle + 1, queue)
        begin, end = np.maximum(own, start), np.minimum(then, start + n)
        sends = end > begin
        cycle, begin, end, skipped = cycle[sends], begin[sends], end[sends], begin[sends] - own[sends]
        place = np.empty(len(cycle), np.int64)
        step = max(1, BLOCK // len(self.totals))
        for a in range(0, len(cycle), step):
            c = cycle[a : a + step]
            before, behind = self.sent(c), self.sent(c + 1)
            place[a : a + step] = before.sum(axis=0) + (behind[:queue] - before[:queue]).sum(axis=0)
        return zip(begin.tolist(), (place + skipped).tolist(), (end - begin).tolist(), strict=True)


class Service:
    """Where ids of queues that hold ``totals`` ids go."""

    def __init__(self, totals: list[int], size: int, weights: list[int] | None = None, least: int = LEAST):
        self.size, self.total = size, sum(totals)
        #: Per phase: what each queue has sent before it, and the place at which it begins.
        self.phases: list[tuple[Phase, list[int], int]] = []
        before, place = [0] * len(totals), 0
        for sends in phases(totals, weights):
            self.phases.append((Phase(sends, size, least), before, place))
            before, place = [x + y for x, y in zip(before, sends, strict=True)], place + sum(sends)
        self.full = self.total // size
        rest = self.total % size
        # the ids after the last full window: sequences of falling powers of two
        self.tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tail_begins = [self.full * size + sum(self.tail[:i]) for i in range(len(self.tail))]

    def pieces(self, queue: int, start: int, n: int) -> list[tuple[int, int, int, int]]:
        """(begin in the queue, length, sequence, offset) of a document's pieces."""
        runs: list[list[int]] = []
        for phase, before, began in self.phases:
            a, b = max(start, before[queue]), min(start + n, before[queue] + phase.totals[queue])
            if a >= b:
                continue
            for at, place, length in phase.runs(queue, a - before[queue], b - a):
                at, place = at + before[queue], place + began
                if runs and runs[-1][1] + runs[-1][2] == place and runs[-1][0] + runs[-1][2] == at:
                    runs[-1][2] += length
                else:
                    runs.append([at, place, length])
        out: list[tuple[int, int, int, int]] = []
        for at, place, left in runs:
            while left:
                seq, off, room = self.window(place)
                had = min(room, left)
                out.append((at, had, seq, off))
                at, place, left = at + had, place + had, left - had
        return out

    def window(self, place: int) -> tuple[int, int, int]:
        """(sequence, offset, ids left in the sequence) of a place in the service order."""
        w, off = divmod(place, self.size)
        if w < self.full:
            return w, off, self.size - off
        for i, (a, k) in enumerate(zip(self.tail_begins, self.tail, strict=True)):
            if place < a + k:
                return self.full + i, place - a, a + k - place
        raise ValueError("place after the last id")


def cut_pieces(chunks: DataFrame, size: int = SIZE, weights: dict[str | None, int] | None = None) -> DataFrame:
    """The pieces of encoded documents; chunks as ``encode`` gives them, behind a cut."""
    held = chunks.groupBy("chunk", "queue").agg(F.sum("n").alias("held"), F.first("source").alias("source"))
    run_up = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(held.withColumn("base", F.coalesce(F.sum("held").over(run_up), F.lit(0))))
    per = base.groupBy("queue").agg(F.sum("held").alias("t"), F.first("source").alias("source")).collect()  # one row a source
    sums, names = {r["queue"]: r["t"] for r in per}, {r["queue"]: r["source"] for r in per}
    queues = range(max(sums, default=0) + 1)
    own = None if weights is None else [weights.get(names.get(q), 1) for q in queues]
    if own is not None and min(own) <= 0:
        raise ValueError("weights must be positive")
    totals = chunks.sparkSession.sparkContext.broadcast(([sums.get(q, 0) for q in queues], own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = Service(totals.value[0], size, totals.value[1])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, source, queue, start, n, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                for at, length, seq, off in service.pieces(queue, start, n):
                    a = at - start
                    rows.append((doc_id, a, length, zlib.crc32(ids[a : a + length]), n, seq, off, source))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 7 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    placed = chunks.join(base.drop("held", "source"), ["chunk", "queue"]).select("doc_id", "source", "queue", (F.col("start") + F.col("base")).alias("start"), "n", "ids")
    return placed.mapInArrow(trimmed(run), PIECES)


def pack(df: DataFrame, path: str, size: int = SIZE, weights: dict[str | None, int] | None = None) -> DataFrame:
    """All documents of df as pieces of sequences of at most ``size`` ids.

    ``weights`` (whole numbers; 1 for sources without one) are the windows' target proportions for as long as the sources
    last; by default the proportions are those of the whole table.
    """
    return cut_pieces(cut(encode(df, path)), size, weights)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path()).drop("source")
