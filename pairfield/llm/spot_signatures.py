"""Document fingerprints by spot signatures, and their comparison.

A word of a text is a maximal run of ASCII letters and digits and of bytes from 128 on, with A-Z in lower case. Common words
of a list are anchors, all others are content. Each anchor gives one signature: the anchor and the next ``chain`` content
words, wherever they stand behind it. What a page adds around a text has few anchors, so signatures follow the prose; an edit
changes only those whose chain it touches. A text without anchors takes every word as one; a text with words but without a
whole chain has its word sequence as its only signature. A fingerprint is the text's set of signatures as 48-bit hashes, in
ascending order, eight base-64 signs each: equal texts have equal fingerprints.

Likeness is the Jaccard similarity of two sets, or 1 of two empty ones. Where only likeness of at least ``least`` is asked for,
sets are told apart without looking at them by their lengths, and while they are merged, as soon as too many signatures of
either have gone by without a partner. ``near_pairs`` finds all such pairs of a table: sets are put into partitions by length,
so that only sets of one partition and the next one down can be near; within these, sets meet in the lists of their rarest
signatures (as many as a near set cannot miss all of), and candidates that also pass the filter by position are merged.

``against_next`` compares every text with the next one in descending order of ids and with an edit that takes its last third from
there. Rows are dealt by ranges of ids, each range in one task in order, with the first row of the next range as a guest; a task
holds two texts at a time. The bounds of the ranges are quantiles of the ids, as many as shuffle partitions.

Nulls and edges: a null text counts as empty; empty texts and texts without words have the empty fingerprint; null ids come after all
others, rows of one id in order of a hash of their texts; the last row is followed by the first, a single row by itself.
``keep`` passes columns on, with ``_in`` behind names that are results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import blocks, kept, partitions, slices, table, trimmed
from .hashing import mix, prefix_hash, range_hash

#: Common words of English, German, French and Spanish: a parameter of every function here.
ANCHORS = tuple(
    (
        "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
        "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich im in ist mit nach nicht oder sich sie sind und von vor war werden wie wird zu zum zur "
        "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qui que sa se ses son sont sur un une vous "
        "al como con de del el en entre era es esta este fue ha la las lo los más no o para pero por que se ser sin sobre su sus también un una y ya"
    ).split()
)
CHAIN, LEAST = 2, 0.8
_MASK = np.uint64((1 << 48) - 1)
_BYTES = np.arange(256)
_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_LOW = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_STEP = np.uint64(0x9FB21C651E98DF25)
OWN = ("n_signatures", "fingerprint")
PAIR = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures bigint"


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts in a row, and the text of each."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], ~_WORD[data]])))
    start, end = edge[0::2], edge[1::2]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return range_hash(prefix_hash(_LOW[data]), start, end), np.searchsorted(begin, start, "right") - 1


def anchor_hashes(anchors: tuple[str, ...] = ANCHORS) -> np.ndarray:
    return np.unique(_word_hashes([w.encode() for w in anchors])[0])


def signatures(texts: list[bytes], anchors: np.ndarray, chain: int = CHAIN) -> list[np.ndarray]:
    """Per text its set of signatures, ascending."""
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        out += _signatures(texts[a:b], anchors, chain)
    return out


def _signatures(texts: list[bytes], anchors: np.ndarray, chain: int) -> list[np.ndarray]:
    word, text = _word_hashes(texts)
    n = len(texts)
    common = anchors[np.minimum(np.searchsorted(anchors, word), len(anchors) - 1)] == word if len(anchors) else np.zeros(len(word), bool)
    some = np.bincount(text[common], minlength=n) > 0
    content = np.flatnonzero(~common)
    spot = np.flatnonzero(common | ~some[text])
    at = np.searchsorted(content, spot, "right")
    h, whole = word[spot], np.ones(len(spot), bool)
    for k in range(chain):
        to = at + k
        there = to < len(content)
        place = content[np.minimum(to, len(content) - 1)] if len(content) else np.zeros(len(spot), np.int64)
        whole &= there & (text[place] == text[spot])
        h = mix(h * _STEP + word[place])
    h, of = h[whole] & _MASK, text[spot[whole]]
    begin, first = np.searchsorted(of, np.arange(n + 1)), np.searchsorted(text, np.arange(n + 1))
    out = []
    for i in range(n):
        own = np.unique(h[begin[i] : begin[i + 1]])
        if not len(own) and first[i] < first[i + 1]:
            x = np.zeros(1, np.uint64)
            for k in range(first[i], first[i + 1]):
                x = mix(x * _STEP + word[k : k + 1])
            own = x & _MASK
        out.append(own)
    return out


def packed(signatures_: np.ndarray) -> str:
    return base64.b64encode(signatures_.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(six), 2), np.uint8), six], axis=1).view(">u8").ravel().astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard similarity of two ascending sets; 0 if it is less than ``least``.

    The merge goes by stretches: what the stretches of both sets had no partner for bounds the sets' overlap from above.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b) - 1e-9:
        return 0.0
    need, met = least / (1 + least) * (len(a) + len(b)) - 1e-9, 0
    step = 256 if least else len(a)
    for k in range(0, len(a), step):
        part = a[k : k + step]
        met += int((b[np.minimum(np.searchsorted(b, part), len(b) - 1)] == part).sum())
        if met + len(a) - k - len(part) < need:
            return 0.0
    out = met / (len(a) + len(b) - met)
    return out if out >= least else 0.0


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Per row: the kept columns, ``n_signatures`` and ``fingerprint``."""
    whole, outside = kept(keep, OWN)
    rows = df.select(whole, F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = anchor_hashes(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = signatures(batch.column(1).cast(pa.binary()).to_pylist(), known, chain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([packed(s) for s in sets], pa.string())], ["__kept", *OWN])

    schema = StructType([*rows.select("__kept").schema, *StructType.fromDDL("n_signatures bigint, fingerprint string")])
    return rows.mapInArrow(trimmed(run), schema).select(*outside, *OWN)


def length_partition(n: Column, least: float = LEAST) -> Column:
    """Sets whose lengths are within ``least`` of one another have the same number or neighbouring ones."""
    if least == 1:
        return n.cast("int")
    return F.floor(F.log(n.cast("double")) / F.lit(-float(np.log(least))) + F.lit(1e-9)).cast("int")


def near_pairs(prints: DataFrame, least: float = LEAST, fingerprint: str = "fingerprint") -> DataFrame:
    """(a, b, near): pairs of different fingerprints with likeness of ``least`` or more, each once; the empty one is near to none.

    Equal fingerprints are one: join the table with the pairs to have its rows. Each set is listed in its own length partition and
    visits the next one up.
    """
    if not 0 < least <= 1:
        raise ValueError("the least likeness is over 0 and at most 1")
    sets = prints.select(F.col(fingerprint).alias("f")).filter("f <> ''").distinct().select(F.md5("f").alias("id"), "f", (F.length("f") / 8).cast("int").alias("n"))
    rows = sets.select("id", "n", F.explode(F.expr("transform(sequence(0, n - 1), i -> substring(f, 8 * i + 1, 8))")).alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("often"))
    by_rarity = Window.partitionBy("id").orderBy("often", "s")
    ranked = rows.join(often, "s").withColumn("at", F.row_number().over(by_rarity))
    # what a set of n can lose and still be near: its first n - ceil(least * n) + 1 signatures meet those of every near set
    prefix = ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1).withColumn("k", length_partition(F.col("n"), least))
    home = prefix.select("s", "k", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    visit = prefix.select("s", F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("to"), F.col("k").alias("k_b"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    met = home.join(visit.withColumnRenamed("to", "k"), ["s", "k"]).filter("k_b < k OR a < b")
    need = F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9)
    in_length = (F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - F.lit(1e-9)) & (1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= need)
    # the filter by position holds where two sets first meet; a later meeting of the same pair may fail it
    pairs = met.groupBy("a", "b").agg(F.min_by(F.struct("n_a", "n_b", "at_a", "at_b"), "at_a").alias("m")).select("a", "b", "m.*").filter(in_length).select("a", "b")
    print_of = lambda c: sets.select(F.col("id").alias(c), F.col("f").alias(f"f_{c}"))
    pairs = pairs.join(print_of("a"), "a").join(print_of("b"), "b").select(F.col("f_a").alias("a"), F.col("f_b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            near = [likeness(unpacked(a), unpacked(b), least) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.float64())], ["a", "b", "near"])

    return pairs.mapInArrow(trimmed(run), "a string, b string, near double").filter("near > 0")


def _dealt(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text, bucket, guest): rows by ranges of descending ids, and in each range the first row of the next one as a guest."""
    n = partitions(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    inner = [i / n for i in range(1, n)]
    got = rows.agg(F.percentile_approx("doc_id", inner, max(10_000, 20 * n)).alias("q")).first()["q"] if inner else []
    bounds = sorted(set(got or []))
    # a range for each bound and one above; null ids come after the least
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(bucket).cast("int")
    rows = rows.withColumn("bucket", bucket)
    top = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect()  # one row a range
    if not top:
        return rows.select("doc_id", "text", "bucket", F.lit(False).alias("guest"))
    order = sorted(r["bucket"] for r in top)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    heads = df.sparkSession.createDataFrame([(r["doc_id"], before[r["bucket"]]) for r in top], "head long, host int")
    guests = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
    guests = guests.groupBy("doc_id", "host").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    guests = guests.select("doc_id", F.col("least.text").alias("text"), F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    every = rows.select("doc_id", "text", "bucket", F.lit(False).alias("guest")).unionByName(guests)
    return every.repartitionById(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def against_next(df: DataFrame, text: str = "text", doc_id: str = "doc_id", anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Per row its fingerprint and that of its edit, and its likeness to the edit and to the next text; ids are whole numbers."""
    known = anchor_hashes(anchors)

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        """Rows (doc_id, text, set, guest), each but the last followed by its next one."""
        done = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3]]
        edits = []
        for a, b in done:
            m = len(a[1]) // 3
            edits.append((a[1][: len(a[1]) - m] + b[1][:m]).encode())
        sets = signatures(edits, known, chain)
        columns = [
            pa.array([a[0] for a, _ in done], pa.int64()), pa.array([len(a[1]) for a, _ in done], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
            pa.array([packed(a[2]) for a, _ in done], pa.string()), pa.array([packed(s) for s in sets], pa.string()),
            pa.array([likeness(a[2], s) for (a, _), s in zip(done, sets, strict=True)], pa.float64()), pa.array([likeness(a[2], b[2]) for a, b in done], pa.float64()), pa.array([len(a[2]) for a, _ in done], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *[c.split()[0] for c in PAIR.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in slices(batches, 64):
            texts = batch.column(1).to_pylist()
            rows = last + list(zip(batch.column(0).to_pylist(), texts, signatures([t.encode() for t in texts], known, chain), batch.column(3).to_pylist(), strict=True))
            last = rows[-1:]
            yield pairs(rows)

    return _dealt(df, text, doc_id).mapInArrow(trimmed(run), f"doc_id bigint, {PAIR}")


def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(table(spark, sf_dir, "documents"))
