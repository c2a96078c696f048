"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its hashed words; the document's is their
noisy-or, 1 - prod(1 - p), so one offending sentence is enough and labels on documents train a scorer of sentences.
Scoring also gives the sentences that stand out, as spans of the text's UTF-8 bytes.

The scorer is fitted on about ``TRAINING_ROWS`` labelled rows (by hash of the text) whose word hashes go to the driver:
bounded, whatever the table holds. Scoring is row-local over whole texts.

Nulls and edges: null and empty texts, and texts without words, score 0; rows without a label do not train; repeated
rows train as often as they occur; without both labels in the training rows every score is 0; further columns are
passed on by ``score(..., keep=...)`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, kept_as, slices, table, trimmed
from .hashing import prefix_hash, range_hash
from .language_id import fold

TRAINING_ROWS = 6_000
#: Beside each word, its first so many bytes are features where it is longer.
PREFIXES = (5, 6, 7)
DIM = 1 << 18
STEPS, RATE, DECAY, LEAST_DOCS, LEAST_Z = 120, 0.05, 0.01, 4, 4.0
THRESHOLD = 0.3

_BYTES = np.arange(256)
_ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_LOW = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_STOP = np.isin(_BYTES, [10, 33, 46, 63])


def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features in sentence order, sentence of each feature, text of each sentence, byte spans of the sentences); sentences have words."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    apart = ~_ALNUM[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], apart])))
    start, end = edge[0::2], edge[1::2]
    h = prefix_hash(_LOW[data])
    stop = np.flatnonzero(_STOP[data])
    of = np.searchsorted(stop, start)
    first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
    sentence = np.cumsum(first) - 1
    features, sentences = [range_hash(h, start, end)], [sentence]
    for k in PREFIXES:
        longer = np.flatnonzero(end - start > k)
        features.append(range_hash(h, start[longer], start[longer] + k) + np.uint64(k))
        sentences.append(sentence[longer])
    feature, sentence = (np.concatenate(features) & np.uint64(DIM - 1)).astype(np.int32), np.concatenate(sentences).astype(np.int32)
    order = np.argsort(sentence, kind="stable")
    feature, sentence = feature[order], sentence[order]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    heads = start[first]
    text = np.searchsorted(begin, heads, side="right") - 1
    spans = np.stack([heads, stop[of[first]]], axis=1) - begin[text][:, None] if len(heads) else np.zeros((0, 2), np.int64)
    return feature, sentence, text, spans


@dataclass
class Scorer:
    weight: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Per text: probability, and (start, end, probability) of sentences at or over the threshold."""
        out, spans = np.zeros(len(texts)), [[] for _ in texts]
        if not np.isfinite(self.bias):
            return out, spans
        for a, b in blocks(texts):
            feature, sentence, text, where = read(texts[a:b])
            if not len(text):
                continue
            z = np.bincount(sentence, self.weight[feature], len(text)) + self.bias
            out[a:b] = 1 - np.exp(-np.bincount(text, np.logaddexp(0, z), b - a))
            p = np.exp(-np.logaddexp(0, -z))
            for i in np.flatnonzero(p >= THRESHOLD):
                spans[a + text[i]].append((int(where[i, 0]), int(where[i, 1]), float(p[i])))
        return out, spans


def fit(feature: np.ndarray, sentence: np.ndarray, text: np.ndarray, label: np.ndarray) -> Scorer:
    """Full-batch Adam on the noisy-or likelihood, from shrunken log odds of the words."""
    n, positive = len(label), float(label.sum())
    if not 0 < positive < n:
        return Scorer(np.zeros(DIM, np.float32), -np.inf)
    pairs = np.unique(text[sentence].astype(np.int64) * DIM + feature)
    doc, word = pairs // DIM, pairs % DIM
    in_all = np.bincount(word, minlength=DIM).astype(float)
    in_positive = np.bincount(word, label[doc].astype(float), DIM)
    rate = positive / n
    odds = np.log((in_positive + rate * 10) / (in_all - in_positive + (1 - rate) * 10)) - np.log(rate / (1 - rate))
    # only features that stand out in positive documents; the rest would fit noise
    active = (in_positive >= LEAST_DOCS) & (in_positive - in_all * rate > LEAST_Z * np.sqrt(in_all * rate * (1 - rate)))
    of_use = active[feature]
    feature, sentence = feature[of_use], sentence[of_use]
    w, b = np.where(active, odds, 0.0) * 2, -6.0
    y = label.astype(float)
    m, v = np.zeros(DIM + 1), np.zeros(DIM + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, w[feature], len(text)) + b
        p = np.exp(-np.logaddexp(0, -z))
        total = np.bincount(text, np.logaddexp(0, z), n)
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
        g = p * pull[text]
        gradient = np.append(np.where(active, np.bincount(feature, g[sentence], DIM), 0.0), g.sum()) / n
        gradient[:-1] += DECAY * w / 100
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        w, b = w - np.where(active, move[:-1], 0), b - move[-1]
    return Scorer(w.astype(np.float32), float(b))


def train(df: DataFrame, text: str = "text", label: str = "label", rows: int = TRAINING_ROWS) -> Scorer:
    """From rows with a text and a 0/1 label; about ``rows`` of them."""
    labelled = df.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    every = max(1, df.filter(F.col(label).isNotNull()).count() // rows)
    sample = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            feature, sentence, text_of, _ = read(texts)
            per = np.bincount(sentence, minlength=len(text_of)) if len(text_of) else np.zeros(0, np.int64)
            words = np.bincount(text_of, per, len(texts)).astype(np.int64)
            upto, s = np.concatenate([[0], np.cumsum(words)]), np.searchsorted(text_of, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([feature[a:b].astype("<u4").tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.binary()), pa.array([per[a:b].astype("<u4").tobytes() for a, b in zip(s[:-1], s[1:], strict=True)], pa.binary()), batch.column(1)],
                ["features", "sizes", "label"],
            )

    got = sample.mapInArrow(trimmed(run), "features binary, sizes binary, label int").toArrow()
    got = got.sort_by([("features", "ascending"), ("label", "ascending")])  # the order of tasks does not matter
    sizes = [np.frombuffer(x, "<u4") for x in got["sizes"].to_pylist()]
    per = np.concatenate(sizes) if sizes else np.zeros(0, np.uint32)
    feature = np.frombuffer(b"".join(got["features"].to_pylist()), "<u4").astype(np.int32)
    text_of = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes]).astype(np.int64)
    return fit(feature, np.repeat(np.arange(len(per), dtype=np.int32), per), text_of, np.array(got["label"].to_pylist(), np.int64))


def score(df: DataFrame, scorer: Scorer, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` (``_in`` behind names of results), score, spans (start, end, p) of offending sentences."""
    shared = df.sparkSession.sparkContext.broadcast(scorer)
    names = kept_as(keep, ("score", "spans"))
    wanted = df.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            p, spans = shared.value.score([t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()])
            spans = [[{"start": a, "end": b, "p": q} for a, b, q in own] for own in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array(spans, span)], [*batch.schema.names[:-1], "score", "spans"])

    return wanted.mapInArrow(trimmed(run), f"{schema}, score double, spans array<struct<start:long,end:long,p:double>>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trusted = labels.filter(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    scorer = train(docs.select("doc_id", "text").join(trusted, "doc_id"))
    out = score(docs, scorer)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_offending"))
