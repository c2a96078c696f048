"""Language identification with interpolated Kneser-Ney character models.

Texts are read as letters, lower-cased and each by its code point, in 16 bits (see ``signs``); other characters become one
blank. Training counts all 4-grams of every labelled row: each task counts its own, Spark sums them by (language, 4-gram).
A 4-gram is a 64-bit key. Lower orders come from the 4-gram types (continuation counts). The model is kept as sorted key
arrays, one per order, with a log probability or back-off weight per language beside each key, and is broadcast; it grows
with the number of different 4-grams of the corpus.

A text gets the language of least cross-entropy per sign. ``score`` is that language's share (softmax of the total
log likelihood, damped to 200 signs). A text is rejected when its cross-entropy is further above the usual one of that
language than nearly all of its labelled texts are, both by the sign and by the sign times the root of the text's length (what
chance adds to a short text shrinks with its length; what another language adds does not), or when it has no letter. The two
bounds are quantiles over all labelled rows and are held out: rows fall into halves by their text, and each half is measured
by the model of the other.

Nulls and edges: a null or empty text, or one without letters, is ``und`` with score 0 and is rejected; ties go to the
language first by code point; repeated rows count as often as they stand in the table; an empty or unlabelled training
set leaves every text ``und``; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut, kept_as, slices, table, trimmed

ORDER, BITS = 4, 16
QUANTILE = 0.999
#: The quantile's rank is exact up to one part in so many of a language's rows.
ACCURACY = 1_000_000


def _alphabet() -> np.ndarray:
    """Sign of each code point: 0 for what is no letter, else the lower-case letter; letters beyond 16 bits share the places of the private use area."""
    out = np.zeros(0x110000, np.uint16)
    # planes 4 to 16 have no letters
    for c in range(0x40000):
        x = chr(c)
        if x.isalpha():
            y = ord(x.lower()[0])
            out[c] = y if y < 1 << 16 else 0xE000 + (y * 40503 >> 3) % 0x1900
    return out


_SIGNS: list[np.ndarray] = []


def signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of signs and the start of each; each text stands between ORDER - 1 blanks and one."""
    if not _SIGNS:
        _SIGNS.append(_alphabet())
    pad = "\n" * (ORDER - 1)
    joined = "".join(f"{pad}{t}\n" for t in texts).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(joined, np.uint32)
    lengths = np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(lengths)])
    all_signs = _SIGNS[0][code]
    # runs of blanks inside a text become one; the blanks before it stay
    drop = np.zeros(len(code), bool)
    drop[1:] = (all_signs[1:] == 0) & (all_signs[:-1] == 0)
    for k in range(ORDER - 1):
        drop[begin[:-1] + k] = False
    keep = ~drop
    kept = np.concatenate([[0], np.cumsum(keep)])
    return all_signs[keep], kept[begin]


def grams(s: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 4-grams that end at each sign after a text's opening blanks, and where each text's begin."""
    x = s.astype(np.uint64)
    key = x.copy()
    for k in range(1, ORDER):
        key[k:] |= x[:-k] << np.uint64(BITS * k)
    inside = np.ones(len(x), bool)
    for k in range(ORDER - 1):
        inside[begin[:-1] + k] = False
    at = np.concatenate([[0], np.cumsum(inside)])
    return key[inside], at[begin]


def count_grams(df: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """(label, half, gram, n) over all rows with a text and a label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, 512):
            labels, halves = (batch.column(i).to_pylist() for i in (1, 2))
            texts = batch.column(0).to_pylist()
            for name in dict.fromkeys(zip(labels, halves, strict=True)):
                mine = [t for t, *own in zip(texts, labels, halves, strict=True) if tuple(own) == name]
                for a, b in blocks(mine):
                    key, _ = grams(*signs(mine[a:b]))
                    u, n = np.unique(key, return_counts=True)
                    if name in total:
                        u, at = np.unique(np.concatenate([total[name][0], u]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([total[name][1], n]), len(u)).astype(np.int64)
                    total[name] = (u, n)
        for (name, part), (u, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array([part] * len(u), pa.int32()), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["label", "half", "gram", "n"])

    rows = _labelled(df, text, label)
    return rows.mapInArrow(trimmed(count), "label string, half int, gram long, n long").groupBy("label", "half", "gram").agg(F.sum("n").alias("n"))


def half(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def _labelled(df: DataFrame, text: str, label: str) -> DataFrame:
    return df.select(F.col(text).alias("text"), F.col(label).alias("label"), half(F.col(text)).alias("half")).dropna()


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """Sorted key arrays by order. ``prob[k]``: log2 probability of the k-gram by language; ``back[k]``: log2 weight of
    the (k-1)-gram context's shorter estimate, by language."""

    languages: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    prob: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    back: dict[int, np.ndarray] = field(default_factory=dict)
    #: Mean cross-entropy by language, and how far above it (times the root of the length) a text may lie.
    usual: np.ndarray | None = None
    room: np.ndarray | None = None
    #: The same bound by the sign.
    least: np.ndarray | None = None

    @classmethod
    def fit(cls, languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """counts: per language the distinct 4-gram keys and how often each occurs."""
        model = cls(languages)
        types = {name: counts.get(name, (np.zeros(0, np.uint64), np.zeros(0))) for name in languages}
        by_order = {ORDER: types}
        for k in range(ORDER - 1, 0, -1):
            # continuation counts: in how many signs' wake a k-gram stands
            mask = np.uint64((1 << BITS * k) - 1)
            by_order[k] = {name: np.unique(key & mask, return_counts=True) for name, (key, _) in by_order[k + 1].items()}
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([by_order[k][name][0] for name in languages] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(keys >> np.uint64(BITS))
            lower = model._score(keys & np.uint64((1 << BITS * (k - 1)) - 1), k - 1)
            prob, back = np.zeros((len(keys), len(languages))), np.zeros((len(contexts), len(languages)))
            for j, name in enumerate(languages):
                key, n = by_order[k][name]
                one, two = (n == 1).sum(), (n == 2).sum()
                d = one / (one + 2 * two) if one and two else 0.5
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, key)] = n
                of = np.searchsorted(contexts, keys >> np.uint64(BITS))
                total = np.bincount(of, c, len(contexts))
                kinds = np.bincount(of, c > 0, len(contexts))
                weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
                back[:, j] = np.log2(np.maximum(weight, 1e-12))
                prob[:, j] = np.log2(np.maximum(c - d, 0) / np.maximum(total, 1)[of] + weight[of] * np.exp2(lower[:, j]))
            model.keys[k], model.prob[k], model.contexts[k], model.back[k] = keys, prob.astype(np.float32), contexts, back.astype(np.float32)
        return model

    def _score(self, keys: np.ndarray, k: int) -> np.ndarray:
        """log2 probability of each k-gram's last sign after the signs before it, by language."""
        if k == 0:
            return np.full((len(keys), len(self.languages)), -float(BITS), np.float32)
        at, known = _find(self.keys[k], keys)
        if known.all():
            return self.prob[k][at]
        out = np.empty((len(keys), len(self.languages)), np.float32)
        out[known] = self.prob[k][at[known]]
        rest = keys[~known]
        shorter = self._score(rest & np.uint64((1 << BITS * (k - 1)) - 1), k - 1)
        at, known_context = _find(self.contexts[k], rest >> np.uint64(BITS))
        if known_context.any():
            shorter[known_context] += self.back[k][at[known_context]]
        out[~known] = shorter
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: cross-entropy in bits per sign by language, signs, letters."""
        h, signs_in, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for a, b in blocks(texts):
            s, begin = signs(texts[a:b])
            key, start = grams(s, begin)
            # sums by differences of running sums, as a text may have no sign at all
            letters[a:b] = np.diff(np.concatenate([[0], np.cumsum(s > 0)])[begin])
            running = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self._score(key, ORDER), axis=0, dtype=np.float64)])
            signs_in[a:b] = np.diff(start)
            h[a:b] = -np.diff(running[start], axis=0) / np.maximum(signs_in[a:b, None], 1)
        return h, signs_in, letters


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per text: language or ``und``, score, rejected."""
    h, n, letters = model.entropy([t or "" for t in texts])
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    best = h.argmin(axis=1)
    nats = -h * np.minimum(n, 200)[:, None] * np.log(2)
    nats -= nats.max(axis=1, keepdims=True)
    share = np.exp(nats)
    share /= share.sum(axis=1, keepdims=True)
    rows = np.arange(len(texts))
    none = letters == 0
    rejected = none.copy()
    if model.usual is not None:
        over = h[rows, best] - model.usual[best]
        rejected |= (over * np.sqrt(n) > model.room[best]) & (over > model.least[best])
    return ["und" if x else model.languages[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, share[rows, best]), rejected


def train(df: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Counts and the rejection threshold, both over all labelled rows."""
    rows = count_grams(df, text, label).toArrow()
    names, parts = np.array(rows["label"].to_pylist(), object), rows["half"].to_numpy()
    gram, n = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    languages = sorted(set(names))

    def counted(of: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for name in languages:
            own = of & (names == name)
            u, at = np.unique(gram[own], return_inverse=True)
            out[name] = u, np.bincount(at, n[own], len(u)).astype(np.int64)
        return out

    model = Model.fit(languages, counted(np.ones(len(n), bool)))
    shared = df.sparkSession.sparkContext.broadcast([Model.fit(languages, counted(parts != k)) for k in (0, 1)])

    def excess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, of = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            own = np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)
            h, n = np.zeros(len(own)), np.zeros(len(own), np.int64)
            for k, other in enumerate(shared.value):
                mine = np.flatnonzero(of == k)
                each, n[mine], _ = other.entropy([texts[i] for i in mine])
                h[mine] = each[np.arange(len(mine)), own[mine]]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(h), pa.array(n)], ["own", "h", "n"])

    seen = cut(_labelled(df, text, label).mapInArrow(trimmed(excess), "own long, h double, n long"))
    model.usual, model.room, model.least = (np.full(len(languages), np.inf) for _ in range(3))
    # one row a language each
    for r in seen.groupBy("own").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("usual")).collect():
        model.usual[r["own"]] = r["usual"] if r["usual"] is not None else np.inf
    usual = F.get(F.array(*map(F.lit, model.usual.tolist())), F.col("own").cast("int"))
    over = F.col("h") - usual
    for r in seen.groupBy("own").agg(F.percentile_approx(over * F.sqrt("n"), QUANTILE, ACCURACY).alias("room"), F.percentile_approx(over, QUANTILE, ACCURACY).alias("least")).collect():
        model.room[r["own"]], model.least[r["own"]] = max(r["room"], 1.0), max(r["least"], 0.1)
    shared.unpersist()
    return model


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` (``_in`` behind names of results), lang_pred, score, rejected. Row-local."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = kept_as(keep, ("lang_pred", "score", "rejected"))
    wanted = df.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            name, score, rejected = judge(shared.value, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return wanted.mapInArrow(trimmed(run), f"{schema}, lang_pred string, score double, rejected boolean")


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold(F.col("doc_id"), 3) != 1))
    out = predict(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
