import hashlib
import math
import random

import numpy as np
import pytest

from pairfield.llm import vector_codes as V


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract in whole numbers, entry by entry."""
    kept = sorted([r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])], key=lambda r: r[0])
    whole = [[math.floor(256 * x) for x in r[1]] for r in kept]
    w = len(whole[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got, strict=True) if g[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = {}
    for r, c in zip(kept, cut, strict=True):
        best = [nearest(p, c[p]) for p in range(parts)]
        out[r[0]] = "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def rows_of(rng, n, d=32):
    rows = [(i * 3, [rng.choice([rng.gauss(0, 1), rng.randrange(-2, 3) / 2]) for _ in range(d)], rng.choice([None, 1, 2])) for i in range(n)]
    bad = [(1000, None, 1), (1001, [None] * d, 1), (1002, [float("nan")] + [0.0] * (d - 1), 1), (1003, [0.0] * (d - 1) + [float("-inf")], None)]
    return rows + bad + [(2000, rows[5][1], 7)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [150, 20])
def test_codes_against_all_entries(spark, n):
    rows = rows_of(random.Random(n), n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    want, digest = plain(rows)
    books = V.fit(df)
    codes = V.encode(df, books, keep=("vec_id", "label"))
    assert {r["vec_id"]: (r["code"], r["error"]) for r in codes.collect()} == want and books.sha256() == digest
    sums = V.with_sums(codes, "label", "error", "label_error").collect()
    assert len(sums) == len(want)
    for r in sums:
        assert r["label_error"] == sum(e for i, (_, e) in want.items() if next(x[2] for x in rows if x[0] == i) == r["label"])
    one = next(iter(want))
    vector = next(r[1] for r in rows if r[0] == one)
    off = sum((math.floor(256 * a) + 0.5 - 256 * b) ** 2 for a, b in zip(vector, books.decode(want[one][0]), strict=True))
    assert off == pytest.approx(want[one][1])


def test_annulus_is_exact_with_ties_and_large_numbers():
    rng = np.random.default_rng(3)
    for top in (2, 300, 1 << 27):
        entries, x = rng.integers(-top, top, (64, 4)), rng.integers(-top, top, (500, 4))
        entries[10], entries[40] = entries[3], -entries[3]
        square = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        entry, least = V.Part(entries).nearest(x)
        assert (entry == square.argmin(1)).all() and (least == square.min(1)).all()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert V.encode(empty, V.fit(empty), keep=("vec_id",)).count() == 0
    rows = [(None, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0, 3.0], 1), (4, [0.0, 0.0, 0.0], 2), (6, [1.0], 2), (7, [], 2), (8, [1e30, 0.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, code string, error int")
    out = V.encode(df, V.fit(df), keep=(*df.columns,))
    assert out.count() == 4 and len(set(out.columns)) == len(out.columns)
    assert {r["error"] for r in out.collect()} == {0} and V.with_sums(out, "label", "error", "label_error").count() == 4
    with pytest.raises(ValueError):
        V.fit(df, entries=300)
