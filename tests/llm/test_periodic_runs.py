import random

from pyspark.sql import functions as F

from pairfield.llm import periodic_runs as R


def brute(w, least=24, fold=3):
    """All lags, place by place; of stretches with the same ends the least lag is the period."""
    n, ends = len(w), {}
    for p in range(1, n // fold + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, fold * p):
                ends.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return {(s, e, p) for (s, e), p in ends.items()}


def text_of(rng, n, k):
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randrange(3)):
        a, p, m = rng.randrange(n), rng.randrange(1, 60), rng.randrange(20, 300)
        for i in range(a + p, min(n, a + m)):
            w[i] = w[i - p]
    return w


def test_scan_against_all_lags():
    rng = random.Random(5)
    for _ in range(400):
        w = text_of(rng, rng.randrange(1, 240), rng.choice([1, 2, 3, 5, 30]))
        least, fold = rng.choice([(24, 3), (24, 3), (10, 2), (5, 4), (1, 2)])
        ids, want = R.numbered([x.encode() for x in w]), brute(w, least, fold)
        assert R.scan(ids, least=least, fold=fold) == want
        ranges = R.lag_ranges(len(w), rng.choice([50, 300]), least, fold)
        assert ranges[0][0] == 1 and ranges[-1][1] > len(w) // fold and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        assert set().union(*[R.scan(ids, a, b, least, fold) for a, b in ranges]) == want


def test_dealt_ranges_and_single_tasks_agree(spark):
    rng = random.Random(6)
    texts = [text_of(rng, rng.randrange(1, 700), rng.choice([2, 5, 40])) for _ in range(40)]
    texts += [texts[3]] * 3 + [["same"] * 3000]
    df = spark.createDataFrame([(i, "\n".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for cells in (64, R.CELLS):
        got = {r["doc_id"]: r for r in R.find_runs(df, keep=("doc_id",), cells=cells).collect()}
        assert len(got) == len(texts)
        for i, w in enumerate(texts):
            want = brute(w)
            assert [(r["start"], r["start"] + r["length"], r["period"]) for r in got[i]["runs"]] == sorted(want, key=lambda r: (r[0], r[2]))
            gone = {j for s, e, p in want for j in range(s + p, e)}
            assert got[i]["collapsed"] == " ".join(x for j, x in enumerate(w) if j not in gone) and got[i]["n_words"] == len(w)


def test_odd_rows(spark, odd, empty):
    out = R.find_runs(odd, keep=(*odd.columns,), cells=1000)
    rows = out.collect()
    assert len(rows) == 8 and len(set(out.columns)) == len(out.columns) and "n_words_in" in out.columns
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["n_words"] == of[2]["n_words"] == 0 and of[1]["runs"] == [] and of[1]["collapsed"] == ""
    assert [tuple(r) for r in of[3]["runs"]] == [(0, 18000, 6)] and of[3]["collapsed"] == "the cat sat on the mat"
    assert R.find_runs(empty, keep=("doc_id",)).count() == 0


def test_the_stated_edit(spark):
    import zlib

    ids = [0, 6, 29, 31, 37, 55, None, 114, 214]
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(3 + (i or 0)))) for i in ids], "doc_id long, text string")
    for r in df.select("doc_id", "text", R.repeating(F.col("text"), F.col("doc_id")).alias("new")).collect():
        w, h = r["text"].split(), 1 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        assert r["new"] == " ".join(w)
