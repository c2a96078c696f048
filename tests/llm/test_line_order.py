from pyspark.sql import functions as F

from pairfield.llm import line_dedup


def test_order_of_words_counts_every_line(spark, monkeypatch):
    """The order that the join uses is counted on all lines of all documents."""
    n = 400
    df = spark.createDataFrame([(i, f"a{i} b{i}\nc{i}") for i in range(n)], "doc_id long, text string")
    seen = []
    levels_of = line_dedup.levels_of

    def watched(hashed):
        out = levels_of(hashed)
        seen.append(out.select(F.size(F.filter("levels", lambda x: x > 0)).alias("n")).first()["n"])
        return out

    monkeypatch.setattr(line_dedup, "levels_of", watched)
    assert line_dedup.later_matches(df).count() == 0
    # 1200 words in 2^20 buckets, of which hardly two share one
    assert len(seen) == 1 and seen[0] > 1190


def test_words_of_a_line_are_kept_and_counted_once(spark):
    """What a line repeats is neither stored nor counted again, and words are counted where they are unfolded, not behind a union."""
    df = spark.createDataFrame([(1, "a b a a b"), (2, "a a"), (3, "c")], "doc_id long, text string")
    hashed = line_dedup.hashes(df, "text", "doc_id")
    assert {r["doc_id"]: len(r["h"]) for r in hashed.collect()} == {1: 2, 2: 1, 3: 1}
    plan = line_dedup.levels_of(hashed)._jdf.queryExecution().executedPlan().toString().splitlines()
    (union,), (words,) = ([i for i, x in enumerate(plan) if name in x] for name in (" Union", "Generate explode(h"))
    assert any("partial_count" in x for x in plan[union:words])
    # two lines have a, one each b and c
    levels = line_dedup.levels_of(hashed).select(F.filter("levels", lambda x: x > 0).alias("x")).first()["x"]
    assert sorted(x >> 56 for x in levels) == [4, 4, 6]
