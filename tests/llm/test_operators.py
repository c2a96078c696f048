import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairfield.llm import audio, language_id, licenses, line_dedup, mixing, ngram_join, packing, quality_rules, registry, suffix_dedup, toxicity
from pairfield.llm.hashing import shingles

SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def mutated(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(f"select * from ({registry.oracle_sql()[name]})").df()
    got = registry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda d: d.astype(object).where(d.notna(), None).map(lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v).sort_values(want.columns[0]).reset_index(drop=True)
    assert key(got).equals(key(want))


def test_odd_rows(spark, odd, empty):
    for df, n in ((odd, 8), (empty, 0)):
        assert quality_rules.ledger(df).count() == n
        assert mixing.mix(df).count() == n
        assert licenses.scan(df, licenses.token_order(df)).count() == n
        model = language_id.train(df)
        rows = language_id.predict(df, model)
        assert {r["lang_pred"] for r in rows.collect() if r["doc_id"] in (1, 2, 6)} <= {"und"}
        assert ngram_join.join(df).count() == n
        assert suffix_dedup.dedup(df).count() == n
        assert line_dedup.drop_lines(df).count() == n
        scorer = toxicity.train(df.withColumn("label", F.lit(None).cast("int")))
        assert {r["score"] for r in toxicity.score(df, scorer).collect()} <= {0.0}
        audio.search(audio.fingerprints(df, "text", "doc_id"), F.col("doc_id") % 2 == 0).collect()
        assert packing.pack(df, packing.default_path()).select("doc_id", "start").count() >= n


def test_names_that_clash_are_passed_on(spark, odd, empty):
    names = tuple(odd.columns)
    for df in (odd, empty):
        scorer = toxicity.train(df.withColumn("label", F.lit(1)))
        for out in (quality_rules.ledger(df, keep=names), licenses.scan(df, licenses.token_order(df), keep=names), language_id.predict(df, language_id.train(df), keep=names), toxicity.score(df, scorer, keep=names)):
            rows = out.collect()
            assert len(out.columns) == len(set(out.columns)) and len(rows) == df.count()
            for r in rows:
                r = r.asDict()
                assert r.get("n_words_in", r["n_words"]) == 7 and r["__t"] == "t" and r.get("score_in", r["score"]) == 1.0 and r.get("lang_pred_in", r["lang_pred"]) == "l" and r.get("places_in", r["places"]) == 9


def test_ngram_join_by_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(6):  # chains of near copies, so that components are wider than links
        w = [f"w{rng.randrange(500)}" for _ in range(rng.choice((12, 80, 300)))]
        for _ in range(12):
            texts.append(" ".join(w))
            w = mutated(rng, w, rng.choice((0, 1, 2)))
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(20)] + ["a b", "a b", ""]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs_of(spark, texts), k=4, percent=85).collect()}
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_ngram_join_pages_give_links_not_pairs(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for size in (120, 30, 1):  # groups of near copies that no hub has settled, in one block
        w = [f"w{rng.randrange(10**6)}" for _ in range(160)]
        texts += [" ".join(mutated(rng, w, rng.choice((1, 2)))) for _ in range(size)]
    sets = shingles([x.encode() for x in texts], 4)
    band = max(b for b, _ in ngram_join._bands(157, 85))
    rows = [(i, band, len(s), ngram_join.count_vector(s, band).tobytes(), s.view(np.int64).tolist()) for i, s in enumerate(sets)]
    sets_of = spark.createDataFrame(rows, "node long, band int, n long, vector binary, s array<long>")
    open_rows = spark.createDataFrame([(band, i, band, i) for i in range(len(sets))], "content long, node long, band int, label long")
    want = [{j for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))} for x in sets]
    for size in (ngram_join.PAGE_BYTES, 1 << 14):  # in one page and in many
        monkeypatch.setattr(ngram_join, "PAGE_BYTES", size)
        pages = ngram_join._pages(open_rows, sets_of)
        found = [(r["a"], r["b"]) for r in ngram_join._probe(pages, 85).collect()]
        assert len(found) < len(texts) * pages.select("page").distinct().count()
        assert all(b in want[a] for a, b in found)
        group = list(range(len(texts)))
        for a, b in found:
            group = [group[a] if x == group[b] else x for x in group]
        assert all(group[i] == group[j] for i, x in enumerate(want) for j in x) and len(set(group)) > 1
        met = {(r["content"], r["node"]) for r in ngram_join._near(ngram_join._pages(open_rows, sets_of, "vector"), 85).collect()}
        clusters = defaultdict(set)
        for c, i in met:
            clusters[i].add(c)
        assert all(clusters[i] & clusters[j] for i, x in enumerate(want) for j in x - {i})


def test_count_tree_keeps_all_within_the_bound():
    rng = np.random.default_rng(0)
    points = rng.poisson(3, (700, 64)).astype(np.int64)
    points[100:140] = points[100] + rng.poisson(0.05, (40, 64))
    sizes = points.sum(axis=1)
    tree = ngram_join.CountTree(points, sizes)
    for q in (0, 100, 120, 699):
        want = np.flatnonzero(np.minimum(points, points[q]).sum(axis=1) >= ngram_join.need(sizes[q], sizes, 85))
        assert sorted(tree.reach(points[q], sizes[q], 85)) == want.tolist()


def test_suffix_dedup_by_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, other = word(450), word(399)
    texts = [word(900), word(200) + shared + word(100), shared, word(50) + shared[3:420] + word(700), other + word(9), other, "x" * 1500, word(300), word(30) + "ab" * 400, "ab" * 230]
    texts += [texts[0], texts[7]]
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(docs_of(spark, texts)).collect()}
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    for d, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
        assert [x for s in got[d]["spans"] for x in (s["start"], s["end"])] == edges.tolist(), d


def test_cover_ranks_sort_suffixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (60, 300)).astype(np.uint8)
    rows[7:20, 30:] = rows[7, 30:]
    ranks = suffix_dedup.CoverRanks(np.ascontiguousarray(rows.T), 200)
    for c in range(0, 130):
        got = [rows[i, c:].tobytes() for i in ranks.sorted(c)]
        assert got == sorted(got)


def test_repeated_starts_by_brute_force():
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 123, (40, 736)).astype(np.uint8)
    rows[7:20, 100:600] = rows[7, 100:600]
    rows[25, 300:701], rows[30, 300:701] = rows[3, 300:701], rows[3, 300:701]
    left, right = rng.integers(200, 337, 40), rng.integers(300, 401, 40)
    got = suffix_dedup.repeated_starts(rows, left, right)
    windows = {(i, c): rows[i, c : c + 400].tobytes() for i in range(40) for c in range(337) if 336 - c <= left[i] and 64 + c <= right[i]}
    seen = Counter(windows.values())
    assert {k for k, w in windows.items() if seen[w] > 1} == set(zip(*map(np.ndarray.tolist, np.nonzero(got)), strict=True)) and got.any()


def test_suffix_dedup_with_a_hot_anchor_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, deep = word(250), word(420)
    texts = [word(rng.randrange(300, 700)) + passage + word(rng.randrange(300, 700)) for _ in range(60)] + [word(300) + deep + passage + word(500), word(40) + deep + passage + word(90), word(600) + passage[:200] + deep]
    df = docs_of(spark, texts).withColumn("doc_id", F.col("doc_id") % 5)
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    want = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want.append((len(b), int(gone.sum())))
    rows = suffix_dedup.dedup(df, passage=240).collect()
    got = [(r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"])) for r in rows]
    assert sorted(got) == sorted(want) and sum(n > 0 for _, n in want) == 3
    short, count = Counter(b[i : i + 240] for b in raw for i in range(len(b) - 239)), []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 239):
            if short[b[i : i + 240]] > 1:
                gone[i : i + 240] = True
        count.append((len(b), int(gone.sum())))
    assert sorted((r["n_bytes"], r["n_passage_bytes"]) for r in rows) == sorted(count) and sum(n > 0 for _, n in count) >= 60


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in docs.select("doc_id", "text").collect()}
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, packing.default_path()).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, x in ids.items():
        at = 0
        for start, n, crc in sorted(pieces[d]):
            assert start == at and zlib.crc32(x[start : start + n].tobytes()) == crc
            at += n
        assert at == len(x)
    for runs in filled.values():
        at = 0
        for offset, n in sorted(runs):
            assert offset == at
            at += n
        assert at <= packing.SIZE and at & (at - 1) == 0


def test_packing_keeps_shares_of_many_sources(spark):
    from tokenizers import Tokenizer

    # 90 sources, one of them large, and documents in runs of one source
    texts = [("big", "word " * 700)] * 90 + [(f"s{i:02d}", "word " * 300) for i in range(89) for _ in range(3)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "doc_id long, source string, text string")
    tok = Tokenizer.from_file(packing.default_path())
    n = {t: len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in {t for _, t in texts}}
    size = -(-sum(n[t] for _, t in texts) // 40)  # a window is a cycle
    total, share = Counter(), defaultdict(Counter)
    for r in packing.pack(df, packing.default_path(), size).collect():
        total[r["source"]] += r["length"]
        share[r["sequence_id"]][r["source"]] += r["length"]
    full = [w for w in share.values() if sum(w.values()) == size]
    assert len(full) >= 39 and len(total) == 90
    # window ends drift from cycle ends by rounding, one id a source and one a window, and by the sources whose turns do not even out
    # over a cycle, and fall into the first queue
    assert max(abs(w["big"] - total["big"] / 40) for w in full) <= 90 + 40 + 2 * packing.LEAST
    # small sources send LEAST ids and more in one cycle of a few, so over as many windows their shares hold
    for s, t in total.items():
        if s != "big":
            held = [share[w][s] for w in range(39)]
            assert max(held) <= 2 * packing.LEAST and all(abs(sum(held[a : a + 12]) - 12 * t / 40) <= 2 * packing.LEAST for a in range(27))


def test_packing_to_target_weights():
    totals, weights = [60_000, 20_000, 90_000, 0], [1, 2, 3, 5]
    service = packing.Service(totals, 1000, weights)
    share, filled = defaultdict(Counter), Counter()
    for q, t in enumerate(totals):
        for start in range(0, t, 700):
            n = min(700, t - start)
            pieces = service.pieces(q, start, n)
            assert sorted(p[0] for p in pieces)[0] == start and sum(p[1] for p in pieces) == n
            for _, length, seq, off in pieces:
                share[seq][q] += length
                filled[seq, off] += length
    assert sum(filled.values()) == sum(totals)
    ends = {seq: 0 for seq, _ in filled}
    for (seq, off), length in sorted(filled.items()):
        assert off == ends[seq]
        ends[seq] += length
    # queue 1 runs empty after 20,000 / 2 * 6 ids; then 1 : 3
    assert all(abs(share[s][q] - 1000 * w / 6) <= 4 for s in range(58) for q, w in enumerate((1, 2, 3)))
    assert all(abs(share[s][q] - 1000 * w / 4) <= 4 for s in range(62, 138) for q, w in ((0, 1), (2, 3)))


def test_language_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = registry.queries()["op7_language_id"](spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registry.queries()["op9_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["toxic"] == r["predicted"] for r in rows]) > 0.9


def test_rejection_is_calibrated_on_all_labelled_rows(spark):
    usual = "the cat sat on the mat and looked at the dog "
    rows = [(i, f"{usual}{i}", "en") for i in range(40_500)] + [(50_000 + i, f"olen talo ja metsä {i}", "fi") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    # each half is measured by the model of the other
    halves = {r["text"]: r["half"] for r in df.filter("lang = 'fi'").select("text", language_id.half(F.col("text")).alias("half")).collect()}
    every = {r["half"]: [x["text"] for x in df.filter(language_id.half(F.col("text")) == r["half"]).filter("lang = 'fi'").collect()] for r in df.select(language_id.half(F.col("text")).alias("half")).distinct().collect()}
    count = lambda texts: np.unique(language_id.grams(*language_id.signs(texts))[0], return_counts=True)
    h, n = [], []
    for text, k in halves.items():
        other = language_id.Model.fit(["fi"], {"fi": count(every[1 - k])})
        each, signs, _ = other.entropy([text])
        h.append(each[0, 0])
        n.append(signs[0])
    h, n = np.array(h), np.array(n)
    mean = np.average(h, weights=n)
    assert model.languages == ["en", "fi"] and np.isfinite(model.usual).all()
    assert model.usual[1] == pytest.approx(mean, rel=0.05) and model.room[1] == pytest.approx(max(1, ((h - mean) * np.sqrt(n)).max()), rel=0.05)
    assert model.least[1] == pytest.approx(max(0.1, (h - mean).max()), rel=0.1)


def test_letters_in_all_planes():
    model = language_id.Model.fit(["en"], {"en": np.unique(language_id.grams(*language_id.signs(["hello"]))[0], return_counts=True)})
    names, scores, rejected = language_id.judge(model, ["\U0001f600\U0001f680 \U0001f600", "\U00010414\U0001043c", "\U00020000\u4e2d"])
    assert names == ["und", "en", "en"] and scores[0] == 0 and rejected.tolist() == [True, False, False]


def test_kneser_ney_sums_to_one():
    s = language_id.signs(["hello there world", "hello where"])
    key, n = np.unique(language_id.grams(*s)[0], return_counts=True)
    model = language_id.Model.fit(["en"], {"en": (key, n)})
    for context in (0, int(key[5]) >> 16, 123456):
        every = np.uint64(context) << np.uint64(16) | np.arange(1 << 16, dtype=np.uint64)
        assert np.exp2(model._score(every, 4)).sum() == pytest.approx(1, abs=1e-3)


def test_kneser_ney_by_brute_force():
    texts = {"a": ["hello there world", "hello where"], "b": ["\u0436\u0430\u043c \u0442\u0430\u043c", "\u0442\u0430\u043c"]}
    model = language_id.Model.fit(["a", "b"], {k: np.unique(language_id.grams(*language_id.signs(v))[0], return_counts=True) for k, v in texts.items()})

    def probability(name, gram):
        """Interpolated Kneser-Ney, straight from its definition."""
        padded = ["\0\0\0" + t.replace(" ", "\0") + "\0" for t in texts[name]]
        fours = Counter(t[i - 3 : i + 1] for t in padded for i in range(3, len(t)))
        counts = {4: fours}
        for k in (3, 2, 1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])

        def p(g):
            if not g:
                return 2.0**-16
            c = counts[len(g)]
            own = [n for x, n in c.items() if x[:-1] == g[:-1]]
            one, two = (sum(n == v for n in c.values()) for v in (1, 2))
            d = one / (one + 2 * two) if one and two else 0.5
            return max(c[g] - d, 0) / sum(own) + d * len(own) / sum(own) * p(g[1:]) if own else p(g[1:])

        return p(gram)

    for gram in ("hell", "\0the", "ello", "\u0436\u0430\u043c\0", "zzzz", "the\0"):
        key = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(gram))], np.uint64)
        assert np.exp2(model._score(key, 4)[0]) == pytest.approx([probability("a", gram), probability("b", gram)], rel=1e-4), gram
    # letters of other scripts are told apart
    assert language_id.judge(model, ["\u0442\u0430\u043c \u0436\u0430\u043c"])[0] == ["b"] and language_id.judge(model, ["1234 !!"])[0] == ["und"]


def test_audio_finds_a_shifted_copy(spark):
    rng = np.random.default_rng(4)
    sound = rng.integers(0, 256, 6000).astype(np.uint8)
    df = spark.createDataFrame([(0, bytearray(sound[:4000].tobytes())), (1, bytearray(sound[640:5000].tobytes())), (2, bytearray(rng.integers(0, 256, 4000).astype(np.uint8).tobytes()))], "doc_id long, a binary")
    rows = audio.search(audio.fingerprints(df, "a", "doc_id"), F.col("doc_id") == 0).collect()
    assert [(r["query_id"], r["doc_id"], r["offset"]) for r in rows] == [(0, 1, -10)] and rows[0]["bit_error"] < 0.01


def test_audio_search_by_brute_force(spark):
    rng = np.random.default_rng(6)
    sound = np.clip(128 + 60 * np.sin(np.cumsum(rng.uniform(0.1, 1.5, 90).repeat(100))) + rng.normal(0, 10, 9000), 0, 255).astype(np.uint8)
    codes = [audio.codes(*audio.chroma([sound[a:b]]))[0] for a, b in ((0, 5000), (320, 5320), (650, 8000), (1007, 4000), (16, 6000), (2100, 2100 + 64 * 26 + 3), (4000, 9000))]
    for share in (0.05, 0.1, 0.14, 0.2):  # noisy copies, bits flipped all over
        codes.append(codes[0] ^ np.packbits(rng.random((len(codes[0]), 32)) < share, axis=1).view(np.int32)[:, 0])
    codes += [np.tile(codes[0][20:31], 4), np.tile(codes[0][20:31], 9)[5:], codes[3][:9], codes[3][:8], codes[3][:7], np.zeros(40, np.int32), np.zeros(55, np.int32)]
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "doc_id long, codes array<int>")
    got = {(r["query_id"], r["doc_id"]): (r["offset"], r["overlap"], r["bit_error"]) for r in audio.search(df, F.col("doc_id") % 3 == 0).collect()}
    want = {}
    for q in range(0, len(codes), 3):
        for d in range(len(codes)):
            best = None
            for o in range(-len(codes[q]), len(codes[d])):
                a, b = codes[q][max(-o, 0) :], codes[d][max(o, 0) :]
                n = min(len(a), len(b))
                e = int(np.bitwise_count((a[:n] ^ b[:n]).view(np.uint32)).sum())
                if n >= 8 and e / (n * 32) <= 0.15 and (best is None or 32 * n - 2 * e > best[0]):
                    best = 32 * n - 2 * e, o, n, e / (n * 32)
            if best and q != d:
                want[q, d] = best[1:]
    # what is found is what brute force finds, and of that at least 0.9
    assert all(want.get(k) == v for k, v in got.items()) and len(got) >= 0.9 * len(want) and {(0, 7), (0, 8), (0, 9), (0, 1)} <= set(got)


def test_audio_codes_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    sounds = [rng.integers(0, 256, n).astype(np.uint8) for n in (4000, 0, 255, 900, 1216, 30_000, 256)] + [np.full(3000, 128, np.uint8)]
    together = audio.codes(*audio.chroma(sounds))
    for s, got in zip(sounds, together, strict=True):
        alone = audio.codes(*audio.chroma([s]))[0]
        assert (alone == got).all() and len(got) == max(0, (len(s) - 256) // 64 + 1 - 15) if len(s) >= 256 else len(got) == 0
    assert audio.codes(*audio.chroma([])) == []
    # integral image against plain sums, for the first filter
    image, count = audio.chroma(sounds[:1])
    kind, y, h, w = audio.FILTERS[0]
    a = image[5 : 5 + w, y : y + h].sum() / audio.STEPS * 12 / h
    b = image[5 : 5 + w].sum() / audio.STEPS
    assert kind == 0 and together[0][5] & 3 == audio.GRAY[np.digitize(np.log((1 + a) / (1 + b)), audio.LEVELS)]


def test_audio_recall_on_noisy_copies():
    rng = np.random.default_rng(9)
    found = wanted = 0
    for _ in range(40):
        query = rng.integers(0, 1 << 32, 60, np.uint32)
        rows = []
        for share in (0.02, 0.08, 0.12, 0.14):
            a = int(rng.integers(0, 53))  # the recording begins with what the query ends with
            rows.append(np.concatenate([query[a:] ^ np.packbits(rng.random((60 - a, 32)) < share, axis=1).view(np.uint32)[:, 0], rng.integers(0, 1 << 32, int(rng.integers(0, 30)), np.uint32)]))
        index = audio.QueryIndex([query, rng.integers(0, 1 << 32, 30, np.uint32)])
        got = {(int(r), int(o)) for r, q, o, *_ in zip(*index.align(rows, 0.15, 8), strict=True) if q == 0}
        for i, r in enumerate(rows):
            hits = []
            for o in range(-52, len(r) - 7):
                x, y = query[max(-o, 0) :], r[max(o, 0) :]
                m = min(len(x), len(y))
                e = int(np.bitwise_count(x[:m] ^ y[:m]).sum()) if m >= 8 else 10**9
                if e <= 0.15 * 32 * m:
                    hits.append((e * 2 - 32 * m, o))
            if hits:
                wanted += 1
                found += (i, min(hits)[1]) in got
    assert wanted > 100 and found >= 0.9 * wanted


def test_audio_query_gives_all_partners(spark, tmp_path):
    rng = np.random.default_rng(5)
    text = "".join(chr(c) for c in rng.integers(32, 127, 4000))
    docs_of(spark, [text[:3200]]).union(docs_of(spark, [text[640:3840]]).withColumn("doc_id", F.lit(100))).union(docs_of(spark, [text[320:3520]]).withColumn("doc_id", F.lit(7))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in registry.queries()["op4_audio_fingerprints"](spark, str(tmp_path)).collect()}
    assert [(p["query_id"], p["offset"]) for p in rows[7]["partners"]] == [(0, -5), (100, 5)]
    assert [p["query_id"] for p in rows[0]["partners"]] == [100] and all(len(r["partners"]) == r["n_queries"] for r in rows.values())


def test_wrapped_notices_are_found(spark):
    import textwrap

    texts = ["one two three\n" + textwrap.fill("Zuvor " * 9 + notice + " danach" * 9, 72) for _, notice in licenses.TEMPLATES] + ["\n".join(n.split()) for _, n in licenses.TEMPLATES]
    texts += ["Under CC BY NC 4 0 terms", "licensed " + "x " * 40 + "under the apache license version 2 0", " ".join(licenses.TEMPLATES[8][1].split()[:12])]
    rows = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts), licenses.token_order(docs_of(spark, texts))).collect()}
    for i, (label, notice) in enumerate(licenses.TEMPLATES * 2):
        best = max((m for m in rows[i]["matches"] if m["label"] == label), key=lambda m: m["containment"])
        assert best["containment"] == 1, (i, label)
    assert {m["label"] for m in rows[20]["matches"]} == {"cc-by-nc"} and rows[21]["matches"] and not rows[22]["matches"]


def test_license_oracle_on_lines_without_licence_words(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs_of(spark, ["Under CC BY NC 4 0 terms", "released under\nthe MIT\nlicense", "cc by nc 4 0", "", "permission is hereby granted"]).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select doc_id, labels, score from ({licenses.ORACLE}) order by doc_id").fetchall()
    got = registry.queries()["op6_license_scan"](spark, str(tmp_path)).select("doc_id", "labels", "score").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want and want[0][1] == "cc-by,cc-by-nc"


def test_mix_reaches_targets(spark):
    rows = registry.queries()["op5_mixing"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    for r in rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r["t"] - r["g"]) <= r["m"] / 2 + 1


def test_ablation(spark):
    rows = quality_rules.ledger(docs_of(spark, ["a b c", "word " * 60, " ".join(f"w{i}" for i in range(80))]))
    got = {r["rule"]: (r["failed"], r["failed_alone"]) for r in quality_rules.ablation(rows, quality_rules.POLICIES["base"]).collect()}
    assert got == {"min_words": (1, 1), "repeat_words": (1, 1)}


def test_short_texts_are_one_shingle():
    assert [len(x) for x in shingles([b"a b"], 5)] == [1] and [len(x) for x in shingles([b""], 4)] == [0]
    assert [len(x) for x in shingles([b"a b", b"", b"a b c d e", b"  "], 4)] == [1, 0, 2, 0]


def test_noisy_or_scores_and_spans_by_brute_force():
    rng = random.Random(12)
    bad = ["awful", "terrible", "nasty"]
    texts, labels = [], []
    for i in range(240):
        sentences = [" ".join(f"w{rng.randrange(60)}" for _ in range(8)) for _ in range(rng.randrange(2, 6))]
        if i % 4 == 0:
            k = rng.randrange(len(sentences))
            sentences[k] = f"w1 {rng.choice(bad)} w2 {rng.choice(bad)} w3"
        texts.append(". ".join(sentences).encode())
        labels.append(int(i % 4 == 0))
    feature, sentence, text, _ = toxicity.read(texts)
    scorer = toxicity.fit(feature, sentence, text, np.array(labels))
    p, spans = scorer.score(texts)
    for i, t in enumerate(texts):
        # each sentence on its own, and their noisy-or
        own = [scorer.score([s])[0][0] for s in t.split(b". ")]
        assert p[i] == pytest.approx(1 - np.prod([1 - x for x in own]), abs=1e-6)
        assert [t[a:b] for a, b, _ in spans[i]] == [s for s, x in zip(t.split(b". "), own, strict=True) if x >= toxicity.THRESHOLD]
        if labels[i]:
            assert any(w.encode() in t[a:b] for a, b, _ in spans[i] for w in bad)
    assert np.mean((p >= toxicity.THRESHOLD) == np.array(labels)) == 1


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "src0", 0), (900_002, "12 !! 34", "en", None, 8), (None, "a text without an id that is rather short", "en", "src1", 41)], docs.schema)
    docs = docs.unionByName(odd)
    names = [n for n, _ in pipeline.STAGES]
    out = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = before.collect(), docs.collect()
        assert name == names[-1] or docs.columns == list(pipeline.COLUMNS)
    was, now = out["language_id"]
    assert {900_001, 900_002} & {r["doc_id"] for r in now} == set() and len(now) >= 0.95 * len(was)
    # lines: kept unless an earlier one has as many words in common
    was, now = out["line_dedup"]
    seen, want = [], {}
    for r in sorted((r for r in was if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        kept = []
        for line in r["text"].split("\n"):
            w = set(line.split())
            if not (w and any(len(w & x) * 9 >= (len(w) + len(x)) * 4 for x in seen)):
                kept.append(line)
            if w:
                seen.append(w)
        want[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in now if r["doc_id"] is not None} == want and len(now) == len(was)
    # one document of each group of near copies
    was, now = out["ngram_join"]
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for r in was if r["doc_id"] is not None for w in [r["text"].lower().split()]}
    ids, root = sorted(sets), {i: i for i in sets}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in now if r["doc_id"] is not None} == {i for i in ids if root[i] == i} and None in {r["doc_id"] for r in now}
    # each source near its target, a document at most three times
    was, now = out["mixing"]
    target = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(r["source"], len(r["text"].split())) for r in was], "source string, size long")).collect()}
    taken, times = Counter(), Counter((r["doc_id"], r["text"]) for r in now)
    for r in now:
        taken[r["source"]] += len(r["text"].split())
    longest = max(len(r["text"].split()) for r in was)
    assert max(times.values()) <= 3 and all(abs(taken[s] - t) <= longest / 2 + 1 for s, t in target.items())
    # every id of every copy in one piece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    was, now = out["packing"]
    assert sum(r["length"] for r in now) == sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in was)


def test_pareto_order_with_unequal_odds_by_brute_force(spark):
    import hashlib

    rng = random.Random(21)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "ab"[i % 3 == 0], float(1 + 9 * (i % 2))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, preference double")
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(df, preference=F.col("preference")).collect()}
    size = {i: len(t.split()) for i, t, *_ in rows}
    held = Counter()
    for i, _, s, _ in rows:
        held[s] += size[i]
    total, want = sum(held.values()), {}
    for s, w in (("a", 1), ("b", 2)):
        target = total * w / 3
        assert target < 3 * held[s]
        whole = int(target // held[s])
        rest, p = target - whole * held[s], target / held[s] - whole
        keyed = []
        for i, _, own, preference in rows:
            if own == s:
                u = (int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                q = u / (1 - u) / (p / (1 - p) * preference)
                keyed.append((int(q / (1 + q) * 2**48), i))
        run = 0
        for _, i in sorted(keyed):
            run += size[i]
            want[i] = whole + (2 * run - size[i] <= 2 * rest)
    assert got == want
    extra = [np.mean([got[i] - min(got.values()) for i, *_, f in rows if f == x and i % 3]) for x in (1.0, 10.0)]
    assert extra[1] > extra[0]


def test_line_dedup_orders_words_by_a_sample_and_loses_no_match(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.choice((6, 20, 70, 130)))] for _ in range(40)]
    texts = []
    for _ in range(200):
        w = [mutated(rng, rng.choice(base), rng.choice((0, 1, 2, 5))) for _ in range(3)]
        texts.append("\n".join([" ".join(w[0]), "\t".join(w[1]), "  " + "  ".join(w[2][: rng.choice((5, 200))]) + " \r"]))
    df = docs_of(spark, texts)
    removed = {r["doc_id"]: r["removed"] for r in line_dedup.later_matches(df).collect()}
    seen, want = [], {}
    for i, text in enumerate(texts):
        for line, s in enumerate(text.split("\n")):
            w = set(s.split())
            if any(len(w & x) * 9 >= (len(w) + len(x)) * 4 for x in seen):
                want.setdefault(i, []).append(line)
            seen.append(w)
    assert removed == want and 100 < sum(map(len, want.values())) < 600
    # one document of SAMPLE is counted, and long ones
    texts = [" ".join(f"d{i}x{j}" for j in range(10)) for i in range(800)]
    counted = lambda df: line_dedup.rarity(df, "text", "doc_id").select(F.size(F.filter("levels", lambda x: x > 0)).alias("n")).first()["n"]
    assert 0 < counted(docs_of(spark, texts)) < 2000 and counted(docs_of(spark, [" ".join(texts * 2)])) > 7900


def test_repeated_ids_are_rows_of_their_own(spark):
    """Rows that share an id are judged by their own texts, in whatever order and cut they come."""
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(12)) for _ in range(6)]
    near = [b + " more" for b in base]
    rows = [(0, f"{base[0]}\n{base[1]}"), (2, near[0]), (2, base[2]), (2, f"{base[3]}\n{near[1]}"), (5, near[2]), (5, near[2]), (7, base[4]), (7, base[5]), (None, base[0]), (None, near[1])]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, __removed string, __doc int").repartition(seed + 1)
        got = sorted(((r["doc_id"], r["text"], r["__removed"]) for r in line_dedup.drop_lines(df).collect()), key=str)
        # by the definition: rows by id, each line against all before it; null ids are left alone
        want = [(None, base[0], "x"), (None, near[1], "x"), (0, f"{base[0]}\n{base[1]}", "x"), (2, "", "x"), (2, base[2], "x"), (2, base[3], "x"), (5, "", "x"), (5, "", "x"), (7, base[4], "x"), (7, base[5], "x")]
        assert got == sorted(want, key=str)
    # of two equal rows one keeps its lines
    twins = spark.createDataFrame([(1, base[0]), (1, base[0])], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.drop_lines(twins).collect()) == ["", base[0]]


def test_join_of_repeated_ids(spark):
    rng = random.Random(13)
    x, y, z = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    rows = [(1, x), (5, x + " more"), (5, y), (7, y), (7, z), (None, z), (9, None)]
    for n in (1, 3):
        got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(1, 1), (5, 1), (5, 5), (7, 5), (7, 7), (None, None), (9, 9)], key=str)


def test_mix_passes_columns_on_by_row(spark):
    rows = [(1, "a b c", "s"), (1, "d e", "s"), (2, "f g h i", "t"), (None, "j k", "t"), (None, "l", None)]
    df = spark.createDataFrame([(*r, f"k{n}", n) for n, r in enumerate(rows)], "doc_id long, text string, source string, copies string, __row int")
    out = mixing.mix(df, keep=tuple(df.columns))
    got = out.collect()
    assert len(got) == 5 and len(set(out.columns)) == len(out.columns)
    assert {(r["doc_id"], r["text"], r["size"], r["copies_in"], r["__row"]) for r in got} == {(i, t, len(t.split()), f"k{n}", n) for n, (i, t, _) in enumerate(rows)}
    assert sum(r["taken"] for r in got) == sum(r["copies"] * r["size"] for r in got)


#: A paragraph each of languages that the tables do not have, and of one that they imitate.
FOREIGN = (
    "Praha je hlavní a současně největší město České republiky. Leží mírně na sever od středu Čech na řece Vltavě, uvnitř Středočeského kraje, jehož je správním centrem, ale není jeho součástí.",
    "La città si trova nel centro della penisola e la sua storia comincia molti secoli prima. Gli abitanti hanno costruito ponti, strade e mercati, e ogni anno arrivano visitatori da tutto il mondo per vedere i palazzi.",
    "De stad ligt aan de rivier en heeft een lange geschiedenis die al begon voordat de eerste huizen van steen werden gebouwd. Elk jaar komen er bezoekers uit het hele land om de markten en de oude kerken te zien.",
    "Miasto leży nad rzeką i ma długą historię, która zaczęła się na długo przed tym, jak zbudowano pierwsze domy z kamienia. Każdego roku przyjeżdżają tu goście z całego kraju, żeby zobaczyć targi i stare kościoły.",
    "A cidade fica perto do rio e tem uma longa história que começou muito antes de as primeiras casas de pedra serem construídas. Todos os anos chegam visitantes de todo o país para ver os mercados e as igrejas antigas.",
    "Kaupunki sijaitsee joen varrella ja sillä on pitkä historia, joka alkoi kauan ennen kuin ensimmäiset kivitalot rakennettiin. Joka vuosi tänne tulee vieraita koko maasta katsomaan toreja ja vanhoja kirkkoja.",
    "Şehir nehrin kıyısında yer alır ve taştan ilk evler yapılmadan çok önce başlayan uzun bir tarihe sahiptir. Her yıl ülkenin her yerinden ziyaretçiler çarşıları ve eski kiliseleri görmeye gelir.",
    "A város a folyó partján fekszik, és hosszú története már jóval azelőtt elkezdődött, hogy az első kőházak felépültek. Minden évben az egész országból jönnek látogatók, hogy megnézzék a piacokat és a régi templomokat.",
    "Staden ligger vid floden och har en lång historia som började långt innan de första husen av sten byggdes. Varje år kommer besökare från hela landet för att se marknaderna och de gamla kyrkorna i centrum.",
    "Orașul se află pe malul râului și are o istorie lungă, care a început cu mult înainte ca primele case de piatră să fie construite. În fiecare an vin vizitatori din toată țara ca să vadă piețele și bisericile vechi.",
)


def test_languages_that_were_not_learned_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.filter(language_id.fold(F.col("doc_id"), 3) != 1))
    _, _, rejected = language_id.judge(model, list(FOREIGN))
    assert rejected.mean() >= 0.9
    held = language_id.predict(docs.filter((language_id.fold(F.col("doc_id"), 3) == 1) & F.col("lang").isNotNull()), model, keep=("doc_id", "lang")).collect()
    assert np.mean([not r["rejected"] for r in held]) >= 0.99


def test_license_templates_are_a_parameter(spark):
    own = [("wtf", "Do what you want with THIS, entirely at your own risk!"), ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented")]
    phrases = {"public domain": "pd"}
    df = docs_of(spark, ["intro words Do what you want with this entirely at own risk end", "This is in the public domain.", "altered source versions must be\nplainly marked as such and not misrepresented", "the MIT license, licensed under the apache license version 2 0", ""])
    order = licenses.token_order(df, templates=own)
    assert set(order) == {w for _, n in licenses.checked(own) for w in n.split()}
    rows = {r["doc_id"]: r for r in licenses.scan(df, order, templates=own, phrases=phrases).collect()}
    assert [sorted({m["label"] for m in rows[i]["matches"]}) for i in range(5)] == [["wtf"], [], ["zlib"], [], []]
    assert [[(p["start"], p["label"]) for p in rows[i]["places"]] for i in range(5)] == [[], [(4, "pd")], [], [], []]
    with pytest.raises(ValueError):
        licenses.checked([("x", "...")])
