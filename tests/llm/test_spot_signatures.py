import hashlib
import random
import re

import pytest

from pairfield.llm import spot_signatures as S


def plain(text, anchors=frozenset(S.ANCHORS), chain=S.CHAIN):
    """The signatures as words, by the definition."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    w = [x for x in re.split(r"[^0-9a-z\x80-\U0010ffff]+", low) if x]
    some = any(x in anchors for x in w)
    out = set()
    for i, x in enumerate(w):
        after = [y for y in w[i + 1 :] if y not in anchors][:chain]
        if (x in anchors or not some) and len(after) == chain:
            out.add((x, *after))
    return out or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def prose(rng, n):
    common = ["the", "of", "una", "der", "and", "près", "où"]
    return "".join((rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(80)}") + rng.choice([" ", ", ", ".\n", "-"]) for _ in range(n))


def texts_of(rng):
    texts = [prose(rng, rng.randrange(0, 120)) for _ in range(40)] + ["", "  ", "!!", "one two", "The THE the", "the cat", "x", "éé ÉÉ the àà ßß", None]
    return texts + texts[:3]


def test_signatures_are_those_of_the_definition():
    texts = [t or "" for t in texts_of(random.Random(1))]
    sets = S.signatures([t.encode() for t in texts], S.anchor_hashes())
    words = [plain(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in words]
    for a, wa in zip(sets, words, strict=True):
        assert (S.unpacked(S.packed(a)) == a).all()
        for b, wb in zip(sets, words, strict=True):
            assert S.likeness(a, b) == pytest.approx(jaccard(wa, wb))
            for least in (0.3, 0.8):
                want = jaccard(wa, wb)
                assert S.likeness(a, b, least) == pytest.approx(want if want >= least - 1e-9 or not wa and not wb else 0)


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(2)
    texts = texts_of(rng)
    for t in texts[:20]:
        w = t.split(" ")
        for _ in range(3):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = S.fingerprints(df, keep=("doc_id",))
    known = {r["fingerprint"] for r in prints.collect()} - {""}
    for least in (0.5, 0.8, 1.0):
        want = {tuple(sorted((a, b))): round(x, 9) for a in known for b in known if a != b and (x := S.likeness(S.unpacked(a), S.unpacked(b), least))}
        got = [(tuple(sorted((r["a"], r["b"]))), round(r["near"], 9)) for r in S.near_pairs(prints, least).collect()]
        assert len(got) == len(want) and dict(got) == want


def against(rows):
    """The contract, row by row."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        t, u = r[1] or "", after[1] or ""
        m = len(t) // 3
        edit = t[: len(t) - m] + u[:m]
        yield r[0], len(t), hashlib.sha256(edit.encode()).hexdigest(), round(jaccard(plain(t), plain(edit)), 9), round(jaccard(plain(t), plain(u)), 9)


def test_against_next_is_the_plain_loop(spark):
    texts = texts_of(random.Random(3))
    for rows in ([(3 * i + 1, t) for i, t in enumerate(texts)], [(-5, "the one and only")], [(None, "a lone text"), (4, "of ünïcode 𝔘𝔘 the end of it")]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = S.against_next(df).collect()
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=key) == sorted(against(rows), key=key)


def test_odd_rows(spark, odd, empty):
    rows = S.against_next(odd).collect()
    assert len(rows) == 8 and S.against_next(empty).count() == 0
    assert {r["near_edited"] for r in rows if r["doc_id"] in (1, 2)} == {1.0} and {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)} == {""}
    # of the two equal rows the first is followed by the second
    assert sorted(r["near_next"] for r in rows if r["doc_id"] == 3)[-1] == 1.0
    out = S.fingerprints(odd, keep=(*odd.columns,))
    assert out.count() == 8 and len(set(out.columns)) == len(out.columns)
