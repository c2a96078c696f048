"""How much the alignment of recordings looks at, and that it finds what looking at everything finds."""

import numpy as np

from pairfield.llm import audio


def _related(rng, n=30):
    """Recordings of odd and even sizes; some hold a noisy part of another one."""
    rows = [rng.integers(0, 1 << 32, int(k), np.uint32) for k in rng.integers(8, 60, n)]
    for i in range(0, n - 1, 2):
        a = int(rng.integers(0, max(1, len(rows[i]) - 8)))
        noise = np.packbits(rng.random((len(rows[i]) - a, 32)) < 0.05, axis=1).view(np.uint32)[:, 0]
        rows[i + 1] = np.concatenate([rng.integers(0, 1 << 32, i % 5, np.uint32), rows[i][a:] ^ noise])
    return rows


def test_fields_cover_a_code_and_near_codes_share_a_key():
    assert [first for first, _ in audio.FIELDS] == list(np.cumsum([0, *[bits for _, bits in audio.FIELDS]])[:-1]) and sum(bits for _, bits in audio.FIELDS) == 32
    code = np.array([0x9E3779B9], np.uint32)
    for i in range(32):
        for j in range(32):
            near = code ^ np.uint32(1 << i | 1 << j)
            assert any(audio.QueryIndex.key(code, k) == audio.QueryIndex.key(near, k) for k in audio.KEYS)


def test_votes_and_errors_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    rows = _related(rng)
    queries = rows[::3]
    index = audio.QueryIndex(queries)
    want = {(r, q, i - j) for r, x in enumerate(rows) for q, y in enumerate(queries) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= audio.VOTE_BITS), strict=True)}
    assert set(zip(*(x.tolist() for x in index.histogram(rows, audio.VOTE_BITS)), strict=True)) == want
    best = {}
    for r, q, o in want:
        x, y = rows[r][max(o, 0) :], queries[q][max(-o, 0) :]
        n = min(len(x), len(y))
        errors = int(np.bitwise_count(x[:n] ^ y[:n]).sum())
        if n >= 8 and errors <= 0.15 * 32 * n:
            best[r, q] = min(best.get((r, q), (0, 0, 0, 0)), (2 * errors - 32 * n, int(o), n, errors))
    got = index.align(rows, 0.15, 8)
    assert {(int(r), int(q)): (-int(v), int(o), int(n), int(e)) for r, q, o, v, n, e in zip(*got, strict=True)} == best
    assert len(best) > 15


def test_chance_brings_few_codes_together(monkeypatch):
    """What is looked at grows with queries times rows: of random codes few may meet, and of overlaps by chance about half is enough."""
    rng = np.random.default_rng(4)
    seen = []

    def counted(counts, of=audio._ragged):
        seen.append(int(counts.sum()))
        return of(counts)

    monkeypatch.setattr(audio, "_ragged", counted)
    queries, rows = ([rng.integers(0, 1 << 32, 200, np.uint32) for _ in range(n)] for n in (300, 50))
    audio.QueryIndex(queries).histogram(rows, audio.VOTE_BITS)
    assert sum(seen) < 3e-5 * 60_000 * 10_000  # two bytes in common: 9.2e-5
    seen.clear()
    for r in rows:  # each has one code of a query, and so one overlap that is long and wrong
        r[100] = queries[0][100]
    index = audio.QueryIndex(queries)
    held = index.histogram(rows, audio.VOTE_BITS)
    seen.clear()
    monkeypatch.setattr(index, "histogram", lambda *_: held)
    index.align(rows, 0.15, 8)
    assert 0 < sum(seen) < 0.3 * sum(200 - abs(int(o)) for o in held[2])
