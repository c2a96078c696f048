import random
from fractions import Fraction

import pytest

from pairfield.llm.packing import Phase, Service


def by_turns(totals, size, least):
    """Deficit round-robin as it is told: cycle by cycle, queue by queue. The place of every id in the order of service."""
    cycles = max(1, -(-sum(totals) // size))
    every = [min(max(1, -(-least * cycles // max(t, 1))), cycles) for t in totals]
    sent, place, out = [0] * len(totals), 0, {}
    deficit = [Fraction(q % every[q] * t, cycles) for q, t in enumerate(totals)]
    for c in range(cycles):
        for q, t in enumerate(totals):
            deficit[q] += Fraction(t, cycles)
            last = c + 1 == cycles
            if (c + 1 + q % every[q]) % every[q] and not last:
                continue
            n = t - sent[q] if last else min(int(deficit[q]), t - sent[q])
            for _ in range(n):
                out[q, sent[q]] = place
                sent[q], place = sent[q] + 1, place + 1
            deficit[q] -= n
    assert sent == list(totals)
    return out


@pytest.mark.parametrize("least", [1, 8, 64])
def test_places_are_those_of_the_turns(least):
    rng = random.Random(least)
    for _ in range(40):
        totals = [rng.choice([0, 1, 7, rng.randrange(1, 3000)]) for _ in range(rng.choice([1, 2, 5, 40]))]
        size = rng.choice([16, 100, 256])
        if not sum(totals):
            continue
        want, service = by_turns(totals, size, least), Service(totals, size, least=least)
        for q, t in enumerate(totals):
            at = 0
            while at < t:
                n = min(t - at, rng.randrange(1, 400))
                got = {}
                for begin, place, length in Phase(totals, size, least).runs(q, at, n):
                    got |= {begin + i: place + i for i in range(length)}
                assert got == {i: want[q, i] for i in range(at, at + n)}
                pieces = service.pieces(q, at, n)
                assert sum(p[1] for p in pieces) == n and all(off + length <= size for _, length, _, off in pieces)
                at += n


@pytest.mark.parametrize("sources", [5, 500, 5000])
def test_documents_of_many_sources_stay_in_few_pieces(sources):
    service = Service([20_000] * sources, 4096)
    pieces = [p for q in range(0, sources, max(1, sources // 50)) for p in service.pieces(q, 6_000, 2_000)]
    per_document = len(pieces) / len(range(0, sources, max(1, sources // 50)))
    assert per_document <= 2_000 / 64 * 1.5 + 3
    # every window still holds many sources, none with much over its share
    held = {}
    for q in range(min(sources, 200)):
        for _, length, seq, _ in service.pieces(q, 0, 20_000):
            held[q, seq] = held.get((q, seq), 0) + length
    assert max(held.values()) <= 4096 / sources + 2 * 64 + 1


def test_places_of_cycles_in_a_row_take_one_sum(monkeypatch):
    """Queues that send in every cycle: the sums over the queues are made once a document."""
    from pairfield.llm import packing

    phase, calls = packing.Phase([4_000_000, 2_000_000, 900_000], 4096), []
    own = phase.sent
    monkeypatch.setattr(phase, "sent", lambda *a: calls.append(1) or own(*a))
    got = list(phase.runs(1, 123_456, 3000))
    assert len(calls) == 1
    monkeypatch.setattr(packing, "BLOCK", 1)
    assert got == list(phase.runs(1, 123_456, 3000)) and sum(n for *_, n in got) == 3000
