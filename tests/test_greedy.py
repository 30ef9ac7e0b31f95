"""The lazy greedy selection against one that counts every gain at every step."""

import random

import pytest

from verdance.functions import alleles as A
from verdance.operators import selection
from verdance.operators.selection import Pick


def plain(targets, wild, quota, weights, start, stage):
    picks, new = list(start), []
    while any(sum(p.region == r for p in picks) < n for r, n in quota.items()):
        left = [(c, b) for c, b in targets if not {p.sample for p in picks} & set(c)]
        options = []
        for order, (s, region, rate) in enumerate(wild):
            if s not in {p.sample for p in picks} and sum(p.region == region for p in picks) < quota.get(region, 0):
                gains = {b: sum(s in c and x == b for c, x in left) for b in A.MAF_BINS}
                options.append(((sum(weights.get(b, 0.0) * gains[b] for b in A.MAF_BINS), sum(gains.values()), rate, -order), s, region, gains))
        (score, _, rate, minus), s, region, gains = max(options, key=lambda o: o[0])
        new.append(Pick(s, region, len(picks) + 1, sum(p.region == region for p in picks) + 1, quota[region], score, gains, rate, 1 - minus, stage))
        picks.append(new[-1])
    return new


@pytest.mark.parametrize("seed", range(5))
def test_lazy_picks_are_plain_picks(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(selection, "LEADERS", [2, 5, 12, 12, 12][seed])
    wild = [(f"w{i:02d}", "abc"[i % 3], rng.choice([0.5, 0.9])) for i in range(40)]
    weights = {A.MAF_BINS[0]: 1.0, A.MAF_BINS[1]: 2.0, A.MAF_BINS[2]: -1.0 if seed == 4 else 2.0}
    # Few carriers and many ties in some, none at all in others.
    targets = [(sorted(rng.sample([w[0] for w in wild[: 40 if seed else 8]], rng.choice([0, 1, 1, 2, 3, 9 if seed else 4]))), rng.choice(A.MAF_BINS)) for _ in range([30, 200, 200, 60, 80][seed])]
    per = spark.createDataFrame([(c, b) for c, b in targets], "carriers array<string>, Wild_MAF_bin string").cache()
    passes = []
    for name in ("gains_of", "overlaps_of"):
        monkeypatch.setattr(selection, name, lambda *a, f=getattr(selection, name): passes.append(1) or f(*a))
    quota = {"a": 7, "b": 5, "c": 6} if seed < 4 else {"a": 2, "b": 1, "c": 2}
    first = selection.greedy(per, wild, quota, weights)
    assert first == plain(targets, wild, quota, weights, [], selection.PLANS[0])
    more = {r: n + 2 for r, n in quota.items()}
    assert selection.greedy(per, wild, more, weights, first, "more") == plain(targets, wild, more, weights, first, "more")
    if seed in (2, 3):
        assert len(passes) < sum(more.values()) * 0.75
