"""Permutations and weighted clusters against plain loops."""

import math
import random

import numpy as np
import pytest

from barloom.operators import resampling as R


def test_permuted_sums_equal_plain_shuffles(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(20240100 + rng.randrange(5), i, rng.choice("xyz"), float(rng.randint(0, 9))) for i in range(80)]
    df = spark.createDataFrame(rows, "date long, i long, k string, v double")
    got = {(r.rep, r.k): (r.s, r.n) for r in R.permuted_sums(df, "date", ["i"], "k", "v", 10).collect()}
    want = {}
    for rep in range(10):
        for day in {r[0] for r in rows}:
            own = sorted(r for r in rows if r[0] == day)
            draw = [((rep * 7368787 + day % 100000 * 104729 + (j + 1) * 15485863 + 1) * 16807 % 2147483647 * 16807 % 2147483647, j) for j in range(len(own))]
            rank = {j: k for k, (_, j) in enumerate(sorted(draw))}
            for j, r in enumerate(own):
                s, n = want.get((rep, r[2]), (0.0, 0))
                want[rep, r[2]] = (s + own[rank[j]][3], n + 1)
    assert got == want
    assert R.permuted_sums(df.limit(0), "date", ["i"], "k", "v", 3).count() == 0


@pytest.mark.parametrize("against", [False, True])
def test_intervals_equal_plain_loops(spark, against):
    rng = random.Random(3)
    rows = [(k, 20240100 + d, float(rng.randint(-5, 9)), float(rng.randint(0, 3)), float(rng.randint(0, 3)), 1.0) for k in "ab" for d in range(12)]
    df = spark.createDataFrame(rows, "k string, date long, s double, n double, s2 double, n2 double")
    got = {r.k: r for r in R.cluster_intervals(df, ["k"], "date", 300, against).collect()}
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        stats = []
        for rep in range(300):
            w = []
            for r in own:
                u = (rep * 1000003 + r[1] % 100000 * 7919 + 12345) * 16807 % 2147483647 * 16807 % 2147483647 / 2147483647
                w.append(next(j for j in range(20) if u < sum(math.exp(-1) / math.factorial(i) for i in range(j + 1))))
            n, n2 = sum(a * r[3] for a, r in zip(w, own)), sum(a * r[5] for a, r in zip(w, own))
            if n and (n2 or not against):
                stats.append(sum(a * r[2] for a, r in zip(w, own)) / n - (sum(a * r[4] for a, r in zip(w, own)) / n2 if against else 0))
        assert (got[k].lo, got[k].hi) == pytest.approx(tuple(np.percentile(stats, [2.5, 97.5]))) and got[k].clusters == 12
        assert got[k].above == pytest.approx(sum(x > 0 for x in stats) / len(stats)) and got[k].n == sum(r[3] for r in own)
    assert abs(R.poisson_weights(np.arange(20240100, 20240130), 500).mean() - 1) < 0.05
