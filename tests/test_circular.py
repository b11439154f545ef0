"""Arcs of a circle and shifts of profiles against plain loops."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from barloom.operators import circular
from barloom.plans.clustering_queries import BINS, SHIFTS, STEP, level_sets, near_levels
from barloom.plans.regime_queries import day_profiles


def test_arcs_equal_plain_sums(spark):
    rng = random.Random(1)
    rows = [(k, b, rng.randint(1, 9)) for k in "ab" for b in rng.sample(range(24), 15)]
    h = spark.createDataFrame(rows, "k string, bin int, n long")
    arcs = [(k, lo, lo + w) for k in "ab" for lo in range(24) for w in (0, 1, 7, 24)]
    got = circular.arc_sums(spark.createDataFrame(arcs, "k string, lo int, hi int"), circular.prefix_sums(h, ["k"], 24, ["n"]), ["k"], ["n"])
    want = {(k, lo, hi): sum(n for j, b, n in rows if j == k and b in {x % 24 for x in range(lo, hi)}) for k, lo, hi in arcs}
    assert {(r.k, r.lo, r.hi): r.n for r in got.collect()} == want


def test_windows_near_levels_equal_masks():
    rng = np.random.default_rng(2)
    hist, sets = rng.integers(0, 5, BINS), level_sets(4)
    for half in (6, 24):
        got = near_levels(hist, sets, half)
        for s in (0, 3):
            for j in (0, 1, SHIFTS - 1):
                mask = {(c + j * STEP + d) % BINS for c in sets[s] for d in range(-half, half)}
                assert got[s, j] == sum(hist[b] for b in mask)


def test_a_planted_hour_is_found(spark):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for day in range(35):
        for _ in range(120):
            minute = int(rng.gauss(570, 12)) if rng.random() < 0.7 else rng.randrange(1440)
            late = 60 if 14 <= day < 21 else 0  # the third week's clock is an hour fast
            rows.append(("a", start + datetime.timedelta(days=day, minutes=(minute + late) % 1440)))
    p = day_profiles(spark.createDataFrame(rows, "event_type string, ts timestamp"))
    got = {r.period: r for r in circular.best_shifts(p, ["event_type"], "period", 1440).collect()}
    assert abs(got[2].shift - 60) <= 6 and got[2].fit > 3 * got[2].at_zero
    assert all(abs(r.shift) <= 12 for k, r in got.items() if k != 2) and {r.n for r in got.values()} == {840}
    assert p.where(F.lit(False)).count() == 0


def test_correlation_is_exact():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 30), rng.integers(0, 9, 30)
    assert circular.cross_correlation(a, b).tolist() == [sum(int(a[(m + s) % 30]) * int(b[m]) for m in range(30)) for s in range(30)]
