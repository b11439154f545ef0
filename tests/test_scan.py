"""Chunked scans against plain loops, at several chunk lengths."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import scan


def series(seed, n):
    rng = random.Random(seed)
    px, rows = 100.0, []
    for i in range(n):
        px *= 1 + rng.choice([-1, 1]) * rng.choice([0, 0.002, 0.01, 0.04])
        rows.append((i, round(px * (1 + rng.random() * 0.02), 2), round(px * (1 - rng.random() * 0.02), 2)))
    return rows


def zigzag_by_hand(rows, reversal):
    up, ext, at, out = True, float("-inf"), -1, []
    for i, h, low in rows:
        if up and h > ext or not up and low < ext:
            ext, at = (h if up else low), i
        elif up and low < ext * (1 - reversal) or not up and h > ext * (1 + reversal):
            out.append((i, at, ext, up))
            ext, at, up = (low if up else h), i, not up
    return out


@pytest.mark.parametrize("chunk", [3, 40, 100_000])
def test_zigzag_is_the_same_at_any_chunk(spark, chunk):
    data = {"a": series(1, 500), "b": series(2, 333), "up": [(i, 10.0 + i, 9.5 + i) for i in range(60)], "flat": [(i, 5.0, 5.0) for i in range(20)]}
    df = spark.createDataFrame([(k, *r) for k, rows in data.items() for r in rows], "series_id string, pos long, h double, l double")
    for reversal in (0.01, 0.05, 0.3):
        want = sorted((k, *r) for k, rows in data.items() for r in zigzag_by_hand(rows, reversal))
        assert sorted(map(tuple, scan.zigzag(df, reversal, chunk).collect())) == want
    assert scan.zigzag(df.limit(0), 0.1, chunk).count() == 0


def test_maps_of_legs_equal_walks():
    rng = random.Random(5)
    for seed in range(200):
        rows = series(seed, rng.randint(1, 60))
        pos, h, low = [[r[k] for r in rows] for k in range(3)]
        m = scan.leg_map(h, low, pos, 0.05)
        for _ in range(10):
            state = [float(rng.random() < 0.5), rng.choice([rng.uniform(60, 160), rng.choice(h), rng.choice(low)]), -7.0]
            up, ext, at, _ = scan.walk(h, low, 0.05, bool(state[0]), state[1], -7, 0)
            assert scan.leg_step(state, m, 0.05) == [float(up), ext, float(at)]


@pytest.mark.parametrize("chunk", [12, 50, 100_000])
def test_kept_events_are_the_same_at_any_chunk(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, rng.randrange(600), v) for k, n in (("a", 300), ("b", 40), ("c", 1)) for v in range(n)] + [("d", i, 0) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    want = []
    for k in "abcd":
        last = None
        for p in sorted({r[1] for r in rows if r[0] == k}):
            if last is None or p >= last + 12:
                want += [r for r in rows if r[:2] == (k, p)]
                last = p
    assert sorted(map(tuple, scan.dedup(df, ["k"], 12, chunk=chunk).collect())) == sorted(want)
    assert scan.dedup(df.limit(0), ["k"], 12, chunk=chunk).count() == 0
    with pytest.raises(ValueError):
        scan.dedup(df, ["k"], chunk + 1, chunk=chunk)


@pytest.mark.parametrize("chunk", [4, 1000])
def test_running_values_equal_plain_loops(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, p, rng.choice([None, rng.randint(-9, 9)])) for k in "ab" for p in sorted(rng.sample(range(100), 40))]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    kinds = {"a_last": ("last", F.col("v")), "a_sum": ("sum", F.col("v")), "a_max": ("max", F.col("v")), "a_prev": ("prev", F.col("v"))}
    got = {(r.k, r.pos): (r.a_last, r.a_sum, r.a_max, r.a_prev, r.v) for r in scan.running(df, ["k"], kinds, chunk=chunk).collect()}
    for k in "ab":
        seen, prev = [], None
        for _, p, v in (r for r in rows if r[0] == k):
            seen += [v] if v is not None else []
            assert got[k, p] == (seen[-1] if seen else None, sum(seen) if seen else None, max(seen, default=None), prev, v)
            prev = v
