"""Semantic rules on hand-made bars, and chunked windows against undivided ones."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import lattice as L
from barloom.operators import events, features, outcomes
from barloom.sources import readers


def bars(spark, rows, series="s"):
    """rows of (h, l, c) as one series."""
    return spark.createDataFrame([(series, i, float(c), float(h), float(low), float(c), 1) for i, (h, low, c) in enumerate(rows)], "series_id string, pos long, o double, h double, l double, c double, v long")


def test_touches_keep_first_and_those_a_gap_after_the_last_kept(spark):
    e = spark.createDataFrame([("a", p) for p in (0, 30, 59, 60, 90)], "k string, pos long")
    assert sorted(r.pos for r in events.dedup(e, ["k"], 60).collect()) == [0, 60]


@pytest.mark.parametrize("gap", [1, 3, 7, 50])
def test_dedup_equals_a_plain_loop(spark, gap):
    import random

    random.seed(gap)
    pos = sorted(random.sample(range(400), 150))
    kept, last = [], -(10**9)
    for p in pos:
        if p - last >= gap:
            kept.append(p)
            last = p
    e = spark.createDataFrame([("a", p) for p in pos], "k string, pos long")
    assert sorted(r.pos for r in events.dedup(e, ["k"], gap).collect()) == kept


def test_dedup_is_linear_and_keeps_keys_apart(spark):
    import time

    e = spark.range(200_000).selectExpr("CAST(id % 2 AS DOUBLE) AS k", "IF(id % 2 = 0, 'a', 'b') AS name", "id DIV 2 AS pos").coalesce(1)
    began = time.perf_counter()
    got = events.dedup(e, ["k", "name"], 12).groupBy("k").agg(F.count("*").alias("n"), F.max("pos").alias("last")).collect()
    assert time.perf_counter() - began < 60
    assert sorted(tuple(r) for r in got) == [(0.0, 8334, 99996), (1.0, 8334, 99996)]  # one run of 100,000 positions each


def zigzag_by_hand(rows, reversal):
    up, ext, at, out = True, rows[0][0], 0, []
    for i, (h, low) in enumerate(rows[1:], 1):
        if up:
            if h > ext:
                ext, at = h, i
            elif low < ext * (1 - reversal):
                out.append((i, at, ext, True))
                up, ext, at = False, low, i
        elif low < ext:
            ext, at = low, i
        elif h > ext * (1 + reversal):
            out.append((i, at, ext, False))
            up, ext, at = True, h, i
    return out


def test_zigzag_equals_a_plain_loop(spark):
    import random

    rng = random.Random(2)
    series = {}
    for name in ("x", "y", "z"):
        px, rows = 100.0, []
        for _ in range(300):
            px *= 1 + rng.gauss(0, 0.01)
            rows.append((px * (1 + rng.random() * 0.01), px * (1 - rng.random() * 0.01)))
        series[name] = rows
    d = spark.createDataFrame([(n, i, h, low) for n, rows in series.items() for i, (h, low) in enumerate(rows)], "series_id string, pos long, h double, l double")
    got = {}
    for r in features.zigzag(d.repartition(3), 0.02).orderBy("series_id", "pos").collect():
        got.setdefault(r.series_id, []).append((r.pos, r.ext_pos, r.px, r.is_high))
    assert got == {n: zigzag_by_hand(rows, 0.02) for n, rows in series.items()}
    assert features.zigzag(d.limit(0), 0.02).count() == 0


def test_a_replay_feeds_rows_in_order_and_those_without_one(spark):
    from barloom.streaming.replay import replay

    d = spark.createDataFrame([(i, i * 2) for i in range(50)] + [(None, 7)], "k long, v long")
    assert sorted(map(tuple, replay(d, "k", lambda s: s.select("k", "v"), finish=lambda t: t.limit(0)).collect()), key=str) == sorted(map(tuple, d.collect()), key=str)


def test_rows_later_than_the_watermark_are_dropped(spark):
    from barloom.streaming.paths import minute_bars
    from barloom.streaming.replay import replay

    at = ["00:10", "00:20", "00:40", "05:00", "05:10", "05:20", "00:30", "05:30", "05:40"]  # the seventh is late
    rows = [(i, f"2024-01-01 {t}:00", 100.0 if i == 6 else i + 1.0) for i, t in enumerate(at)]
    d = spark.createDataFrame(rows, "id long, ts string, px double").select("id", F.to_timestamp("ts").alias("ts"), "px", F.lit("s").alias("k"))
    end = lambda t: t.limit(1).select(F.lit(99).cast("long").alias("id"), F.to_timestamp(F.lit("2100-01-01 00:00:00")).alias("ts"), F.lit(0.0).alias("px"), F.lit("end").alias("k"))
    out = replay(d, "id", lambda s: minute_bars(s, "ts", "px", "id", ["k"], late="1 hour", width="1 hour"), finish=end)
    assert sorted((r.ts.hour, r.o, r.h, r.l, r.c, r.v) for r in out.where("k = 's'").collect()) == [(0, 1.0, 3.0, 1.0, 3.0, 3), (5, 4.0, 9.0, 4.0, 9.0, 5)]


def test_a_tie_loses_or_is_dropped(spark):
    b = bars(spark, [(10, 10, 10), (12, 8, 10), (13, 7, 10)])
    e = b.where("pos = 0").select("series_id", "pos")
    win, lose = F.col("bh") >= 12, F.col("bl") <= 8
    assert outcomes.race(e, b, ["series_id", "pos"], 2, win, lose).first().outcome == -1
    assert outcomes.race(e, b, ["series_id", "pos"], 2, win, lose, tie="drop").first().outcome is None
    assert outcomes.race(e, b, ["series_id", "pos"], 2, F.col("bh") > 99, F.col("bl") < 0).first().outcome == 0


def test_the_entry_bar_counts_only_where_asked(spark):
    b = bars(spark, [(12, 8, 10), (11, 9, 10), (12, 10, 11)])
    e = b.where("pos = 0").select("series_id", "pos")
    win, lose = F.col("bh") >= 12, F.col("bl") <= 8
    assert outcomes.race(e, b, ["series_id", "pos"], 2, win, lose, start=1).first().outcome == 1
    assert outcomes.race(e, b, ["series_id", "pos"], 2, win, lose, start=1, lose_from=0).first().outcome == -1


def test_a_wide_bar_is_no_retest(spark):
    b = bars(spark, [(10, 9, 10), (20, 5, 12), (13, 12, 12)])  # beyond and back in one bar only
    e = b.where("pos = 0").select("series_id", "pos")
    r = outcomes.retests(e, b, ["series_id", "pos"], F.col("bh") >= 15, F.col("bl") <= 10, 5).first()
    assert (r.t_gone, r.t_back) == (1, None)


def test_flat_tops_are_no_swings(spark):
    s = features.fractal_swings(bars(spark, [(1, 0, 1), (5, 1, 2), (5, 1, 2), (5, 1, 2), (1, 0, 1)]), 1)
    assert s.where("swing_hi").count() == 0


def test_the_tail_has_no_forward_extremes(spark):
    f = features.forward_extremes(bars(spark, [(i, i, i) for i in range(5)]), 4).orderBy("pos").collect()
    assert [r.fwd_hi for r in f] == [4.0, None, None, None, None]


@pytest.mark.parametrize("chunk", [16, 50, 1000])
def test_chunks_give_what_an_undivided_window_gives(spark, monkeypatch, chunk):
    from barloom.operators import halo

    rows = [((i * 37) % 101 + 5, (i * 37) % 101 - 5, (i * 37) % 101) for i in range(200)]
    whole = features.forward_extremes(features.fractal_swings(bars(spark, rows), 3), 8).toPandas().sort_values("pos", ignore_index=True)
    monkeypatch.setattr(halo.with_halo, "__defaults__", (chunk,))
    parts = features.forward_extremes(features.fractal_swings(bars(spark, rows), 3), 8).toPandas().sort_values("pos", ignore_index=True)
    pd.testing.assert_frame_equal(whole, parts)


def test_wilder_atr_of_chunks_equals_the_recursion(spark, monkeypatch):
    from barloom.operators import halo

    rows = [((i * 37) % 11 + 5, (i * 17) % 7 - 5, (i * 5) % 3) for i in range(700)]
    monkeypatch.setattr(halo.with_halo, "__defaults__", (300,))
    got = {r.pos: r.atr for r in features.wilder_atr(bars(spark, rows), 4).collect()}
    tr = [rows[0][0] - rows[0][1]] + [max(h - low, abs(h - rows[i][2]), abs(low - rows[i][2])) for i, (h, low, _) in enumerate(rows[1:])]
    atr = sum(tr[:4]) / 4
    assert got[2] is None and got[3] == pytest.approx(atr)
    for i in range(4, len(tr)):
        atr = (atr * 3 + tr[i]) / 4
        assert got[i] == pytest.approx(atr, rel=1e-12)


def test_wilder_atr_is_linear(spark):
    import time

    b = spark.range(200_000).selectExpr("'s' AS series_id", "id AS pos", "CAST(id * 37 % 101 + 5 AS DOUBLE) AS h", "CAST(id * 37 % 101 - 5 AS DOUBLE) AS l", "CAST(id * 37 % 101 AS DOUBLE) AS c")
    began = time.perf_counter()
    got = features.wilder_atr(b).agg(F.count("atr").alias("n"), F.max(F.when(F.col("pos") == 199_999, F.col("atr"))).alias("last")).first()
    assert time.perf_counter() - began < 90
    rows = [(i * 37 % 101) for i in range(200_000)]
    atr = 0.0
    for i in range(150_000, 200_000):  # long after the seed is forgotten
        atr = (atr * 13 + max(10, abs(rows[i] + 5 - rows[i - 1]), abs(rows[i] - 5 - rows[i - 1]))) / 14
    assert got.n == 200_000 - 13 and got["last"] == pytest.approx(atr, rel=1e-12)


def test_lattice_edges(spark):
    df = spark.createDataFrame([(243.0,), (-1.0,), (121.5,), (0.0,)], "p double")
    pct = [r[0] for r in df.select(L.block_pct(F.col("p"), 243.0)).collect()]
    assert pct[0] == 0 and 0 <= pct[1] < 100 and pct[2] == 50 and pct[3] == 0
    half = df.limit(1).select(L.nearest_level_price(F.lit(121.5), F.lit(0.0), 243.0), L.nearest_level_price(F.lit(364.5), F.lit(0.0), 243.0)).first()
    assert tuple(half) == (0.0, 486.0)  # halves go to the even block


def test_daylight_saving(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",)], "s string").select(F.to_timestamp("s").alias("ts"))
    got = [str(r[0]) for r in df.select(F.date_format(readers.new_york_to_zurich(F.col("ts")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-03-10 08:00", "2024-11-03 06:30"]


def test_roles_scale_and_files(spark, tmp_path):
    assert readers.detect_roles(["TS_Event", "Instrument_ID", "open", "high", "low", "close", "volume"])["ts"] == "TS_Event"
    df = spark.createDataFrame([(21_000_000_000_000,), (22_000_000_000_000,)], "close long")
    assert readers.price_scale(df, "close") == 1e9 and readers.price_scale(df, "close", 10.0) == 10.0
    (tmp_path / "a.csv").write_text("20240102 093000;1;2;0;1;5\n20240102 093000;9;9;9;9;9\n20240102 093100;1;3;1;2;6\n")
    read = readers.read_vendor_csv(spark, str(tmp_path / "*.csv")).orderBy("ts").collect()
    assert [(r.o, r.v) for r in read] == [(1.0, 5.0), (1.0, 6.0)]
    assert readers.text_delimiter(spark, str(tmp_path / "a.csv")) == ";"
    readers.write_year_buckets(spark.createDataFrame([("2024-01-02", 1)], "t string, x int").select(F.to_timestamp("t").alias("ts"), "x"), str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y")).first().year_bucket == 2024
    assert readers.inspect_parquet(spark, str(tmp_path / "y")).rows == 1
    readers.write_cube(spark.createDataFrame([(1, 2.0)], "a int, b double"), str(tmp_path / "j1"))
    readers.write_cube(spark.createDataFrame([(3,)], "a int"), str(tmp_path / "j2"))
    assert readers.merge_cubes(spark, {"x": str(tmp_path / "j1"), "y": str(tmp_path / "j2")}).count() == 2


def test_touched_cells_equal_a_test_of_every_cell(spark):
    import math
    import random

    from barloom.functions import lattice as L
    from barloom.operators import events as V

    rng = random.Random(6)
    rows = []
    for i in range(150):
        low = round(rng.uniform(-300, 900), 2) if i % 3 else 2.43 * rng.choice(L.LEVELS) + 4.05 * rng.randrange(60)
        rows.append((i, low, low + rng.choice([0.0, 0.5, 20.0, 242.0, 600.0])))
    got = sorted((r.i, r.pct, round(r.phase, 9)) for r in V.touched_cells(spark.createDataFrame(rows, "i int, l double, h double"), F.lit(243.0), 60).collect())
    want = []
    for i, low, high in rows:
        for p in L.LEVELS:
            for j in range(60):
                shift = 243.0 * (100.0 * j / 60) / 100
                if math.floor((high - shift) / 243.0 - p / 100) >= math.ceil((low - shift) / 243.0 - p / 100):
                    want.append((i, float(p), round(100.0 * j / 60, 9)))
    assert got == sorted(want)


def test_prices_on_an_edge_of_a_bin_count_in_the_bin_above(spark):
    from barloom.plans.study_queries import position_histogram

    px = [20.25, 28.35, 40.5, 56.7, 81.0, 162.0, 263.25]  # by way of percent each falls a bin lower
    got = position_histogram(spark.createDataFrame([(x,) for x in px], "h double")).collect()
    assert {r.bin: r.cnt for r in got} == {50: 2, 70: 1, 100: 1, 140: 1, 200: 1, 400: 1}


def test_ranks_of_prices_run_over_tasks(spark):
    from barloom.operators.bars import ranked

    px = [(float(i * 7 % 50), i) for i in range(200)]
    got = ranked(spark.createDataFrame(px, "px double, i int").repartition(3), ["px", "i"], "rank").collect()
    assert [(r.px, r.i) for r in sorted(got, key=lambda r: r["rank"])] == sorted(px)
    assert sorted(r["rank"] for r in got) == list(range(200))


def test_injected_prices_are_drawn_by_rank():
    from barloom.plans import registry

    sql = registry.oracle_sql()["injected_power"]
    assert "row_number() OVER (ORDER BY px) AS i FROM px" in sql and "ascii" not in sql


def test_price_scale_holds_no_prices(spark):
    import random
    import statistics

    rng = random.Random(4)
    tables = [[], [None], [1e6], [1e6 + 1, None], [999_999.0, 1_000_001.0], [-999_999.0, 1_000_003.0], [1e6, 1e6, 2e6], [1.0, float("inf")]]
    tables += [[rng.choice([-1, 1]) * rng.choice([999_998.5, 1e6, 1_000_001.0, 1_000_003.0]) for _ in range(rng.randrange(1, 9))] for _ in range(30)]
    rows = [(i, x) for i, t in enumerate(tables) for x in t or [None]]
    out = spark.createDataFrame(rows, "i int, x double").groupBy("i").agg(readers.scale_of(F.col("x")).alias("s"))
    got = {r.i: r.s for r in out.collect()}
    sizes = [[abs(x) for x in t if x is not None] for t in tables]
    assert got == {i: 1e9 if t and statistics.median(t) > 1e6 else 1.0 for i, t in enumerate(sizes)}
    assert "percentile" not in out._jdf.queryExecution().toString()
