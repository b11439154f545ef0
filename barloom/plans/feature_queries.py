"""Lattice functions and window features."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import lattice as L
from barloom.operators import features as X
from barloom.operators.bars import daily
from barloom.operators.halo import core, frame, ordered, with_halo
from barloom.operators.outcomes import future
from barloom.operators.scan import running
from barloom.plans.inputs import EVT, LEVELS, ORD, bars_evt, bars_ord
from barloom.plans.registry import query

R = 243.0
_W = "WINDOW w AS (PARTITION BY series_id ORDER BY pos)"
_PCT = "(c - 243 * floor(c / 243)) / 243 * 100"


def _r(x, n=6):
    return F.round(x, n)


@query(EVT + f", {LEVELS}, p AS (SELECT series_id, pos, c, {_PCT} AS pct FROM bars), n AS (SELECT series_id, pos, idx, least(abs(p.pct - v.pct), 100 - abs(p.pct - v.pct)) AS d FROM p, levels v) SELECT p.series_id, p.pos, round(p.pct, 6) AS pct, x.on_level, x.level FROM p JOIN (SELECT series_id, pos, bool_or(d <= 0.5) AS on_level, CAST(CASE WHEN min(d) <= 0.5 THEN arg_min(idx, d * 100 + idx * 1e-9) ELSE -1 END AS INT) AS level FROM n GROUP BY series_id, pos) x USING (series_id, pos)")
def block_position(spark, sf_dir):
    b = bars_evt(spark, sf_dir).withColumn("pct", L.block_pct(F.col("c"), R))
    return b.select("series_id", "pos", _r("pct").alias("pct"), L.on_level(F.col("pct"), 0.5).alias("on_level"), L.level_index(F.col("pct"), 0.5).cast("int").alias("level"))


@query(f"WITH {LEVELS}, g AS (SELECT i * 100.0 / 100001 AS pct, i FROM (SELECT unnest(range(0, 100001)) AS i)) SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM (SELECT i, bool_or(least(abs(g.pct - v.pct), 100 - abs(g.pct - v.pct)) <= 0.5) AS hit FROM g, levels v GROUP BY i)")
def level_coverage(spark, sf_dir):
    grid = spark.range(100001).select((F.col("id") * 100.0 / 100001).alias("pct"))
    return grid.agg(_r(F.avg(L.on_level(F.col("pct"), 0.5).cast("double"))).alias("coverage"))


@query(EVT + f""", {LEVELS} SELECT series_id, pos, CAST(floor(c / 243) AS BIGINT) AS block, CAST((SELECT max(idx) FROM levels v WHERE v.pct <= {_PCT}) AS INT) AS level_below,
round((round_even(c / 243 - 0.5, 0) + 0.5) * 243, 6) AS nearest_mid, round(least(c - 25 * floor(c / 25), 25 - (c - 25 * floor(c / 25))), 6) AS round_dist FROM bars""")
def level_split(spark, sf_dir):
    c, pct = F.col("c"), L.block_pct(F.col("c"), R)
    return bars_evt(spark, sf_dir).select("series_id", "pos", F.floor(c / R).alias("block"), L.level_floor(pct).cast("int").alias("level_below"), _r(L.nearest_level_price(c, F.lit(50.0), R)).alias("nearest_mid"), _r(L.round_distance(c, 25.0)).alias("round_dist"))


@query(EVT + f"""SELECT series_id, layer, CAST(count(*) AS BIGINT) AS n FROM (SELECT series_id, CASE WHEN p < 11 THEN 0 WHEN p < 23 THEN 1 WHEN p < 41 THEN 2 WHEN p < 59 THEN 3
WHEN p < 77 THEN 4 WHEN p < 89 THEN 5 ELSE 6 END AS layer FROM (SELECT series_id, {_PCT} AS p FROM bars)) GROUP BY ALL""")
def layer_dwell(spark, sf_dir):
    return bars_evt(spark, sf_dir).groupBy("series_id", L.layer_index(L.block_pct(F.col("c"), R)).alias("layer")).agg(F.count("*").alias("n"))


@query(EVT + f"""SELECT series_id, CAST(count(*) FILTER (p < 3 OR p >= 97) AS BIGINT) AS ext, CAST(count(*) FILTER (p >= 47 AND p < 53) AS BIGINT) AS eq,
CAST(count(*) FILTER ((p >= 27.5 AND p < 30.5) OR (p >= 69.5 AND p < 72.5)) AS BIGINT) AS fv, CAST(count(*) FILTER ((p >= 15.5 AND p < 18.5) OR (p >= 81.5 AND p < 84.5)) AS BIGINT) AS gip
FROM (SELECT series_id, {_PCT} AS p FROM bars) GROUP BY series_id""")
def zone_masks(spark, sf_dir):
    p = L.block_pct(F.col("c"), R)
    return bars_evt(spark, sf_dir).groupBy("series_id").agg(*[F.count_if(L.in_zone(p, z)).alias(z.lower()) for z in L.ZONES])


@query(EVT + "SELECT series_id, date, CAST(arg_min(p, abs(ln(x) - ln(p)) + p * 1e-12) AS INT) AS po3 FROM (SELECT series_id, date, max(h) - min(l) AS x FROM bars GROUP BY ALL HAVING max(h) > min(l)), (SELECT unnest([27,81,243,729,2187,6561]) AS p) GROUP BY ALL")
def nearest_po3(spark, sf_dir):
    d = daily(bars_evt(spark, sf_dir)).where("h > l")
    return d.select("series_id", "date", L.nearest_po3(F.col("h") - F.col("l")).alias("po3"))


@query("SELECT DISTINCT r, r IN (81, 243, 729, 2187, 6561) AS is_po3 FROM (SELECT round(exp(ln(50) + (ln(7000) - ln(50)) * i / 47), 2) AS r FROM (SELECT unnest(range(0, 48)) AS i) UNION ALL SELECT CAST(unnest([81,243,729,2187,6561]) AS DOUBLE))")
def r_grid(spark, sf_dir):
    geo = spark.range(48).select(F.round(F.exp(F.ln(F.lit(50.0)) + (F.ln(F.lit(7000.0)) - F.ln(F.lit(50.0))) * F.col("id") / 47), 2).alias("r"))
    po3 = spark.createDataFrame([(float(p),) for p in L.PO3], "r double")
    return geo.union(po3).distinct().withColumn("is_po3", F.col("r").isin([float(p) for p in L.PO3]))


@query(EVT + f""", s AS (SELECT *, count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 AND count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3 AS whole,
greatest(max(h) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), max(h) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS mh,
least(min(l) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), min(l) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS ml FROM bars {_W})
SELECT series_id, pos, whole AND h > mh AS swing_hi, whole AND l < ml AS swing_lo FROM s WHERE whole AND (h > mh OR l < ml)""")
def fractal_swings(spark, sf_dir):
    return X.fractal_swings(bars_evt(spark, sf_dir), 3).where("swing_hi OR swing_lo").select("series_id", "pos", "swing_hi", "swing_lo")


@query(EVT + f""", g AS (SELECT *, sum(CASE WHEN d > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos) AS blk FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER w) AS d FROM bars {_W})),
s AS (SELECT *, lag(blk, 3) OVER w = lead(blk, 3) OVER w AS whole, greatest(max(h) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), max(h) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS mh,
least(min(l) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), min(l) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS ml FROM g {_W})
SELECT series_id, pos, h > mh AS swing_hi, l < ml AS swing_lo FROM s WHERE whole AND (h > mh OR l < ml)""")
def pivots_in_block(spark, sf_dir):
    from barloom.operators.bars import gap_blocks

    return X.fractal_swings(gap_blocks(bars_evt(spark, sf_dir), 7200), 3, "blk").where("swing_hi OR swing_lo").select("series_id", "pos", "swing_hi", "swing_lo")


@query(EVT + f""", s AS (SELECT *, greatest(max(h) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), max(h) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) AS mh,
least(min(l) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), min(l) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) AS ml FROM bars {_W}),
k AS (SELECT *, lag(CASE WHEN h > mh THEN h END, 5) OVER w AS kh, lag(CASE WHEN l < ml THEN l END, 5) OVER w AS kl FROM s {_W})
SELECT series_id, pos, last_value(kh IGNORE NULLS) OVER w AS last_hi, last_value(kl IGNORE NULLS) OVER w AS last_lo FROM k {_W}""")
def last_fractal(spark, sf_dir):
    return X.last_fractal(bars_evt(spark, sf_dir), 5).select("series_id", "pos", "last_hi", "last_lo")


_FWD = f"SELECT series_id, pos, CASE WHEN count(*) OVER f = 16 THEN max(h) OVER f END AS fwd_hi, CASE WHEN count(*) OVER f = 16 THEN min(l) OVER f END AS fwd_lo FROM bars WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING)"


@query(EVT + _FWD)
def fwd_extremes(spark, sf_dir):
    return X.forward_extremes(bars_evt(spark, sf_dir), 16).select("series_id", "pos", "fwd_hi", "fwd_lo")


@query(EVT + _FWD)
def fwd_extremes_doubled(spark, sf_dir):
    return X.forward_extremes_doubled(bars_evt(spark, sf_dir), 4).select("series_id", "pos", "fwd_hi", "fwd_lo")


@query(EVT + """SELECT series_id, pos, coalesce(max(c) OVER p, c) AS prev_max_c, coalesce(min(c) OVER p, c) AS prev_min_c, max(h) OVER r AS roll_hi, min(l) OVER r AS roll_lo,
max(h) OVER p AS win_hi, min(l) OVER p AS win_lo FROM bars WINDOW p AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""")
def trailing_extremes(spark, sf_dir):
    return X.trailing_extremes(bars_evt(spark, sf_dir)).select("series_id", "pos", "prev_max_c", "prev_min_c", "roll_hi", "roll_lo", "win_hi", "win_lo")


_TR = f"t AS (SELECT *, greatest(h - l, coalesce(abs(h - lag(c) OVER w), 0), coalesce(abs(l - lag(c) OVER w), 0)) AS tr FROM bars {_W})"


@query(EVT + f", {_TR} SELECT series_id, pos, round(CASE WHEN pos >= 20 THEN avg(tr) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, 6) AS atr FROM t")
def simple_atr(spark, sf_dir):
    return X.simple_atr(bars_evt(spark, sf_dir), 20).select("series_id", "pos", _r("atr").alias("atr"))


@query(EVT + f", {_TR}, a AS (SELECT series_id, CAST(13 AS BIGINT) AS pos, avg(tr) AS atr FROM t WHERE pos < 14 GROUP BY series_id HAVING count(*) = 14 UNION ALL SELECT t.series_id, t.pos, (a.atr * 13 + t.tr) / 14 FROM a JOIN t ON t.series_id = a.series_id AND t.pos = a.pos + 1) SELECT b.series_id, b.pos, round(a.atr, 6) AS atr FROM bars b LEFT JOIN a USING (series_id, pos)")
def wilder_atr(spark, sf_dir):
    return X.wilder_atr(bars_evt(spark, sf_dir), 14).select("series_id", "pos", _r("atr").alias("atr"))


@query(EVT + """SELECT series_id, pos, round(v / CASE WHEN pos > 0 THEN exp(avg(ln(greatest(v, 1))) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) ELSE 1 END, 6) AS rvol,
round(avg(v) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), 6) AS approach,
v >= max(v) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS climax,
round((h - l) / nullif(avg(h - l) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 0), 5) AS expansion FROM bars""")
def rel_volume(spark, sf_dir):
    return X.volume_features(bars_evt(spark, sf_dir)).select("series_id", "pos", _r("rvol").alias("rvol"), _r("approach").alias("approach"), "climax", _r("expansion", 5).alias("expansion"))


@query(EVT + "SELECT series_id, pos, round(sum((h + l + c) / 3 * v) OVER w / greatest(sum(v) OVER w, 1), 3) AS vwap, max(h) OVER w AS run_hi, min(l) OVER w AS run_lo FROM bars WINDOW w AS (PARTITION BY series_id, date ORDER BY pos)")
def session_vwap(spark, sf_dir):
    return X.session_running(bars_evt(spark, sf_dir)).select("series_id", "pos", _r("vwap", 3).alias("vwap"), "run_hi", "run_lo")


@query(EVT + "SELECT series_id, pos, round(CASE WHEN count(*) OVER w = 40 THEN median(c) OVER w END, 6) AS med FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)")
def trailing_median(spark, sf_dir):
    return X.trailing_median(bars_evt(spark, sf_dir), "c", 40).select("series_id", "pos", _r("med").alias("med"))


@query(EVT + """, d AS (SELECT series_id, date, max(h) - min(l) AS rng, row_number() OVER (PARTITION BY series_id ORDER BY date) AS n FROM bars GROUP BY series_id, date),
f AS (SELECT series_id, median(rng) AS fb FROM d WHERE n <= 20 GROUP BY series_id)
SELECT series_id, date, round(CASE WHEN count(*) OVER w >= 5 THEN median(rng) OVER w ELSE fb END, 6) AS med FROM d JOIN f USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def session_median(spark, sf_dir):
    """The first sessions take the median of the first 20, which looks ahead; so does what is matched here."""
    d = daily(bars_evt(spark, sf_dir)).withColumn("rng", F.col("h") - F.col("l"))
    w = Window.partitionBy("series_id").orderBy("date")
    back = w.rowsBetween(-20, -1)
    first = d.withColumn("_n", F.row_number().over(w)).where("_n <= 20").groupBy("series_id").agg(F.percentile("rng", 0.5).alias("fb"))
    med = F.when(F.count("*").over(back) >= 5, F.percentile("rng", 0.5).over(back)).otherwise(F.col("fb"))
    return d.join(first, "series_id").select("series_id", "date", _r(med).alias("med"))


@query(EVT + f"SELECT series_id, pos, coalesce(max(CASE WHEN {_PCT} BETWEEN 47 AND 53 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM bars")
def seen_within(spark, sf_dir):
    return X.seen_within(bars_evt(spark, sf_dir), L.block_pct(F.col("c"), R).between(47, 53), 24).select("series_id", "pos", "seen")


@query(EVT + f"""SELECT series_id, pos, gap_up, gap_dn, CASE WHEN gap_up THEN h2 ELSE h END AS edge_lo, CASE WHEN gap_up THEN l ELSE l2 END AS edge_hi FROM
(SELECT *, l > h2 AS gap_up, h < l2 AS gap_dn FROM (SELECT *, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2 FROM bars {_W})) WHERE gap_up OR gap_dn""")
def fair_value_gaps(spark, sf_dir):
    return X.fair_value_gaps(bars_evt(spark, sf_dir)).where("gap_up OR gap_dn").select("series_id", "pos", "gap_up", "gap_dn", "edge_lo", "edge_hi")


@query(ORD + f""", g AS (SELECT *, lag(h, 2) OVER w AS h2 FROM bars {_W}), u AS (SELECT series_id, pos, h2 AS lo, l AS hi FROM g WHERE l > h2),
k AS (SELECT u.series_id, u.pos, u.lo, u.hi, min(b.pos) AS killed FROM u LEFT JOIN bars b ON b.series_id = u.series_id AND b.pos > u.pos AND b.pos <= u.pos + 80 AND b.l <= u.lo GROUP BY ALL)
SELECT b.series_id, b.pos FROM bars b WHERE EXISTS (SELECT 1 FROM k WHERE k.series_id = b.series_id AND b.pos > k.pos AND b.pos <= least(k.pos + 80, coalesce(k.killed, k.pos + 80)) AND b.c >= k.lo AND b.c <= k.hi)""")
def inside_unfilled_gap(spark, sf_dir):
    """Bars that close inside an upward gap which is still open: at most 80 bars old and not traded through."""
    bars = bars_ord(spark, sf_dir)
    gaps = X.fair_value_gaps(bars).where("gap_up").select("series_id", "pos", F.col("edge_lo").alias("lo"), F.col("edge_hi").alias("hi"))
    rows = future(gaps, bars, 80)
    killed = rows.groupBy("series_id", "pos").agg(F.min(F.when(F.col("bl") <= F.col("lo"), F.col("w"))).alias("killed"))
    live = rows.join(killed, ["series_id", "pos"]).where("w <= coalesce(killed, 80) AND bc >= lo AND bc <= hi")
    return live.select("series_id", (F.col("pos") + F.col("w")).alias("pos")).distinct()


HIGHER, LIVES = 2, 80
_GAPS = f"""{EVT}, hc AS (SELECT series_id, pos // {HIGHER} AS k, max(h) AS h, min(l) AS l FROM bars GROUP BY ALL),
g0 AS (SELECT *, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2 FROM hc WINDOW w AS (PARTITION BY series_id ORDER BY k)),
gp AS (SELECT series_id, k, 'up' AS side, h2 AS lo, l AS hi FROM g0 WHERE l > h2 UNION ALL SELECT series_id, k, 'dn', h, l2 FROM g0 WHERE h < l2),
kl AS (SELECT gp.series_id, gp.k, side, lo, hi, min(x.k - gp.k) AS killed FROM gp LEFT JOIN hc x ON x.series_id = gp.series_id AND x.k > gp.k AND x.k <= gp.k + {LIVES}
  AND CASE WHEN side = 'up' THEN x.l <= lo ELSE x.h >= hi END GROUP BY ALL),
bx AS (SELECT DISTINCT b.series_id, b.pos, side FROM kl JOIN bars b ON b.series_id = kl.series_id AND b.pos // {HIGHER} > k AND b.pos // {HIGHER} <= k + coalesce(killed, {LIVES}) AND c BETWEEN lo AND hi)
SELECT series_id, pos, bool_or(side = 'up') AS in_up, bool_or(side = 'dn') AS in_dn FROM bx GROUP BY ALL"""


@query(_GAPS)
def inside_higher_gaps(spark, sf_dir):
    """Bars that close inside a gap of the higher time frame, upward or downward, that is 80 candles old at most and not traversed."""
    bars = bars_evt(spark, sf_dir).withColumn("k", F.floor(F.col("pos") / HIGHER))
    candles = bars.groupBy("series_id", F.col("k").alias("pos")).agg(F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "pos").alias("c"))
    gaps = X.fair_value_gaps(candles).where("gap_up OR gap_dn")
    gaps = gaps.select("series_id", "pos", F.when(F.col("gap_up"), "up").otherwise("dn").alias("side"), F.col("edge_lo").alias("lo"), F.col("edge_hi").alias("hi"))
    rows = future(gaps, candles, LIVES).where("w IS NOT NULL")
    through = F.when(F.col("side") == "up", F.col("bl") <= F.col("lo")).otherwise(F.col("bh") >= F.col("hi"))
    last = rows.groupBy("series_id", "pos", "side").agg(F.min(F.when(through, F.col("w"))).alias("killed"))
    live = rows.join(last, ["series_id", "pos", "side"]).where(F.col("w") <= F.coalesce("killed", F.lit(LIVES)))
    live = live.select("series_id", (F.col("pos") + F.col("w")).alias("k"), "side", "lo", "hi")
    inside = live.join(bars.select("series_id", "k", "pos", "c"), ["series_id", "k"]).where("c BETWEEN lo AND hi")
    return inside.groupBy("series_id", "pos").agg(F.bool_or(F.col("side") == "up").alias("in_up"), F.bool_or(F.col("side") == "dn").alias("in_dn"))


@query(EVT + f"""SELECT series_id, min(pos) AS first_pos, max(pos) AS last_pos, CAST(count(*) AS BIGINT) AS n FROM (SELECT series_id, pos, rn - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS run
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS rn FROM bars) WHERE {_PCT} < 23 OR {_PCT} >= 77) GROUP BY series_id, run""")
def episodes(spark, sf_dir):
    p = L.block_pct(F.col("c"), R)
    return X.islands(bars_evt(spark, sf_dir), (p < 23) | (p >= 77), ["series_id"]).select("series_id", "first_pos", "last_pos", "n")


@query(EVT + f"SELECT series_id, pos, blk, CAST(row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS INT) AS step FROM (SELECT series_id, pos, CAST(floor(c / 81) AS BIGINT) AS blk, lag(floor(c / 81)) OVER w AS was FROM bars {_W}) WHERE was IS NULL OR was <> blk")
def level_changes(spark, sf_dir):
    b = bars_evt(spark, sf_dir).withColumn("blk", F.floor(F.col("c") / 81))
    return X.changes(b, "blk", ["series_id"]).select("series_id", "pos", "blk", F.col("step").cast("int").alias("step"))


@query(EVT + f"SELECT series_id, pos, round(max(h) OVER f - min(l) OVER f, 6) AS amplitude FROM bars WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)")
def swing_amplitude(spark, sf_dir):
    df = with_halo(bars_evt(spark, sf_dir), 30, 30)
    f = frame(-30, 30)
    return core(df.withColumn("amplitude", _r(F.max("h").over(f) - F.min("l").over(f)))).select("series_id", "pos", "amplitude")


@query(EVT + f"SELECT series_id, pos, round((c / lag(c) OVER w - 1) * 10000, 4) AS ret_bps, round((h - l) / o * 10000, 4) AS range_bps FROM bars {_W}")
def returns_bps(spark, sf_dir):
    df = with_halo(bars_evt(spark, sf_dir), 1, 0)
    df = core(df.withColumn("ret_bps", _r((F.col("c") / F.lag("c").over(ordered()) - 1) * 10000, 4)))
    return df.select("series_id", "pos", "ret_bps", _r((F.col("h") - F.col("l")) / F.col("o") * 10000, 4).alias("range_bps"))


@query(EVT + f"""SELECT series_id, pos, max(CASE WHEN new THEN pos END) OVER w AS run_start FROM (SELECT *, coalesce((c > o) <> lag(c > o) OVER w, true) AS new FROM bars {_W}) {_W}""")
def candle_run_start(spark, sf_dir):
    up = F.col("c") > F.col("o")
    df = core(with_halo(bars_evt(spark, sf_dir), 1, 0).withColumn("_was", F.lag(up).over(ordered())))
    starts = F.when(F.coalesce(up != F.col("_was"), F.lit(True)), F.col("pos"))
    return running(df, ["series_id"], {"run_start": ("max", starts)}).select("series_id", "pos", "run_start")


_ZIG = ORD + """, s0 AS (SELECT series_id, pos, h, l FROM bars),
z AS (SELECT series_id, pos, true AS up, h AS ext, pos AS spot, CAST(NULL AS DOUBLE) AS px, CAST(NULL AS BIGINT) AS ext_pos, CAST(NULL AS BOOLEAN) AS is_high FROM s0 WHERE pos = 0
UNION ALL SELECT s.series_id, s.pos, CASE WHEN turned THEN NOT up ELSE up END, CASE WHEN moved THEN best WHEN turned THEN other ELSE ext END,
CASE WHEN moved OR turned THEN s.pos ELSE spot END, CASE WHEN turned THEN ext END, CASE WHEN turned THEN spot END, CASE WHEN turned THEN up END
FROM (SELECT z.up, z.ext, z.spot, b.*, CASE WHEN up THEN b.h ELSE b.l END AS best, CASE WHEN up THEN b.l ELSE b.h END AS other,
CASE WHEN up THEN b.h > ext ELSE b.l < ext END AS moved,
CASE WHEN up THEN b.h <= ext AND b.l < ext * (1 - 0.02) ELSE b.l >= ext AND b.h > ext * (1 + 0.02) END AS turned
FROM z JOIN s0 b ON b.series_id = z.series_id AND b.pos = z.pos + 1) s)
SELECT series_id, pos, ext_pos, px, is_high FROM z WHERE is_high IS NOT NULL"""


@query(_ZIG)
def zigzag_swings(spark, sf_dir):
    return X.zigzag(bars_ord(spark, sf_dir), 0.02)
