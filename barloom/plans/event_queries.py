"""Events on the price lattice, their de-duplication and their outcomes."""

from pyspark.sql import functions as F

from barloom.functions import lattice as L
from barloom.operators import events as V
from barloom.operators import features as X
from barloom.operators import outcomes as O
from barloom.operators.halo import core, frame, ordered, with_halo
from barloom.operators.scan import running
from barloom.operators.stats import cells_against_phases
from barloom.plans.inputs import EVT, LEVELS, bars_evt
from barloom.plans.registry import query
from barloom.sources.tables import save

R = SIZE = 243.0
M, GAP = 12, 12

# touches of every level, greedily de-duplicated within (series, phase, level); the recursion walks from kept to kept
_TOUCHES = LEVELS + """, ph AS (SELECT unnest({phases}) AS phase),
t AS (SELECT b.series_id, b.pos, v.pct, ph.phase FROM bars b, levels v, ph
      WHERE floor((b.h - 243 * ph.phase / 100.0) / 243 - v.pct / 100) >= ceil((b.l - 243 * ph.phase / 100.0) / 243 - v.pct / 100)),
k AS (SELECT series_id, pct, phase, min(pos) AS pos FROM t GROUP BY ALL
      UNION ALL SELECT s.series_id, s.pct, s.phase, s.pos FROM (
        SELECT t.*, row_number() OVER (PARTITION BY t.series_id, t.pct, t.phase ORDER BY t.pos) AS rn FROM k JOIN t
        ON t.series_id = k.series_id AND t.pct = k.pct AND t.phase = k.phase AND t.pos >= k.pos + 12) s WHERE s.rn = 1),
x AS (SELECT series_id, pos, CASE WHEN count(*) OVER f = 12 THEN max(h) OVER f END AS fh, CASE WHEN count(*) OVER f = 12 THEN min(l) OVER f END AS fl,
      lag(c, 5) OVER (PARTITION BY series_id ORDER BY pos) AS c5, c FROM bars
      WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)),
o AS (SELECT k.series_id, k.pct, k.phase, k.pos, x.fh, x.fl, x.c5,
      (round_even((x.c - 243 * k.phase / 100.0) / 243 - k.pct / 100, 0) + k.pct / 100) * 243 + 243 * k.phase / 100.0 AS lv
      FROM k JOIN x USING (series_id, pos)),
r AS (SELECT *, CASE WHEN c5 < lv THEN lv - fl > fh - lv ELSE fh - lv > lv - fl END AS reject FROM o WHERE fh IS NOT NULL AND c5 IS NOT NULL AND c5 <> lv)
"""


def touch_outcomes(bars, phases=1):
    """Kept touches with whether price moved back to the side it came from more than it went on, over M bars.

    phases: how many equal shifts of the lattice are scored, the true one (phase 0) included.
    """
    lagged = with_halo(bars, 5, M)
    lagged = core(lagged.withColumn("c5", F.lag("c", 5).over(ordered())))
    df = V.touched_cells(X.forward_extremes(lagged, M), F.lit(R), phases)
    shift = SIZE * F.col("phase") / 100
    kept = V.dedup(df, ["series_id", "phase", "pct"], GAP)
    lv = L.nearest_level_price(F.col("c") - shift, F.col("pct"), R) + shift
    kept = kept.withColumn("lv", lv).where("fwd_hi IS NOT NULL AND c5 IS NOT NULL AND c5 <> lv")
    up, dn = F.col("fwd_hi") - F.col("lv"), F.col("lv") - F.col("fwd_lo")
    return kept.withColumn("reject", F.when(F.col("c5") < F.col("lv"), dn > up).otherwise(up > dn))


@query(EVT + ", " + _TOUCHES.replace("{phases}", "[0.0]") + "SELECT CAST(pct AS INT) AS level, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN reject THEN 1.0 ELSE 0.0 END), 6) AS reject_rate FROM r GROUP BY pct")
def touch_reaction(spark, sf_dir):
    t = touch_outcomes(bars_evt(spark, sf_dir))
    return t.groupBy(F.col("pct").cast("int").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("reject").cast("double")), 6).alias("reject_rate"))


@query(EVT + ", " + _TOUCHES.replace("{phases}", str([100.0 * i / 60 for i in range(60)]) + "::DOUBLE[]") + """, p AS (SELECT phase, avg(CASE WHEN reject THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM r GROUP BY phase)
SELECT CAST(max(CASE WHEN phase = 0 THEN n END) AS BIGINT) AS n, round(max(CASE WHEN phase = 0 THEN rate END), 6) AS rate, round(avg(CASE WHEN phase > 0 THEN rate END), 6) AS null_mean,
round(stddev_samp(CASE WHEN phase > 0 THEN rate END), 6) AS null_sd, round((max(CASE WHEN phase = 0 THEN rate END) - avg(CASE WHEN phase > 0 THEN rate END)) / stddev_samp(CASE WHEN phase > 0 THEN rate END), 4) AS z,
CAST(count(*) FILTER (phase > 0 AND rate >= (SELECT rate FROM p WHERE phase = 0)) + 1 AS BIGINT) AS rank FROM p""")
def touch_reaction_phase_null(spark, sf_dir):
    """Phase is a column: one plan scores the true lattice and its shifts."""
    from barloom.operators.stats import score_against_phases

    t = touch_outcomes(bars_evt(spark, sf_dir), 60)
    return score_against_phases(t.groupBy("phase").agg(F.avg(F.col("reject").cast("double")).alias("rate"), F.count("*").alias("n")))


GRID_SIZES, GRID_AHEAD, GRID_PHASES, BACK = [81.0, 243.0, 729.0], [6, 12, 24, 48], 60, 5
_GRID = LEVELS + f""", ph AS (SELECT 100.0 * i / {GRID_PHASES} AS phase FROM (SELECT unnest(range({GRID_PHASES})) AS i)), rs AS (SELECT unnest({GRID_SIZES}::DOUBLE[]) AS r),
t AS (SELECT b.series_id, b.pos, v.pct, ph.phase, r FROM bars b, levels v, ph, rs
  WHERE floor((b.h - r * ph.phase / 100.0) / r - v.pct / 100) >= ceil((b.l - r * ph.phase / 100.0) / r - v.pct / 100)),
k AS (SELECT series_id, pct, phase, r, min(pos) AS pos FROM t GROUP BY ALL
  UNION ALL SELECT s.series_id, s.pct, s.phase, s.r, s.pos FROM (
    SELECT t.*, row_number() OVER (PARTITION BY t.series_id, t.pct, t.phase, t.r ORDER BY t.pos) AS rn FROM k JOIN t
    ON t.series_id = k.series_id AND t.pct = k.pct AND t.phase = k.phase AND t.r = k.r AND t.pos >= k.pos + {GAP}) s WHERE s.rn = 1),
x AS (SELECT series_id, pos, c, lag(c, {BACK}) OVER (PARTITION BY series_id ORDER BY pos) AS c5, unnest([{", ".join(
  f"{{'m': {m}, 'fh': CASE WHEN count(*) OVER f{m} = {m} THEN max(h) OVER f{m} END, 'fl': min(l) OVER f{m}}}" for m in GRID_AHEAD)}]) AS f FROM bars
  WINDOW {", ".join(f"f{m} AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {m} FOLLOWING)" for m in GRID_AHEAD)}),
o AS (SELECT k.r, k.pct, k.phase, f.m AS m, f.fh AS fh, f.fl AS fl, x.c5,
  (round_even((x.c - k.r * k.phase / 100.0) / k.r - k.pct / 100, 0) + k.pct / 100) * k.r + k.r * k.phase / 100.0 AS lv FROM k JOIN x USING (series_id, pos)),
g AS (SELECT r, m, pct, phase, count(*) AS n, avg(CASE WHEN CASE WHEN c5 < lv THEN lv - fl > fh - lv ELSE fh - lv > lv - fl END THEN 1.0 ELSE 0.0 END) AS rate
  FROM o WHERE fh IS NOT NULL AND c5 IS NOT NULL AND c5 <> lv GROUP BY ALL)
SELECT g.r, CAST(g.m AS INT) AS m, CAST(g.pct AS INT) AS level, CAST(b.n AS BIGINT) AS n, round(b.rate, 6) AS rate, round(avg(g.rate) FILTER (g.phase > 0), 6) AS null_mean,
round(stddev_samp(g.rate) FILTER (g.phase > 0), 6) AS null_sd, round((b.rate - avg(g.rate) FILTER (g.phase > 0)) / nullif(stddev_samp(g.rate) FILTER (g.phase > 0), 0), 4) AS z,
CAST(count(*) FILTER (g.phase > 0 AND g.rate >= b.rate) + 1 AS BIGINT) AS rank FROM g JOIN g b ON b.r = g.r AND b.m = g.m AND b.pct = g.pct AND b.phase = 0 GROUP BY g.r, g.m, g.pct, b.n, b.rate"""


def touch_grid(bars, sizes, ahead, phases):
    """Rates of rejection by size, horizon, level and phase: touches are found and de-duplicated once a size for all horizons."""
    df = with_halo(bars, BACK, max(ahead))
    extremes = [F.struct(F.lit(m).alias("m"), F.when(X.full(m, 1, m), F.max("h").over(frame(1, m))).alias("fh"), F.min("l").over(frame(1, m)).alias("fl")) for m in ahead]
    df = core(df.withColumns({"c5": F.lag("c", BACK).over(ordered()), "ahead": F.array(*extremes)}))
    df = save(df.select("series_id", "pos", "h", "l", "c", "c5", "ahead"), "ahead")
    every = None
    for r in sizes:
        one = V.touched_cells(df, F.lit(r), phases).withColumn("r", F.lit(r))
        every = one if every is None else every.unionByName(one)
    shift = F.col("r") * F.col("phase") / 100
    kept = V.dedup(every, ["series_id", "r", "phase", "pct"], GAP).withColumn("lv", L.nearest_level_price(F.col("c") - shift, F.col("pct"), F.col("r")) + shift)
    kept = kept.where("c5 IS NOT NULL AND c5 <> lv").select("r", "pct", "phase", "c5", "lv", F.explode("ahead").alias("f")).select("*", "f.*").where("fh IS NOT NULL")
    up, dn = F.col("fh") - F.col("lv"), F.col("lv") - F.col("fl")
    reject = F.when(F.col("c5") < F.col("lv"), dn > up).otherwise(up > dn)
    return kept.groupBy("r", "m", "pct", "phase").agg(F.avg(reject.cast("double")).alias("rate"), F.count("*").alias("n"))


@query(EVT + ", " + _GRID)
def level_reaction_grid(spark, sf_dir):
    """Rejection of each level by block size and horizon, against 59 shifts of the lattice."""
    g = touch_grid(bars_evt(spark, sf_dir), GRID_SIZES, GRID_AHEAD, GRID_PHASES)
    out = cells_against_phases(save(g, "touch_grid"), ["r", "m", "pct"])
    return out.withColumn("level", F.col("pct").cast("int")).drop("pct")


_CROSS = """, x AS (SELECT *, CAST(floor(c / 243) AS BIGINT) AS bn, CAST(floor(lag(c) OVER w / 243) AS BIGINT) AS was FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
e AS (SELECT series_id, pos, bn > was AS up, CASE WHEN bn > was THEN bn ELSE bn + 1 END * 243.0 AS lv FROM x WHERE was IS NOT NULL AND bn <> was)"""


@query(EVT + _CROSS + " SELECT series_id, pos, up, lv FROM e")
def close_crosses(spark, sf_dir):
    return V.close_crosses(bars_evt(spark, sf_dir), SIZE).select("series_id", "pos", "up", F.col("line").alias("lv"))


@query(EVT + _CROSS + """, f AS (SELECT e.*, (SELECT CASE WHEN count(*) = 12 THEN max(b.h) END FROM bars b WHERE b.series_id = e.series_id AND b.pos > e.pos AND b.pos <= e.pos + 12) AS fh,
(SELECT CASE WHEN count(*) = 12 THEN min(b.l) END FROM bars b WHERE b.series_id = e.series_id AND b.pos > e.pos AND b.pos <= e.pos + 12) AS fl FROM e)
SELECT series_id, up, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN up THEN CAST(fl < lv AS INT) ELSE CAST(fh > lv AS INT) END), 6) AS reverse_rate FROM f WHERE fh IS NOT NULL GROUP BY series_id, up""")
def sweep_reverse(spark, sf_dir):
    """How often a crossed boundary is given back within M bars."""
    e = V.close_crosses(X.forward_extremes(bars_evt(spark, sf_dir), M), SIZE).where("fwd_hi IS NOT NULL")
    back = F.when(F.col("up"), F.col("fwd_lo") < F.col("line")).otherwise(F.col("fwd_hi") > F.col("line"))
    return e.groupBy("series_id", "up").agg(F.count("*").alias("n"), F.round(F.avg(back.cast("double")), 6).alias("reverse_rate"))


@query(EVT + _CROSS + """, f AS (SELECT e.*, (SELECT CASE WHEN count(*) = 12 THEN max(b.h) END FROM bars b WHERE b.series_id = e.series_id AND b.pos > e.pos AND b.pos <= e.pos + 12) AS fh,
(SELECT CASE WHEN count(*) = 12 THEN min(b.l) END FROM bars b WHERE b.series_id = e.series_id AND b.pos > e.pos AND b.pos <= e.pos + 12) AS fl FROM e),
d AS (SELECT series_id, CASE WHEN up THEN greatest(lv - fl, 0) ELSE greatest(fh - lv, 0) END / 243 AS pen FROM f WHERE fh IS NOT NULL)
SELECT series_id, CAST(count(*) AS BIGINT) AS n, round(median(pen), 6) AS med_pen, round(avg(CASE WHEN pen <= 0.02 THEN 1.0 ELSE 0.0 END), 6) AS hold_rate FROM d GROUP BY series_id""")
def penetration_hold(spark, sf_dir):
    e = V.close_crosses(X.forward_extremes(bars_evt(spark, sf_dir), M), SIZE).where("fwd_hi IS NOT NULL")
    pen = F.when(F.col("up"), F.greatest(F.col("line") - F.col("fwd_lo"), F.lit(0.0))).otherwise(F.greatest(F.col("fwd_hi") - F.col("line"), F.lit(0.0))) / SIZE
    return e.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.percentile(pen, 0.5), 6).alias("med_pen"), F.round(F.avg((pen <= 0.02).cast("double")), 6).alias("hold_rate"))


# arrivals at all levels: the line is fixed by the previous close; away by half a simple ATR within 60 closes
_ARR = """, t AS (SELECT *, lag(c) OVER w AS c1, greatest(h - l, coalesce(abs(h - lag(c) OVER w), 0), coalesce(abs(l - lag(c) OVER w), 0)) AS tr,
min(c) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS lo60, max(c) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS hi60 FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
a AS (SELECT *, CASE WHEN pos >= 20 THEN avg(tr) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS atr FROM t),
q AS (SELECT a.*, p.pct, (floor(c1 / 243 - p.pct / 100) + 1 + p.pct / 100) * 243 AS up, (ceil(c1 / 243 - p.pct / 100) - 1 + p.pct / 100) * 243 AS dn FROM a, (SELECT unnest({pcts}) AS pct) p WHERE c1 IS NOT NULL),
ev AS (SELECT series_id, pos, pct, up AS lv, true AS above, atr FROM q WHERE h >= up AND up - lo60 >= 0.5 * atr UNION ALL
SELECT series_id, pos, pct, dn AS lv, false AS above, atr FROM q WHERE l <= dn AND hi60 - dn >= 0.5 * atr)""".replace("{pcts}", str([float(x) for x in L.LEVELS]))


def edge_arrivals(bars):
    """Arrivals at all twenty levels."""
    return V.arrivals(X.simple_atr(bars, 20), SIZE, 0.5).select("series_id", "pos", "pct", F.col("line").alias("lv"), "above", "atr")


@query(EVT + _ARR + " SELECT series_id, pos, CAST(pct AS INT) AS pct, round(lv, 6) AS lv, above FROM ev")
def level_arrivals(spark, sf_dir):
    return edge_arrivals(bars_evt(spark, sf_dir)).select("series_id", "pos", F.col("pct").cast("int").alias("pct"), F.round("lv", 6).alias("lv"), "above")


_KEYS = ["series_id", "pos", "pct", "above"]


@query(EVT + _ARR + """, w AS (SELECT ev.*, b.pos - ev.pos AS w, b.h AS bh, b.l AS bl FROM ev JOIN bars b ON b.series_id = ev.series_id AND b.pos BETWEEN ev.pos AND ev.pos + 24),
z AS (SELECT series_id, pos, pct, above, min(w) FILTER (w >= 1 AND CASE WHEN above THEN bl <= lv - 0.5 * atr ELSE bh >= lv + 0.5 * atr END) AS t_win,
min(w) FILTER (CASE WHEN above THEN bh >= lv + 0.5 * atr ELSE bl <= lv - 0.5 * atr END) AS t_lose FROM w GROUP BY ALL),
s AS (SELECT *, CASE WHEN t_win IS NULL AND t_lose IS NULL THEN 0 WHEN t_lose IS NULL OR t_win < t_lose THEN 1 ELSE -1 END AS o FROM z)
SELECT CAST(pct AS INT) AS pct, above, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o = 1) AS BIGINT) AS rejects, CAST(count(*) FILTER (o = -1) AS BIGINT) AS breaks FROM s GROUP BY pct, above""")
def touch_reject_break(spark, sf_dir):
    """Race from a touch: half an ATR back (from the next bar on) against half an ATR through (from the touch bar on); ties break."""
    bars = bars_evt(spark, sf_dir)
    half = F.col("atr") * 0.5
    back = F.when(F.col("above"), F.col("bl") <= F.col("lv") - half).otherwise(F.col("bh") >= F.col("lv") + half)
    through = F.when(F.col("above"), F.col("bh") >= F.col("lv") + half).otherwise(F.col("bl") <= F.col("lv") - half)
    out = O.race(edge_arrivals(bars), bars, _KEYS, 24, back, through, start=1, lose_from=0)
    return out.groupBy(F.col("pct").cast("int").alias("pct"), "above").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == 1).alias("rejects"), F.count_if(F.col("outcome") == -1).alias("breaks"))


_RETEST = _CROSS + """, t AS (SELECT *, greatest(h - l, coalesce(abs(h - lag(c) OVER w), 0), coalesce(abs(l - lag(c) OVER w), 0)) AS tr FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
ats AS (SELECT series_id, pos, CASE WHEN pos >= 20 THEN avg(tr) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS atr FROM t),
ea AS (SELECT e.*, ats.atr FROM e JOIN ats USING (series_id, pos) WHERE atr IS NOT NULL),
g AS (SELECT ea.series_id, ea.pos, ea.up, ea.lv, ea.atr, min(b.pos - ea.pos) FILTER (CASE WHEN up THEN b.h >= lv + 0.5 * atr ELSE b.l <= lv - 0.5 * atr END) AS t_gone FROM ea LEFT JOIN bars b ON b.series_id = ea.series_id AND b.pos > ea.pos AND b.pos <= ea.pos + 48 GROUP BY ALL),
rt AS (SELECT g.series_id, g.pos, g.up, g.lv, g.atr, g.t_gone, min(b.pos - g.pos) AS t_back FROM g LEFT JOIN bars b ON b.series_id = g.series_id AND b.pos > g.pos + g.t_gone AND b.pos <= g.pos + 48 AND CASE WHEN up THEN b.l <= lv ELSE b.h >= lv END GROUP BY ALL)"""


def break_retests(bars):
    """Boundary crossings with t_gone (half an ATR beyond) and t_back (a later bar back at the line), within 48 bars."""
    e = V.close_crosses(X.simple_atr(bars, 20), SIZE).where("atr IS NOT NULL").select("series_id", "pos", "up", F.col("line").alias("lv"), "atr")
    beyond = F.when(F.col("up"), F.col("bh") >= F.col("lv") + 0.5 * F.col("atr")).otherwise(F.col("bl") <= F.col("lv") - 0.5 * F.col("atr"))
    back = F.when(F.col("up"), F.col("bl") <= F.col("lv")).otherwise(F.col("bh") >= F.col("lv"))
    return O.retests(e, bars, ["series_id", "pos", "up", "lv", "atr"], beyond, back, 48)


@query(EVT + _RETEST + """ SELECT series_id, CAST(count(*) AS BIGINT) AS n, CAST(count(t_gone) AS BIGINT) AS gone, CAST(count(*) FILTER (t_back <= 12) AS BIGINT) AS in12,
CAST(count(*) FILTER (t_back <= 24) AS BIGINT) AS in24, CAST(count(*) FILTER (t_back <= 48) AS BIGINT) AS in48 FROM rt GROUP BY series_id""")
def break_retest(spark, sf_dir):
    r = break_retests(bars_evt(spark, sf_dir))
    within = [F.count_if(F.col("t_back") <= k).alias(f"in{k}") for k in (12, 24, 48)]
    return r.groupBy("series_id").agg(F.count("*").alias("n"), F.count("t_gone").alias("gone"), *within)


@query(EVT + _RETEST + """, rr AS (SELECT series_id, pos + t_back AS pos, pos AS broke, up, lv, atr FROM rt WHERE t_back IS NOT NULL),
w AS (SELECT rr.*, b.pos - rr.pos AS w, b.h AS bh, b.l AS bl FROM rr JOIN bars b ON b.series_id = rr.series_id AND b.pos BETWEEN rr.pos AND rr.pos + 24),
z AS (SELECT series_id, broke, up, min(w) FILTER (w >= 1 AND CASE WHEN up THEN bh >= lv + 0.5 * atr ELSE bl <= lv - 0.5 * atr END) AS t_win, min(w) FILTER (CASE WHEN up THEN bl <= lv - 0.5 * atr ELSE bh >= lv + 0.5 * atr END) AS t_lose FROM w GROUP BY ALL),
s AS (SELECT *, CASE WHEN t_win IS NULL AND t_lose IS NULL THEN 0 WHEN t_lose IS NULL OR t_win < t_lose THEN 1 ELSE -1 END AS o FROM z)
SELECT series_id, up, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o = 1) AS BIGINT) AS holds, CAST(count(*) FILTER (o = -1) AS BIGINT) AS fails FROM s GROUP BY series_id, up""")
def retest_hold(spark, sf_dir):
    bars = bars_evt(spark, sf_dir)
    r = break_retests(bars).where("t_back IS NOT NULL").select("series_id", (F.col("pos") + F.col("t_back")).alias("pos"), F.col("pos").alias("broke"), "up", "lv", "atr")
    half = 0.5 * F.col("atr")
    hold = F.when(F.col("up"), F.col("bh") >= F.col("lv") + half).otherwise(F.col("bl") <= F.col("lv") - half)
    fail = F.when(F.col("up"), F.col("bl") <= F.col("lv") - half).otherwise(F.col("bh") >= F.col("lv") + half)
    out = O.race(r, bars, ["series_id", "broke", "up"], 24, hold, fail, start=1, lose_from=0)
    return out.groupBy("series_id", "up").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == 1).alias("holds"), F.count_if(F.col("outcome") == -1).alias("fails"))


@query(EVT + _CROSS + """, k AS (SELECT e.*, k, CASE WHEN up THEN lv + k * 0.1 * 243 ELSE lv - k * 0.1 * 243 END AS fav, CASE WHEN up THEN lv - k * 0.1 * 243 ELSE lv + k * 0.1 * 243 END AS adv FROM e, (SELECT unnest([1, 2, 3]) AS k)),
z AS (SELECT k.series_id, k.pos, k.k, k.up, min(b.pos - k.pos) FILTER (CASE WHEN up THEN b.h >= fav ELSE b.l <= fav END) AS tf, min(b.pos - k.pos) FILTER (CASE WHEN up THEN b.l <= adv ELSE b.h >= adv END) AS ta
FROM k LEFT JOIN bars b ON b.series_id = k.series_id AND b.pos > k.pos AND b.pos <= k.pos + 48 GROUP BY ALL)
SELECT up, k, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (coalesce(tf, 1e9) < coalesce(ta, 1e9)) AS BIGINT) AS first_fav, CAST(count(*) FILTER (tf IS NULL AND ta IS NULL) AS BIGINT) AS neither FROM z GROUP BY up, k""")
def first_touch_k(spark, sf_dir):
    """Which of two lines k tenths of a block ahead and behind is reached first; a tie counts against."""
    bars = bars_evt(spark, sf_dir)
    e = V.close_crosses(bars, SIZE).select("series_id", "pos", "up", F.col("line").alias("lv"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    far = F.col("k") * F.lit(0.1) * SIZE
    fav = F.when(F.col("up"), F.col("bh") >= F.col("lv") + far).otherwise(F.col("bl") <= F.col("lv") - far)
    adv = F.when(F.col("up"), F.col("bl") <= F.col("lv") - far).otherwise(F.col("bh") >= F.col("lv") + far)
    out = O.race(e, bars, ["series_id", "pos", "k", "up"], 48, fav, adv)
    return out.groupBy("up", "k").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == 1).alias("first_fav"), F.count_if(F.col("outcome") == 0).alias("neither"))


@query(EVT + _CROSS + """, f AS (SELECT e.*, (SELECT CASE WHEN count(*) = 48 THEN max(b.h) END FROM bars b WHERE b.series_id = e.series_id AND b.pos > e.pos AND b.pos <= e.pos + 48) AS fh,
(SELECT CASE WHEN count(*) = 48 THEN min(b.l) END FROM bars b WHERE b.series_id = e.series_id AND b.pos > e.pos AND b.pos <= e.pos + 48) AS fl FROM e)
SELECT up, k, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN CASE WHEN (k > 0) = up THEN fh >= lv + abs(k) * 0.1 * 243 ELSE fl <= lv - abs(k) * 0.1 * 243 END THEN 1.0 ELSE 0.0 END), 6) AS reach FROM f, (SELECT unnest([-2, -1, 1, 2, 4]) AS k) WHERE fh IS NOT NULL GROUP BY up, k""")
def reach_k(spark, sf_dir):
    e = V.close_crosses(X.forward_extremes(bars_evt(spark, sf_dir), 48), SIZE).where("fwd_hi IS NOT NULL")
    e = e.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2, 4)])))
    far = F.abs("k") * F.lit(0.1) * SIZE
    hit = F.when((F.col("k") > 0) == F.col("up"), F.col("fwd_hi") >= F.col("line") + far).otherwise(F.col("fwd_lo") <= F.col("line") - far)
    return e.groupBy("up", "k").agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("reach"))


@query(EVT + _ARR + """, n AS (SELECT series_id, max(pos) AS last FROM bars GROUP BY series_id),
z AS (SELECT ev.pct, ev.above, hd.hold, x.c AS c1, b.c AS c0 FROM ev CROSS JOIN (SELECT unnest([3, 6, 12]) AS hold) hd JOIN n USING (series_id) JOIN bars b ON b.series_id = ev.series_id AND b.pos = ev.pos
JOIN bars x ON x.series_id = ev.series_id AND x.pos = least(ev.pos + hd.hold, n.last)), p AS (SELECT *, CASE WHEN above THEN c0 - c1 ELSE c1 - c0 END AS fade FROM z)
SELECT CAST(pct AS INT) AS pct, above, hold, CAST(count(*) AS BIGINT) AS n, round(avg(fade), 5) AS mean_pts, round(median(fade), 5) AS med_pts, round(avg(CASE WHEN fade > 0 THEN 1.0 ELSE 0.0 END), 6) AS win,
round(sum(CASE WHEN fade > 0 THEN fade END) / nullif(-sum(CASE WHEN fade < 0 THEN fade END), 0), 5) AS pf, round(-avg(fade), 5) AS follow_pts FROM p GROUP BY pct, above, hold""")
def fixed_hold_cube(spark, sf_dir):
    """Fade of an arrival held for a fixed number of bars (to the last bar at most), by level, side and hold; follow mirrors it."""
    bars = bars_evt(spark, sf_dir)
    last = bars.groupBy("series_id").agg(F.max("pos").alias("_last"))
    own = bars.select("series_id", "pos", F.col("c").alias("c0"))
    e = edge_arrivals(bars).join(own, ["series_id", "pos"]).join(last, "series_id").withColumn("hold", F.explode(F.array(F.lit(3), F.lit(6), F.lit(12))))
    x = bars.select("series_id", F.col("pos").alias("_at"), F.col("c").alias("c1"))
    e = e.withColumn("_at", F.least(F.col("pos") + F.col("hold"), F.col("_last"))).join(x, ["series_id", "_at"])
    fade = F.when(F.col("above"), F.col("c0") - F.col("c1")).otherwise(F.col("c1") - F.col("c0"))
    e = e.withColumn("fade", fade)
    return e.groupBy(F.col("pct").cast("int").alias("pct"), "above", "hold").agg(
        F.count("*").alias("n"), F.round(F.avg("fade"), 5).alias("mean_pts"), F.round(F.percentile("fade", 0.5), 5).alias("med_pts"), F.round(F.avg((F.col("fade") > 0).cast("double")), 6).alias("win"),
        F.round(F.sum(F.when(F.col("fade") > 0, F.col("fade"))) / F.nullif(-F.sum(F.when(F.col("fade") < 0, F.col("fade"))), F.lit(0.0)), 5).alias("pf"), F.round(-F.avg("fade"), 5).alias("follow_pts"),
    )


@query(EVT + _ARR + """ SELECT ev.series_id, ev.pos, CAST(ev.pct AS INT) AS pct, ev.above, round(max(CASE WHEN above THEN b.h - lv ELSE lv - b.l END), 6) AS mae, round(max(CASE WHEN above THEN lv - b.l ELSE b.h - lv END), 6) AS mfe
FROM ev JOIN bars b ON b.series_id = ev.series_id AND b.pos > ev.pos AND b.pos <= ev.pos + 12 GROUP BY ev.series_id, ev.pos, ev.pct, ev.above""")
def mfe_mae(spark, sf_dir):
    bars = bars_evt(spark, sf_dir)
    rows = O.future(edge_arrivals(bars), bars, 12).where("w IS NOT NULL")
    up, dn = F.col("bh") - F.col("lv"), F.col("lv") - F.col("bl")
    return rows.groupBy("series_id", "pos", F.col("pct").cast("int").alias("pct"), "above").agg(F.round(F.max(F.when(F.col("above"), up).otherwise(dn)), 6).alias("mae"), F.round(F.max(F.when(F.col("above"), dn).otherwise(up)), 6).alias("mfe"))


@query(EVT + _CROSS + """, q AS (SELECT e.*, b.c FROM e JOIN bars b USING (series_id, pos)), z AS (SELECT q.series_id, q.pos, min(b.pos - q.pos) FILTER (b.h >= q.c + 24.3) AS tu, min(b.pos - q.pos) FILTER (b.l <= q.c - 24.3) AS td
FROM q LEFT JOIN bars b ON b.series_id = q.series_id AND b.pos > q.pos AND b.pos <= q.pos + 96 GROUP BY ALL)
SELECT series_id, pos, CAST(CASE WHEN tu = td THEN NULL WHEN tu IS NULL AND td IS NULL THEN 0 WHEN td IS NULL OR tu < td THEN 1 ELSE -1 END AS INT) AS outcome FROM z""")
def symmetric_race(spark, sf_dir):
    """A tenth of a block up or down from the close; a bar that does both is dropped (null)."""
    bars = bars_evt(spark, sf_dir)
    e = V.close_crosses(bars, SIZE).select("series_id", "pos", "c")
    return O.race(e, bars, ["series_id", "pos"], 96, F.col("bh") >= F.col("c") + 24.3, F.col("bl") <= F.col("c") - 24.3, tie="drop").select("series_id", "pos", "outcome")


@query(EVT + _CROSS + """, q AS (SELECT e.series_id, e.pos, e.up, b.c FROM e JOIN bars b USING (series_id, pos)), m AS (SELECT q.*, f, CASE WHEN up THEN c + f * 24.3 ELSE c - f * 24.3 END AS tg, CASE WHEN up THEN c - f * 24.3 ELSE c + f * 24.3 END AS sp FROM q, (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]) AS f))
SELECT m.series_id, m.pos, CAST(m.f AS DOUBLE) AS f, min(b.pos - m.pos) FILTER (b.pos > m.pos AND CASE WHEN up THEN b.h >= tg ELSE b.l <= tg END) AS tf, min(b.pos - m.pos) FILTER (CASE WHEN up THEN b.l <= sp ELSE b.h >= sp END) AS ta
FROM m JOIN bars b ON b.series_id = m.series_id AND b.pos BETWEEN m.pos AND m.pos + 24 GROUP BY m.series_id, m.pos, m.f""")
def hit_times(spark, sf_dir):
    """First bars that reach favourable (from the next bar) and adverse (from the event bar) thresholds."""
    bars = bars_evt(spark, sf_dir)
    e = V.close_crosses(bars, SIZE).select("series_id", "pos", "up", "c", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)))).alias("f"))
    far = F.col("f") * 24.3
    fav = F.when(F.col("up"), F.col("bh") >= F.col("c") + far).otherwise(F.col("bl") <= F.col("c") - far)
    adv = F.when(F.col("up"), F.col("bl") <= F.col("c") - far).otherwise(F.col("bh") >= F.col("c") + far)
    return O.hit_times(e, bars, ["series_id", "pos", "f"], 24, {"tf": (1, fav), "ta": (0, adv)})


@query(EVT + _CROSS + " SELECT a.series_id, a.pos, max(b.pos) AS last_cross FROM bars a LEFT JOIN e b ON b.series_id = a.series_id AND b.pos <= a.pos GROUP BY a.series_id, a.pos")
def asof_last_cross(spark, sf_dir):
    """As-of backward join: the last crossing at or before each bar, as a running last value over the union."""
    bars = bars_evt(spark, sf_dir).select("series_id", "pos")
    marks = V.close_crosses(bars_evt(spark, sf_dir), SIZE).select("series_id", "pos", F.col("pos").alias("m"))
    marked = bars.join(marks, ["series_id", "pos"], "left")
    return running(marked, ["series_id"], {"last_cross": ("last", F.col("m"))}).select("series_id", "pos", "last_cross")
