"""Event builders with conditions, and the races and trades they start."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import lattice as L
from barloom.operators import events as V
from barloom.operators import features as X
from barloom.operators import outcomes as O
from barloom.operators import stats as S
from barloom.operators.halo import core, frame, ordered, with_halo
from barloom.plans.event_queries import SIZE
from barloom.plans.inputs import EVT, LEVELS, bars_evt
from barloom.plans.registry import query
from barloom.plans.sql_parts import ATR, kept

GAP, BACK, LOOK = 12, 0.1, 60
_P = "((c - 243 * floor(c / 243)) / 243 * 100)"
_SIDES = "CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o = 1) AS BIGINT) AS wins, CAST(count(*) FILTER (o = -1) AS BIGINT) AS losses"
_OUT = "CASE WHEN t_win IS NULL AND t_lose IS NULL THEN 0 WHEN t_lose IS NULL OR t_win < t_lose THEN 1 ELSE -1 END AS o"


def sides(outcome="outcome"):
    return F.count("*").alias("n"), F.count_if(F.col(outcome) == 1).alias("wins"), F.count_if(F.col(outcome) == -1).alias("losses")


_ABS = f"""{LEVELS}, cu AS (SELECT b.series_id, b.pos, b.h, b.l, b.c, CAST(floor(b.c / 243) AS BIGINT) * 20 + count(*) FILTER (v.pct <= {_P.replace('c ', 'b.c ').replace('(c', '(b.c')}) - 1 AS cur FROM bars b, levels v GROUP BY b.series_id, b.pos, b.h, b.l, b.c),
cx AS (SELECT *, lag(cur) OVER w AS prev, min(c) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS lo60, max(c) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS hi60,
(floor((cur + 1) / 20.0) + (SELECT pct FROM levels WHERE idx = (cur + 1) % 20) / 100) * 243 AS up_px, (floor(cur / 20.0) + (SELECT pct FROM levels WHERE idx = cur % 20) / 100) * 243 AS dn_px FROM cu WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
ev AS (SELECT series_id, pos, 'break_up' AS kind, cur AS lv FROM cx WHERE cur > prev AND pos > 60 UNION ALL SELECT series_id, pos, 'break_down', prev FROM cx WHERE cur < prev AND pos > 60
UNION ALL SELECT series_id, pos, 'reject_up', cur + 1 FROM cx WHERE h >= up_px AND c < up_px AND lo60 <= up_px - 24.3 AND pos > 60 UNION ALL SELECT series_id, pos, 'reject_down', cur FROM cx WHERE l <= dn_px AND c > dn_px AND hi60 >= dn_px + 24.3 AND pos > 60)"""


def level_events(bars, size=SIZE):
    """Breaks and rejections of absolute levels: kind and the level's index lv."""
    df = with_halo(bars, LOOK, 0)
    cur = F.floor(F.col("c") / size) * 20 + L.level_floor(L.block_pct(F.col("c"), F.lit(size)))
    df = df.withColumn("cur", cur)
    before = frame(-LOOK, -1)
    df = core(df.withColumns({"prev": F.lag("cur").over(ordered()), "lo60": F.min("c").over(before), "hi60": F.max("c").over(before)})).where(F.col("pos") > LOOK)
    up, dn = (L.absolute_level_price(j, F.lit(size)) for j in (F.col("cur") + 1, F.col("cur")))
    kinds = F.array(
        F.when(F.col("cur") > F.col("prev"), F.struct(F.lit("break_up").alias("kind"), F.col("cur").alias("lv"))),
        F.when(F.col("cur") < F.col("prev"), F.struct(F.lit("break_down").alias("kind"), F.col("prev").alias("lv"))),
        F.when((F.col("h") >= up) & (F.col("c") < up) & (F.col("lo60") <= up - BACK * size), F.struct(F.lit("reject_up").alias("kind"), (F.col("cur") + 1).alias("lv"))),
        F.when((F.col("l") <= dn) & (F.col("c") > dn) & (F.col("hi60") >= dn + BACK * size), F.struct(F.lit("reject_down").alias("kind"), F.col("cur").alias("lv"))),
    )
    e = df.withColumn("x", F.explode(F.filter(kinds, lambda x: x.isNotNull()))).select("series_id", "pos", "c", "x.kind", "x.lv")
    return V.dedup(e, ["series_id", "kind"], GAP)


@query(EVT + ", " + _ABS + kept("k", "ev", "series_id, kind", 12) + " SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT lv) AS BIGINT) AS levels, round(avg(lv % 20), 6) AS mean_level FROM ev JOIN k USING (series_id, kind, pos) GROUP BY kind")
def level_break_reject(spark, sf_dir):
    e = level_events(bars_evt(spark, sf_dir))
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("lv").alias("levels"), F.round(F.avg(F.pmod("lv", F.lit(20))), 6).alias("mean_level"))


_STEPS = """, k0 AS (SELECT series_id, pos, CAST(floor(c / 81) AS BIGINT) AS k, lag(CAST(floor(c / 81) AS BIGINT)) OVER (PARTITION BY series_id ORDER BY pos) AS was FROM bars),
ks AS (SELECT series_id, pos AS ts, k, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS st FROM k0 WHERE was IS NULL OR was <> k),
sp AS (SELECT *, k - lag(k) OVER (PARTITION BY series_id ORDER BY st) AS step, lag(k) OVER (PARTITION BY series_id ORDER BY st) AS kp FROM ks), ev AS (SELECT series_id, ts AS pos, step > 0 AS up FROM sp WHERE abs(step) = 1)"""


@query(EVT + _STEPS + kept("kp1", "ev", "series_id, up", 12) + """, br AS (SELECT sp.series_id, sp.st, sp.ts, sp.step > 0 AS up, CASE WHEN sp.step > 0 THEN sp.k ELSE sp.kp END AS bi FROM sp JOIN kp1 ON kp1.series_id = sp.series_id AND kp1.pos = sp.ts AND kp1.up = (sp.step > 0) WHERE abs(sp.step) = 1),
rc AS (SELECT br.series_id, br.st, br.up, min(n.st - br.st) FILTER (n.k >= bi + 1) AS t_win, min(n.st - br.st) FILTER (n.k <= bi - 2) AS t_lose FROM br LEFT JOIN ks n ON n.series_id = br.series_id AND n.st > br.st AND n.st <= br.st + 40 AND n.ts - br.ts <= 120 GROUP BY ALL)
SELECT up, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (coalesce(t_win, 9999) < coalesce(t_lose, 9999)) AS BIGINT) AS above_first, CAST(count(*) FILTER (coalesce(t_lose, 9999) < coalesce(t_win, 9999)) AS BIGINT) AS below_first FROM rc GROUP BY up""")
def block_breach_race(spark, sf_dir):
    """Closes that move by one block, and which of the blocks beyond and behind comes first, raced on the changes of block alone."""
    bars = bars_evt(spark, sf_dir).withColumn("k", F.floor(F.col("c") / 81.0))
    steps = X.changes(bars, "k", ["series_id"]).select("series_id", F.col("pos").alias("ts"), "k", F.col("step").cast("long").alias("pos"))
    b = core(with_halo(steps, 1, 0).withColumn("kp", F.lag("k").over(ordered()))).where(F.abs(F.col("k") - F.col("kp")) == 1).withColumn("up", F.col("k") > F.col("kp"))
    b = V.dedup(b, ["series_id", "up"], GAP, "ts").withColumn("bi", F.when(F.col("up"), F.col("k")).otherwise(F.col("kp")))
    later = steps.select("series_id", "pos", F.col("k").alias("h"), F.col("k").alias("l"), F.col("ts").alias("c"))
    near = F.col("bc") - F.col("ts") <= 120
    o = O.race(b.select("series_id", "pos", "ts", "up", "bi"), later, ["series_id", "pos", "up"], 40, near & (F.col("bh") >= F.col("bi") + 1), near & (F.col("bl") <= F.col("bi") - 2))
    return o.groupBy("up").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == 1).alias("above_first"), F.count_if(F.col("outcome") == -1).alias("below_first"))


_HTF = ATR + """, lb AS (SELECT *, min(c) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS lo60, max(c) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS hi60 FROM ats WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
cd AS (SELECT series_id, date, hh // 4 AS b, max(pos) AS last, max(h) AS h, min(l) AS l, arg_max(c, pos) AS c, arg_max(atr, pos) AS atr, arg_max(lo60, pos) AS lo60, arg_max(hi60, pos) AS hi60 FROM lb GROUP BY ALL),
cp AS (SELECT *, lag(c) OVER w AS prev, lag(atr) OVER w AS patr FROM cd WINDOW w AS (PARTITION BY series_id ORDER BY last))"""


def candles(bars, hours=4):
    """Candles of some hours of the clock, with the last bar's position, ATR and closes' extremes before it."""
    df = with_halo(X.simple_atr(bars, 20), LOOK, 0)
    df = core(df.withColumns({"lo60": F.min("c").over(frame(-LOOK, -1)), "hi60": F.max("c").over(frame(-LOOK, -1))}))
    last = [F.max_by(c, "pos").alias(c) for c in ("c", "atr", "lo60", "hi60")]
    cd = df.groupBy("series_id", "date", F.floor(F.col("hh") / hours).alias("b")).agg(F.max("pos").alias("last"), F.max("h").alias("h"), F.min("l").alias("l"), *last)
    w = Window.partitionBy("series_id").orderBy("last")
    return cd.withColumns({"prev": F.lag("c").over(w), "patr": F.lag("atr").over(w)})


@query(EVT + _HTF + """, bt AS (SELECT *, 'high' AS side, (floor(prev / 243) + 1) * 243 AS bd FROM cp UNION ALL SELECT *, 'low', floor(prev / 243) * 243 FROM cp),
ev AS (SELECT * FROM bt WHERE CASE WHEN side = 'high' THEN h >= bd AND lo60 <= bd - 0.5 * patr ELSE l <= bd AND hi60 >= bd + 0.5 * patr END),
z AS (SELECT ev.series_id, ev.last, side, CASE WHEN side = 'high' THEN ev.c < bd ELSE ev.c > bd END AS inside, min(x.pos - ev.last) FILTER (x.h >= bd + 121.5) AS tu, min(x.pos - ev.last) FILTER (x.l <= bd - 121.5) AS td
FROM ev LEFT JOIN bars x ON x.series_id = ev.series_id AND x.pos > ev.last AND x.pos <= ev.last + 96 GROUP BY ALL),
o AS (SELECT *, CASE WHEN tu = td THEN NULL WHEN tu IS NULL AND td IS NULL THEN 0 WHEN td IS NULL OR tu < td THEN 1 ELSE -1 END AS o FROM z)
SELECT side, inside, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o <> 0) AS BIGINT) AS decided, CAST(count(*) FILTER (o = CASE WHEN side = 'high' THEN -1 ELSE 1 END) AS BIGINT) AS back FROM o GROUP BY side, inside""")
def htf_boundary(spark, sf_dir):
    """Four-hour candles that reach the boundary above or below the close before, by whether they close inside it: half a block either way."""
    bars = bars_evt(spark, sf_dir)
    cd = candles(bars)
    base = F.floor(F.col("prev") / SIZE)
    tests = F.array(F.struct(F.lit("high").alias("side"), ((base + 1) * SIZE).alias("bd")), F.struct(F.lit("low").alias("side"), (base * SIZE).alias("bd")))
    e = cd.withColumn("t", F.explode(tests)).select("*", "t.side", "t.bd")
    high, far = F.col("side") == "high", F.lit(0.5) * F.col("patr")
    e = e.where(F.when(high, (F.col("h") >= F.col("bd")) & (F.col("lo60") <= F.col("bd") - far)).otherwise((F.col("l") <= F.col("bd")) & (F.col("hi60") >= F.col("bd") + far)))
    e = e.withColumn("inside", F.when(high, F.col("c") < F.col("bd")).otherwise(F.col("c") > F.col("bd"))).select("series_id", F.col("last").alias("pos"), "side", "inside", "bd")
    o = O.race(e, bars, ["series_id", "pos", "side", "inside"], 96, F.col("bh") >= F.col("bd") + SIZE / 2, F.col("bl") <= F.col("bd") - SIZE / 2, tie="drop")
    return o.groupBy("side", "inside").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") != 0).alias("decided"), F.count_if(F.col("outcome") == F.when(F.col("side") == "high", -1).otherwise(1)).alias("back"))


_STRADDLE = _HTF + f""", {LEVELS}, cn AS (SELECT cp.series_id, cp.last, cp.c, cp.prev, v.pct, (floor(cp.c / 243) + bk + v.pct / 100) * 243 AS lv, v.idx + 20 * bk AS i FROM cp, levels v, (SELECT unnest([0, 1]) AS bk) WHERE (floor(cp.c / 243) + bk + v.pct / 100) * 243 BETWEEN cp.l AND cp.h AND prev IS NOT NULL),
st AS (SELECT series_id, last, prev, pct, lv FROM cn QUALIFY row_number() OVER (PARTITION BY series_id, last ORDER BY round(abs(lv - c), 9), i) = 1), ev AS (SELECT *, prev < lv AS above FROM st WHERE prev <> lv),
z AS (SELECT ev.series_id, ev.last, ev.pct, ev.above, ev.lv, min(x.pos - ev.last) FILTER (CASE WHEN above THEN x.l <= lv - 24.3 ELSE x.h >= lv + 24.3 END) AS t_win, min(x.pos - ev.last) FILTER (CASE WHEN above THEN x.h >= lv + 24.3 ELSE x.l <= lv - 24.3 END) AS t_lose, arg_max((x.h + x.l) / 2, x.pos) AS mid
FROM ev LEFT JOIN bars x ON x.series_id = ev.series_id AND x.pos > ev.last AND x.pos <= ev.last + 24 GROUP BY ALL),
pn AS (SELECT *, CASE WHEN t_lose IS NOT NULL AND (t_win IS NULL OR t_lose <= t_win) THEN -24.3 WHEN t_win IS NOT NULL THEN 24.3 WHEN mid IS NULL THEN 0.0 WHEN above THEN lv - mid ELSE mid - lv END AS pnl FROM z)"""


def straddle_trades(bars):
    """Candles that straddle a level (the nearest to their close): a fade of it, a tenth of a block either way, else flat at the last middle."""
    cd = candles(bars).where("prev IS NOT NULL")
    base = F.floor(F.col("c") / SIZE)
    every = F.array(*[F.struct(F.lit(i + 20 * k).alias("i"), F.lit(float(p)).alias("pct"), ((base + k + F.lit(float(p)) / 100) * SIZE).alias("lv")) for k in (0, 1) for i, p in enumerate(L.LEVELS)])
    held = F.filter(every, lambda x: (x["lv"] >= F.col("l")) & (x["lv"] <= F.col("h")))
    near = F.array_min(F.transform(held, lambda x: F.struct(F.round(F.abs(x["lv"] - F.col("c")), 9).alias("d"), x["i"].alias("i"), x["pct"].alias("pct"), x["lv"].alias("lv"))))
    e = cd.withColumn("x", near).where("x IS NOT NULL").select("series_id", F.col("last").alias("pos"), "prev", "x.pct", "x.lv").where("prev <> lv").withColumn("above", F.col("prev") < F.col("lv"))
    rows = O.future(e, bars, 24)
    up = F.col("above")
    win = F.when(up, F.col("bl") <= F.col("lv") - 24.3).otherwise(F.col("bh") >= F.col("lv") + 24.3)
    lose = F.when(up, F.col("bh") >= F.col("lv") + 24.3).otherwise(F.col("bl") <= F.col("lv") - 24.3)
    t = rows.groupBy("series_id", "pos", "pct", "above", "lv").agg(F.min(F.when(win, F.col("w"))).alias("t_win"), F.min(F.when(lose, F.col("w"))).alias("t_lose"), F.max_by((F.col("bh") + F.col("bl")) / 2, "w").alias("mid"))
    flat = F.when(F.col("mid").isNull(), 0.0).when(F.col("above"), F.col("lv") - F.col("mid")).otherwise(F.col("mid") - F.col("lv"))
    pnl = F.when(F.col("t_lose").isNotNull() & (F.col("t_win").isNull() | (F.col("t_lose") <= F.col("t_win"))), -24.3).when(F.col("t_win").isNotNull(), 24.3).otherwise(flat)
    return t.withColumn("pnl", pnl)


@query(EVT + ", " + _STRADDLE[2:] + " SELECT CAST(pct AS INT) AS pct, above, CAST(count(*) AS BIGINT) AS n, round(avg(pnl), 5) AS mean_pnl FROM pn GROUP BY pct, above")
def htf_straddle(spark, sf_dir):
    t = straddle_trades(bars_evt(spark, sf_dir))
    return t.groupBy(F.col("pct").cast("int").alias("pct"), "above").agg(F.count("*").alias("n"), F.round(F.avg("pnl"), 5).alias("mean_pnl"))


@query(EVT + ", " + _STRADDLE[2:] + """, g AS (SELECT CAST(pct AS INT) AS pct, above, count(*) AS n, avg(pnl) AS m FROM pn GROUP BY ALL HAVING count(*) >= 5)
SELECT a.pct, a.above, CAST(a.n AS BIGINT) AS n, CAST(b.n AS BIGINT) AS n_mirror, round(a.m, 5) AS mean_pnl, round(b.m, 5) AS mirror_pnl, a.m > 0 AND b.m > 0 AS both FROM g a JOIN g b ON b.pct = (100 - a.pct) % 100 AND b.above <> a.above""")
def mirror_pairs(spark, sf_dir):
    """Cells beside their mirror images (100 less the percentage, the other side): an edge must show in both."""
    g = straddle_trades(bars_evt(spark, sf_dir)).groupBy(F.col("pct").cast("int").alias("pct"), "above").agg(F.count("*").alias("n"), F.avg("pnl").alias("m")).where("n >= 5")
    b = g.select(((100 - F.col("pct")) % 100).alias("pct"), (~F.col("above")).alias("above"), F.col("n").alias("n_mirror"), F.col("m").alias("m2"))
    return g.join(b, ["pct", "above"]).select("pct", "above", "n", "n_mirror", F.round("m", 5).alias("mean_pnl"), F.round("m2", 5).alias("mirror_pnl"), ((F.col("m") > 0) & (F.col("m2") > 0)).alias("both"))


_IN = {z: " OR ".join(f"(p >= {a} AND p < {b})" for a, b in bands) for z, bands in L.ZONES.items()}
_ZONE = ATR + f""", zp AS (SELECT *, {_P} AS p, min(l) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS wlo, max(h) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS whi FROM ats),
zz AS (""" + " UNION ALL ".join(f"SELECT series_id, pos, hh, h, l, c, c1, atr, wlo, whi, '{z}' AS zone, {m} AS inz FROM zp" for z, m in _IN.items()) + """),
ze AS (SELECT *, lag(inz) OVER (PARTITION BY series_id, zone ORDER BY pos) AS was FROM zz), ev AS (SELECT * FROM ze WHERE inz AND NOT was AND hh BETWEEN 9 AND 15 AND atr IS NOT NULL)"""


@query(EVT + _ZONE + kept("k", "ev", "series_id, zone", 6) + """, en AS (SELECT ev.*, c > c1 AS up, CASE WHEN c > c1 THEN l < wlo ELSE h > whi END AS swept FROM ev JOIN k USING (series_id, zone, pos)),
z AS (SELECT en.series_id, en.zone, en.pos, en.swept, min(x.pos - en.pos) FILTER (CASE WHEN up THEN x.h >= en.c + en.atr ELSE x.l <= en.c - en.atr END) AS t_win, min(x.pos - en.pos) FILTER (CASE WHEN up THEN x.l <= en.c - en.atr ELSE x.h >= en.c + en.atr END) AS t_lose
FROM en LEFT JOIN bars x ON x.series_id = en.series_id AND x.pos > en.pos AND x.pos <= en.pos + 24 GROUP BY ALL), s AS (SELECT *, """ + _OUT + " FROM z) SELECT zone, swept, " + _SIDES + " FROM s GROUP BY zone, swept")
def zone_entries(spark, sf_dir):
    """First entries into a zone within session hours, with or without a sweep of the twenty bars before: one ATR either way."""
    bars = bars_evt(spark, sf_dir)
    df = with_halo(X.simple_atr(bars, 20), 21, 0)
    p = L.block_pct(F.col("c"), F.lit(SIZE))
    df = df.withColumns({"c1": F.lag("c").over(ordered()), "wlo": F.min("l").over(frame(-20, -1)), "whi": F.max("h").over(frame(-20, -1))})
    df = df.withColumns({f"in_{z}": L.in_zone(p, z) for z in L.ZONES})
    df = core(df.withColumns({f"was_{z}": F.lag(f"in_{z}").over(ordered()) for z in L.ZONES})).where(F.col("hh").between(9, 15) & F.col("atr").isNotNull())
    zones = F.filter(F.array(*[F.when(F.col(f"in_{z}") & ~F.col(f"was_{z}"), F.lit(z)) for z in L.ZONES]), lambda x: x.isNotNull())
    e = V.dedup(df.withColumn("zone", F.explode(zones)), ["series_id", "zone"], 6)
    up = F.col("c") > F.col("c1")
    e = e.select("series_id", "zone", "pos", "c", "atr", up.alias("up"), F.when(up, F.col("l") < F.col("wlo")).otherwise(F.col("h") > F.col("whi")).alias("swept"))
    above, below = F.col("bh") >= F.col("c") + F.col("atr"), F.col("bl") <= F.col("c") - F.col("atr")
    o = O.race(e, bars, ["series_id", "zone", "pos", "swept"], 24, F.when(F.col("up"), above).otherwise(below), F.when(F.col("up"), below).otherwise(above))
    return o.groupBy("zone", "swept").agg(*sides())


_LIN = ", ".join(f"{float(p)}" for p in L.LEVELS)
_ARR20 = """, t AS (SELECT *, lag(c) OVER w AS c1, greatest(h - l, coalesce(abs(h - lag(c) OVER w), 0), coalesce(abs(l - lag(c) OVER w), 0)) AS tr,
min(c) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS lo60, max(c) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS hi60,
CASE WHEN pos > 0 THEN exp(avg(ln(greatest(v, 1))) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) ELSE 1.0 END AS geo FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
a AS (SELECT *, CASE WHEN pos >= 20 THEN avg(tr) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS atr, v / geo AS rvol FROM t),
q AS (SELECT a.*, p.pct, (floor(c1 / 243 - p.pct / 100) + 1 + p.pct / 100) * 243 AS up, (ceil(c1 / 243 - p.pct / 100) - 1 + p.pct / 100) * 243 AS dn FROM a, (SELECT unnest([""" + _LIN + """]) AS pct) p WHERE c1 IS NOT NULL),
ev AS (SELECT series_id, date, pos, pct, up AS lv, true AS above, atr, rvol, h - l AS rng, c FROM q WHERE h >= up AND up - lo60 >= 0.5 * atr UNION ALL
SELECT series_id, date, pos, pct, dn AS lv, false AS above, atr, rvol, h - l AS rng, c FROM q WHERE l <= dn AND hi60 - dn >= 0.5 * atr)"""
_RACE20 = """, z AS (SELECT ev.series_id, ev.date, ev.pos, ev.pct, ev.above, ev.rvol, ev.rng, ev.atr, ev.lv, min(b.pos - ev.pos) FILTER (b.pos > ev.pos AND CASE WHEN above THEN b.l <= lv - 0.5 * atr ELSE b.h >= lv + 0.5 * atr END) AS t_win,
min(b.pos - ev.pos) FILTER (b.pos >= ev.pos + FROM0 AND CASE WHEN above THEN b.h >= lv + 0.5 * atr ELSE b.l <= lv - 0.5 * atr END) AS t_lose FROM ev JOIN bars b ON b.series_id = ev.series_id AND b.pos BETWEEN ev.pos AND ev.pos + 24 GROUP BY ALL), s AS (SELECT *, """ + _OUT + " FROM z)"


def arrivals20(bars):
    """Arrivals at all twenty levels, with relative volume and the bar's range."""
    b = X.volume_features(X.simple_atr(bars, 20), 20, 20, 16)
    return V.arrivals(b, SIZE, 0.5).select("series_id", "date", "pos", "pct", F.col("line").alias("lv"), "above", "atr", "rvol", (F.col("h") - F.col("l")).alias("rng"), "c")


def raced20(e, bars, carry, lose_from=0):
    """Half an ATR back from the level against half an ATR through it."""
    half = F.col("atr") * 0.5
    lower, upper = F.col("bl") <= F.col("lv") - half, F.col("bh") >= F.col("lv") + half
    return O.race(e, bars, ["series_id", "pos", "pct", "above"], 24, F.when(F.col("above"), lower).otherwise(upper), F.when(F.col("above"), upper).otherwise(lower), start=1, lose_from=lose_from, carry=carry)


@query(EVT + _ARR20 + _RACE20.replace("FROM0", "0") + _RACE20.replace("FROM0", "1").replace(", z AS", ", z1 AS").replace("s AS", "s1 AS").replace("FROM z)", "FROM z1)")
+ " SELECT quiet, entry_bar, " + _SIDES + " FROM (SELECT *, true AS entry_bar FROM s UNION ALL SELECT *, false FROM s1), (SELECT 1) CROSS JOIN LATERAL (SELECT rng / atr <= 0.6 AND rvol <= 0.75 AS quiet) GROUP BY quiet, entry_bar")
def quiet_arrivals(spark, sf_dir):
    """Arrivals on a small bar of little volume against all others; with and without the entry bar counting as a break."""
    bars = bars_evt(spark, sf_dir)
    e = arrivals20(bars).withColumn("quiet", (F.col("rng") / F.col("atr") <= 0.6) & (F.col("rvol") <= 0.75))
    both = raced20(e, bars, ["quiet"], 0).withColumn("entry_bar", F.lit(True)).unionByName(raced20(e, bars, ["quiet"], 1).withColumn("entry_bar", F.lit(False)))
    return both.groupBy("quiet", "entry_bar").agg(*sides())


@query(EVT + _ARR20 + _RACE20.replace("FROM0", "0") + " SELECT CASE WHEN rvol < 0.85 THEN 'low' WHEN rvol < 1.2 THEN 'mid' ELSE 'high' END AS volume, date < 20240116 AS discovery, " + _SIDES + " FROM s GROUP BY ALL")
def volume_conditions(spark, sf_dir):
    """Rejections of levels by relative volume, in the first and the second half of the time."""
    bars = bars_evt(spark, sf_dir)
    vol = F.when(F.col("rvol") < 0.85, "low").when(F.col("rvol") < 1.2, "mid").otherwise("high")
    e = arrivals20(bars).withColumns({"volume": vol, "discovery": F.col("date") < 20240116})
    return raced20(e, bars, ["volume", "discovery"]).groupBy("volume", "discovery").agg(*sides())


_OTHERS = " + ".join(f"CASE WHEN list_min([least(abs((lv - {s} * floor(lv / {s})) / {s} * 100 - v), 100 - abs((lv - {s} * floor(lv / {s})) / {s} * 100 - v)) FOR v IN [{', '.join(map(str, L.LEVELS))}]]) <= 0.5 THEN 1 ELSE 0 END" for s in (81, 729))


@query(EVT + _ARR20 + _RACE20.replace("FROM0", "0") + f", d AS (SELECT CAST(pct AS INT) AS pct, {_OTHERS} AS depth, o FROM s), g AS (SELECT pct, avg(CASE WHEN o = 1 THEN 1.0 ELSE 0.0 END) FILTER (depth > 0) - avg(CASE WHEN o = 1 THEN 1.0 ELSE 0.0 END) FILTER (depth = 0) AS diff, count(*) FILTER (depth > 0) AS n1, count(*) FILTER (depth = 0) AS n0 FROM d GROUP BY pct) SELECT pct, CAST(n1 AS BIGINT) AS n_confluent, CAST(n0 AS BIGINT) AS n_other, round(diff, 6) AS diff FROM g WHERE n1 >= 5 AND n0 >= 5")
def confluence_strata(spark, sf_dir):
    """Rejection where another scale has a level too, less where none has, level by level."""
    bars = bars_evt(spark, sf_dir)
    depth = sum((L.on_level(L.block_pct(F.col("lv"), F.lit(float(s))), 0.5).cast("int") for s in (81, 729)), F.lit(0))
    o = raced20(arrivals20(bars).withColumn("depth", depth), bars, ["depth"])
    hit = (F.col("outcome") == 1).cast("double")
    some, none = F.col("depth") > 0, F.col("depth") == 0
    g = o.groupBy(F.col("pct").cast("int").alias("pct")).agg(F.count_if(some).alias("n_confluent"), F.count_if(none).alias("n_other"), F.round(F.avg(F.when(some, hit)) - F.avg(F.when(none, hit)), 6).alias("diff"))
    return g.where("n_confluent >= 5 AND n_other >= 5")


@query(EVT + _ARR20 + _RACE20.replace("FROM0", "0") + ", g AS (SELECT pct, count(*) AS n, avg(CASE WHEN o = 1 THEN 1.0 ELSE 0.0 END) AS p FROM s GROUP BY pct), av AS (SELECT avg(CASE WHEN o = 1 THEN 1.0 ELSE 0.0 END) AS q FROM s) SELECT CAST(count(*) AS BIGINT) AS levels, round(sum(n * (p - q) * (p - q)) / max(q * (1 - q)), 4) AS chi2, round(max(abs(p - q) / sqrt(q * (1 - q) / n)), 4) AS most_z FROM g, av")
def level_omnibus(spark, sf_dir):
    """Whether levels differ at all in how often they are rejected."""
    bars = bars_evt(spark, sf_dir)
    o = raced20(arrivals20(bars), bars, []).withColumn("hit", (F.col("outcome") == 1).cast("double"))
    g = o.groupBy("pct").agg(F.count("*").alias("n"), F.avg("hit").alias("p")).crossJoin(F.broadcast(o.agg(F.avg("hit").alias("q"))))  # one row
    apart, var = F.col("p") - F.col("q"), F.col("q") * (1 - F.col("q"))
    return g.agg(F.count("*").alias("levels"), F.round(F.sum(F.col("n") * apart * apart) / F.max(var), 4).alias("chi2"), F.round(F.max(F.abs(apart) / F.sqrt(var / F.col("n"))), 4).alias("most_z"))
