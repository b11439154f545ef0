"""Trade plans, entry modules, the table of conditional edges, sweeps over sizes and costs, and studies by era and day."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import clock as C
from barloom.functions import lattice as L
from barloom.operators import events as V
from barloom.operators import features as X
from barloom.operators import outcomes as O
from barloom.operators import stats as S
from barloom.operators.halo import core, frame, ordered, with_halo
from barloom.plans.event_queries import _CROSS, _RETEST, SIZE, break_retests
from barloom.plans.inputs import EVT, bars_evt
from barloom.plans.registry import query
from barloom.plans.relation_queries import _LUT
from barloom.plans.setup_queries import _OUT, _P, _SIDES, sides
from barloom.plans.sql_parts import ATR, SWINGS, kept, lcg
from barloom.plans.study_queries import resolve_in_session, sessions

# --- plans -----------------------------------------------------------------------------------------------------------

SEEN, WIDE, GAPPED, AHEAD = 12, 36, 6, 48
#: Fixed values, by plan and side (up): conditions over pct (p) and flags of the bars before, the entry (a level or the
#: close), the target and the stop, as percentages of the block. A flag is (condition, how many bars back).
FLAGS = {
    "consol": ("p >= 47 AND p <= 53", SEEN), "below": ("p < 23", SEEN), "above": ("p > 77", SEEN), "low_ext": ("p <= 3", WIDE), "high_ext": ("p >= 97", WIDE),
    "past29": ("p >= 29", SEEN), "past71": ("p <= 71", SEEN), "hover_lo": ("p <= 11", SEEN), "hover_hi": ("p >= 89", SEEN),
    "at29": ("abs(p - 29) <= 1.5", SEEN), "at71": ("abs(p - 71) <= 1.5", SEEN), "gap_up": ("l > h2", GAPPED), "gap_dn": ("h < l2", GAPPED),
}
PLANS = [
    ("rebalance", True, "consol AND l <= blk * 243 + 0.41 * 243", 41, 59, None), ("rebalance", False, "consol AND h >= blk * 243 + 0.59 * 243", 59, 41, None),
    ("continuation", True, "below AND p >= 23 AND p <= 35", None, 47, 23), ("continuation", False, "above AND p >= 65 AND p <= 77", None, 53, 77),
    ("rejection", True, "at29 AND gap_up AND abs(p - 29) <= 4", None, 50, 23), ("rejection", False, "at71 AND gap_dn AND abs(p - 71) <= 4", None, 50, 77),
    ("sequence", True, "low_ext AND past29 AND abs(p - 17) <= 1", 17, 50, 0), ("sequence", False, "high_ext AND past71 AND abs(p - 83) <= 1", 83, 50, 100),
    ("liquidity", True, "hover_lo AND hover_hi AND p >= 3 AND p <= 50", None, 29, -17), ("liquidity", False, "hover_hi AND hover_lo AND p <= 97 AND p >= 50", None, 71, 117),
]
_LEVEL = "(blk * 243 + {} / 100.0 * 243)"
_PLAN = ATR + f", p0 AS (SELECT *, floor(c / 243) AS blk, {_P} AS p, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2 FROM ats WINDOW w AS (PARTITION BY series_id ORDER BY pos)), p1 AS (SELECT *, " + ", ".join(
    f"coalesce(max(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) = 1 AS {name}" for name, (cond, n) in FLAGS.items()
) + " FROM p0), ev AS (" + " UNION ALL ".join(
    f"SELECT series_id, pos, '{plan}' AS plan, {str(up).lower()} AS up, {'c' if at is None else _LEVEL.format(at)} AS entry, {_LEVEL.format(to)} AS tg, {'CAST(NULL AS DOUBLE)' if stop is None else _LEVEL.format(stop)} AS sp FROM p1 WHERE pos > {WIDE} AND {cond}" for plan, up, cond, at, to, stop in PLANS
) + ")" + kept("k", "ev", "series_id, plan, up", SEEN)


def plan_entries(bars):
    """Entries of every plan and side: entry, tg and sp (null: no stop)."""
    df = with_halo(X.simple_atr(bars, 20), WIDE + 2, 0)
    df = df.withColumns({"blk": F.floor(F.col("c") / SIZE), "p": L.block_pct(F.col("c"), F.lit(SIZE)), "h2": F.lag("h", 2).over(ordered()), "l2": F.lag("l", 2).over(ordered())})
    df = core(df.withColumns({name: F.coalesce(F.max(F.coalesce(F.expr(cond), F.lit(False))).over(frame(-n, -1)), F.lit(False)) for name, (cond, n) in FLAGS.items()})).where(F.col("pos") > WIDE)
    level = lambda x: F.col("blk") * SIZE + F.lit(float(x)) / 100 * SIZE
    each = [
        F.when(F.expr(cond), F.struct(F.lit(plan).alias("plan"), F.lit(up).alias("up"), (F.col("c") if at is None else level(at)).alias("entry"), level(to).alias("tg"), (F.lit(None).cast("double") if stop is None else level(stop)).alias("sp")))
        for plan, up, cond, at, to, stop in PLANS
    ]
    e = df.withColumn("x", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull()))).select("series_id", "pos", "x.*")
    return V.dedup(e, ["series_id", "plan", "up"], SEEN)


@query(EVT + _PLAN + f""", en AS (SELECT ev.* FROM ev JOIN k USING (series_id, plan, up, pos)),
j AS (SELECT en.*, x.pos - en.pos AS w, x.h AS bh, x.l AS bl, abs(tg - entry) AS d FROM en LEFT JOIN bars x ON x.series_id = en.series_id AND x.pos > en.pos AND x.pos <= en.pos + {AHEAD}),
z AS (SELECT series_id, pos, plan, up, min(w) FILTER (CASE WHEN up THEN bh >= tg ELSE bl <= tg END) AS tt, min(w) FILTER (CASE WHEN up THEN bl <= sp ELSE bh >= sp END) AS ts,
min(w) FILTER (CASE WHEN up THEN bl <= entry - d ELSE bh >= entry + d END) AS ta FROM j GROUP BY ALL),
m AS (SELECT j.series_id, j.pos, j.plan, j.up, greatest(max(CASE WHEN j.up THEN entry - bl ELSE bh - entry END) FILTER (z.tt IS NULL OR w <= z.tt), 0) AS mae FROM j JOIN z USING (series_id, pos, plan, up) GROUP BY ALL)
SELECT plan, up, CAST(count(*) AS BIGINT) AS n, CAST(count(tt) FILTER (ts IS NULL OR tt < ts) AS BIGINT) AS wins, CAST(count(ts) FILTER (tt IS NULL OR ts <= tt) AS BIGINT) AS stops,
CAST(count(tt) FILTER (ta IS NULL OR tt < ta) AS BIGINT) AS even_wins, CAST(count(ta) FILTER (tt IS NULL OR ta <= tt) AS BIGINT) AS even_losses, round(avg(mae) FILTER (tt IS NOT NULL), 5) AS mean_mae FROM z JOIN m USING (series_id, pos, plan, up) GROUP BY plan, up""")
def trade_plans(spark, sf_dir):
    """Five plans: target against their stop, target against a level as far behind, and how far a trade runs against before its target."""
    bars = bars_evt(spark, sf_dir)
    j = O.future(plan_entries(bars), bars, AHEAD).withColumn("d", F.abs(F.col("tg") - F.col("entry")))
    up = F.col("up")
    reach = F.when(up, F.col("bh") >= F.col("tg")).otherwise(F.col("bl") <= F.col("tg"))
    stop = F.when(up, F.col("bl") <= F.col("sp")).otherwise(F.col("bh") >= F.col("sp"))
    even = F.when(up, F.col("bl") <= F.col("entry") - F.col("d")).otherwise(F.col("bh") >= F.col("entry") + F.col("d"))
    against = F.when(up, F.col("entry") - F.col("bl")).otherwise(F.col("bh") - F.col("entry"))
    keys = ["series_id", "pos", "plan", "up"]
    first = {name: F.min(F.when(cond, F.col("w"))).alias(name) for name, cond in (("tt", reach), ("ts", stop), ("ta", even))}
    z = j.groupBy(*keys).agg(*first.values())
    m = j.join(z.select(*keys, "tt"), keys).groupBy(*keys).agg(F.greatest(F.max(F.when(F.col("tt").isNull() | (F.col("w") <= F.col("tt")), against)), F.lit(0.0)).alias("mae"))
    won = lambda a, b: F.count_if(F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) < F.col(b))))
    lost = lambda a, b: F.count_if(F.col(b).isNotNull() & (F.col(a).isNull() | (F.col(b) <= F.col(a))))
    return z.join(m, keys).groupBy("plan", "up").agg(
        F.count("*").alias("n"), won("tt", "ts").alias("wins"), lost("tt", "ts").alias("stops"), won("tt", "ta").alias("even_wins"), lost("tt", "ta").alias("even_losses"),
        F.round(F.avg(F.when(F.col("tt").isNotNull(), F.col("mae"))), 5).alias("mean_mae"),
    )


# --- entries after a touch of a boundary -----------------------------------------------------------------------------

_MODULE = ATR + """, lb AS (SELECT *, min(c) OVER w60 AS lo60, max(c) OVER w60 AS hi60, min(l) OVER w3 AS l3, max(h) OVER w3 AS h3, l > lag(h, 2) OVER w AS gu, h < lag(l, 2) OVER w AS gd FROM ats
WINDOW w AS (PARTITION BY series_id ORDER BY pos), w60 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
tc AS (SELECT series_id, pos, atr, true AS above, (floor(c1 / 243) + 1) * 243 AS bd FROM lb WHERE h >= (floor(c1 / 243) + 1) * 243 AND (floor(c1 / 243) + 1) * 243 - lo60 >= 0.5 * atr
UNION ALL SELECT series_id, pos, atr, false, (ceil(c1 / 243) - 1) * 243 FROM lb WHERE l <= (ceil(c1 / 243) - 1) * 243 AND hi60 - (ceil(c1 / 243) - 1) * 243 >= 0.5 * atr)""" + kept("k", "tc", "series_id, above", 6) + """,
t2 AS (SELECT tc.* FROM tc JOIN k USING (series_id, above, pos)),
cf AS (SELECT t2.series_id, t2.pos, t2.above, b.pos AS p2, CASE WHEN above THEN b.c < b.o AND b.c < bd ELSE b.c > b.o AND b.c > bd END AS close_back, CASE WHEN above THEN b.c < b.l3 ELSE b.c > b.h3 END AS shift, CASE WHEN above THEN b.gd ELSE b.gu END AS gap
FROM t2 JOIN lb b ON b.series_id = t2.series_id AND b.pos > t2.pos AND b.pos <= t2.pos + 12),
md AS (SELECT series_id, pos, above, 'immediate' AS module, pos AS at_pos FROM t2 UNION ALL SELECT series_id, pos, above, 'close_back', min(p2) FROM cf WHERE close_back GROUP BY ALL
UNION ALL SELECT series_id, pos, above, 'shift', min(p2) FROM cf WHERE shift GROUP BY ALL UNION ALL SELECT series_id, pos, above, 'gap', min(p2) FROM cf WHERE gap GROUP BY ALL),
en AS (SELECT md.*, t2.bd, t2.atr, b.c AS entry FROM md JOIN t2 USING (series_id, pos, above) JOIN bars b ON b.series_id = md.series_id AND b.pos = md.at_pos),
ex AS (SELECT en.series_id, en.pos, en.above, module, at_pos, entry, bd, en.atr, greatest(CASE WHEN above THEN max(b.h) - entry ELSE entry - min(b.l) END, 0.5 * en.atr) AS risk FROM en JOIN bars b ON b.series_id = en.series_id AND b.pos BETWEEN en.pos AND en.at_pos GROUP BY en.series_id, en.pos, en.above, module, at_pos, entry, bd, en.atr),
z AS (SELECT ex.series_id, ex.pos, ex.above, ex.module, ex.risk, min(b.pos) FILTER (CASE WHEN above THEN b.l <= bd - 121.5 ELSE b.h >= bd + 121.5 END) AS t_win, min(b.pos) FILTER (CASE WHEN above THEN b.h >= entry + risk ELSE b.l <= entry - risk END) AS t_lose
FROM ex LEFT JOIN bars b ON b.series_id = ex.series_id AND b.pos > ex.at_pos AND b.pos <= ex.at_pos + 72 GROUP BY ALL), s AS (SELECT *, """ + _OUT + " FROM z)"


@query(EVT + _MODULE + " SELECT module, above, " + _SIDES + ", round(avg(risk), 5) AS mean_risk FROM s GROUP BY module, above")
def entry_modules(spark, sf_dir):
    """Ways into a fade of a boundary: at once, on a close back, on a break of the last three bars, on a gap; to the middle of
    the block, with a stop beyond the extreme since the touch, half an ATR at least."""
    bars = bars_evt(spark, sf_dir)
    df = with_halo(X.simple_atr(bars, 20), 61, 0)
    w = ordered()
    df = core(df.withColumns({"l3": F.min("l").over(frame(-3, -1)), "h3": F.max("h").over(frame(-3, -1)), "gu": F.col("l") > F.lag("h", 2).over(w), "gd": F.col("h") < F.lag("l", 2).over(w)}))
    touch = V.arrivals(X.simple_atr(bars, 20), SIZE, 0.5, pcts=[0.0]).select("series_id", "pos", "above", F.col("line").alias("bd"), "atr")
    touch = V.dedup(touch, ["series_id", "above"], 6)
    keys = ["series_id", "pos", "above", "bd", "atr"]
    b = df.select(F.col("series_id").alias("s2"), F.col("pos").alias("p2"), F.floor(F.col("pos") / 12).alias("k2"), "c", "o", "l3", "h3", "gu", "gd")
    near = touch.withColumn("kk", F.explode(F.array(F.floor((F.col("pos") + 1) / 12), F.floor((F.col("pos") + 12) / 12)))).distinct()
    cf = near.join(b, (F.col("series_id") == F.col("s2")) & (F.col("kk") == F.col("k2")) & (F.col("p2") > F.col("pos")) & (F.col("p2") <= F.col("pos") + 12))
    up = F.col("above")
    ways = {
        "close_back": F.when(up, (F.col("c") < F.col("o")) & (F.col("c") < F.col("bd"))).otherwise((F.col("c") > F.col("o")) & (F.col("c") > F.col("bd"))),
        "shift": F.when(up, F.col("c") < F.col("l3")).otherwise(F.col("c") > F.col("h3")), "gap": F.when(up, F.col("gd")).otherwise(F.col("gu")),
    }
    first = cf.groupBy(*keys).agg(*[F.min(F.when(cond, F.col("p2"))).alias(name) for name, cond in ways.items()])
    found = F.array(*[F.when(F.col(x).isNotNull(), F.struct(F.lit(x).alias("module"), F.col(x).alias("at_pos"))) for x in ways])
    later = first.withColumn("x", F.explode(F.filter(found, lambda x: x.isNotNull()))).select(*keys, "x.*")
    every = touch.select(*keys, F.lit("immediate").alias("module"), F.col("pos").alias("at_pos")).unionByName(later)
    own = bars.select("series_id", F.col("pos").alias("at_pos"), F.col("c").alias("entry"))
    en = every.join(own, ["series_id", "at_pos"])
    span = O.future(en, bars, 12, 0).where(F.col("pos") + F.col("w") <= F.col("at_pos"))
    beyond = F.when(up, F.max("bh") - F.col("entry")).otherwise(F.col("entry") - F.min("bl"))
    ex = span.groupBy(*keys, "module", "at_pos", "entry").agg(F.max("bh").alias("top"), F.min("bl").alias("low"))
    beyond = F.when(up, F.col("top") - F.col("entry")).otherwise(F.col("entry") - F.col("low"))
    ex = ex.withColumn("risk", F.greatest(beyond, F.col("atr") * 0.5)).withColumnRenamed("pos", "touch").withColumnRenamed("at_pos", "pos")
    win = F.when(up, F.col("bl") <= F.col("bd") - SIZE / 2).otherwise(F.col("bh") >= F.col("bd") + SIZE / 2)
    lose = F.when(up, F.col("bh") >= F.col("entry") + F.col("risk")).otherwise(F.col("bl") <= F.col("entry") - F.col("risk"))
    o = O.race(ex, bars, ["series_id", "touch", "pos", "above", "module"], 72, win, lose, carry=["risk"])
    return o.groupBy("module", "above").agg(*sides(), F.round(F.avg("risk"), 5).alias("mean_risk"))


# --- conditional edges -----------------------------------------------------------------------------------------------

_FAV, _ADV, _RM = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0], [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0], [1.0, 1.5, 2.0, 3.0]
_EDGE = _RETEST + """, rr AS (SELECT series_id, pos + t_back AS pos, pos AS broke, up, lv, atr, t_back FROM rt WHERE t_back IS NOT NULL),
vv AS (SELECT series_id, pos, hh, date, c, h, l, v / avg(v) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS vr FROM bars),
pk AS (SELECT rr.series_id, rr.broke, max(CASE WHEN up THEN b.h - lv ELSE lv - b.l END) / max(rr.atr) AS peak FROM rr JOIN bars b ON b.series_id = rr.series_id AND b.pos > rr.broke AND b.pos < rr.pos GROUP BY ALL),
an AS (SELECT rr.*, vv.date, vv.c, CASE WHEN up THEN vv.l ELSE vv.h END AS ext, pk.peak, CASE WHEN hh IN (9) THEN 'open' WHEN hh BETWEEN 10 AND 15 THEN 'day' WHEN hh >= 20 OR hh < 2 THEN 'night' WHEN hh BETWEEN 3 AND 4 THEN 'early' ELSE 'other' END AS sess,
CASE WHEN peak < 1.5 THEN 'near' WHEN peak < 2.5 THEN 'mid' ELSE 'far' END AS exc, CASE WHEN vr < 0.85 THEN 'low' WHEN vr < 1.2 THEN 'mid' ELSE 'high' END AS vol FROM rr JOIN vv USING (series_id, pos) JOIN pk USING (series_id, broke)),
ct AS (SELECT an.*, unnest(['all', 'sess:' || sess, 'exc:' || exc, 'vol:' || vol, CASE WHEN up THEN 'dir:long' ELSE 'dir:short' END]) AS cut FROM an)"""


def annotated(bars):
    """Retests of crossed boundaries with the session, the excursion before, relative volume and side, all known at entry."""
    r = break_retests(bars).where("t_back IS NOT NULL").select("series_id", (F.col("pos") + F.col("t_back")).alias("pos"), F.col("pos").alias("broke"), "up", "lv", "atr", "t_back")
    df = with_halo(bars, 21, 0)
    df = core(df.withColumn("vr", F.col("v") / F.avg("v").over(frame(-20, 0)))).select("series_id", "pos", "hh", "date", "c", "h", "l", "vr")
    b = r.select("series_id", F.col("broke").alias("pos"), "up", "lv", "atr", "t_back")
    past = O.future(b, bars, 48).where(F.col("w") < F.col("t_back"))
    run = F.when(F.col("up"), F.col("bh") - F.col("lv")).otherwise(F.col("lv") - F.col("bl"))
    peak = past.groupBy("series_id", F.col("pos").alias("broke")).agg((F.max(run) / F.max("atr")).alias("peak"))
    hh = F.col("hh")
    sess = F.when(hh == 9, "open").when(hh.between(10, 15), "day").when((hh >= 20) | (hh < 2), "night").when(hh.between(3, 4), "early").otherwise("other")
    exc = F.when(F.col("peak") < 1.5, "near").when(F.col("peak") < 2.5, "mid").otherwise("far")
    vol = F.when(F.col("vr") < 0.85, "low").when(F.col("vr") < 1.2, "mid").otherwise("high")
    e = r.join(df, ["series_id", "pos"]).join(peak, ["series_id", "broke"]).withColumn("ext", F.when(F.col("up"), F.col("l")).otherwise(F.col("h"))).drop("h", "l")
    cuts = F.array(F.lit("all"), F.concat(F.lit("sess:"), sess), F.concat(F.lit("exc:"), exc), F.concat(F.lit("vol:"), vol), F.when(F.col("up"), "dir:long").otherwise("dir:short"))
    return e.withColumn("cuts", cuts)


_HITS = """, gr AS (SELECT f, a FROM (SELECT unnest([""" + ", ".join(map(str, _FAV)) + """]) AS f), (SELECT unnest([""" + ", ".join(map(str, _ADV)) + """]) AS a)),
th AS (SELECT an.series_id, an.broke, x, min(b.pos - an.pos) FILTER (b.pos > an.pos AND CASE WHEN up THEN b.h >= lv + x * atr ELSE b.l <= lv - x * atr END) AS tf, min(b.pos - an.pos) FILTER (CASE WHEN up THEN b.l <= lv - x * atr ELSE b.h >= lv + x * atr END) AS ta
FROM an, (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]) AS x) JOIN bars b ON b.series_id = an.series_id AND b.pos BETWEEN an.pos AND an.pos + 24 GROUP BY ALL)"""


@query(EVT + _EDGE + _HITS + """ SELECT cut, CAST(f AS DOUBLE) AS fav, CAST(a AS DOUBLE) AS adv, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN coalesce(p.tf, 9999) < coalesce(q.ta, 9999) THEN 1.0 ELSE 0.0 END), 6) AS win
FROM ct JOIN th p ON p.series_id = ct.series_id AND p.broke = ct.broke JOIN th q ON q.series_id = ct.series_id AND q.broke = ct.broke JOIN gr ON gr.f = p.x AND gr.a = q.x WHERE NOT (p.tf IS NULL AND q.ta IS NULL) GROUP BY cut, f, a HAVING count(*) >= 20""")
def edge_table(spark, sf_dir):
    """Retests by condition, six favourable against seven adverse distances, undecided ones left out; cells of 20 or more."""
    bars = bars_evt(spark, sf_dir)
    e = annotated(bars)
    rows = O.future(e.select("series_id", "pos", "broke", "up", "lv", "atr"), bars, 24, 0)
    up, keys = F.col("up"), ["series_id", "broke"]
    far = {x: F.col("atr") * x for x in _ADV}
    fav = [F.min(F.when((F.col("w") >= 1) & F.when(up, F.col("bh") >= F.col("lv") + far[x]).otherwise(F.col("bl") <= F.col("lv") - far[x]), F.col("w"))).alias(f"f{i}") for i, x in enumerate(_FAV)]
    adv = [F.min(F.when(F.when(up, F.col("bl") <= F.col("lv") - far[x]).otherwise(F.col("bh") >= F.col("lv") + far[x]), F.col("w"))).alias(f"a{i}") for i, x in enumerate(_ADV)]
    hits = rows.groupBy(*keys).agg(*fav, *adv)
    grid = F.array(*[F.struct(F.lit(f).alias("fav"), F.lit(a).alias("adv"), F.col(f"f{i}").alias("tf"), F.col(f"a{j}").alias("ta")) for i, f in enumerate(_FAV) for j, a in enumerate(_ADV)])
    cells = hits.select(*keys, F.explode(grid).alias("g")).select(*keys, "g.*").where("NOT (tf IS NULL AND ta IS NULL)")
    won = (F.coalesce("tf", F.lit(9999)) < F.coalesce("ta", F.lit(9999))).cast("double")
    out = cells.join(e.select(*keys, F.explode("cuts").alias("cut")), keys).groupBy("cut", "fav", "adv").agg(F.count("*").alias("n"), F.round(F.avg(won), 6).alias("win"))
    return out.where("n >= 20")


_STRUCT = """, sr AS (SELECT ct.*, m, greatest(CASE WHEN up THEN c - ext + 0.05 * atr ELSE ext - c + 0.05 * atr END, 0.05 * atr) AS risk FROM ct, (SELECT unnest([1.0, 1.5, 2.0, 3.0]) AS m)),
z AS (SELECT sr.series_id, sr.broke, sr.cut, sr.m, sr.date, sr.risk / sr.atr AS risk, min(b.pos - sr.pos) FILTER (CASE WHEN up THEN b.h >= c + m * risk ELSE b.l <= c - m * risk END) AS t_win, min(b.pos - sr.pos) FILTER (CASE WHEN up THEN b.l <= c - risk ELSE b.h >= c + risk END) AS t_lose
FROM (SELECT sr.* RENAME (c AS c), b0.c AS c0 FROM sr JOIN bars b0 USING (series_id, pos)) sr LEFT JOIN bars b ON b.series_id = sr.series_id AND b.pos > sr.pos AND b.pos <= sr.pos + 48 GROUP BY ALL), s AS (SELECT *, """ + _OUT + " FROM z)"
_STRUCT = _STRUCT.replace("(SELECT sr.* RENAME (c AS c), b0.c AS c0 FROM sr JOIN bars b0 USING (series_id, pos)) sr", "sr").replace("b.h >= c +", "b.h >= sr.c +").replace("b.l <= c -", "b.l <= sr.c -").replace("b.h >= c +", "b.h >= sr.c +")


def structure_trades(bars):
    """Entry at the retest's close, stop beyond its extreme, targets in multiples of that risk; by cut."""
    e = annotated(bars)
    ext = F.when(F.col("up"), F.col("c") - F.col("ext")).otherwise(F.col("ext") - F.col("c")) + 0.05 * F.col("atr")
    e = e.withColumn("risk", F.greatest(ext, 0.05 * F.col("atr"))).withColumn("m", F.explode(F.array(*map(F.lit, _RM))))
    e = e.select("series_id", "pos", "broke", "up", "c", "risk", "m", "date", (F.col("risk") / F.col("atr")).alias("risk_atr"), "cuts")
    up, far = F.col("up"), F.col("m") * F.col("risk")
    win = F.when(up, F.col("bh") >= F.col("c") + far).otherwise(F.col("bl") <= F.col("c") - far)
    lose = F.when(up, F.col("bl") <= F.col("c") - F.col("risk")).otherwise(F.col("bh") >= F.col("c") + F.col("risk"))
    return O.race(e, bars, ["series_id", "broke", "m"], 48, win, lose, carry=["date", "risk_atr", "cuts"]).withColumn("cut", F.explode("cuts"))


@query(EVT + _EDGE + _STRUCT + " SELECT cut, CAST(m AS DOUBLE) AS m, " + _SIDES + ", round(avg(CASE WHEN o = 1 THEN m WHEN o = -1 THEN -1.0 ELSE 0.0 END), 6) AS mean_r, round(avg(risk), 5) AS risk_atr FROM s GROUP BY cut, m HAVING count(*) >= 20")
def structure_search(spark, sf_dir):
    """Plays (targets of one to three risks) by condition: the exhaustive table, cells of 20 or more."""
    t = structure_trades(bars_evt(spark, sf_dir))
    r = F.when(F.col("outcome") == 1, F.col("m")).when(F.col("outcome") == -1, F.lit(-1.0)).otherwise(F.lit(0.0))
    return t.groupBy("cut", "m").agg(*sides(), F.round(F.avg(r), 6).alias("mean_r"), F.round(F.avg("risk_atr"), 5).alias("risk_atr")).where("n >= 20")


@query(EVT + _EDGE + _STRUCT + ", pr AS (SELECT cut, m, date // 100000 * 0 + CASE WHEN date < 20240111 THEN 1 WHEN date < 20240121 THEN 2 ELSE 3 END AS era, count(*) AS n, avg(CASE WHEN o = 1 THEN m WHEN o = -1 THEN -1.0 ELSE 0.0 END) AS r FROM s GROUP BY ALL) SELECT cut, CAST(m AS DOUBLE) AS m, CAST(count(*) AS BIGINT) AS eras, CAST(count(*) FILTER (r > 0) AS BIGINT) AS positive, round(min(r), 6) AS worst, round(max(r), 6) AS best FROM pr WHERE n >= 5 GROUP BY cut, m")
def rule_stability(spark, sf_dir):
    """In how many eras each play by condition gains, and its worst and best."""
    t = structure_trades(bars_evt(spark, sf_dir))
    era = F.when(F.col("date") < 20240111, 1).when(F.col("date") < 20240121, 2).otherwise(3)
    r = F.when(F.col("outcome") == 1, F.col("m")).when(F.col("outcome") == -1, F.lit(-1.0)).otherwise(F.lit(0.0))
    per = t.groupBy("cut", "m", era.alias("era")).agg(F.count("*").alias("n"), F.avg(r).alias("r")).where("n >= 5")
    return per.groupBy("cut", "m").agg(F.count("*").alias("eras"), F.count_if(F.col("r") > 0).alias("positive"), F.round(F.min("r"), 6).alias("worst"), F.round(F.max("r"), 6).alias("best"))


# --- sweeps ----------------------------------------------------------------------------------------------------------

_SWEEP = "[81.0, 162.0, 243.0, 486.0, 729.0]"
_S1R = f""", se AS (SELECT series_id, date, min(pos) AS a, max(pos) AS z, arg_min(o, pos) AS op, arg_max(c, pos) AS lc FROM bars GROUP BY series_id, date),
e AS (SELECT se.*, r, op - floor(op / r) * r <= floor(op / r) * r + r - op AS is_long, floor(op / r) * r AS lo FROM se, (SELECT unnest({_SWEEP}) AS r)),
t AS (SELECT e.*, CASE WHEN is_long THEN lo ELSE lo + r END AS edge, CASE WHEN is_long THEN lo + r ELSE lo END AS tg, CASE WHEN is_long THEN lo - 0.1 * r ELSE lo + r + 0.1 * r END AS sp FROM e),
f AS (SELECT t.series_id, t.date, t.r, min(b.pos) AS pos FROM t JOIN bars b ON b.series_id = t.series_id AND b.pos BETWEEN t.a AND t.z AND b.l <= t.edge AND b.h >= t.edge GROUP BY ALL),
x AS (SELECT t.series_id, t.date, t.r, f.pos, t.is_long, t.edge, t.tg, t.sp, t.lc, min(b.pos) FILTER (CASE WHEN is_long THEN b.h >= tg ELSE b.l <= tg END) AS pt, min(b.pos) FILTER (CASE WHEN is_long THEN b.l <= sp ELSE b.h >= sp END) AS ps
FROM t JOIN f USING (series_id, date, r) JOIN bars b ON b.series_id = t.series_id AND b.pos BETWEEN f.pos AND t.z GROUP BY ALL),
tr AS (SELECT r, CASE WHEN is_long THEN 1 ELSE -1 END * (CASE WHEN ps IS NOT NULL AND (pt IS NULL OR ps <= pt) THEN sp WHEN pt IS NOT NULL THEN tg ELSE lc END - edge) AS pnl FROM x)"""


def traverse_trades(bars, sizes):
    """The first touch of a session's nearer block edge, for every block size."""
    s = sessions(bars).withColumn("r", F.explode(F.array(*map(F.lit, sizes))))
    lo, r = F.floor(F.col("op") / F.col("r")) * F.col("r"), F.col("r")
    s = s.withColumn("is_long", F.col("op") - lo <= lo + r - F.col("op")).withColumn("edge", F.when(F.col("is_long"), lo).otherwise(lo + r))
    s = s.withColumns({"tg": F.when(F.col("is_long"), lo + r).otherwise(lo), "sp": F.when(F.col("is_long"), F.col("edge") - 0.1 * r).otherwise(F.col("edge") + 0.1 * r)})
    touch = s.where((F.col("l") <= F.col("edge")) & (F.col("h") >= F.col("edge")))
    first = touch.groupBy("series_id", "date", "r", "edge", "tg", "sp", "is_long", "z", "lc").agg(F.min("pos").alias("pos"))
    return resolve_in_session(first, bars, ["r"])


@query(EVT + _S1R + " SELECT CAST(r AS DOUBLE) AS r, CAST(cost AS DOUBLE) AS cost, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN pnl - cost > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(avg(pnl - cost), 5) AS mean, round(avg((pnl - cost) / r), 6) AS mean_r FROM tr, (SELECT unnest([0.0, 1.0, 2.5, 5.0]) AS cost) GROUP BY r, cost")
def size_cost_sweep(spark, sf_dir):
    """The block traverse over block sizes and costs."""
    t = traverse_trades(bars_evt(spark, sf_dir), [81.0, 162.0, 243.0, 486.0, 729.0]).withColumn("cost", F.explode(F.array(*map(F.lit, (0.0, 1.0, 2.5, 5.0)))))
    net = F.col("pnl") + 1.0 - F.col("cost")  # the trades bear a cost of one already
    return t.groupBy("r", "cost").agg(F.count("*").alias("n"), F.round(F.avg((net > 0).cast("double")), 6).alias("win"), F.round(F.avg(net), 5).alias("mean"), F.round(F.avg(net / F.col("r")), 6).alias("mean_r"))


_RANDOM = f""", se AS (SELECT series_id, date, min(pos) AS a, max(pos) AS z, count(*) AS n, arg_max(c, pos) AS lc FROM bars GROUP BY series_id, date),
d0 AS (SELECT se.*, rep, a + {lcg('rep * 1000003 + date % 100000 * 7919 + 31')} % n AS pos FROM se, (SELECT unnest(range(0, 20)) AS rep)),
e AS (SELECT d0.*, b.c AS edge, (rep + d0.pos) % 2 = 0 AS is_long FROM d0 JOIN bars b USING (series_id, pos)),
x AS (SELECT e.series_id, e.date, e.rep, e.edge, e.is_long, e.lc, min(b.pos) FILTER (CASE WHEN is_long THEN b.h >= edge + 24.3 ELSE b.l <= edge - 24.3 END) AS pt, min(b.pos) FILTER (CASE WHEN is_long THEN b.l <= edge - 24.3 ELSE b.h >= edge + 24.3 END) AS ps
FROM e JOIN bars b ON b.series_id = e.series_id AND b.pos BETWEEN e.pos AND e.z GROUP BY ALL), tr AS (SELECT series_id, CASE WHEN ps IS NOT NULL AND (pt IS NULL OR ps <= pt) THEN -24.3 WHEN pt IS NOT NULL THEN 24.3 WHEN is_long THEN lc - edge ELSE edge - lc END - 1.0 AS pnl FROM x)"""


@query(EVT + _RANDOM + " SELECT series_id, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(avg(pnl), 5) AS mean FROM tr GROUP BY series_id")
def random_time_control(spark, sf_dir):
    """The same stop and target from a bar of each session drawn at random, twenty times."""
    bars = bars_evt(spark, sf_dir)
    s = sessions(bars)
    d = s.groupBy("series_id", "date", "z", "lc").agg(F.min("pos").alias("a"), F.count("*").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))
    d = d.withColumn("pos", F.col("a") + S.lcg(F.col("rep").cast("long") * 1000003 + F.col("date") % 100000 * 7919 + 31) % F.col("n"))
    e = d.join(bars.select("series_id", "pos", F.col("c").alias("edge")), ["series_id", "pos"]).withColumn("is_long", (F.col("rep") + F.col("pos")) % 2 == 0)
    far = lambda sign: F.when(F.col("is_long"), F.col("edge") + sign * 24.3).otherwise(F.col("edge") - sign * 24.3)
    t = resolve_in_session(e.withColumns({"tg": far(1), "sp": far(-1)}), bars, ["rep"])
    return t.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pnl") > 0).cast("double")), 6).alias("win"), F.round(F.avg("pnl"), 5).alias("mean"))


# --- by era, day, place ----------------------------------------------------------------------------------------------

_ERA = "CASE WHEN date < 20240111 THEN 1 WHEN date < 20240121 THEN 2 ELSE 3 END"


@query(EVT + _CROSS + f""", q AS (SELECT e.series_id, e.pos, e.up, b.c, {_ERA.replace('date', 'b.date')} AS era, b.date FROM e JOIN bars b USING (series_id, pos)),
z AS (SELECT q.series_id, q.pos, q.era, q.date, q.up, min(b.pos - q.pos) FILTER (b.h >= q.c + 24.3) AS tu, min(b.pos - q.pos) FILTER (b.l <= q.c - 24.3) AS td FROM q LEFT JOIN bars b ON b.series_id = q.series_id AND b.pos > q.pos AND b.pos <= q.pos + 48 GROUP BY ALL),
o AS (SELECT *, CASE WHEN coalesce(tu, 9999) < coalesce(td, 9999) THEN up WHEN coalesce(td, 9999) < coalesce(tu, 9999) THEN NOT up END AS went_on FROM z),
dy AS (SELECT era, date, avg(CASE WHEN went_on THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM o WHERE went_on IS NOT NULL GROUP BY era, date)
SELECT CAST(era AS INT) AS era, CAST(count(*) AS BIGINT) AS days, CAST(sum(n) AS BIGINT) AS n, round(sum(r * n) / sum(n), 6) AS rate, round(stddev_samp(r), 6) AS day_sd, round(min(r), 6) AS least, round(max(r), 6) AS most FROM dy GROUP BY era""")
def path_statistics(spark, sf_dir):
    """How often price goes on after a crossing before it comes back as far, by day, and its spread over days, by era."""
    bars = bars_evt(spark, sf_dir)
    e = V.close_crosses(bars, SIZE).select("series_id", "pos", "up", "c", "date")
    o = O.race(e, bars, ["series_id", "pos"], 48, F.col("bh") >= F.col("c") + 24.3, F.col("bl") <= F.col("c") - 24.3, tie="drop", carry=["up", "date"])
    on = F.when(F.col("outcome") == 1, F.col("up")).when(F.col("outcome") == -1, ~F.col("up"))
    era = F.when(F.col("date") < 20240111, 1).when(F.col("date") < 20240121, 2).otherwise(3)
    d = o.withColumn("on", on).where("on IS NOT NULL").groupBy(era.alias("era"), "date").agg(F.avg(F.col("on").cast("double")).alias("r"), F.count("*").alias("n"))
    return d.groupBy("era").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.round(F.sum(F.col("r") * F.col("n")) / F.sum("n"), 6).alias("rate"), F.round(F.stddev_samp("r"), 6).alias("day_sd"), F.round(F.min("r"), 6).alias("least"), F.round(F.max("r"), 6).alias("most"))


_DEPTHS = " + ".join(f"CASE WHEN (m - {s} * floor(m / {s})) / {s} * 100 >= 47 AND (m - {s} * floor(m / {s})) / {s} * 100 < 53 THEN 1 ELSE 0 END" for s in L.PO3)


@query(EVT + f", dm AS (SELECT b AS bin, {_DEPTHS} AS depth FROM (SELECT b, (b + 0.5) * 0.125 AS m FROM (SELECT unnest(range(0, 52488)) AS b))), hc AS (SELECT CAST(floor((c - 6561 * floor(c / 6561)) * 8) AS BIGINT) AS bin, count(*) AS n FROM bars GROUP BY 1), "
+ """g AS (SELECT j, depth, sum(n) AS n FROM (SELECT j, n, (bin + 52488 - j * 2624) % 52488 AS bin FROM hc, (SELECT unnest(range(0, 20)) AS j)) JOIN dm USING (bin) GROUP BY ALL), k AS (SELECT j, d, sum(n) FILTER (depth >= d) / CAST(sum(n) AS DOUBLE) AS x FROM g, (SELECT unnest([1, 2, 3]) AS d) GROUP BY ALL)
SELECT CAST(d AS INT) AS depth, round(coalesce(max(x) FILTER (j = 0), 0), 6) AS rate, round(avg(coalesce(x, 0)) FILTER (j > 0), 6) AS null_mean, round((coalesce(max(x) FILTER (j = 0), 0) - avg(coalesce(x, 0)) FILTER (j > 0)) / nullif(stddev_samp(coalesce(x, 0)) FILTER (j > 0), 0), 4) AS z FROM k GROUP BY d""")
def nested_depth(spark, sf_dir):
    """How often closes lie where several scales have their middle zone at once, over the whole period of 6,561, against shifts."""
    n = 52488
    mid = (F.col("id") + 0.5) * 0.125
    depth = sum((L.in_zone(L.block_pct(mid, F.lit(float(s))), "EQ").cast("int") for s in L.PO3), F.lit(0))
    dm = spark.range(n).select(F.col("id").alias("bin"), depth.alias("depth"))
    h = bars_evt(spark, sf_dir).groupBy(F.floor((F.col("c") - 6561 * F.floor(F.col("c") / 6561)) * 8).alias("bin")).agg(F.count("*").alias("n"))
    moved = h.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("bin", F.pmod(F.col("bin") - F.col("j") * 2624, F.lit(n)))
    g = moved.join(dm, "bin").groupBy("j").agg(*[(F.sum(F.when(F.col("depth") >= d, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"d{d}") for d in (1, 2, 3)])
    k = g.select("j", F.inline(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"d{d}").alias("x")) for d in (1, 2, 3)])))
    true, null = F.max(F.when(F.col("j") == 0, F.col("x"))), F.when(F.col("j") > 0, F.col("x"))
    return k.groupBy("depth").agg(F.round(true, 6).alias("rate"), F.round(F.avg(null), 6).alias("null_mean"), F.round((true - F.avg(null)) / F.nullif(F.stddev_samp(null), F.lit(0.0)), 4).alias("z"))


@query(EVT + ATR + SWINGS + _LUT.replace("WITH RECURSIVE", ",", 1) + """, q AS (SELECT mod, max(CASE WHEN pri AND pd = 0 THEN 3 WHEN pri THEN 2 ELSE 1 END) AS quality FROM lut GROUP BY mod),
sg AS (SELECT s.series_id, s.pos, s.hi, (s.hh * 60 + s.pos * 7) % 1440 AS mod, s.hh, a.atr, a.c, lead(a2.c, 0) OVER (PARTITION BY s.series_id ORDER BY s.pos) AS c6 FROM swings s JOIN ats a USING (series_id, pos) JOIN bars a2 ON a2.series_id = s.series_id AND a2.pos = s.pos + 6),
am AS (SELECT b.series_id, b.pos, max(b2.h) - min(b2.l) AS amp FROM swings b JOIN bars b2 ON b2.series_id = b.series_id AND b2.pos BETWEEN b.pos - 30 AND b.pos + 30 GROUP BY ALL),
g AS (SELECT sg.*, coalesce(q.quality, 0) AS quality, CASE WHEN amp > 8 * atr THEN 'major' WHEN amp > 2 * atr THEN 'minor' ELSE 'none' END AS tier, CASE WHEN hi THEN c - c6 ELSE c6 - c END - 0.5 AS net FROM sg JOIN am USING (series_id, pos) LEFT JOIN q USING (mod))
SELECT tier, CAST(quality AS INT) AS quality, hh BETWEEN 8 AND 11 AS killzone, CAST(count(*) AS BIGINT) AS n, round(avg(net), 5) AS mean_net, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win FROM g GROUP BY ALL""")
def swing_tiers(spark, sf_dir):
    """Swings by size against ATR, quality of their minute's node and hours; what a fade six bars on gives net of a spread."""
    bars = bars_evt(spark, sf_dir)
    s = X.fractal_swings(X.simple_atr(bars, 20), 2)
    df = with_halo(s, 30, 30)
    amp = F.max("h").over(frame(-30, 30)) - F.min("l").over(frame(-30, 30))
    df = core(df.withColumns({"amp": amp, "c6": F.lead("c", 6).over(ordered())})).where("(swing_hi OR swing_lo) AND c6 IS NOT NULL")
    q = C.minute_lut(spark).groupBy("mod").agg(F.max("quality").alias("quality"))
    g = df.withColumn("mod", ((F.col("hh") * 60 + F.col("pos") * 7) % 1440).cast("int")).join(F.broadcast(q), "mod", "left").na.fill(0, ["quality"])
    tier = F.when(F.col("amp") > 8 * F.col("atr"), "major").when(F.col("amp") > 2 * F.col("atr"), "minor").otherwise("none")
    net = F.when(F.col("swing_hi"), F.col("c") - F.col("c6")).otherwise(F.col("c6") - F.col("c")) - 0.5
    return g.groupBy(tier.alias("tier"), "quality", F.col("hh").between(8, 11).alias("killzone")).agg(F.count("*").alias("n"), F.round(F.avg(net), 5).alias("mean_net"), F.round(F.avg((net > 0).cast("double")), 6).alias("win"))


@query(EVT + SWINGS + f""", px AS (SELECT date, CASE WHEN hi THEN h ELSE l END AS v FROM swings UNION ALL SELECT date, l FROM swings WHERE hi AND lo), b AS (SELECT CAST(floor((v - 243 * floor(v / 243)) / 243 * 20) AS BIGINT) AS bin, date < 20240116 AS early FROM px),
o AS (SELECT CAST(floor((c - 243 * floor(c / 243)) / 243 * 20) AS BIGINT) AS bin, date < 20240116 AS early FROM bars), sc AS (SELECT bin, early, count(*) / sum(count(*)) OVER (PARTITION BY early) AS r FROM b GROUP BY bin, early), oc AS (SELECT bin, early, count(*) / sum(count(*)) OVER (PARTITION BY early) AS r FROM o GROUP BY bin, early),
j AS (SELECT oc.bin, oc.early, coalesce(sc.r, 0) - oc.r AS x FROM oc LEFT JOIN sc USING (bin, early)), pv AS (SELECT bin, max(x) FILTER (early) AS a, max(x) FILTER (NOT early) AS b FROM j GROUP BY bin)
SELECT CAST(count(*) AS BIGINT) AS bins, round(corr(a, b), 5) AS corr, CAST(count(*) FILTER (a > 0 AND b > 0) AS BIGINT) AS alive, round(arg_max(b, a), 6) AS best_out_of_sample FROM pv""")
def conditional_swing_scan(spark, sf_dir):
    """Excess of swings over bars by twentieths of a block: found in the first half of the time, judged in the second."""
    bars = bars_evt(spark, sf_dir)
    s = X.fractal_swings(bars, 2)
    both = F.filter(F.array(F.when(F.col("swing_hi"), F.col("h")), F.when(F.col("swing_lo"), F.col("l"))), lambda x: x.isNotNull())
    early = (F.col("date") < 20240116).alias("early")

    def share(px, name):
        g = px.groupBy(F.floor((F.col("v") - SIZE * F.floor(F.col("v") / SIZE)) / SIZE * 20).alias("bin"), early).agg(F.count("*").alias("n"))
        return g.select("bin", "early", (F.col("n") / F.sum("n").over(Window.partitionBy("early"))).alias(name))

    j = share(bars.select("date", F.col("c").alias("v")), "o").join(share(s.select("date", F.explode(both).alias("v")), "s"), ["bin", "early"], "left").na.fill(0.0, ["s"])
    x = F.col("s") - F.col("o")
    pv = j.groupBy("bin").agg(F.max(F.when(F.col("early"), x)).alias("a"), F.max(F.when(~F.col("early"), x)).alias("b"))
    return pv.agg(F.count("*").alias("bins"), F.round(F.corr("a", "b"), 5).alias("corr"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("alive"), F.round(F.max_by("b", "a"), 6).alias("best_out_of_sample"))
