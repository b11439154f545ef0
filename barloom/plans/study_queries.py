"""Strategies, benchmarks, aggregate statistics and null models."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import lattice as L
from barloom.operators import stats as S
from barloom.operators.bars import daily
from barloom.operators.features import changes, fractal_swings
from barloom.operators.halo import core, ordered, with_halo
from barloom.operators.resampling import permuted_sums
from barloom.plans.inputs import EVT, bars_evt, bars_ord
from barloom.plans.registry import query

SIZE, RISK, COST = 243.0, 24.3, 1.0

# per series and date the session: first touch of the nearer block edge of the open, stop a tenth of a block beyond, target the far edge
_S1 = """, se AS (SELECT series_id, date, min(pos) AS a, max(pos) AS z, arg_min(o, pos) AS op, arg_max(c, pos) AS lc FROM bars GROUP BY series_id, date),
e AS (SELECT *, op - floor(op / 243) * 243 <= floor(op / 243) * 243 + 243 - op AS is_long, floor(op / 243) * 243 AS lo FROM se),
t AS (SELECT e.*, CASE WHEN is_long THEN lo ELSE lo + 243 END AS edge, CASE WHEN is_long THEN lo + 243 ELSE lo END AS tg, CASE WHEN is_long THEN lo - 24.3 ELSE lo + 243 + 24.3 END AS sp FROM e),
f AS (SELECT t.series_id, t.date, min(b.pos) AS pos FROM t JOIN bars b ON b.series_id = t.series_id AND b.pos BETWEEN t.a AND t.z AND b.l <= t.edge AND b.h >= t.edge GROUP BY ALL),
x AS (SELECT t.series_id, t.date, f.pos, t.is_long, t.edge, t.tg, t.sp, t.lc, min(b.pos) FILTER (CASE WHEN is_long THEN b.h >= tg ELSE b.l <= tg END) AS pt, min(b.pos) FILTER (CASE WHEN is_long THEN b.l <= sp ELSE b.h >= sp END) AS ps
FROM t JOIN f USING (series_id, date) JOIN bars b ON b.series_id = t.series_id AND b.pos BETWEEN f.pos AND t.z GROUP BY ALL),
tr AS (SELECT series_id, date, pos, CASE WHEN ps IS NOT NULL AND (pt IS NULL OR ps <= pt) THEN 'stop' WHEN pt IS NOT NULL THEN 'target' ELSE 'timeout' END AS how,
CASE WHEN is_long THEN 1 ELSE -1 END * (CASE WHEN ps IS NOT NULL AND (pt IS NULL OR ps <= pt) THEN sp WHEN pt IS NOT NULL THEN tg ELSE lc END - edge) - 1.0 AS pnl FROM x)"""


def sessions(bars):
    """Bars with their session's last position, open and last close."""
    d = daily(bars).select("series_id", "date", F.col("last_pos").alias("z"), F.col("o").alias("op"), F.col("c").alias("lc"), "n")
    return bars.join(d, ["series_id", "date"])


def resolve_in_session(entries, bars, more=()):
    """Trades from entries (edge, tg, sp, is_long, z, lc; the entry bar counts, a tie is a stop) to the session's end, z.

    A session's bars are matched by its date, so no horizon is needed; ``more`` names further columns of an entry.
    """
    keys = ["series_id", "date", "pos", "edge", "tg", "sp", "is_long", "lc", *more]
    b = bars.select("series_id", "date", F.col("pos").alias("_p"), F.col("h").alias("bh"), F.col("l").alias("bl"))
    rows = entries.select(*keys).join(b, ["series_id", "date"]).where(F.col("_p") >= F.col("pos"))
    hit_t = F.when(F.col("is_long"), F.col("bh") >= F.col("tg")).otherwise(F.col("bl") <= F.col("tg"))
    hit_s = F.when(F.col("is_long"), F.col("bl") <= F.col("sp")).otherwise(F.col("bh") >= F.col("sp"))
    t = rows.groupBy(*keys).agg(F.min(F.when(hit_t, F.col("_p"))).alias("_t"), F.min(F.when(hit_s, F.col("_p"))).alias("_s"))
    stopped = F.col("_s").isNotNull() & (F.col("_t").isNull() | (F.col("_s") <= F.col("_t")))
    how = F.when(stopped, "stop").when(F.col("_t").isNotNull(), "target").otherwise("timeout")
    price = F.when(F.col("how") == "stop", F.col("sp")).when(F.col("how") == "target", F.col("tg")).otherwise(F.col("lc"))
    pnl = F.when(F.col("is_long"), price - F.col("edge")).otherwise(F.col("edge") - price) - COST
    return t.withColumn("how", how).withColumn("pnl", pnl).drop("_t", "_s")


def s1_trades(bars):
    s = sessions(bars)
    lo = F.floor(F.col("op") / SIZE) * SIZE
    s = s.withColumn("is_long", F.col("op") - lo <= lo + SIZE - F.col("op")).withColumn("edge", F.when(F.col("is_long"), lo).otherwise(lo + SIZE))
    s = s.withColumns({"tg": F.when(F.col("is_long"), lo + SIZE).otherwise(lo), "sp": F.when(F.col("is_long"), F.col("edge") - RISK).otherwise(F.col("edge") + RISK)})
    touch = s.where((F.col("l") <= F.col("edge")) & (F.col("h") >= F.col("edge")))
    first = touch.groupBy("series_id", "date", "edge", "tg", "sp", "is_long", "z", "lc").agg(F.min("pos").alias("pos"))
    return resolve_in_session(first, bars)


@query(EVT + _S1 + " SELECT series_id, date, pos, how, round(pnl, 5) AS pnl FROM tr")
def s1_traverse(spark, sf_dir):
    return s1_trades(bars_evt(spark, sf_dir)).select("series_id", "date", "pos", "how", F.round("pnl", 5).alias("pnl"))


@query(EVT + _S1 + """, q AS (SELECT *, sum(pnl) OVER w AS eq FROM tr WINDOW w AS (PARTITION BY series_id ORDER BY pos)), d AS (SELECT *, max(eq) OVER (PARTITION BY series_id ORDER BY pos) - eq AS dd FROM q)
SELECT series_id, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(avg(pnl), 4) AS mean, round(sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl END), 0), 4) AS pf,
round(avg(pnl) / nullif(CASE WHEN count(*) > 2 THEN stddev_samp(pnl) END, 0) * sqrt(count(*)), 4) AS t, round(sum(pnl), 4) AS total, round(max(dd), 4) AS max_dd FROM d GROUP BY series_id""")
def trade_stats(spark, sf_dir):
    s = S.trade_stats(s1_trades(bars_evt(spark, sf_dir)), ["series_id"], "pnl", ["pos"])
    return s.select("series_id", "n", F.round("win", 6).alias("win"), *[F.round(c, 4).alias(c) for c in ("mean", "pf", "t", "total", "max_dd")])


_S3 = """, r AS (SELECT *, max(h) OVER w AS rh, min(l) OVER w AS rl FROM bars WINDOW w AS (PARTITION BY series_id, date ORDER BY pos)),
f AS (SELECT series_id, date, min(pos) AS pos FROM r WHERE rh - rl >= 81 GROUP BY ALL),
g AS (SELECT f.*, r.rh, r.rl, r.c FROM f JOIN r USING (series_id, date, pos)), z AS (SELECT series_id, date, max(pos) AS z, arg_max(c, pos) AS lc FROM bars GROUP BY ALL)
SELECT series_id, date, pos, abs(c - rh) < abs(c - rl) AS at_high, round(CASE WHEN abs(c - rh) < abs(c - rl) THEN c - lc ELSE lc - c END, 5) AS fade_to_close FROM g JOIN z USING (series_id, date)"""


@query(EVT + _S3)
def s3_range_complete(spark, sf_dir):
    """The first bar of a session whose running range is 81 or more; what fading it to the session's close gives."""
    bars = sessions(bars_evt(spark, sf_dir))
    w = Window.partitionBy("series_id", "date").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = bars.withColumns({"rh": F.max("h").over(w), "rl": F.min("l").over(w)}).where("rh - rl >= 81")
    first = run.groupBy("series_id", "date").agg(F.min_by(F.struct("pos", "rh", "rl", "c", "lc"), "pos").alias("x")).select("series_id", "date", "x.*")
    high = F.abs(F.col("c") - F.col("rh")) < F.abs(F.col("c") - F.col("rl"))
    return first.select("series_id", "date", "pos", high.alias("at_high"), F.round(F.when(high, F.col("c") - F.col("lc")).otherwise(F.col("lc") - F.col("c")), 5).alias("fade_to_close"))


SPACING, MOST = 4, 3


def s2_entries(bars, size, pen=0.0):
    """Touches of block edges in time order: at most MOST a session, SPACING bars apart; those level with the close five
    bars before are passed over and use up no spacing. A session's ordered fold over its touches."""
    s = sessions(bars)
    w = Window.partitionBy("series_id", "date").orderBy("pos")
    s = s.withColumns({"i": F.row_number().over(w) - 1, "cj": F.coalesce(F.lag("c", 5).over(w), F.first("c").over(w))})
    inner = F.sequence(F.ceil((F.col("l") + pen) / size), F.floor((F.col("h") - pen) / size))
    lows = s.where(F.ceil((F.col("l") + pen) / size) <= F.floor((F.col("h") - pen) / size))
    span = s.groupBy("series_id", "date").agg(F.min(F.floor(F.col("c") / size)).alias("k0"), F.max(F.floor(F.col("c") / size)).alias("k1"))
    t = lows.withColumn("k", F.explode(inner)).join(span, ["series_id", "date"]).where("k BETWEEN k0 AND k1 + 1").withColumn("edge", F.col("k") * size)
    t = t.where(F.col("cj") != F.col("edge"))
    folded = t.groupBy("series_id", "date").agg(F.array_sort(F.collect_list(F.struct("i", "edge", "pos", "cj", "z", "lc"))).alias("all"))
    empty = F.slice("all", 1, 0)
    picks = F.aggregate(
        "all", F.struct(empty.alias("got"), F.lit(-999).alias("last")),
        lambda a, e: F.when((F.size(a["got"]) < MOST) & (e["i"] - a["last"] >= SPACING), F.struct(F.array_append(a["got"], e).alias("got"), e["i"].alias("last"))).otherwise(a), lambda a: a["got"],
    )
    e = folded.select("series_id", "date", F.explode(picks).alias("e")).select("series_id", "date", "e.*")
    e = e.withColumn("is_long", ~(F.col("cj") < F.col("edge")))
    return e.withColumns({"sp": F.when(F.col("is_long"), F.col("edge") - 0.1 * size).otherwise(F.col("edge") + 0.1 * size), "tg": F.when(F.col("is_long"), F.col("edge") + 0.1 * size).otherwise(F.col("edge") - 0.1 * size)})


_S2 = """, s AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(c, 5) OVER w, first_value(c) OVER w) AS cj, max(pos) OVER (PARTITION BY series_id, date) AS z, last_value(c) OVER (PARTITION BY series_id, date ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc,
min(floor(c / 81)) OVER (PARTITION BY series_id, date) AS k0, max(floor(c / 81)) OVER (PARTITION BY series_id, date) AS k1 FROM bars WINDOW w AS (PARTITION BY series_id, date ORDER BY pos)),
t AS (SELECT s.*, k * 81.0 AS edge, row_number() OVER (PARTITION BY series_id, date ORDER BY pos, k) AS n FROM s, (SELECT unnest(range(0, 20)) AS k) WHERE l + {pen} <= k * 81.0 AND h - {pen} >= k * 81.0 AND k BETWEEN k0 AND k1 + 1 AND cj <> k * 81.0),
w AS (SELECT series_id, date, n, pos, i, 1 AS used FROM t WHERE n = 1
UNION ALL SELECT * FROM (SELECT t.series_id, t.date, t.n, t.pos, t.i, w.used + 1 AS used FROM w JOIN t ON t.series_id = w.series_id AND t.date = w.date AND t.n > w.n AND t.i - w.i >= 4 AND w.used < 3
QUALIFY row_number() OVER (PARTITION BY t.series_id, t.date ORDER BY t.n) = 1)),
e AS (SELECT t.*, NOT (t.cj < t.edge) AS is_long FROM w JOIN t USING (series_id, date, n)),
x AS (SELECT e.series_id, e.date, e.n, e.pos, e.edge, e.is_long, e.lc, min(b.pos) FILTER (CASE WHEN is_long THEN b.h >= edge + 8.1 ELSE b.l <= edge - 8.1 END) AS pt, min(b.pos) FILTER (CASE WHEN is_long THEN b.l <= edge - 8.1 ELSE b.h >= edge + 8.1 END) AS ps
FROM e JOIN bars b ON b.series_id = e.series_id AND b.pos BETWEEN e.pos AND e.z GROUP BY ALL)
SELECT series_id, date, pos, edge, CASE WHEN ps IS NOT NULL AND (pt IS NULL OR ps <= pt) THEN 'stop' WHEN pt IS NOT NULL THEN 'target' ELSE 'timeout' END AS how,
round(CASE WHEN ps IS NOT NULL AND (pt IS NULL OR ps <= pt) THEN -8.1 WHEN pt IS NOT NULL THEN 8.1 ELSE CASE WHEN is_long THEN lc - edge ELSE edge - lc END END - 1.0, 5) AS pnl FROM x"""


@query(EVT + _S2.replace("{pen}", "0"))
def s2_edge_fade(spark, sf_dir):
    bars = bars_evt(spark, sf_dir)
    return resolve_in_session(s2_entries(bars, 81.0), bars).select("series_id", "date", "pos", "edge", "how", F.round("pnl", 5).alias("pnl"))


@query(EVT + _S2.replace("{pen}", "2"))
def s2_penetration(spark, sf_dir):
    """Fills only where price went two points beyond the edge."""
    bars = bars_evt(spark, sf_dir)
    return resolve_in_session(s2_entries(bars, 81.0, 2.0), bars).select("series_id", "date", "pos", "edge", "how", F.round("pnl", 5).alias("pnl"))


_DAYS = """, d AS (SELECT series_id, date, arg_min(c, pos) AS fc, arg_min(o, pos) AS op, arg_max(c, pos) AS cl, max(h) AS hi, min(l) AS lo FROM bars WHERE hh BETWEEN 9 AND 15 GROUP BY ALL),
p AS (SELECT *, lag(cl) OVER w AS pc, lag(hi) OVER w AS pdh, lag(lo) OVER w AS pdl FROM d WINDOW w AS (PARTITION BY series_id ORDER BY date))"""


def rth_days(bars):
    rth = bars.where(F.col("hh").between(9, 15))
    d = rth.groupBy("series_id", "date").agg(F.min_by("c", "pos").alias("fc"), F.min_by("o", "pos").alias("op"), F.max_by("c", "pos").alias("cl"), F.max("h").alias("hi"), F.min("l").alias("lo"))
    w = Window.partitionBy("series_id").orderBy("date")
    return d.withColumns({"pc": F.lag("cl").over(w), "pdh": F.lag("hi").over(w), "pdl": F.lag("lo").over(w)})


@query(EVT + _DAYS + " SELECT series_id, CAST(count(*) AS BIGINT) AS n, round(avg(fc - pc) - 0.45, 5) AS overnight_net, round(avg(cl - op) - 0.45, 5) AS rth_net FROM p WHERE pc IS NOT NULL GROUP BY series_id")
def benchmark_overnight(spark, sf_dir):
    """Yesterday's close to the close of today's first session bar, and open to close."""
    return rth_days(bars_evt(spark, sf_dir)).where("pc IS NOT NULL").groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("fc") - F.col("pc")) - 0.45, 5).alias("overnight_net"), F.round(F.avg(F.col("cl") - F.col("op")) - 0.45, 5).alias("rth_net"))


@query(EVT + _DAYS + " SELECT series_id, op > pc AS gap_up, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN op > pc THEN op - cl ELSE cl - op END), 5) AS fade, round(-avg(CASE WHEN op > pc THEN op - cl ELSE cl - op END), 5) AS follow FROM p WHERE pc IS NOT NULL AND op <> pc GROUP BY ALL")
def gap_fade_follow(spark, sf_dir):
    d = rth_days(bars_evt(spark, sf_dir)).where("pc IS NOT NULL AND op <> pc").withColumn("gap_up", F.col("op") > F.col("pc"))
    fade = F.when(F.col("gap_up"), F.col("op") - F.col("cl")).otherwise(F.col("cl") - F.col("op"))
    return d.groupBy("series_id", "gap_up").agg(F.count("*").alias("n"), F.round(F.avg(fade), 5).alias("fade"), F.round(-F.avg(fade), 5).alias("follow"))


_ORB = """, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY pos) AS rn FROM bars WHERE hh BETWEEN 9 AND 15),
o AS (SELECT series_id, date, max(h) AS oh, min(l) AS ol, max(pos) AS op FROM r WHERE rn <= 2 GROUP BY ALL), z AS (SELECT series_id, date, arg_max(c, pos) AS cl FROM r GROUP BY ALL),
x AS (SELECT o.series_id, o.date, oh, ol, min(r.pos) FILTER (r.h > oh) AS pu, min(r.pos) FILTER (r.l < ol) AS pd FROM o JOIN r ON r.series_id = o.series_id AND r.date = o.date AND r.pos > o.op GROUP BY ALL)
SELECT series_id, date, CASE WHEN pu = pd THEN 'both' WHEN pu IS NULL AND pd IS NULL THEN 'none' WHEN pd IS NULL OR pu < pd THEN 'up' ELSE 'down' END AS side,
round(CASE WHEN pu = pd OR (pu IS NULL AND pd IS NULL) THEN 0 WHEN pd IS NULL OR pu < pd THEN cl - oh ELSE ol - cl END, 5) AS pnl FROM x JOIN z USING (series_id, date)"""


@query(EVT + _ORB)
def opening_range_breakout(spark, sf_dir):
    rth = bars_evt(spark, sf_dir).where(F.col("hh").between(9, 15))
    w = Window.partitionBy("series_id", "date").orderBy("pos")
    r = rth.withColumn("rn", F.row_number().over(w))
    o = r.groupBy("series_id", "date").agg(F.max(F.when(F.col("rn") <= 2, F.col("h"))).alias("oh"), F.min(F.when(F.col("rn") <= 2, F.col("l"))).alias("ol"), F.max_by("c", "pos").alias("cl"))
    x = r.where("rn > 2").join(o, ["series_id", "date"]).groupBy("series_id", "date", "oh", "ol", "cl").agg(F.min(F.when(F.col("h") > F.col("oh"), F.col("pos"))).alias("pu"), F.min(F.when(F.col("l") < F.col("ol"), F.col("pos"))).alias("pd"))
    side = F.when(F.col("pu") == F.col("pd"), "both").when(F.col("pu").isNull() & F.col("pd").isNull(), "none").when(F.col("pd").isNull() | (F.col("pu") < F.col("pd")), "up").otherwise("down")
    return x.withColumn("side", side).select("series_id", "date", "side", F.round(F.when(F.col("side") == "up", F.col("cl") - F.col("oh")).when(F.col("side") == "down", F.col("ol") - F.col("cl")).otherwise(0.0), 5).alias("pnl"))


@query(EVT + _DAYS + """ SELECT p.series_id, p.date, min(b.pos) FILTER (b.h > pdh) AS took_high, min(b.pos) FILTER (b.l < pdl) AS took_low FROM p JOIN bars b ON b.series_id = p.series_id AND b.date = p.date AND b.hh BETWEEN 9 AND 15 WHERE pdh IS NOT NULL GROUP BY p.series_id, p.date""")
def pdh_pdl_break(spark, sf_dir):
    bars = bars_evt(spark, sf_dir)
    d = rth_days(bars).where("pdh IS NOT NULL").select("series_id", "date", "pdh", "pdl")
    return bars.where(F.col("hh").between(9, 15)).join(d, ["series_id", "date"]).groupBy("series_id", "date").agg(F.min(F.when(F.col("h") > F.col("pdh"), F.col("pos"))).alias("took_high"), F.min(F.when(F.col("l") < F.col("pdl"), F.col("pos"))).alias("took_low"))


_SW = """, s AS (SELECT *, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) = 2 AND count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) = 2 AS whole, greatest(max(h) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), max(h) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS mh FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
sw AS (SELECT CAST(floor((h - 243 * floor(h / 243)) / 243 * 600) AS BIGINT) AS bin, count(*) AS cnt FROM s WHERE whole AND h > mh GROUP BY 1), oc AS (SELECT CAST(floor((h - 243 * floor(h / 243)) / 243 * 600) AS BIGINT) AS bin, count(*) AS cnt FROM bars GROUP BY 1)"""


def position_histogram(df, column="h", bins=600):
    return df.groupBy(L.block_bin(F.col(column), F.lit(SIZE), bins).alias("bin")).agg(F.count("*").alias("cnt"))


@query(EVT + _SW + " SELECT bin, CAST(cnt AS BIGINT) AS cnt FROM sw")
def swing_phase_hist(spark, sf_dir):
    return position_histogram(fractal_swings(bars_evt(spark, sf_dir), 2).where("swing_hi"))


@query(EVT + _SW + """, m AS (SELECT unnest(range(0, 18)) AS bin UNION ALL SELECT unnest(range(582, 600)) UNION ALL SELECT unnest(range(282, 318))), sh AS (SELECT j AS shift, (bin + j * 30) % 600 AS bin FROM m, (SELECT unnest(range(0, 20)) AS j)),
a AS (SELECT shift, sum(cnt) * 1.0 / (SELECT sum(cnt) FROM sw) AS r FROM sh JOIN sw USING (bin) GROUP BY shift), b AS (SELECT shift, sum(cnt) * 1.0 / (SELECT sum(cnt) FROM oc) AS r FROM sh JOIN oc USING (bin) GROUP BY shift)
SELECT CAST(b.shift AS INT) AS shift, round(coalesce(a.r, 0), 6) AS swing_rate, round(b.r, 6) AS occupancy, round(coalesce(a.r, 0) - b.r, 6) AS excess FROM b LEFT JOIN a USING (shift)""")
def swing_zone_rates(spark, sf_dir):
    """Swing highs in the extreme and middle zones less the share of bars there, for every shift of the lattice."""
    bars = bars_evt(spark, sf_dir)
    bins = F.array(*[F.lit(x) for x in (*range(18), *range(582, 600), *range(282, 318))])
    mask = spark.range(1).select(F.explode(bins).alias("bin"))
    a = S.shifted_rates(position_histogram(fractal_swings(bars, 2).where("swing_hi")), mask, 600, 20, 30).select("shift", F.col("rate").alias("a"))
    b = S.shifted_rates(position_histogram(bars), mask, 600, 20, 30).select("shift", F.col("rate").alias("b"))
    both = b.join(a, "shift", "left").na.fill(0.0, ["a"])
    return both.select("shift", F.round("a", 6).alias("swing_rate"), F.round("b", 6).alias("occupancy"), F.round(F.col("a") - F.col("b"), 6).alias("excess"))


_LAYER = "CASE WHEN p < 11 THEN 0 WHEN p < 23 THEN 1 WHEN p < 41 THEN 2 WHEN p < 59 THEN 3 WHEN p < 77 THEN 4 WHEN p < 89 THEN 5 ELSE 6 END"
_TRANS = f", l0 AS (SELECT series_id, pos, {_LAYER} AS layer FROM (SELECT series_id, pos, (c - 243 * floor(c / 243)) / 243 * 100 AS p FROM bars)), lg AS (SELECT *, lag(layer) OVER (PARTITION BY series_id ORDER BY pos) AS was FROM l0)"


def layers(bars):
    return bars.withColumn("layer", L.layer_index(L.block_pct(F.col("c"), SIZE)))


@query(EVT + _TRANS + " SELECT series_id, was, layer AS now, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY series_id, was), 6) AS share FROM lg WHERE was <> layer GROUP BY series_id, was, layer")
def transition_matrix(spark, sf_dir):
    return S.transitions(layers(bars_evt(spark, sf_dir)), "layer", ["series_id"], "pos").withColumn("share", F.round("share", 6))


@query(EVT + _TRANS + ", x AS (SELECT series_id, pos, layer, lag(layer) OVER (PARTITION BY series_id ORDER BY pos) AS prev FROM l0 WHERE layer IN (0, 6)) SELECT series_id, CAST(count(*) AS BIGINT) AS traversals FROM x WHERE prev <> layer GROUP BY series_id")
def traversal(spark, sf_dir):
    """Passages from one extreme layer to the other, whatever lies between."""
    ends = layers(bars_evt(spark, sf_dir)).where(F.col("layer").isin(0, 6))
    return changes(ends, "layer", ["series_id"]).where("step > 0").groupBy("series_id").agg(F.count("*").alias("traversals"))


@query(EVT + _TRANS + " SELECT series_id, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN abs(layer - was) = 1 THEN 1.0 ELSE 0.0 END), 6) AS step_rate FROM lg WHERE was <> layer GROUP BY series_id")
def step_rate(spark, sf_dir):
    m = S.transitions(layers(bars_evt(spark, sf_dir)), "layer", ["series_id"], "pos")
    return m.groupBy("series_id").agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.abs(F.col("now") - F.col("was")) == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("step_rate"))


_DEPTH = "(" + " + ".join(f"CASE WHEN list_bool_or([least(abs(x - v), 100 - abs(x - v)) <= 0.5 for v in [0,3,7,11,17,23,29,35,41,47,50,53,59,65,71,77,83,89,93,97]]) THEN 1 ELSE 0 END".replace("x", f"((c - {s} * floor(c / {s})) / {s} * 100)") for s in (27, 81, 243, 729)) + ")"


@query(EVT + f", x AS (SELECT series_id, pos, c, lead(c, 6) OVER (PARTITION BY series_id ORDER BY pos) - c AS f, {_DEPTH} AS depth FROM bars) SELECT depth, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_rate FROM x WHERE f IS NOT NULL GROUP BY depth")
def confluence_depth(spark, sf_dir):
    """On how many scales a close lies at a level, and how often price is higher six bars on."""
    c = F.col("c")
    depth = sum((L.on_level(L.block_pct(c, float(s)), 0.5).cast("int") for s in (27, 81, 243, 729)), F.lit(0))
    x = core(with_halo(bars_evt(spark, sf_dir), 0, 6).withColumns({"depth": depth, "f": F.lead("c", 6).over(ordered()) - c})).where("f IS NOT NULL")
    return x.groupBy("depth").agg(F.count("*").alias("n"), F.round(F.avg((F.col("f") > 0).cast("double")), 6).alias("up_rate"))


_HRS = ", x AS (SELECT hh, avg(c - o) FILTER (date < 20240116) AS a, avg(c - o) FILTER (date >= 20240116) AS b, CAST(count(*) AS DOUBLE) AS n, avg(c - o) AS y FROM bars GROUP BY hh)"


@query(EVT + _HRS + " SELECT round(corr(a, b), 5) AS corr, CAST(count(*) FILTER (a > 0 AND b > 0) AS BIGINT) AS alive FROM x")
def disc_val_corr(spark, sf_dir):
    """Hourly means before and after a date: their correlation, and the cells that are positive in both."""
    body = F.col("c") - F.col("o")
    x = bars_evt(spark, sf_dir).groupBy("hh").agg(F.avg(F.when(F.col("date") < 20240116, body)).alias("a"), F.avg(F.when(F.col("date") >= 20240116, body)).alias("b"))
    return x.agg(F.round(F.corr("a", "b"), 5).alias("corr"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("alive"))


@query(EVT + _HRS + " SELECT round((sum(n) * sum(n * hh * y) - sum(n * hh) * sum(n * y)) / (sum(n) * sum(n * hh * hh) - sum(n * hh) * sum(n * hh)), 6) AS slope FROM x")
def weighted_trend(spark, sf_dir):
    x = bars_evt(spark, sf_dir).groupBy("hh").agg(F.avg(F.col("c") - F.col("o")).alias("y"), F.count("*").cast("double").alias("n"))
    return x.agg(F.round(S.weighted_trend(F.col("hh").cast("double"), F.col("y"), F.col("n")), 6).alias("slope"))


_LCG = "((({x}) * 16807 % 2147483647) * 16807 % 2147483647)"


@query(EVT + ", d AS (SELECT date, sum(c - o) AS s, count(*) AS n, row_number() OVER (ORDER BY date) - 1 AS i FROM bars GROUP BY date), k AS (SELECT count(*) AS k FROM d), g AS (SELECT rep, " + _LCG.replace("{x}", "rep * 1000003 + i * 7919 + 12345") + " % k AS j FROM d, k, (SELECT unnest(range(0, 2000)) AS rep)), m AS (SELECT rep, sum(s) / sum(n) AS m FROM g JOIN d ON d.i = g.j GROUP BY rep) SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.5), 6) AS mid, round(quantile_cont(m, 0.975), 6) AS hi FROM m")
def day_bootstrap_ci(spark, sf_dir):
    """Interval of the mean bar body, days drawn with replacement."""
    days = bars_evt(spark, sf_dir).groupBy("date").agg(F.sum(F.col("c") - F.col("o")).alias("s"), F.count("*").alias("n"))
    m = S.cluster_bootstrap(days, 2000, "date")
    return m.agg(*[F.round(F.percentile("mean", q), 6).alias(name) for name, q in (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))])


_PERM = ", b AS (SELECT date, series_id, pos, c - o AS y, row_number() OVER (PARTITION BY date ORDER BY series_id, pos) AS r FROM bars), p AS (SELECT rep, date, series_id, row_number() OVER (PARTITION BY rep, date ORDER BY " + _LCG.replace("{x}", "rep * 7368787 + date % 100000 * 104729 + r * 15485863 + 1") + ", r) AS r FROM b, (SELECT unnest(range(0, 2000)) AS rep)), m AS (SELECT rep, p.series_id, avg(b.y) AS m FROM p JOIN b USING (date, r) GROUP BY ALL), sp AS (SELECT rep, max(m) - min(m) AS spread FROM m GROUP BY rep), tr AS (SELECT max(m) - min(m) AS t FROM (SELECT series_id, avg(y) AS m FROM b GROUP BY series_id))"


@query(EVT + _PERM + " SELECT round(t, 6) AS spread, round((SELECT avg(spread) FROM sp), 6) AS null_mean, CAST((SELECT count(*) FROM sp WHERE spread >= t) AS BIGINT) AS as_high FROM tr")
def within_day_permutation(spark, sf_dir):
    """Spread of the series' mean bodies, against labels permuted within each day (2,000 times), in tasks that hold a day each."""
    b = bars_evt(spark, sf_dir).select("date", "series_id", "pos", (F.col("c") - F.col("o")).alias("y"))
    m = permuted_sums(b, "date", ["series_id", "pos"], "series_id", "y", 2000).withColumn("m", F.col("s") / F.col("n"))
    spread = m.groupBy("rep").agg((F.max("m") - F.min("m")).alias("spread"))
    true = b.groupBy("series_id").agg(F.avg("y").alias("m")).agg((F.max("m") - F.min("m")).alias("t"))
    scored = spread.crossJoin(F.broadcast(true)).groupBy("t")  # one row
    out = scored.agg(F.avg("spread").alias("null_mean"), F.count_if(F.col("spread") >= F.col("t")).alias("as_high"))
    return out.select(F.round("t", 6).alias("spread"), F.round("null_mean", 6).alias("null_mean"), "as_high")


@query(EVT + ", d AS (SELECT series_id, date, max(h) - min(l) AS rng FROM bars GROUP BY ALL) SELECT series_id, CAST(r AS DOUBLE) AS r, round(avg(CASE WHEN rng <= r THEN 1.0 ELSE 0.0 END), 6) AS contained FROM d, (SELECT unnest([81.0, 243.0, 729.0]) AS r) GROUP BY series_id, r")
def containment(spark, sf_dir):
    d = daily(bars_evt(spark, sf_dir)).withColumn("r", F.explode(F.array(F.lit(81.0), F.lit(243.0), F.lit(729.0))))
    return d.groupBy("series_id", "r").agg(F.round(F.avg((F.col("h") - F.col("l") <= F.col("r")).cast("double")), 6).alias("contained"))


@query("SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS yr, CAST(count(*) AS BIGINT) AS n, round(median(o_totalprice), 4) AS med FROM orders GROUP BY CUBE (o_orderpriority, year(o_orderdate))")
def price_cube(spark, sf_dir):
    """Disjoint keys: Spark's own cube."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("yr", F.year("o_orderdate"))
    return o.cube("o_orderpriority", "yr").agg(F.count("*").alias("n"), F.round(F.percentile("o_totalprice", 0.5), 4).alias("med"))
