"""Relational odds and ends of the studies: anti and self joins, set operations, modes, top cells, clock audits and gates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import clock as C
from barloom.functions import lattice as L
from barloom.operators import events as V
from barloom.operators import features as X
from barloom.operators import stats as S
from barloom.operators.bars import daily
from barloom.operators.halo import core, frame, ordered, with_halo
from barloom.operators.scan import running
from barloom.plans.event_queries import _CROSS, _TOUCHES, SIZE, touch_outcomes
from barloom.plans.inputs import EVT, LEVELS, bars_evt, table
from barloom.plans.registry import query
from barloom.plans.sql_parts import ATR, SWINGS
from barloom.sources import readers


@query(EVT + _CROSS + ", xd AS (SELECT DISTINCT series_id, date FROM bars JOIN e USING (series_id, pos)) SELECT series_id, CAST(count(*) AS BIGINT) AS days FROM (SELECT DISTINCT series_id, date FROM bars) d WHERE NOT EXISTS (SELECT 1 FROM xd WHERE xd.series_id = d.series_id AND xd.date = d.date) GROUP BY series_id")
def quiet_days(spark, sf_dir):
    """Days on which no close crosses a boundary: an anti join."""
    bars = bars_evt(spark, sf_dir)
    crossed = V.close_crosses(bars, SIZE).select("series_id", "date").distinct()
    return daily(bars).select("series_id", "date").join(crossed, ["series_id", "date"], "left_anti").groupBy("series_id").agg(F.count("*").alias("days"))


@query(EVT + ", d AS (SELECT DISTINCT series_id, date FROM bars), x AS (SELECT series_id, date, CAST(h AS INT) AS hh FROM d, (SELECT unnest(range(0, 24)) AS h) EXCEPT SELECT series_id, date, hh FROM bars) SELECT hh, CAST(count(*) AS BIGINT) AS days FROM x GROUP BY hh")
def absent_hours(spark, sf_dir):
    """Hours without a bar, by hour: all hours of the days except those that are there."""
    bars = bars_evt(spark, sf_dir)
    every = bars.select("series_id", "date").distinct().withColumn("hh", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return every.exceptAll(bars.select("series_id", "date", "hh").distinct()).groupBy("hh").agg(F.count("*").alias("days"))


@query(EVT + SWINGS + """, p AS (SELECT series_id, date, hi, lag(hi) OVER w AS was, CASE WHEN hi THEN h ELSE l END AS px, lag(CASE WHEN hi THEN h ELSE l END) OVER w AS wpx, pos - lag(pos) OVER w AS apart
FROM swings WINDOW w AS (PARTITION BY series_id, date ORDER BY pos)) SELECT was AS was_high, hi AS is_high, px > wpx AS higher, CAST(count(*) AS BIGINT) AS n, round(avg(apart), 6) AS bars_apart FROM p WHERE was IS NOT NULL GROUP BY ALL""")
def consecutive_swings(spark, sf_dir):
    """Pairs of one swing and the next of the same day, by kind and direction."""
    s = X.fractal_swings(bars_evt(spark, sf_dir), 2).where("swing_hi OR swing_lo").withColumn("px", F.when(F.col("swing_hi"), F.col("h")).otherwise(F.col("l")))
    w = Window.partitionBy("series_id", "date").orderBy("pos")
    p = s.select(F.lag("swing_hi").over(w).alias("was_high"), F.col("swing_hi").alias("is_high"), (F.col("px") > F.lag("px").over(w)).alias("higher"), (F.col("pos") - F.lag("pos").over(w)).alias("apart"))
    return p.where("was_high IS NOT NULL").groupBy("was_high", "is_high", "higher").agg(F.count("*").alias("n"), F.round(F.avg("apart"), 6).alias("bars_apart"))


@query(EVT + _CROSS + ", xh AS (SELECT series_id, hh, count(*) AS n FROM bars JOIN e USING (series_id, pos) GROUP BY ALL) SELECT series_id, CAST(count(*) AS BIGINT) AS hours, arg_max(hh, n * 100 - hh) AS modal_hour, CAST(max(n) AS BIGINT) AS n FROM xh GROUP BY series_id")
def modal_hour(spark, sf_dir):
    """The hour with most crossings, the earliest of equals, and how many hours have any."""
    x = V.close_crosses(bars_evt(spark, sf_dir), SIZE).groupBy("series_id", "hh").agg(F.count("*").alias("n"))
    return x.groupBy("series_id").agg(F.count("*").alias("hours"), F.max_by("hh", F.struct("n", -F.col("hh"))).alias("modal_hour"), F.max("n").alias("n"))


@query(EVT + ATR + " SELECT series_id, pos, round(CASE WHEN count(*) OVER f >= 20 THEN avg(tr) OVER f END, 6) AS atr60 FROM tr0 WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def rolling_atr(spark, sf_dir):
    """Mean true range of up to 60 bars, from 20 on."""
    df = with_halo(bars_evt(spark, sf_dir), 60, 0).withColumn("tr", X.true_range(ordered()))
    f = frame(-59, 0)
    return core(df.withColumn("atr60", F.round(F.when(F.count("*").over(f) >= 20, F.avg("tr").over(f)), 6))).select("series_id", "pos", "atr60")


@query(EVT + """, x AS (SELECT series_id, pos, hh, c - lag(c, 10) OVER w AS b, lead(c, 10) OVER w - c AS f FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos))
SELECT hh, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN b <> 0 AND f <> 0 AND sign(b) <> sign(f) THEN 1.0 ELSE 0.0 END), 6) AS reversal FROM x WHERE b IS NOT NULL AND f IS NOT NULL GROUP BY hh""")
def reversal_rate(spark, sf_dir):
    """How often the ten bars before and the ten after go opposite ways, by hour."""
    df = with_halo(bars_evt(spark, sf_dir), 10, 10)
    df = core(df.withColumns({"b": F.col("c") - F.lag("c", 10).over(ordered()), "f": F.lead("c", 10).over(ordered()) - F.col("c")})).where("b IS NOT NULL AND f IS NOT NULL")
    turned = (F.col("b") != 0) & (F.col("f") != 0) & (F.signum("b") != F.signum("f"))
    return df.groupBy("hh").agg(F.count("*").alias("n"), F.round(F.avg(turned.cast("double")), 6).alias("reversal"))


@query(EVT + ", " + _TOUCHES.replace("{phases}", "[0.0]") + "SELECT CAST(pct AS INT) AS level, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN reject THEN 1.0 ELSE 0.0 END), 6) AS reject_rate FROM r GROUP BY pct ORDER BY round(avg(CASE WHEN reject THEN 1.0 ELSE 0.0 END), 6) DESC, level LIMIT 5")
def top_levels(spark, sf_dir):
    """The five levels that are rejected most: a top-k, the lowest level first of equals."""
    t = touch_outcomes(bars_evt(spark, sf_dir)).groupBy(F.col("pct").cast("int").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("reject").cast("double")), 6).alias("reject_rate"))
    return t.orderBy(F.desc("reject_rate"), "level").limit(5)


@query(EVT + ", x AS (SELECT series_id, hh, avg(c - o) FILTER (date < 20240116) AS a, avg(c - o) FILTER (date >= 20240116) AS b FROM bars GROUP BY ALL) SELECT series_id, hh FROM x WHERE a > 0 INTERSECT SELECT series_id, hh FROM x WHERE b > 0")
def alive_cells(spark, sf_dir):
    """Cells that are positive in both halves of the time: an intersection."""
    x = bars_evt(spark, sf_dir).withColumn("early", F.col("date") < 20240116).groupBy("series_id", "hh", "early").agg(F.avg(F.col("c") - F.col("o")).alias("m")).where("m > 0")
    return x.where("early").select("series_id", "hh").intersect(x.where("NOT early").select("series_id", "hh"))


@query(EVT + _CROSS + SWINGS + " SELECT series_id, kind, CAST(count(*) AS BIGINT) AS n, CAST(min(pos) AS BIGINT) AS first_pos FROM (SELECT series_id, pos, CASE WHEN up THEN 'cross_up' ELSE 'cross_down' END AS kind FROM e UNION ALL SELECT series_id, pos, 'swing_high' FROM swings WHERE hi UNION ALL SELECT series_id, pos, 'swing_low' FROM swings WHERE lo) GROUP BY ALL")
def event_union(spark, sf_dir):
    """Crossings and swings as one set of events."""
    bars = bars_evt(spark, sf_dir)
    cross = V.close_crosses(bars, SIZE).select("series_id", "pos", F.when(F.col("up"), "cross_up").otherwise("cross_down").alias("kind"))
    s = X.fractal_swings(bars, 2)
    every = cross
    for side, name in (("swing_hi", "swing_high"), ("swing_lo", "swing_low")):
        every = every.unionByName(s.where(side).select("series_id", "pos", F.lit(name).alias("kind")))
    return every.groupBy("series_id", "kind").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query(f"WITH {LEVELS}, j AS (SELECT unnest(range(-25, 90)) AS j), p AS (SELECT j, (floor(j / 20.0) + pct / 100) * 243 AS px FROM j JOIN levels ON idx = j - 20 * CAST(floor(j / 20.0) AS INT)) SELECT CAST(j AS BIGINT) AS j, round(px, 6) AS px, CAST("
+ " + ".join(f"CASE WHEN least(px - {s} * floor(px / {s}), {s} - (px - {s} * floor(px / {s}))) <= 2.0 THEN 1 ELSE 0 END" for s in L.ROUND_STEPS) + " AS INT) AS round_depth FROM p")
def absolute_levels(spark, sf_dir):
    """Prices of levels by absolute index, and on how many round-number grids each lies."""
    df = spark.range(-25, 90).withColumnRenamed("id", "j").withColumn("px", L.absolute_level_price(F.col("j"), F.lit(243.0)))
    return df.select("j", F.round("px", 6).alias("px"), L.round_depth(F.col("px"), 2.0).alias("round_depth"))


@query("SELECT CASE WHEN median(abs(l_extendedprice * 1000)) > 1e6 THEN 1e9 ELSE 1.0 END AS scale, CASE WHEN median(abs(l_extendedprice)) > 1e6 THEN 1e9 ELSE 1.0 END AS plain FROM lineitem")
def price_scale(spark, sf_dir):
    """Whether prices are fixed-point numbers, by their median."""
    px = F.col("l_extendedprice").cast("double")
    return table(spark, sf_dir, "lineitem").agg(readers.scale_of(px * 1000).alias("scale"), readers.scale_of(px).alias("plain"))


_LUT = """WITH RECURSIVE m AS (SELECT unnest(range(0, 1440)) AS mod), r AS (SELECT mod, 0 AS m, mod % 60 AS v, true AS pri FROM m UNION ALL SELECT mod, 1, mod // 60 + mod % 60, false FROM m UNION ALL SELECT mod, 2, abs(mod // 60 - mod % 60), false FROM m),
nd AS (SELECT * FROM (VALUES """ + ", ".join(f"({a}, {i}, {str(end).lower()}, {k}, {v})" for a, chain in C.CHAINS.items() for i, (_, vals, end) in enumerate(chain) for k, v in enumerate(vals)) + """) t(algo, idx, term, ord, target)),
hit AS (SELECT mod, algo, idx, term, pri, abs(v - target) AS dist, m, ord FROM r JOIN nd ON abs(v - target) <= 1),
lut AS (SELECT mod, algo, arg_min(idx, (CASE WHEN pri THEN 0 ELSE 1 END) * 100000 + dist * 10000 + idx * 1000 + m * 100 + ord) AS idx, bool_or(pri) AS pri, min(CASE WHEN pri THEN dist END) AS pd FROM hit GROUP BY mod, algo)"""


@query(_LUT + """, x AS (SELECT mod // 60 AS hh, mod % 60 AS mm, idx, lag(idx) OVER (PARTITION BY mod // 60 ORDER BY mod) AS was FROM lut WHERE algo = 2 AND pri AND pd = 0)
SELECT CAST(hh AS INT) AS hh, CAST(count(*) AS BIGINT) AS nodes, CAST(count(*) FILTER (idx = was - 1) AS BIGINT) AS steps_down FROM x GROUP BY hh""")
def minute_monotonicity(spark, sf_dir):
    """How many steps of the second chain the clock alone makes within an hour, from exact minutes."""
    lut = C.minute_lut(spark).where("algo = 2 AND primary AND dist = 0")
    w = Window.partitionBy("hh").orderBy("mod")
    x = lut.withColumn("was", F.lag("idx").over(w))
    return x.groupBy("hh").agg(F.count("*").alias("nodes"), F.count_if(F.col("idx") == F.col("was") - 1).alias("steps_down"))


@query(_LUT + """, h2 AS (SELECT DISTINCT mod, algo, idx FROM hit), s AS (SELECT a.mod, h2.algo, h2.idx, st, row_number() OVER (PARTITION BY a.mod, h2.algo, h2.idx ORDER BY st) AS rn
FROM m a, (SELECT unnest(range(1, 91)) AS st) JOIN h2 ON h2.mod = (a.mod + st) % 1440 WHERE a.mod % 60 = 0)
SELECT CAST(mod AS INT) AS mod, CAST(algo AS INT) AS algo, CAST(idx AS INT) AS idx, CAST(count(*) AS BIGINT) AS times, CAST(min(st) AS INT) AS first_step, CAST(max(st) AS INT) AS last_step, CAST(min(min(st)) OVER (PARTITION BY mod) AS INT) AS least_travel FROM s WHERE rn <= 8 GROUP BY mod, algo, idx""")
def watch_times(spark, sf_dir):
    """From each full hour, the first eight minutes within 90 that hit a node, and the nearest of all: the least travel."""
    day = spark.range(0, 1440, 60).select(F.col("id").cast("int").alias("mod"), F.explode(F.sequence(F.lit(1), F.lit(90))).alias("step"))
    minute = spark.range(1440).select(F.col("id").cast("int").alias("to"))
    reads = minute.select("to", F.inline(C.reads(F.floor(F.col("to") / 60).cast("int"), (F.col("to") % 60).cast("int"))))
    hits = reads.join(F.broadcast(C.nodes(spark)), F.abs(F.col("value") - F.col("target")) <= 1).select("to", "algo", "idx").distinct()
    s = day.withColumn("to", (F.col("mod") + F.col("step")) % 1440).join(F.broadcast(hits), "to")
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy("mod", "algo", "idx").orderBy("step"))).where("rn <= 8")
    g = s.groupBy("mod", "algo", "idx").agg(F.count("*").alias("times"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))
    return g.withColumn("least_travel", F.min("first_step").over(Window.partitionBy("mod")))


_VERDICT = """, nx AS (SELECT l.mod, l.algo, n.idx, n.label FROM lut l JOIN (SELECT DISTINCT algo, idx, label FROM (VALUES """ + ", ".join(f"({a}, {i}, '{lab}')" for a, chain in C.CHAINS.items() for i, (lab, _, _) in enumerate(chain)) + """) t(algo, idx, label)) n ON n.algo = l.algo AND n.idx = CASE WHEN l.algo = 1 THEN l.idx + 1 ELSE l.idx - 1 END),
vd AS (SELECT m.mod, a.label AS n1, b.label AS n2, CASE WHEN a.label IS NULL AND b.label IS NULL THEN 'none' WHEN a.label IS NULL OR b.label IS NULL THEN 'partial' WHEN a.label = b.label THEN 'agree' ELSE 'conflict' END AS verdict
FROM m LEFT JOIN nx a ON a.mod = m.mod AND a.algo = 1 LEFT JOIN nx b ON b.mod = m.mod AND b.algo = 2)"""


def verdicts(spark):
    """Per minute the next node of each chain, and whether they agree, conflict or only one reads."""
    nxt = F.broadcast(C.next_nodes(spark).select("algo", "idx", "next_node"))
    n = C.minute_lut(spark).join(nxt, ["algo", "idx"])
    one = n.groupBy("mod").agg(*[F.max(F.when(F.col("algo") == a, F.col("next_node"))).alias(f"n{a}") for a in (1, 2)])
    both = spark.range(1440).select(F.col("id").cast("int").alias("mod")).join(one, "mod", "left")
    none1, none2 = F.col("n1").isNull(), F.col("n2").isNull()
    return both.withColumn("verdict", F.when(none1 & none2, "none").when(none1 | none2, "partial").when(F.col("n1") == F.col("n2"), "agree").otherwise("conflict"))


@query(_LUT + _VERDICT + " SELECT verdict, CAST(count(*) AS BIGINT) AS minutes, CAST(min(mod) AS INT) AS first_mod FROM vd GROUP BY verdict")
def confluence_verdict(spark, sf_dir):
    return verdicts(spark).groupBy("verdict").agg(F.count("*").alias("minutes"), F.min("mod").alias("first_mod"))


@query(EVT + SWINGS + _LUT.replace("WITH RECURSIVE", ",", 1) + _VERDICT + """, g AS (SELECT s.series_id, s.pos, v.verdict, s.hi, s.h - s.l AS risk, (s.hi AND s.c < s.o) OR (s.lo AND s.c > s.o) AS seen,
(s.hi AND s.c < avg_c) OR (s.lo AND s.c > avg_c) AS bias FROM (SELECT *, avg(c) OVER (PARTITION BY series_id, date) AS avg_c FROM swings) s JOIN vd v ON v.mod = (s.hh * 60 + s.pos * 7) % 1440),
gr AS (SELECT *, CASE WHEN verdict = 'none' OR NOT seen THEN 'NO' WHEN bias AND verdict = 'agree' THEN 'A' WHEN bias OR verdict = 'agree' THEN 'B' ELSE 'C' END AS grade FROM g)
SELECT grade, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN grade = 'A' THEN 1.0 WHEN grade = 'B' THEN 0.5 ELSE 0.0 END * 100 / greatest(risk, 1)), 5) AS mean_lots FROM gr GROUP BY grade""")
def trade_gate(spark, sf_dir):
    """Swings graded by what is true of them: a node, a reaction seen, the bias, both chains; and the size for a fixed risk."""
    s = X.fractal_swings(bars_evt(spark, sf_dir), 2).where("swing_hi OR swing_lo")
    s = s.withColumns({"avg_c": F.avg("c").over(Window.partitionBy("series_id", "date")), "mod": ((F.col("hh") * 60 + F.col("pos") * 7) % 1440).cast("int")})
    s = s.join(F.broadcast(verdicts(spark)), "mod")
    hi, lo = F.col("swing_hi"), F.col("swing_lo")
    seen = (hi & (F.col("c") < F.col("o"))) | (lo & (F.col("c") > F.col("o")))
    bias = (hi & (F.col("c") < F.col("avg_c"))) | (lo & (F.col("c") > F.col("avg_c")))
    agree = F.col("verdict") == "agree"
    grade = F.when((F.col("verdict") == "none") | ~seen, "NO").when(bias & agree, "A").when(bias | agree, "B").otherwise("C")
    share = F.when(F.col("grade") == "A", 1.0).when(F.col("grade") == "B", 0.5).otherwise(0.0)
    return s.withColumn("grade", grade).groupBy("grade").agg(F.count("*").alias("n"), F.round(F.avg(share * 100 / F.greatest(F.col("h") - F.col("l"), F.lit(1.0))), 5).alias("mean_lots"))


@query(EVT + """, x AS (SELECT series_id, hh, count(DISTINCT date) AS days FROM bars GROUP BY ALL), g AS (SELECT s.series_id, CAST(u.h AS INT) AS hh, coalesce(x.days, 0) AS days FROM (SELECT DISTINCT series_id FROM bars) s CROSS JOIN (SELECT unnest(range(0, 24)) AS h) u LEFT JOIN x ON x.series_id = s.series_id AND x.hh = u.h),
k AS (SELECT *, days < (SELECT max(days) FROM x) AS thin, hh - row_number() OVER (PARTITION BY series_id, days < (SELECT max(days) FROM x) ORDER BY hh) AS run FROM g)
SELECT series_id, CAST(min(hh) AS INT) AS first_hour, CAST(count(*) AS BIGINT) AS hours, CAST(min(days) AS BIGINT) AS least_days FROM k WHERE thin GROUP BY series_id, run""")
def thin_hour_runs(spark, sf_dir):
    """Runs of hours of the day that lack bars on some day: where a feed's session breaks show."""
    bars = bars_evt(spark, sf_dir)
    x = bars.groupBy("series_id", "hh").agg(F.countDistinct("date").alias("days"))
    grid = bars.select("series_id").distinct().withColumn("hh", F.explode(F.sequence(F.lit(0), F.lit(23))))
    most = x.agg(F.max("days").alias("most"))
    g = grid.join(x, ["series_id", "hh"], "left").na.fill(0, ["days"]).crossJoin(F.broadcast(most)).withColumn("thin", F.col("days") < F.col("most"))  # one row
    run = F.col("hh") - F.row_number().over(Window.partitionBy("series_id", "thin").orderBy("hh"))
    return g.withColumn("run", run).where("thin").groupBy("series_id", "run").agg(F.min("hh").alias("first_hour"), F.count("*").alias("hours"), F.min("days").alias("least_days")).drop("run")


@query(EVT + """, q AS (SELECT series_id, pos, sum(c - o) OVER (PARTITION BY series_id ORDER BY pos) AS eq, ntile(40) OVER (PARTITION BY series_id ORDER BY pos) AS tile FROM bars)
SELECT series_id, CAST(tile AS INT) AS tile, CAST(max(pos) AS BIGINT) AS pos, round(arg_max(eq, pos), 4) AS equity, round(min(eq), 4) AS lowest FROM q GROUP BY series_id, tile""")
def thinned_equity(spark, sf_dir):
    """An equity curve cut to forty points a series, as a report reads it."""
    bars = bars_evt(spark, sf_dir)
    q = running(bars.select("series_id", "pos", "o", "c"), ["series_id"], {"eq": ("sum", F.col("c") - F.col("o"))})
    n = bars.groupBy("series_id").agg(F.count("*").alias("n"))
    # the first n % 40 tiles have one bar more than the others
    least, more = F.floor(F.col("n") / 40), F.col("n") % 40
    wide = more * (least + 1)
    tile = F.when(F.col("pos") < wide, F.floor(F.col("pos") / (least + 1))).otherwise(more + F.floor((F.col("pos") - wide) / F.greatest(least, F.lit(1))))
    q = q.join(n, "series_id").withColumn("tile", (tile + 1).cast("int"))
    return q.groupBy("series_id", "tile").agg(F.max("pos").alias("pos"), F.round(F.max_by("eq", "pos"), 4).alias("equity"), F.round(F.min("eq"), 4).alias("lowest"))
