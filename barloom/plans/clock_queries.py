"""Clock nodes: look-up table, density, returns at nodes, rotation null."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import clock as C
from barloom.operators.features import fractal_swings
from barloom.operators.halo import core, ordered, with_halo
from barloom.operators.stats import shifted_rates
from barloom.plans.inputs import EVT, bars_evt, table
from barloom.plans.registry import query

_NODES = "nodes(algo, idx, node, term, ord, target) AS (VALUES " + ", ".join(f"({a}, {i}, '{label}', {end}, {k}, {v})" for a, chain in C.CHAINS.items() for i, (label, values, end) in enumerate(chain) for k, v in enumerate(values)) + ")"
_HITS = _NODES + """, rd AS (SELECT CAST(m AS INT) AS mod, CAST(floor(m / 60) AS INT) AS hh, CAST(m % 60 AS INT) AS mm FROM (SELECT unnest(range(0, 1440)) AS m)),
r AS (SELECT mod, 0 AS k, 'MM' AS method, mm AS val, true AS prim FROM rd UNION ALL SELECT mod, 1, 'HH+MM', hh + mm, false FROM rd UNION ALL SELECT mod, 2, '|HH-MM|', abs(hh - mm), false FROM rd),
hit AS (SELECT r.*, n.*, abs(val - target) AS dist FROM r JOIN nodes n ON abs(val - target) <= {tol})"""
_LUT = _HITS.replace("{tol}", "1") + """, lut AS (SELECT mod, algo, idx, CASE WHEN term AND algo = 1 THEN CASE WHEN target >= 71 THEN '71/77' ELSE '29/35' END ELSE node END AS label, term AS terminal, method, prim AS "primary", dist,
CASE WHEN prim AND dist = 0 THEN 3 WHEN prim THEN 2 ELSE 1 END AS quality FROM hit QUALIFY row_number() OVER (PARTITION BY mod, algo ORDER BY prim DESC, dist, idx, k, ord) = 1)"""


@query("WITH " + _LUT + " SELECT * FROM lut")
def clock_lut(spark, sf_dir):
    return C.minute_lut(spark).select("mod", "algo", "idx", "label", "terminal", "method", "primary", "dist", "quality")


@query("SELECT * FROM (VALUES ('all tol0', 839), ('all tol1', 1406), ('all tol2', 1434), ('minute tol0', 384), ('minute tol1', 1104), ('top quality', 384)) t(name, n)")
def clock_density(spark, sf_dir):
    """Minutes that have a node: known counts of the clock, whatever the data."""
    cases = [("minute tol0", 0, True), ("minute tol1", 1, True), ("all tol0", 0, False), ("all tol1", 1, False), ("all tol2", 2, False)]
    parts = [C.minute_lut(spark, t, p).agg(F.lit(name).alias("name"), F.countDistinct("mod").cast("int").alias("n")) for name, t, p in cases]
    parts.append(C.both_reads(C.minute_lut(spark)).where("quality = 3").agg(F.lit("top quality").alias("name"), F.count("*").cast("int").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("WITH " + _LUT + ' SELECT mod, max(quality) AS quality, count(*) = 2 AS "both", count(*) = 2 AND min(label) = max(label) AS shared FROM lut GROUP BY mod')
def clock_both_reads(spark, sf_dir):
    return C.both_reads(C.minute_lut(spark))


@query("WITH " + _NODES + ", n AS (SELECT DISTINCT algo, idx, node, term FROM nodes) SELECT a.algo, a.idx, a.node, b.idx AS next_idx, b.node AS next_node, b.term AS \"end\" FROM n a JOIN n b ON a.algo = b.algo AND b.idx = a.idx + CASE WHEN a.algo = 1 THEN 1 ELSE -1 END")
def next_node(spark, sf_dir):
    return C.next_nodes(spark)


@query("WITH " + _HITS.replace("{tol}", "1") + ", h AS (SELECT DISTINCT algo, idx, mod AS at_ FROM hit) SELECT rd.mod, h.algo, h.idx, CAST(min(CASE WHEN at_ > rd.mod THEN at_ - rd.mod ELSE at_ - rd.mod + 1440 END) AS INT) AS step FROM rd, h WHERE CASE WHEN at_ > rd.mod THEN at_ - rd.mod ELSE at_ - rd.mod + 1440 END <= 720 GROUP BY ALL")
def next_node_time(spark, sf_dir):
    return C.first_future_time(spark)


@query("WITH RECURSIVE " + _NODES + ", n AS (SELECT DISTINCT algo, idx, node, term FROM nodes), w AS (SELECT algo, idx AS start, idx, 0 AS step, node AS path FROM n UNION ALL SELECT w.algo, w.start, n.idx, w.step + 1, w.path || ' > ' || n.node FROM w JOIN n ON n.algo = w.algo AND n.idx = w.idx + CASE WHEN w.algo = 1 THEN 1 ELSE -1 END) SELECT algo, start, max(step) AS steps, max_by(path, step) AS path FROM w GROUP BY algo, start")
def chain_walk(spark, sf_dir):
    """Every node's way to its chain's terminal, as a recursive query over the node table."""
    C.nodes(spark).select("algo", "idx", "node").distinct().createOrReplaceTempView("clock_nodes")
    return spark.sql("""WITH RECURSIVE w(algo, start, idx, step, path) AS (
        SELECT algo, idx, idx, 0, node FROM clock_nodes UNION ALL
        SELECT w.algo, w.start, n.idx, w.step + 1, concat(w.path, ' > ', n.node) FROM w JOIN clock_nodes n
        ON n.algo = w.algo AND n.idx = w.idx + CASE WHEN w.algo = 1 THEN 1 ELSE -1 END)
        SELECT algo, start, max(step) AS steps, max_by(path, step) AS path FROM w GROUP BY algo, start""")


_BEST = ", q AS (SELECT mod, max(quality) AS quality FROM lut GROUP BY mod)"


@query(EVT + ", " + _LUT + _BEST + """, f AS (SELECT series_id, hh, c, lead(c, 3) OVER w AS c3 FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
g AS (SELECT coalesce(q.quality, 0) AS quality, (c3 / c - 1) * 10000 AS bps FROM f LEFT JOIN q ON q.mod = f.hh * 60 WHERE c3 IS NOT NULL)
SELECT quality, CAST(count(*) AS BIGINT) AS n, round(median(bps), 4) AS med_bps, round(avg(CASE WHEN bps > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_rate FROM g GROUP BY quality""")
def node_forward_returns(spark, sf_dir):
    df = with_halo(bars_evt(spark, sf_dir), 0, 3)
    df = core(df.withColumn("c3", F.lead("c", 3).over(ordered()))).where("c3 IS NOT NULL")
    best = C.both_reads(C.minute_lut(spark)).select("mod", "quality")
    bps = (F.col("c3") / F.col("c") - 1) * 10000
    joined = df.withColumn("mod", F.col("hh") * 60 + F.col("mm")).join(F.broadcast(best), "mod", "left").na.fill(0, ["quality"]).withColumn("bps", bps)
    return joined.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.percentile("bps", 0.5), 4).alias("med_bps"), F.round(F.avg((F.col("bps") > 0).cast("double")), 6).alias("up_rate"))


@query("WITH " + _LUT + """, hist AS (SELECT CAST(hour(ts) * 60 + minute(ts) AS INT) AS bin, count(*) AS cnt FROM events GROUP BY 1), m AS (SELECT DISTINCT mod FROM lut WHERE quality = 3),
sh AS (SELECT j AS shift, (mod + j * 24) % 1440 AS bin FROM m, (SELECT unnest(range(0, 60)) AS j)), rt AS (SELECT shift, sum(cnt) AS hits, sum(cnt) * 1.0 / (SELECT sum(cnt) FROM hist) AS rate FROM sh JOIN hist USING (bin) GROUP BY shift)
SELECT CAST(max(CASE WHEN shift = 0 THEN hits END) AS BIGINT) AS hits, round(max(CASE WHEN shift = 0 THEN rate END), 8) AS rate, round(avg(CASE WHEN shift > 0 THEN rate END), 8) AS null_mean, round(stddev_samp(CASE WHEN shift > 0 THEN rate END), 8) AS null_sd FROM rt""")
def rotation_null(spark, sf_dir):
    """How many events fall on top-quality minutes, against the 59 rotations of the clock by 24 minutes."""
    minutes = table(spark, sf_dir, "events").groupBy((F.hour("ts") * 60 + F.minute("ts")).alias("bin")).agg(F.count("*").alias("cnt"))
    mask = C.both_reads(C.minute_lut(spark)).where("quality = 3").select(F.col("mod").alias("bin"))
    r = shifted_rates(minutes, mask, 1440, 60, 24)
    null = F.when(F.col("shift") > 0, F.col("rate"))
    return r.agg(F.max(F.when(F.col("shift") == 0, F.col("hits"))).alias("hits"), F.round(F.max(F.when(F.col("shift") == 0, F.col("rate"))), 8).alias("rate"), F.round(F.avg(null), 8).alias("null_mean"), F.round(F.stddev_samp(null), 8).alias("null_sd"))


@query(EVT + """, s AS (SELECT *, count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 AND count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3 AS whole, max(h) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, max(h) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
p AS (SELECT hh, count(*) AS bars, count(*) FILTER (whole AND h > a AND h > b) AS swings FROM s GROUP BY hh)
SELECT hh, CAST(swings AS BIGINT) AS swings, round(swings * 1.0 / bars / (sum(swings) OVER () / sum(bars) OVER ()), 6) AS lift, CAST(row_number() OVER (ORDER BY swings * 1.0 / bars DESC, hh) AS INT) AS rank FROM p""")
def hour_profile(spark, sf_dir):
    """Rate of swing highs by hour of day, its lift over the mean, and its rank."""
    s = fractal_swings(bars_evt(spark, sf_dir), 3)
    p = s.groupBy("hh").agg(F.count("*").alias("bars"), F.count_if("swing_hi").alias("swings"))
    every = Window.partitionBy()  # 24 rows
    rate = F.col("swings") / F.col("bars")
    return p.select("hh", "swings", F.round(rate / (F.sum("swings").over(every) / F.sum("bars").over(every)), 6).alias("lift"), F.row_number().over(Window.orderBy(F.desc(rate), "hh")).alias("rank"))
