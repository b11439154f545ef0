"""Studies with resampled nulls and intervals: levels against permuted labels, cells of conditions and eras by whole days."""

from pyspark.sql import functions as F

from barloom.operators.resampling import POISSON, cluster_intervals, permuted_sums
from barloom.operators.search import bitmap, name_of
from barloom.plans.event_queries import _TOUCHES, touch_outcomes
from barloom.plans.inputs import EVT, bars_evt
from barloom.plans.registry import query
from barloom.plans.search_queries import _CONDITIONS, _PLAYED, _RETESTED, conditions, entry_features, level_retests, plays
from barloom.plans.sql_parts import lcg
from barloom.sources.tables import save

PERMUTATIONS, REPLICATES, CELL_REPLICATES, LEAST = 2000, 2000, 400, 20
#: Lines that any evenly spaced grid has.
STRUCTURAL = [0.0, 50.0]
_POISSON = " + ".join(f"CAST(u >= {x!r} AS INT)" for x in POISSON)


def _weights(replicates: int, days: str) -> str:
    return f"""(SELECT rep, date, {_POISSON} AS w FROM (SELECT rep, date, {lcg("rep * 1000003 + date % 100000 * 7919 + 12345")} / 2147483647.0 AS u
  FROM (SELECT DISTINCT date FROM {days}), (SELECT unnest(range(0, {replicates})) AS rep)))"""


_TOUCHED = ", " + _TOUCHES.replace("{phases}", "[0.0]") + """,
y AS (SELECT r.series_id, r.pos, r.pct, date, CAST(reject AS INT) AS y, row_number() OVER (PARTITION BY date ORDER BY r.series_id, r.pct, r.pos) AS r FROM r JOIN bars USING (series_id, pos))"""
_PERMUTED = f""",
p AS (SELECT rep, date, pct, row_number() OVER (PARTITION BY rep, date ORDER BY {lcg("rep * 7368787 + date % 100000 * 104729 + r * 15485863 + 1")}, r) AS r
  FROM y, (SELECT unnest(range(0, {PERMUTATIONS})) AS rep)),
m AS (SELECT rep, p.pct, avg(y.y) AS m FROM p JOIN y USING (date, r) GROUP BY ALL UNION ALL SELECT -1, pct, avg(y) FROM y GROUP BY pct),
sc AS (SELECT 'all' AS scope, * FROM m UNION ALL SELECT 'unstructural', * FROM m WHERE pct NOT IN (0, 50)),
sp AS (SELECT scope, rep, max(m) - min(m) AS spread, stddev_samp(m) AS sd FROM sc GROUP BY ALL),
tr AS (SELECT scope, spread AS t, sd AS tsd FROM sp WHERE rep < 0)
SELECT scope, round(t, 6) AS spread, round(avg(spread), 6) AS null_spread, round((t - avg(spread)) / stddev_samp(spread), 4) AS z, CAST(count(*) FILTER (spread >= t) AS BIGINT) AS as_high,
round(tsd, 6) AS sd, round(avg(sd), 6) AS null_sd, round((tsd - avg(sd)) / stddev_samp(sd), 4) AS z_sd FROM sp JOIN tr USING (scope) WHERE rep >= 0 GROUP BY scope, t, tsd"""


@query(EVT + _TOUCHED + _PERMUTED)
def level_permutation(spark, sf_dir):
    """Do the levels differ? Spread and deviation of their rejection rates against level labels permuted within each day, 2,000 times.

    All levels, and those without the lines that any grid has.
    """
    bars = bars_evt(spark, sf_dir)
    t = touch_outcomes(bars).select("date", "series_id", "pos", "pct", F.col("reject").cast("double").alias("y"))
    t = save(t, "touches")
    m = permuted_sums(t, "date", ["series_id", "pct", "pos"], "pct", "y", PERMUTATIONS).select("rep", "pct", (F.col("s") / F.col("n")).alias("m"))
    m = m.unionByName(t.groupBy("pct").agg(F.avg("y").alias("m")).withColumn("rep", F.lit(-1)))
    scopes = F.array(F.lit("all"), F.when(~F.col("pct").isin(*STRUCTURAL), "unstructural"))
    m = m.withColumn("scope", F.explode(F.filter(scopes, lambda x: x.isNotNull())))
    sp = save(m.groupBy("scope", "rep").agg((F.max("m") - F.min("m")).alias("spread"), F.stddev_samp("m").alias("sd")), "spreads")
    true = sp.where("rep < 0").select("scope", F.col("spread").alias("t"), F.col("sd").alias("tsd"))
    z = lambda x, c: F.round((F.col(x) - F.avg(c)) / F.stddev_samp(c), 4)
    return sp.where("rep >= 0").join(F.broadcast(true), "scope").groupBy("scope", "t", "tsd").agg(  # two rows
        F.round(F.avg("spread"), 6).alias("null_spread"), z("t", "spread").alias("z"), F.count_if(F.col("spread") >= F.col("t")).alias("as_high"),
        F.round(F.avg("sd"), 6).alias("null_sd"), z("tsd", "sd").alias("z_sd"),
    ).select("scope", F.round("t", 6).alias("spread"), "null_spread", "z", "as_high", F.round("tsd", 6).alias("sd"), "null_sd", "z_sd")


@query(EVT + _TOUCHED + f""",
d AS (SELECT 'level ' || CAST(CAST(pct AS INT) AS VARCHAR) AS what, date, sum(y) AS s, count(*) AS n, 0 AS s2, 0 AS n2 FROM y GROUP BY ALL
  UNION ALL SELECT CASE WHEN pct IN (0, 50) THEN 'structural' ELSE 'rest' END, date, sum(y), count(*), 0, 0 FROM y GROUP BY ALL
  UNION ALL SELECT 'difference', date, sum(y) FILTER (pct IN (0, 50)), count(*) FILTER (pct IN (0, 50)), sum(y) FILTER (pct NOT IN (0, 50)), count(*) FILTER (pct NOT IN (0, 50)) FROM y GROUP BY date),
b AS (SELECT what, rep, sum(w * s) / nullif(sum(w * n), 0) - CASE WHEN what = 'difference' THEN sum(w * s2) / nullif(sum(w * n2), 0) ELSE 0 END AS m
  FROM d JOIN {_weights(REPLICATES, "y")} USING (date) GROUP BY what, rep),
q AS (SELECT what, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS above FROM b WHERE m IS NOT NULL GROUP BY what)
SELECT what, CAST(count(*) AS BIGINT) AS days, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / nullif(sum(n), 0) - CASE WHEN what = 'difference' THEN sum(s2) / nullif(sum(n2), 0) ELSE 0 END, 6) AS rate,
round(lo, 6) AS lo, round(hi, 6) AS hi, round(above, 6) AS above FROM d JOIN q USING (what) GROUP BY what, lo, hi, above""")
def level_intervals(spark, sf_dir):
    """Rejection rate of each level, of the lines that any grid has, of the rest, and their difference, with intervals by whole days."""
    t = touch_outcomes(bars_evt(spark, sf_dir)).select("date", "pct", F.col("reject").cast("double").alias("y"))
    per = save(t.groupBy("date", "pct").agg(F.sum("y").alias("s"), F.count("*").cast("double").alias("n")), "per_day")
    grid = F.col("pct").isin(*STRUCTURAL)
    what = F.array(F.concat(F.lit("level "), F.col("pct").cast("int").cast("string")), F.when(grid, "structural").otherwise("rest"))
    one = per.withColumn("what", F.explode(what)).groupBy("what", "date").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    two = per.withColumn("what", F.lit("difference")).groupBy("what", "date").agg(
        *[F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0)).alias(c + end) for cond, end in ((grid, ""), (~grid, "2")) for c in ("s", "n")],
    )
    out = cluster_intervals(one, ["what"], "date", REPLICATES).unionByName(cluster_intervals(two, ["what"], "date", REPLICATES, against=True))
    return out.select("what", F.col("clusters").alias("days"), "n", *[F.round(c, 6).alias(a) for c, a in (("mean", "rate"), ("lo", "lo"), ("hi", "hi"), ("above", "above"))])


_PLAIN = [(i, n, c) for i, (n, c) in enumerate(_CONDITIONS) if not n.startswith("level=")]


@query(EVT + _RETESTED + _PLAYED + f""",
cu AS (SELECT id, unnest(list_filter(['all', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for _, n, c in _PLAIN)}], lambda x: x IS NOT NULL)) AS cut FROM an),
er AS (SELECT series_id, pos, date, least(CAST(floor((epoch(ts) - a) * 3 / (b - a)) AS INT), 2) + 1 AS era FROM bars, (SELECT min(epoch(ts)) AS a, max(epoch(ts)) AS b FROM bars)),
d AS (SELECT cut, play, unnest(['all', 'era ' || CAST(er.era AS VARCHAR)]) AS era, er.date, CASE WHEN win THEN gain ELSE -loss END AS pnl FROM cu JOIN tr USING (id) JOIN an USING (id) JOIN er USING (series_id, pos)),
dd AS (SELECT cut, play, era, date, sum(pnl) AS s, count(*) AS n FROM d GROUP BY ALL),
k AS (SELECT cut, play, era, count(*) AS days, sum(n) AS n, sum(s) / sum(n) AS m FROM dd GROUP BY ALL HAVING sum(n) >= {LEAST}),
b AS (SELECT cut, play, era, rep, sum(w * s) / nullif(sum(w * n), 0) AS m FROM dd JOIN (SELECT cut, play, era FROM k) USING (cut, play, era) JOIN {_weights(CELL_REPLICATES, "bars")} USING (date) GROUP BY ALL),
q AS (SELECT cut, play, era, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS above FROM b WHERE m IS NOT NULL GROUP BY ALL)
SELECT cut, play, era, CAST(days AS BIGINT) AS days, CAST(n AS BIGINT) AS n, round(m, 6) AS mean_r, round(lo, 6) AS lo, round(hi, 6) AS hi, round(above, 6) AS above FROM k JOIN q USING (cut, play, era)""")
def edge_intervals(spark, sf_dir):
    """Every play by every single condition, over all time and by thirds of it: mean result with an interval by whole days."""
    bars = bars_evt(spark, sf_dir)
    span = bars.agg(F.min(F.unix_timestamp("ts")).alias("a"), F.max(F.unix_timestamp("ts")).alias("b"))
    e = level_retests(bars).join(entry_features(bars), ["series_id", "pos"]).crossJoin(F.broadcast(span))  # one row
    third = F.least(F.floor((F.unix_timestamp("ts") - F.col("a")) * 3 / (F.col("b") - F.col("a"))).cast("int"), F.lit(2)) + 1
    asked = {n: c for n, c in conditions().items() if not n.startswith("level=")}
    risk, hits, every = plays()
    e = e.withColumns({"bits": bitmap(asked), "third": third, "risk": risk}).withColumns(hits)
    t = e.select("bits", "third", "date", F.explode(every).alias("t")).select("bits", "third", "date", "t.*").where("live")
    per = save(t.groupBy("bits", "third", "date", "play").agg(F.sum("pnl").alias("s"), F.count("*").cast("double").alias("n")), "by_bitmap")
    masks = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << i for i in range(len(asked))))])
    own = F.filter(masks, lambda m: F.col("bits").bitwiseAND(m) == m)
    eras = F.array(F.lit("all"), F.concat(F.lit("era "), F.col("third").cast("string")))
    cells = per.withColumn("mask", F.explode(own)).withColumn("era", F.explode(eras)).groupBy("mask", "play", "era", "date").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = cluster_intervals(cells, ["mask", "play", "era"], "date", CELL_REPLICATES).where(F.col("n") >= LEAST)
    figures = [F.round(c, 6).alias(a) for c, a in (("mean", "mean_r"), ("lo", "lo"), ("hi", "hi"), ("above", "above"))]
    return out.select(name_of(F.col("mask"), list(asked)).alias("cut"), "play", "era", F.col("clusters").alias("days"), "n", *figures)
