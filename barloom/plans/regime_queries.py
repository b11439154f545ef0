"""Where in the block a session closed and what the night brought; clocks that were moved, levels that changed."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators.circular import arc_sums, best_shifts, prefix_sums
from barloom.operators.stats import lcg as draw
from barloom.plans.inputs import EVT, bars_evt, table
from barloom.plans.registry import query
from barloom.plans.search_queries import halves
from barloom.plans.sql_parts import lcg
from barloom.plans.study_queries import _DAYS, rth_days
from barloom.sources.tables import save

# --- the night after a close -----------------------------------------------------------------------------------------

#: Bands of the block in percent, and block sizes.
BANDS, SIZES = [(0, 10), (10, 25), (25, 40), (40, 60), (60, 75), (75, 90), (90, 100)], [243.0, 729.0, 2187.0]
COST, BINS, SHIFTED, OFFSETS, FEW = 0.45, 400, 10, 400, 3


def nights(bars):
    """One row per size and night: where the close before stood (bin of BINS), what the night brought, which half of time."""
    d = rth_days(bars).where("pc IS NOT NULL").withColumn("pnl", F.col("fc") - F.col("pc") - COST)
    ts = F.unix_timestamp(F.col("date").cast("string"), "yyyyMMdd")
    d = d.crossJoin(F.broadcast(halves(bars))).withColumn("val", ts >= F.col("split")).withColumn("r", F.explode(F.array(*map(F.lit, SIZES))))
    place = F.floor((F.col("pc") - F.col("r") * F.floor(F.col("pc") / F.col("r"))) / F.col("r") * BINS)
    return d.select("series_id", "date", "r", "val", "pnl", place.cast("int").alias("bin"))


def histogram(n):
    each = {"s": F.col("pnl"), "n": F.lit(1.0), "s0": F.when(~F.col("val"), F.col("pnl")).otherwise(0.0), "n0": F.when(~F.col("val"), 1.0).otherwise(0.0)}
    return n.groupBy("r", "bin").agg(*[F.sum(x).alias(c) for c, x in each.items()]), list(each)


def bands(df, offset):
    """df once per band, as an arc moved by a column of bins."""
    arcs = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("band"), F.lit(a * BINS // 100).alias("a"), F.lit(b * BINS // 100).alias("b")) for a, b in BANDS])
    return df.withColumn("x", F.explode(arcs)).select(*df.columns, "x.band", (F.col("x.a") + offset).alias("lo"), (F.col("x.b") + offset).alias("hi"))


_NIGHTS = _DAYS + f""", half AS (SELECT min(epoch(ts)) + (max(epoch(ts)) - min(epoch(ts))) * 0.5 AS split FROM bars),
ng AS (SELECT series_id, date, r, epoch(strptime(CAST(date AS VARCHAR), '%Y%m%d')) >= split AS val, fc - pc - {COST} AS pnl, CAST(floor((pc - r * floor(pc / r)) / r * {BINS}) AS BIGINT) AS bin
  FROM p, half, (SELECT unnest({SIZES}::DOUBLE[]) AS r) WHERE pc IS NOT NULL),
bd AS (SELECT b[1] || '-' || b[2] AS band, b[1] * {BINS // 100} AS a, b[2] * {BINS // 100} AS z FROM (SELECT unnest({[list(b) for b in BANDS]}) AS b)),
al AS (SELECT avg(pnl) AS base, avg(pnl) FILTER (NOT val) AS base0, avg(pnl) FILTER (val) AS base1 FROM ng WHERE r = {SIZES[0]})"""


@query(EVT + _NIGHTS + f""",
sh AS (SELECT r, band, j, avg(pnl) AS m FROM ng, bd, (SELECT unnest(range({SHIFTED})) AS j) WHERE (bin - j * {BINS // SHIFTED} + {BINS}) % {BINS} >= a AND (bin - j * {BINS // SHIFTED} + {BINS}) % {BINS} < z GROUP BY ALL HAVING count(*) >= {FEW}),
tr AS (SELECT r, band, count(*) AS n, avg(pnl) AS net, avg(pnl) FILTER (NOT val) AS disc, avg(pnl) FILTER (val) AS vali FROM ng, bd WHERE bin >= a AND bin < z GROUP BY ALL HAVING count(*) >= {FEW}),
nl AS (SELECT r, band, avg(m) AS shifted FROM sh WHERE j > 0 GROUP BY ALL)
SELECT r, band, CAST(n AS BIGINT) AS n, round(net, 5) AS net, round(shifted, 5) AS shifted, round(net - base, 5) AS over_all, round(disc, 5) AS disc, round(vali, 5) AS val,
round(disc - base0, 5) AS disc_rel, round(vali - base1, 5) AS val_rel, coalesce(row_number() OVER (PARTITION BY r ORDER BY round(disc, 9) DESC NULLS LAST, band) = 1, false) AS picked FROM tr LEFT JOIN nl USING (r, band), al""")
def overnight_bands(spark, sf_dir):
    """Nights by band of the block where the session closed, beside nine shifts of the lattice; picked: the best band of the first half, to be judged in the second."""
    n = save(nights(bars_evt(spark, sf_dir)), "nights")
    h, columns = histogram(n)
    arcs = bands(n.select("r").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(SHIFTED - 1)))), F.col("j") * (BINS // SHIFTED))
    got = save(arc_sums(arcs, save(prefix_sums(h, ["r"], BINS, columns), "prefix"), ["r"], columns).where(F.col("n") >= FEW), "arcs")
    val = F.col("val")
    base = n.where(F.col("r") == SIZES[0]).agg(F.avg("pnl").alias("base"), F.avg(F.when(~val, F.col("pnl"))).alias("base0"), F.avg(F.when(val, F.col("pnl"))).alias("base1"))
    null = got.where("j > 0").groupBy("r", "band").agg(F.avg(F.col("s") / F.col("n")).alias("shifted"))
    none = F.lit(0.0)
    true = got.where("j = 0").select(
        "r", "band", F.col("n").cast("long").alias("n"), (F.col("s") / F.col("n")).alias("net"), (F.col("s0") / F.nullif("n0", none)).alias("disc"),
        ((F.col("s") - F.col("s0")) / F.nullif(F.col("n") - F.col("n0"), none)).alias("vali"),
    )
    best = Window.partitionBy("r").orderBy(F.desc_nulls_last(F.round("disc", 9)), "band")  # seven rows
    out = true.join(null, ["r", "band"], "left").crossJoin(F.broadcast(base)).withColumn("picked", F.row_number().over(best) == 1)
    r5 = lambda x: F.round(x, 5)
    return out.select(
        "r", "band", "n", r5("net").alias("net"), r5("shifted").alias("shifted"), r5(F.col("net") - F.col("base")).alias("over_all"), r5("disc").alias("disc"), r5("vali").alias("val"),
        r5(F.col("disc") - F.col("base0")).alias("disc_rel"), r5(F.col("vali") - F.col("base1")).alias("val_rel"), "picked",
    )


@query(EVT + _NIGHTS + f""",
of AS (SELECT rep, r, CASE WHEN rep = 0 THEN 0 ELSE {lcg("rep * 48271 + CAST(r AS BIGINT) * 7919 + 3")} % {BINS} END AS o FROM (SELECT unnest(range({OFFSETS + 1})) AS rep), (SELECT unnest({SIZES}::DOUBLE[]) AS r)),
ce AS (SELECT rep, r, band, avg(pnl) - max(base) AS m FROM ng JOIN of USING (r), bd, al WHERE (bin - o + {BINS}) % {BINS} >= a AND (bin - o + {BINS}) % {BINS} < z GROUP BY ALL HAVING count(*) >= {FEW}),
mx AS (SELECT rep, round(max(m), 9) AS best FROM ce GROUP BY rep),
t AS (SELECT r, band, round(m, 9) AS m FROM ce WHERE rep = 0 ORDER BY round(m, 9) DESC, r, band LIMIT 1)
SELECT t.r, t.band, round(m, 5) AS best, CAST((SELECT count(*) FROM ce WHERE rep = 0) AS BIGINT) AS cells, round(quantile_cont(best, 0.5), 5) AS null_median, round(quantile_cont(best, 0.95), 5) AS null_p95,
round(max(best), 5) AS null_max, round(avg(CASE WHEN best >= m THEN 1.0 ELSE 0.0 END), 6) AS p FROM mx, t WHERE rep > 0 GROUP BY t.r, t.band, m""")
def overnight_maximum(spark, sf_dir):
    """The best of 21 cells (size and band), against the best of the same search on 400 lattices of random offsets."""
    n = save(nights(bars_evt(spark, sf_dir)), "nights")
    h, columns = histogram(n)
    reps = n.select("r").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS))))
    own = draw(F.col("rep").cast("long") * 48271 + F.col("r").cast("long") * 7919 + 3) % BINS
    arcs = bands(reps.withColumn("o", F.when(F.col("rep") == 0, 0).otherwise(own).cast("int")), F.col("o"))
    got = arc_sums(arcs, save(prefix_sums(h, ["r"], BINS, columns), "prefix"), ["r"], columns).where(F.col("n") >= FEW)
    base = n.where(F.col("r") == SIZES[0]).agg(F.avg("pnl").alias("base"))
    cells = save(got.crossJoin(F.broadcast(base)).select("rep", "r", "band", F.round(F.col("s") / F.col("n") - F.col("base"), 9).alias("m")), "cells")
    true = cells.where("rep = 0").orderBy(F.desc("m"), "r", "band").limit(1).select("r", "band", "m")
    count = cells.where("rep = 0").agg(F.count("*").alias("cells"))
    best = cells.where("rep > 0").groupBy("rep").agg(F.max("m").alias("best"))
    both = best.crossJoin(F.broadcast(true.crossJoin(count)))  # one row
    return both.groupBy("r", "band", F.round("m", 5).alias("best_cell"), "m", "cells").agg(
        F.round(F.percentile("best", 0.5), 5).alias("null_median"), F.round(F.percentile("best", 0.95), 5).alias("null_p95"), F.round(F.max("best"), 5).alias("null_max"),
        F.round(F.avg((F.col("best") >= F.col("m")).cast("double")), 6).alias("p"),
    ).withColumnRenamed("best_cell", "best").drop("m")


# --- clocks and levels that moved ------------------------------------------------------------------------------------

MINUTES, PERIOD_DAYS = 1440, 7
_SHIFT = f"""WITH s0 AS (SELECT min(epoch(date_trunc('day', ts))) AS t0 FROM events),
pf AS (SELECT event_type, CAST(floor((epoch(ts) - t0) / {86400 * PERIOD_DAYS}) AS INT) AS period, CAST(hour(ts) * 60 + minute(ts) AS INT) AS bin, count(*) AS n FROM events, s0 GROUP BY ALL),
wh AS (SELECT event_type, bin, sum(n) AS n FROM pf GROUP BY ALL),
pr AS (SELECT DISTINCT event_type, period FROM pf),
ot AS (SELECT pr.event_type, pr.period, wh.bin, wh.n - coalesce(pf.n, 0) AS n FROM pr JOIN wh USING (event_type) LEFT JOIN pf ON pf.event_type = pr.event_type AND pf.period = pr.period AND pf.bin = wh.bin),
co AS (SELECT a.event_type, a.period, (a.bin - b.bin + {MINUTES}) % {MINUTES} AS s, sum(a.n * b.n) AS c FROM pf a JOIN ot b USING (event_type, period) GROUP BY ALL),
nm AS (SELECT event_type, period, sum(n) AS n, sum(n * n) AS a2 FROM pf GROUP BY ALL), no AS (SELECT event_type, period, sum(n * n) AS b2 FROM ot GROUP BY ALL),
fu AS (SELECT event_type, period, s, coalesce(c, 0) AS c FROM (SELECT event_type, period, unnest(range({MINUTES})) AS s FROM pr) LEFT JOIN co USING (event_type, period, s)),
be AS (SELECT event_type, period, s AS best, c AS top FROM fu QUALIFY row_number() OVER (PARTITION BY event_type, period ORDER BY c DESC, least(s, {MINUTES} - s), s > {MINUTES // 2}) = 1),
ne AS (SELECT event_type, period, max(c) FILTER (least((s - best + {MINUTES}) % {MINUTES}, (best - s + {MINUTES}) % {MINUTES}) > 1) AS second, max(c) FILTER (s = 0) AS zero FROM fu JOIN be USING (event_type, period) GROUP BY ALL)
SELECT event_type, period, CAST(n AS BIGINT) AS n, CAST(CASE WHEN best > {MINUTES // 2} THEN best - {MINUTES} ELSE best END AS INT) AS shift, round(top / nullif(sqrt(CAST(a2 * b2 AS DOUBLE)), 0), 6) AS fit,
round(zero / nullif(sqrt(CAST(a2 * b2 AS DOUBLE)), 0), 6) AS at_zero, round((top - second) / nullif(sqrt(CAST(a2 * b2 AS DOUBLE)), 0), 6) AS margin FROM be JOIN ne USING (event_type, period) JOIN nm USING (event_type, period) JOIN no USING (event_type, period)"""


def day_profiles(events, key: str = "event_type", days: int = PERIOD_DAYS):
    """(key, period, bin, n): events by minute of the day in runs of so many days from the first."""
    first = events.agg(F.min(F.unix_timestamp(F.date_trunc("day", "ts"))).alias("t0"))
    period = F.floor((F.unix_timestamp("ts") - F.col("t0")) / (86400 * days)).cast("int")
    rows = events.crossJoin(F.broadcast(first))  # one row
    return rows.groupBy(key, period.alias("period"), (F.hour("ts") * 60 + F.minute("ts")).alias("bin")).agg(F.count("*").alias("n"))


@query(_SHIFT)
def clock_shift(spark, sf_dir):
    """By how many minutes each week's day stands later than that of all other weeks, by type: correlation at all 1,440 shifts."""
    p = save(day_profiles(table(spark, sf_dir, "events").select("event_type", "ts")), "profiles")
    out = best_shifts(p, ["event_type"], "period", MINUTES)
    return out.select("event_type", "period", "n", "shift", *[F.round(c, 6).alias(c) for c in ("fit", "at_zero", "margin")])


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS s, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT *, sum(s) OVER w AS s1, sum(n) OVER w AS n1, sum(s) OVER (PARTITION BY event_type) AS st, sum(n) OVER (PARTITION BY event_type) AS nt FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT event_type, day, n1, s1 / n1 AS before, (st - s1) / (nt - n1) AS after, round(abs(s1 / n1 - (st - s1) / (nt - n1)) * sqrt(CAST(n1 AS DOUBLE) * (nt - n1) / nt), 9) AS score FROM c WHERE n1 > 0)
SELECT event_type, CAST(day AS VARCHAR) AS first_day, CAST(n1 AS BIGINT) AS n_before, round(before, 5) AS before, round(after, 5) AS after, round(score, 5) AS score FROM g
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, day) = 1""")
def level_change_point(spark, sf_dir):
    """Per type the day at which the mean value before and after differ most, for the numbers of events on both sides."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    of = Window.partitionBy("event_type")  # a row a day
    w = of.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    c = d.withColumns({"s1": F.sum("s").over(w), "n1": F.sum("n").over(w), "st": F.sum("s").over(of), "nt": F.sum("n").over(of)}).where("n1 > 0")
    before, after = F.col("s1") / F.col("n1"), (F.col("st") - F.col("s1")) / (F.col("nt") - F.col("n1"))
    size = F.sqrt(F.col("n1").cast("double") * (F.col("nt") - F.col("n1")) / F.col("nt"))
    g = c.withColumns({"before": before, "after": after, "score": F.round(F.abs(before - after) * size, 9)})
    g = g.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "day"))).where("rank = 1")
    return g.select("event_type", F.col("day").cast("string").alias("first_day"), F.col("n1").alias("n_before"), *[F.round(x, 5).alias(x) for x in ("before", "after", "score")])
