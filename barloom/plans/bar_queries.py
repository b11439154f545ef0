"""Bars, sessions, roll: sources and first aggregations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.plans.inputs import EVT, ORD, bars_evt, bars_ord, table
from barloom.plans.registry import query
from barloom.sources import readers as R


@query(EVT + "SELECT series_id, strftime(ts, '%Y-%m-%d %H') AS hour, o, h, l, c, v, pos FROM bars")
def ohlcv_hourly(spark, sf_dir):
    return bars_evt(spark, sf_dir).select("series_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "o", "h", "l", "c", "v", "pos")


@query(EVT + "SELECT series_id, strftime(ts, '%Y-%m-%d %H') AS hour, o, h, l, c, v FROM bars")
def ohlcv_merge_parts(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("part", F.floor(F.minute("ts") / 10))
    parts = B.ohlcv(ev, [F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("hour_ts"), "part"], "value", F.struct("ts", "event_id"))
    return B.merge_bars(parts, ["series_id", F.date_format("hour_ts", "yyyy-MM-dd HH").alias("hour")], "part")


@query("""SELECT strftime(day, '%Y-%m-%d') AS day, front, round(vol, 4) AS vol FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY vol DESC, front) AS rn
FROM (SELECT l_shipdate AS day, l_returnflag AS front, sum(l_quantity) AS vol FROM lineitem GROUP BY ALL)) WHERE rn = 1""")
def front_month_roll(spark, sf_dir):
    out = B.front_month(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_returnflag", "l_quantity")
    return out.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "front", F.round("vol", 4).alias("vol"))


_FRONT = """f AS (SELECT day, front FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY vol DESC, front) AS rn
FROM (SELECT l_shipdate AS day, l_returnflag AS front, sum(l_quantity) AS vol FROM lineitem GROUP BY ALL)) WHERE rn = 1)"""


@query(f"WITH {_FRONT}, s AS (SELECT *, lag(front) OVER (ORDER BY day) AS was FROM f) SELECT strftime(day, '%Y-%m-%d') AS day, was, front FROM s WHERE was <> front")
def roll_switches(spark, sf_dir):
    front = B.front_month(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_returnflag", "l_quantity")
    return B.roll_switches(front, "l_shipdate").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "was", "front")


@query(f"""WITH {_FRONT} SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, arg_min(l_extendedprice, {{'k': l_orderkey, 'n': l_linenumber}}) AS o, max(l_extendedprice) AS h,
min(l_extendedprice) AS l, arg_max(l_extendedprice, {{'k': l_orderkey, 'n': l_linenumber}}) AS c, CAST(sum(l_quantity) AS BIGINT) AS v
FROM lineitem JOIN f ON l_shipdate = day AND l_returnflag = front GROUP BY l_shipdate""")
def roll_filter_bars(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    front = B.front_month(li, "l_shipdate", "l_returnflag", "l_quantity").select("l_shipdate", F.col("front").alias("l_returnflag"))
    kept = li.join(front, ["l_shipdate", "l_returnflag"])
    return B.ohlcv(kept, [F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")], "l_extendedprice", F.struct("l_orderkey", "l_linenumber"), F.col("l_quantity"))


@query("""SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey, l_linenumber, l_extendedprice AS c FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber) = 1""")
def dedup_ts_first(spark, sf_dir):
    out = R.first_of_equal(table(spark, sf_dir, "lineitem"), ["l_shipdate"], ["l_orderkey", "l_linenumber"])
    return out.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("c"))


_GAPS = """g AS (SELECT *, CAST(sum(CASE WHEN d > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts) AS BIGINT) AS blk
FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS d FROM bars))"""


@query(EVT + f", {_GAPS} SELECT series_id, blk, CAST(count(*) AS BIGINT) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM g GROUP BY series_id, blk")
def gap_blocks(spark, sf_dir):
    out = B.gap_blocks(bars_evt(spark, sf_dir), 7200)
    return out.groupBy("series_id", "blk").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(EVT + "SELECT series_id, date, min(pos) AS first_pos, max(pos) AS last_pos, CAST(count(*) AS BIGINT) AS n FROM bars WHERE hh BETWEEN 9 AND 15 GROUP BY series_id, date HAVING count(*) >= 0.6 * 7")
def session_slices(spark, sf_dir):
    rth = bars_evt(spark, sf_dir).where(F.col("hh").between(9, 15))
    return B.daily(rth).where(F.col("n") >= 0.6 * 7).select("series_id", "date", "first_pos", "last_pos", "n")


@query(EVT + "SELECT series_id, date, arg_min(o, pos) AS day_open, arg_max(c, pos) AS day_close, max(h) AS day_high, min(l) AS day_low, round(max(h) - min(l), 6) AS day_range FROM bars GROUP BY series_id, date")
def day_open_close(spark, sf_dir):
    d = B.daily(bars_evt(spark, sf_dir))
    return d.select("series_id", "date", F.col("o").alias("day_open"), F.col("c").alias("day_close"), F.col("h").alias("day_high"), F.col("l").alias("day_low"), F.round(F.col("h") - F.col("l"), 6).alias("day_range"))


@query(EVT + """SELECT series_id, date, CAST(floor(hh / 4) AS BIGINT) AS bucket, arg_min(o, pos) AS o, max(h) AS h, min(l) AS l, arg_max(c, pos) AS c,
CAST(sum(v) AS BIGINT) AS v, max(pos) AS last_pos FROM bars GROUP BY ALL""")
def htf_candles(spark, sf_dir):
    bars = bars_evt(spark, sf_dir).withColumn("bucket", F.floor(F.col("hh") / 4))
    return bars.groupBy("series_id", "date", "bucket").agg(F.min_by("o", "pos").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "pos").alias("c"), F.sum("v").alias("v"), F.max("pos").alias("last_pos"))


@query(EVT + "SELECT series_id, CAST(floor(pos / 15) AS BIGINT) AS bucket, arg_min(o, pos) AS o, max(h) AS h, min(l) AS l, arg_max(c, pos) AS c, CAST(sum(v) AS BIGINT) AS v FROM bars GROUP BY ALL")
def htf_by_count(spark, sf_dir):
    bars = bars_evt(spark, sf_dir).withColumn("bucket", F.floor(F.col("pos") / 15))
    return B.merge_bars(bars, ["series_id", "bucket"], "pos")


@query(EVT + """, r AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY series_id, date ORDER BY pos) - 1) / 5) AS BIGINT) AS run FROM bars)
SELECT series_id, date, run, round(max(h) - min(l), 6) AS "range" FROM r GROUP BY series_id, date, run HAVING count(*) = 5""")
def nbar_ranges(spark, sf_dir):
    return B.nbar_ranges(bars_evt(spark, sf_dir), 5, ["series_id", "date"]).withColumn("range", F.round("range", 6))


@query(EVT + """, d AS (SELECT series_id, date, max(h) AS hi, min(l) AS lo FROM bars GROUP BY series_id, date),
p AS (SELECT series_id, date, lag(hi) OVER w AS pdh, lag(lo) OVER w AS pdl FROM d WINDOW w AS (PARTITION BY series_id ORDER BY date))
SELECT b.series_id, b.pos, p.pdh, p.pdl, b.h > p.pdh AS took_high, b.l < p.pdl AS took_low FROM bars b JOIN p USING (series_id, date) WHERE p.pdh IS NOT NULL""")
def prior_day_levels(spark, sf_dir):
    bars = bars_evt(spark, sf_dir)
    w = Window.partitionBy("series_id").orderBy("date")
    prior = B.daily(bars).select("series_id", "date", F.lag("h").over(w).alias("pdh"), F.lag("l").over(w).alias("pdl")).where("pdh IS NOT NULL")
    return bars.join(prior, ["series_id", "date"]).select("series_id", "pos", "pdh", "pdl", (F.col("h") > F.col("pdh")).alias("took_high"), (F.col("l") < F.col("pdl")).alias("took_low"))


@query(ORD + """, r AS (SELECT year(ts) AS yr, h - l AS rng FROM bars) SELECT CAST(yr AS INT) AS yr, CAST(count(*) AS BIGINT) AS n, round(median(rng), 4) AS med, round(quantile_cont(rng, 0.9), 4) AS p90,
round(avg(CASE WHEN rng <= 400000 THEN 1.0 ELSE 0.0 END), 6) AS contained FROM r GROUP BY yr""")
def range_quantiles_by_year(spark, sf_dir):
    r = bars_ord(spark, sf_dir).withColumn("rng", F.col("h") - F.col("l"))
    return r.groupBy("yr").agg(F.count("*").alias("n"), F.round(F.percentile("rng", 0.5), 4).alias("med"), F.round(F.percentile("rng", 0.9), 4).alias("p90"), F.round(F.avg(F.when(F.col("rng") <= 400000, 1.0).otherwise(0.0)), 6).alias("contained"))


@query("""SELECT CAST(m.minute AS INT) AS minute, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(0, 1440)) AS minute) m
LEFT JOIN (SELECT hour(ts) * 60 + minute(ts) AS minute, count(*) AS n FROM events GROUP BY 1) e ON m.minute = e.minute""")
def minute_calendar(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy((F.hour("ts") * 60 + F.minute("ts")).alias("minute")).agg(F.count("*").alias("n"))
    return spark.range(1440).select(F.col("id").cast("int").alias("minute")).join(seen, "minute", "left").na.fill(0, ["n"])


@query("""SELECT date_part('hour', x) AS hh, date_part('minute', x) AS mm, CAST(count(*) AS BIGINT) AS n FROM
(SELECT ((date_trunc('minute', ts) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Zurich') AS x FROM events) GROUP BY ALL""")
def zurich_minutes(spark, sf_dir):
    x = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Zurich")
    return table(spark, sf_dir, "events").groupBy(F.hour(x).cast("long").alias("hh"), F.minute(x).cast("long").alias("mm")).agg(F.count("*").alias("n"))


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def date_slice(spark, sf_dir):
    return R.slice_dates(table(spark, sf_dir, "events"), "ts", "2024-01-10", "2024-01-12").select("event_id", "value")
