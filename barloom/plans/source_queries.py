"""Files written and read back: vendor text, year buckets, JSON cubes; what inspection finds in them; clock and lattice over the data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import clock as C
from barloom.functions import lattice as L
from barloom.operators.bars import daily, ohlcv
from barloom.plans.clock_queries import _HITS, _LUT
from barloom.plans.inputs import EVT, LEVELS, bars_evt, table
from barloom.plans.registry import query
from barloom.sources import readers as R
from barloom.sources.tables import new_path

# --- files -----------------------------------------------------------------------------------------------------------

_MINUTES = """WITH m AS (SELECT event_type AS series, date_trunc('minute', ts) AS ts, arg_min(value, {'t': ts, 'i': event_id}) AS o, max(value) AS h, min(value) AS l, arg_max(value, {'t': ts, 'i': event_id}) AS c,
CAST(count(*) AS BIGINT) AS v FROM events GROUP BY event_type, date_trunc('minute', ts)),
ny AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS x FROM m)"""


def minute_bars(events):
    """Minute OHLCV of events by type, in UTC."""
    return ohlcv(events, [F.col("event_type").alias("series_id"), F.date_trunc("minute", "ts").alias("ts")], "value", F.struct("ts", "event_id"))


def repeated(bars, every: int = 50):
    """Bars with some written twice, the second time with other prices, as feeds do that resend a minute."""
    again = F.when(F.minute("ts") * 24 + F.hour("ts") < every, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = bars.withColumn("_again", F.explode(again))
    return rows.withColumns({x: F.col(x) + F.col("_again") for x in "ohlc"}).sort("series_id", "ts", "_again").drop("_again")


@query(_MINUTES + """ SELECT series, CAST(year(x) * 10000 + month(x) * 100 + day(x) AS BIGINT) * 10 + CASE WHEN hour(x) >= 18 THEN 1 ELSE 0 END AS sess, CAST(count(*) AS BIGINT) AS bars, CAST(min(x) AS VARCHAR) AS first_bar,
round(arg_min(o, ts), 6) AS o, round(max(h), 6) AS h, round(min(l), 6) AS l, round(arg_max(c, ts), 6) AS c, CAST(sum(v) AS BIGINT) AS v FROM ny WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL""")
def vendor_round_trip(spark, sf_dir):
    """Events out as vendor text with repeated minutes, back in without them, to New York time, out as year buckets, back by session.

    Only the folders of the days asked for are read.
    """
    text, buckets = new_path(spark, "vendor"), new_path(spark, "buckets")
    R.write_vendor_tree(repeated(minute_bars(table(spark, sf_dir, "events"))), text)
    got = R.read_vendor_tree(spark, text).where("day >= DATE'2024-01-05' AND day < DATE'2024-01-20'")
    local = got.withColumns({"utc": F.col("ts"), "ts": R.utc_to_new_york(F.col("ts"))})
    R.write_year_buckets(local.withColumns(R.date_parts(F.col("ts"))), buckets, span=2)
    back = spark.read.parquet(buckets).where("year_bucket >= 2022")
    return back.groupBy("series", "sess").agg(
        F.count("*").alias("bars"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_bar"), F.round(F.min_by("o", "utc"), 6).alias("o"), F.round(F.max("h"), 6).alias("h"),
        F.round(F.min("l"), 6).alias("l"), F.round(F.max_by("c", "utc"), 6).alias("c"), F.sum("v").cast("long").alias("v"),
    )


@query(_MINUTES + """, f AS (SELECT count(*) AS n, CAST(min(ts) AS VARCHAR) AS a, CAST(max(ts) AS VARCHAR) AS b FROM m)
SELECT 'parquet' AS kind, CAST(n AS BIGINT) AS n, a AS first, b AS last, 'close:c high:h low:l open:o ts:ts volume:v' AS roles, CAST(NULL AS VARCHAR) AS delimiter FROM f
UNION ALL SELECT 'text', (SELECT CAST(count(*) AS BIGINT) FROM m WHERE series = 'click'), NULL, NULL, 'close:c high:h low:l open:o ts:ts volume:v', ';' FROM f""")
def inspected_files(spark, sf_dir):
    """Bars written as parquet and as vendor text, and what inspection finds: rows, span, the roles of columns, the delimiter."""
    flat, text = new_path(spark, "flat"), new_path(spark, "vendor")
    bars = minute_bars(table(spark, sf_dir, "events"))
    bars.write.parquet(flat)
    R.write_vendor_tree(bars.where("series_id = 'click'"), text)
    found = R.inspect_parquet(spark, flat)
    stamp = lambda x: None if x is None else x.strftime("%Y-%m-%d %H:%M:%S")
    roles = lambda names: " ".join(f"{k}:{v}" for k, v in sorted(R.detect_roles(names).items()))
    rows = [
        ("parquet", found.rows, stamp(found.first), stamp(found.last), roles([c for c, _ in found.columns]), None),
        ("text", R.read_vendor_tree(spark, text).count(), None, None, roles(R.read_vendor_tree(spark, text).columns), R.text_delimiter(spark, text)),
    ]  # a row a file set, as an inspection reports them
    return spark.createDataFrame(rows, "kind string, n long, first string, last string, roles string, delimiter string")


@query("""SELECT 'hours' AS cube, event_type, CAST(hour(ts) AS BIGINT) AS hh, CAST(NULL AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL
UNION ALL SELECT 'days', event_type, NULL, CAST(CAST(ts AS DATE) AS VARCHAR), CAST(count(*) AS BIGINT), NULL FROM events GROUP BY ALL""")
def merged_cubes(spark, sf_dir):
    """Two result cubes written as JSON and read back as one, with nulls where a cube lacks a column."""
    e, a, b = table(spark, sf_dir, "events"), new_path(spark, "cube"), new_path(spark, "cube")
    R.write_cube(e.groupBy("event_type", F.hour("ts").cast("long").alias("hh")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")), a)
    R.write_cube(e.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n")), b)
    return R.merge_cubes(spark, {"hours": a, "days": b}).select("cube", "event_type", "hh", "day", "n", "mean")


# --- the clock over the minutes of the data ---------------------------------------------------------------------------

_SEEN = ", sn AS (SELECT event_type, CAST(hour(ts) * 60 + minute(ts) AS INT) AS mod, count(*) AS n FROM events GROUP BY ALL)"


def seen_minutes(events):
    return events.groupBy("event_type", (F.hour("ts") * 60 + F.minute("ts")).alias("mod")).agg(F.count("*").alias("n"))


@query("WITH " + _LUT + _SEEN + """, br AS (SELECT mod, max(quality) AS quality, count(*) = 2 AS two, count(*) = 2 AND min(label) = max(label) AS shared FROM lut GROUP BY mod)
SELECT event_type, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS minutes, CAST(count(quality) AS BIGINT) AS node_minutes, CAST(coalesce(sum(n) FILTER (quality IS NOT NULL), 0) AS BIGINT) AS at_node,
CAST(coalesce(sum(n) FILTER (quality = 3), 0) AS BIGINT) AS exact, CAST(coalesce(sum(n) FILTER (two), 0) AS BIGINT) AS both_chains, CAST(coalesce(sum(n) FILTER (shared), 0) AS BIGINT) AS shared
FROM sn LEFT JOIN br USING (mod) GROUP BY event_type""")
def events_at_nodes(spark, sf_dir):
    """How many minutes and events of each type read as a clock node: at all, exactly, in both chains, in both as the same node."""
    seen = seen_minutes(table(spark, sf_dir, "events")).join(F.broadcast(C.both_reads(C.minute_lut(spark))), "mod", "left")
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return seen.groupBy("event_type").agg(
        F.sum("n").alias("n"), F.count("*").alias("minutes"), F.count("quality").alias("node_minutes"), some(F.col("quality").isNotNull()).alias("at_node"),
        some(F.col("quality") == 3).alias("exact"), some(F.col("both")).alias("both_chains"), some(F.col("shared")).alias("shared"),
    )


@query("WITH " + _HITS.replace("{tol}", "1") + _SEEN + """, h2 AS (SELECT DISTINCT mod AS at_, algo, idx FROM hit),
s AS (SELECT sn.event_type, sn.mod, sn.n, algo, idx, (at_ - sn.mod + 1440) % 1440 AS st, row_number() OVER (PARTITION BY sn.event_type, sn.mod, algo, idx ORDER BY (at_ - sn.mod + 1440) % 1440) AS rn
  FROM sn, h2 WHERE (at_ - sn.mod + 1440) % 1440 BETWEEN 1 AND 90),
g AS (SELECT event_type, mod, n, algo, idx, count(*) AS times, min(st) AS first FROM s WHERE rn <= 8 GROUP BY ALL)
SELECT event_type, CAST(algo AS INT) AS algo, CAST(idx AS INT) AS idx, CAST(sum(n) AS BIGINT) AS n, round(sum(n * times) / CAST(sum(n) AS DOUBLE), 6) AS times, round(sum(n * first) / CAST(sum(n) AS DOUBLE), 6) AS wait, CAST(min(first) AS INT) AS least_travel FROM g GROUP BY ALL""")
def watch_times_of_events(spark, sf_dir):
    """From each event, the first eight minutes within 90 that hit a node: how many, how far the first, the least of all, by type and node."""
    minute = spark.range(1440).select(F.col("id").cast("int").alias("to"))
    read = minute.select("to", F.inline(C.reads(F.floor(F.col("to") / 60).cast("int"), (F.col("to") % 60).cast("int"))))
    hits = read.join(F.broadcast(C.nodes(spark)), F.abs(F.col("value") - F.col("target")) <= 1).select("to", "algo", "idx").distinct()
    ahead = seen_minutes(table(spark, sf_dir, "events")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(90))))
    met = ahead.withColumn("to", (F.col("mod") + F.col("step")) % 1440).join(F.broadcast(hits), "to")
    g = met.groupBy("event_type", "mod", "n", "algo", "idx").agg(F.slice(F.array_sort(F.collect_list("step")), 1, 8).alias("steps"))  # 90 steps at most
    g = g.select("event_type", "n", "algo", "idx", F.size("steps").alias("times"), F.element_at("steps", 1).alias("first"))
    mean = lambda x: F.round(F.sum(F.col("n") * F.col(x)) / F.sum("n"), 6)
    return g.groupBy("event_type", "algo", "idx").agg(F.sum("n").alias("n"), mean("times").alias("times"), mean("first").alias("wait"), F.min("first").alias("least_travel"))


@query("WITH " + _LUT + _SEEN + """, x AS (SELECT event_type, mod // 60 AS hh, n, idx, lag(idx) OVER (PARTITION BY event_type, mod // 60 ORDER BY mod) AS was FROM sn JOIN lut USING (mod) WHERE algo = 2 AND "primary" AND dist = 0)
SELECT event_type, CAST(count(*) AS BIGINT) AS minutes, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) FILTER (idx = was - 1) AS BIGINT) AS steps_down, CAST(count(*) FILTER (idx > was) AS BIGINT) AS steps_up FROM x GROUP BY event_type""")
def minute_steps_of_events(spark, sf_dir):
    """Steps of the second chain that the clock alone makes within an hour, over the exact minutes at which a type has events."""
    lut = C.minute_lut(spark).where("algo = 2 AND primary AND dist = 0").select("mod", "idx")
    w = Window.partitionBy("event_type", F.floor(F.col("mod") / 60)).orderBy("mod")  # 60 rows
    x = seen_minutes(table(spark, sf_dir, "events")).join(F.broadcast(lut), "mod").withColumn("was", F.lag("idx").over(w))
    return x.groupBy("event_type").agg(F.count("*").alias("minutes"), F.sum("n").alias("n"), F.count_if(F.col("idx") == F.col("was") - 1).alias("steps_down"), F.count_if(F.col("idx") > F.col("was")).alias("steps_up"))


@query("WITH RECURSIVE " + _LUT + _SEEN + """, nn AS (SELECT DISTINCT algo, idx FROM nodes), w AS (SELECT algo, idx AS start, idx, 0 AS step FROM nn UNION ALL SELECT w.algo, w.start, nn.idx, w.step + 1 FROM w JOIN nn ON nn.algo = w.algo AND nn.idx = w.idx + CASE WHEN w.algo = 1 THEN 1 ELSE -1 END),
st AS (SELECT algo, start AS idx, max(step) AS steps FROM w GROUP BY ALL)
SELECT event_type, CAST(algo AS INT) AS algo, CAST(steps AS INT) AS steps_left, CAST(sum(n) AS BIGINT) AS n FROM sn JOIN lut USING (mod) JOIN st USING (algo, idx) GROUP BY ALL""")
def chain_left_of_events(spark, sf_dir):
    """How many steps of its chain an event's node stands from the terminal, by type."""
    n = C.nodes(spark).select("algo", "idx", "terminal").distinct()
    end = F.broadcast(n.where("terminal").select("algo", F.col("idx").alias("end")))
    left = n.join(end, "algo").select("algo", "idx", F.abs(F.col("end") - F.col("idx")).alias("steps_left"))
    lut = C.minute_lut(spark).select("mod", "algo", "idx").join(F.broadcast(left), ["algo", "idx"])
    return seen_minutes(table(spark, sf_dir, "events")).join(F.broadcast(lut), "mod").groupBy("event_type", "algo", "steps_left").agg(F.sum("n").alias("n"))


# --- the lattice over the prices of the data --------------------------------------------------------------------------

TOLERANCES, BLOCK = [0.25, 0.5, 1.0], 243.0


@query(EVT + f""", {LEVELS}, tl AS (SELECT unnest({TOLERANCES}::DOUBLE[]) AS tol),
g AS (SELECT tol, avg(CASE WHEN d <= tol THEN 1.0 ELSE 0.0 END) AS coverage FROM tl, (SELECT i, min(least(abs(i * 100.0 / 100001 - pct), 100 - abs(i * 100.0 / 100001 - pct))) AS d FROM (SELECT unnest(range(0, 100001)) AS i), levels GROUP BY i) GROUP BY tol),
x AS (SELECT series_id, min(least(abs(p - pct), 100 - abs(p - pct))) AS d FROM (SELECT series_id, pos, (c - 243 * floor(c / 243)) / 243 * 100 AS p FROM bars), levels GROUP BY series_id, pos)
SELECT series_id, tol, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN d <= tol THEN 1.0 ELSE 0.0 END), 6) AS share, round(max(coverage), 6) AS coverage FROM x JOIN g ON true GROUP BY series_id, tol""")
def level_share_of_closes(spark, sf_dir):
    """Closes within a tolerance of a level, beside the share of the block that such places cover (on a grid of 100,001 points)."""
    tols = F.explode(F.array(*map(F.lit, TOLERANCES))).alias("tol")

    def hit(pct):
        nearest = F.array_min(F.transform(L.levels(), lambda x: L.circular(pct, x)))
        return F.avg((nearest <= F.col("tol")).cast("double"))

    grid = spark.range(100001).select((F.col("id") * 100.0 / 100001).alias("pct"), tols).groupBy("tol").agg(F.round(hit(F.col("pct")), 6).alias("coverage"))
    x = bars_evt(spark, sf_dir).select("series_id", L.block_pct(F.col("c"), F.lit(BLOCK)).alias("pct"), tols)
    out = x.groupBy("series_id", "tol").agg(F.count("*").alias("n"), F.round(hit(F.col("pct")), 6).alias("share"))
    return out.join(F.broadcast(grid), "tol")  # three rows


@query(EVT + """, gr AS (SELECT DISTINCT r, r IN (81, 243, 729, 2187, 6561) AS is_po3 FROM (SELECT round(exp(ln(50) + (ln(7000) - ln(50)) * i / 47), 2) AS r FROM (SELECT unnest(range(0, 48)) AS i) UNION ALL SELECT CAST(unnest([81,243,729,2187,6561]) AS DOUBLE))),
d AS (SELECT series_id, date, max(h) - min(l) AS rng FROM bars GROUP BY ALL)
SELECT series_id, r, is_po3, CAST(count(*) AS BIGINT) AS days, round(avg(CASE WHEN rng <= r THEN 1.0 ELSE 0.0 END), 6) AS contained FROM d, gr GROUP BY ALL""")
def contained_by_size(spark, sf_dir):
    """How often a day's range fits into a block, over the grid of block sizes; powers of three marked."""
    geo = spark.range(48).select(F.round(F.exp(F.ln(F.lit(50.0)) + (F.ln(F.lit(7000.0)) - F.ln(F.lit(50.0))) * F.col("id") / 47), 2).alias("r"))
    sizes = geo.union(spark.createDataFrame([(float(p),) for p in L.PO3], "r double")).distinct().agg(F.collect_list("r").alias("rs"))  # 53 numbers
    d = daily(bars_evt(spark, sf_dir)).crossJoin(F.broadcast(sizes)).select("series_id", (F.col("h") - F.col("l")).alias("rng"), F.explode("rs").alias("r"))
    out = d.groupBy("series_id", "r").agg(F.count("*").alias("days"), F.round(F.avg((F.col("rng") <= F.col("r")).cast("double")), 6).alias("contained"))
    return out.withColumn("is_po3", F.col("r").isin([float(p) for p in L.PO3]))


_DEPTH = " + ".join(f"CASE WHEN least(px - {s} * floor(px / {s}), {s} - (px - {s} * floor(px / {s}))) <= 2.0 THEN 1 ELSE 0 END" for s in L.ROUND_STEPS)


@query(EVT + f""", {LEVELS}, j AS (SELECT series_id, c, floor(c / 243) AS b, (SELECT max(idx) FROM levels WHERE pct <= (c - 243 * floor(c / 243)) / 243 * 100) AS i FROM bars),
p AS (SELECT j.series_id, c, (b + pct / 100) * 243 AS px FROM j JOIN levels ON idx = i), q AS (SELECT *, CAST({_DEPTH} AS INT) AS depth FROM p)
SELECT series_id, depth, CAST(count(*) AS BIGINT) AS n, round(avg(c - px), 6) AS above FROM q GROUP BY ALL""")
def round_depth_of_closes(spark, sf_dir):
    """The level below each close by its absolute index: on how many round-number grids it lies, and how far above it the close is."""
    c, size, n = F.col("c"), F.lit(BLOCK), len(L.LEVELS)
    j = F.floor(c / size) * n + L.level_floor(L.block_pct(c, size))
    x = bars_evt(spark, sf_dir).select("series_id", "c", L.absolute_level_price(j, size).alias("px"))
    return x.groupBy("series_id", L.round_depth(F.col("px"), 2.0).alias("depth")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("c") - F.col("px")), 6).alias("above"))
