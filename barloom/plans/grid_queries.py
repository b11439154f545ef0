"""Grids over swing definitions, scales, levels and minutes of the day."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import lattice as L
from barloom.operators import features as X
from barloom.operators.halo import core, frame, with_halo
from barloom.plans.inputs import EVT, bars_evt, table
from barloom.plans.registry import query

_TOD = "CAST(hour(ts) * 100 + minute(ts) AS INT)"
#: Windows of the day as hhmm, the end left out; the last one passes midnight.
WINDOWS = {"open": (930, 1030), "lunch": (1145, 1315), "close": (1500, 1600), "night": (2200, 115)}
_IN_TOD = {name: f"(tod >= {a} {'AND' if a < b else 'OR'} tod < {b})" for name, (a, b) in WINDOWS.items()}


def in_window(tod, start, end):
    """Membership of hhmm in [start, end); a window that ends before it starts passes midnight."""
    return (tod >= start) & (tod < end) if start < end else (tod >= start) | (tod < end)


@query(f"WITH e AS (SELECT event_type, value, {_TOD} AS tod FROM events), x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS win, event_type, value FROM e WHERE {m}" for n, m in _IN_TOD.items())
+ ") SELECT win, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS high_rate FROM x GROUP BY win, event_type HAVING count(*) >= 5")
def time_windows(spark, sf_dir):
    """Events by window of the day in minutes, one row for each window that an event is in; cells of five events at least."""
    e = table(spark, sf_dir, "events").withColumn("tod", F.hour("ts") * 100 + F.minute("ts"))
    of = F.array(*[F.when(in_window(F.col("tod"), a, b), F.lit(n)) for n, (a, b) in WINDOWS.items()])
    x = e.select("event_type", "value", F.explode(F.array_compact(of)).alias("win"))
    return x.groupBy("win", "event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("high_rate")).where("n >= 5")


@query("""WITH m AS (SELECT event_type, CAST(hour(ts) * 60 + minute(ts) AS INT) AS mod, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, mod) AS r FROM m), h AS (SELECT event_type, CAST(floor(mod / 60) AS INT) AS hh, sum(n) AS n FROM m GROUP BY ALL),
s AS (SELECT event_type, hh, n, lag(n) OVER (PARTITION BY event_type ORDER BY hh) AS was, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, hh) AS r FROM h),
g AS (SELECT event_type, mod - lag(mod) OVER (PARTITION BY event_type ORDER BY mod) - 1 AS empty FROM m)
SELECT p.event_type, p.mod AS busiest_minute, CAST(p.n AS BIGINT) AS n, s.hh AS busiest_hour, (SELECT CAST(max(abs(x.n - x.was)) AS BIGINT) FROM s x WHERE x.event_type = p.event_type) AS largest_step,
(SELECT CAST(max(empty) AS INT) FROM g WHERE g.event_type = p.event_type) AS longest_empty FROM p JOIN s ON s.event_type = p.event_type AND s.r = 1 WHERE p.r = 1""")
def clock_forensics(spark, sf_dir):
    """What gives a wrong clock away: the busiest minute and hour, the largest step between hours, the longest run of empty minutes."""
    m = table(spark, sf_dir, "events").groupBy("event_type", (F.hour("ts") * 60 + F.minute("ts")).alias("mod")).agg(F.count("*").alias("n"))
    most = lambda key: F.max_by(key, F.struct("n", -F.col(key)))
    of = Window.partitionBy("event_type")  # 1,440 rows at most
    gaps = m.withColumn("empty", F.col("mod") - F.lag("mod").over(of.orderBy("mod")) - 1)
    a = gaps.groupBy("event_type").agg(most("mod").alias("busiest_minute"), F.max("n").alias("n"), F.max("empty").alias("longest_empty"))
    h = m.groupBy("event_type", F.floor(F.col("mod") / 60).cast("int").alias("hh")).agg(F.sum("n").alias("n"))
    h = h.withColumn("step", F.abs(F.col("n") - F.lag("n").over(of.orderBy("hh"))))
    b = h.groupBy("event_type").agg(most("hh").alias("busiest_hour"), F.max("step").alias("largest_step"))
    return a.join(b, "event_type").select("event_type", "busiest_minute", "n", "busiest_hour", "largest_step", "longest_empty")


#: The scales whose zones are laid over one period, the longest.
NESTED = (27, 81, 243, 729, 2187, 6561)
_ZONE = {z: " OR ".join(f"(p >= {a} AND p < {b})" for a, b in bands) for z, bands in L.ZONES.items()}
_NEST = (
    "WITH bins AS (SELECT unnest(range(0, 52488)) AS bin), pl AS (SELECT bin, s, ((bin + 0.5) / 8 - s * floor((bin + 0.5) / 8 / s)) / s * 100 AS p FROM bins, (SELECT unnest(["
    + ", ".join(map(str, NESTED)) + "]) AS s)), dp AS (" + " UNION ALL ".join(f"SELECT '{z}' AS zone, bin, CAST(count(*) FILTER ({m}) AS INT) AS depth FROM pl GROUP BY bin" for z, m in _ZONE.items()) + ")"
)


def nested_depth(spark):
    """(zone, bin, depth) over the longest period in bins of an eighth of a point: on how many scales a bin is in the zone."""
    mid = (F.col("bin") + 0.5) / 8
    one = [F.struct(F.lit(z).alias("zone"), sum((L.in_zone(L.block_pct(mid, F.lit(float(s))), z).cast("int") for s in NESTED), F.lit(0)).alias("depth")) for z in L.ZONES]
    return spark.range(NESTED[-1] * 8).withColumnRenamed("id", "bin").select("bin", F.explode(F.array(*one)).alias("x")).select("bin", "x.zone", "x.depth")


@query(_NEST + ", e AS (SELECT CAST(floor((value * 100 - 6561 * floor(value * 100 / 6561)) * 8) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1)"
+ " SELECT zone, depth, CAST(count(*) AS BIGINT) AS bins, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM dp LEFT JOIN e USING (bin) GROUP BY zone, depth")
def nested_zone_depth(spark, sf_dir):
    """The map of nested zones over the longest period: bins and events of each depth."""
    x = F.col("value") * 100
    e = table(spark, sf_dir, "events").groupBy(F.floor((x - 6561 * F.floor(x / 6561)) * 8).alias("bin")).agg(F.count("*").alias("n"))
    both = nested_depth(spark).join(e, "bin", "left")
    return both.groupBy("zone", "depth").agg(F.count("*").alias("bins"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


#: Bars on each side of a swing, and block sizes, of the table of major swings.
WIDTHS, SIZES = (1, 2, 3, 4, 6, 8, 10, 12), (81, 243, 729, 2187)


def _swings_sql(k):
    w = f"(w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)", f"(w ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
    whole = " AND ".join(f"count(*) OVER {x} = {k}" for x in w)
    top, low = (f"{a}({f}({c}) OVER {w[0]}, {f}({c}) OVER {w[1]})" for a, f, c in (("greatest", "max", "h"), ("least", "min", "l")))
    x = f"(SELECT h, l, {whole} AS whole, {top} AS mh, {low} AS ml FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos))"
    return f"SELECT {k} AS k, h AS px FROM {x} WHERE whole AND h > mh UNION ALL SELECT {k}, l FROM {x} WHERE whole AND l < ml"


_MAJOR = (
    ", sp AS (" + " UNION ALL ".join(_swings_sql(k) for k in WIDTHS) + "), al AS (SELECT 0 AS k, h AS px FROM bars UNION ALL SELECT 0, l FROM bars UNION ALL SELECT * FROM sp), pl AS (SELECT k, s, (px - s * floor(px / s)) / s * 100 AS p FROM al, (SELECT unnest(["
    + ", ".join(map(str, SIZES)) + "]) AS s)), ct AS (" + " UNION ALL ".join(f"SELECT k, s, '{z}' AS zone, count(*) AS n, count(*) FILTER ({m}) AS hits FROM pl GROUP BY k, s" for z, m in _ZONE.items()) + ")"
)


@query(EVT + _MAJOR + """ SELECT CAST(a.k AS INT) AS width, CAST(a.s AS INT) AS size, a.zone, CAST(a.n AS BIGINT) AS n, round(a.hits / CAST(a.n AS DOUBLE), 6) AS rate, round(b.hits / CAST(b.n AS DOUBLE), 6) AS occupancy,
round(a.hits / CAST(a.n AS DOUBLE) - b.hits / CAST(b.n AS DOUBLE), 6) AS excess FROM ct a JOIN ct b ON b.k = 0 AND b.s = a.s AND b.zone = a.zone WHERE a.k > 0""")
def major_swing_zones(spark, sf_dir):
    """Swings in each zone less the bars' own share there, for eight widths of a swing and four sizes of a block.

    All widths are frames over one sort of the series; widths are elements of an array until the count.
    """
    df = with_halo(bars_evt(spark, sf_dir), max(WIDTHS), max(WIDTHS))
    for k in WIDTHS:
        whole, before, after = X.full(k, -k, -1) & X.full(k, 1, k), frame(-k, -1), frame(1, k)
        hi = whole & (F.col("h") > F.max("h").over(before)) & (F.col("h") > F.max("h").over(after))
        lo = whole & (F.col("l") < F.min("l").over(before)) & (F.col("l") < F.min("l").over(after))
        df = df.withColumns({f"hi{k}": hi, f"lo{k}": lo})
    df = core(df)
    own = [F.struct(F.lit(0).alias("width"), F.col(c).alias("px")) for c in ("h", "l")]
    swings = [F.when(F.col(f"{side}{k}"), F.struct(F.lit(k).alias("width"), F.col(c).alias("px"))) for k in WIDTHS for side, c in (("hi", "h"), ("lo", "l"))]
    px = df.select(F.explode(F.array_compact(F.array(*own, *swings))).alias("x")).select("x.width", "x.px")
    px = px.withColumn("size", F.explode(F.array(*[F.lit(s) for s in SIZES])))
    p = L.block_pct(F.col("px"), F.col("size"))
    g = px.groupBy("width", "size").agg(F.count("*").alias("n"), *[F.count_if(L.in_zone(p, z)).alias(z) for z in L.ZONES])
    g = g.select("width", "size", "n", F.explode(F.map_from_arrays(F.array(*[F.lit(z) for z in L.ZONES]), F.array(*L.ZONES))).alias("zone", "hits"))
    base = g.where("width = 0").select("size", "zone", (F.col("hits") / F.col("n")).alias("occ"))
    both = g.where("width > 0").join(F.broadcast(base), ["size", "zone"])  # a row per size and zone
    rate = F.col("hits") / F.col("n")
    return both.select("width", "size", "zone", "n", F.round(rate, 6).alias("rate"), F.round("occ", 6).alias("occupancy"), F.round(rate - F.col("occ"), 6).alias("excess"))
