"""Null models, controls and grids: the same statistic on shifted, shuffled, drawn or injected data.

A replicate, a phase, a size or a level set is a column, so one plan makes all of them.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import lattice as L
from barloom.operators import events as V
from barloom.operators import features as X
from barloom.operators import outcomes as O
from barloom.operators import stats as S
from barloom.operators.bars import daily, ranked
from barloom.operators.halo import core, ordered, with_halo
from barloom.plans.event_queries import _CROSS, SIZE
from barloom.plans.inputs import EVT, LEVELS, bars_evt
from barloom.plans.registry import query
from barloom.plans.sql_parts import SWINGS, lcg
from barloom.plans.study_queries import rth_days, _DAYS

BINS, PHASES = 600, 20


def swing_prices(bars, k=2):
    """One row per swing price."""
    s = X.fractal_swings(bars, k)
    both = F.array(*[F.when(F.col(f"swing_{x}"), F.struct(F.col(x[0]).alias("px"), F.lit(x == "hi").alias("hi"))) for x in ("hi", "lo")])
    return s.withColumn("x", F.explode(F.filter(both, lambda x: x.isNotNull()))).select("series_id", "pos", "date", "x.px", "x.hi")


_PX = SWINGS + ", px AS (SELECT h AS px FROM swings WHERE hi UNION ALL SELECT l FROM swings WHERE lo), oc AS (SELECT h AS px FROM bars UNION ALL SELECT l FROM bars)"


def bin_of(px, size):
    return L.block_bin(px, size, BINS)


def level_mask(spark, half):
    """Bins within ``half`` bins of a level."""
    return spark.range(1).select(F.explode(L.levels()).alias("pct")).select(F.explode(F.sequence(F.lit(-half), F.lit(half - 1))).alias("d"), "pct").select(
        F.pmod((F.col("pct") * (BINS // 100)).cast("int") + F.col("d"), F.lit(BINS)).alias("bin")).distinct()


_MASK = f"{LEVELS}, mk AS (SELECT DISTINCT (CAST(pct * 6 AS INT) + d + 600) % 600 AS bin FROM levels, (SELECT unnest(range(-HALF, HALF)) AS d))"
_BIN = "CAST(floor((px - SZ * floor(px / SZ)) / SZ * 600) AS BIGINT)"


@query(EVT + _PX + ", " + _MASK.replace("HALF", "3") + ", r AS (SELECT unnest([81.0, 243.0, 729.0]) AS r), sh AS (SELECT j, (bin + j * 30) % 600 AS bin FROM mk, (SELECT unnest(range(0, 20)) AS j)), "
+ "a AS (SELECT r, " + _BIN.replace("SZ", "r") + " AS bin, count(*) AS n FROM px, r GROUP BY ALL), b AS (SELECT r, " + _BIN.replace("SZ", "r") + """ AS bin, count(*) AS n FROM oc, r GROUP BY ALL),
ra AS (SELECT r, j, sum(a.n) / (SELECT CAST(count(*) AS DOUBLE) FROM px) AS x FROM a JOIN sh USING (bin) GROUP BY ALL), rb AS (SELECT r, j, sum(b.n) / (SELECT CAST(count(*) AS DOUBLE) FROM oc) AS y FROM b JOIN sh USING (bin) GROUP BY ALL),
g AS (SELECT r, j, coalesce(x, 0) AS x, y, coalesce(x, 0) - y AS e FROM rb LEFT JOIN ra USING (r, j))
SELECT CAST(r AS DOUBLE) AS r, round(max(x) FILTER (j = 0), 6) AS rate, round(max(y) FILTER (j = 0), 6) AS occupancy, round(max(e) FILTER (j = 0), 6) AS excess,
round((max(x) FILTER (j = 0) - avg(x) FILTER (j > 0)) / stddev_samp(x) FILTER (j > 0), 4) AS z, round((max(e) FILTER (j = 0) - avg(e) FILTER (j > 0)) / stddev_samp(e) FILTER (j > 0), 4) AS z_excess,
CAST(count(*) FILTER (e >= (SELECT g2.e FROM g g2 WHERE g2.r = g.r AND g2.j = 0)) AS BIGINT) AS rank FROM g GROUP BY r""")
def swing_grid(spark, sf_dir):
    """Swings at levels less the bars' own share there, by block size, scored against shifts of the lattice."""
    bars = bars_evt(spark, sf_dir)
    sizes = F.explode(F.array(*[F.lit(x) for x in (81.0, 243.0, 729.0)])).alias("r")
    every = bars.select(F.explode(F.array("h", "l")).alias("px"))
    shifts = level_mask(spark, 3).select("bin", F.explode(F.sequence(F.lit(0), F.lit(PHASES - 1))).alias("j"))
    shifts = F.broadcast(shifts.select(F.pmod(F.col("bin") + F.col("j") * 30, F.lit(BINS)).cast("long").alias("bin"), "j"))

    def rates(px, name):
        n = px.agg(F.count("*").cast("double").alias("all"))
        h = px.select("px", sizes).groupBy("r", bin_of(F.col("px"), F.col("r")).alias("bin")).agg(F.count("*").alias("n"))
        return h.join(shifts, "bin").groupBy("r", "j").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(n)).select("r", "j", (F.col("n") / F.col("all")).alias(name))

    g = rates(every, "y").join(rates(swing_prices(bars), "x"), ["r", "j"], "left").na.fill(0.0, ["x"]).withColumn("e", F.col("x") - F.col("y"))
    true, null = F.col("j") == 0, F.col("j") > 0
    g = g.withColumn("e0", F.max(F.when(true, F.col("e"))).over(Window.partitionBy("r")))
    at = lambda c: F.max(F.when(true, F.col(c)))
    z = lambda c: F.round((at(c) - F.avg(F.when(null, F.col(c)))) / F.stddev_samp(F.when(null, F.col(c))), 4)
    return g.groupBy("r").agg(F.round(at("x"), 6).alias("rate"), F.round(at("y"), 6).alias("occupancy"), F.round(at("e"), 6).alias("excess"), z("x").alias("z"), z("e").alias("z_excess"), F.count_if(F.col("e") >= F.col("e0")).alias("rank"))


SETS = 600
_SETS = f"""{LEVELS}, gp AS (SELECT idx, coalesce(lead(pct) OVER (ORDER BY idx), 100) - pct AS gap FROM levels),
st AS (SELECT s, idx, gap, {lcg("s * 1000003 + idx * 7919 + 17")} AS u FROM gp, (SELECT unnest(range(1, {SETS + 1})) AS s)),
cs AS (SELECT s, sum(gap) OVER (PARTITION BY s ORDER BY u, idx) - gap AS p FROM st),
ls AS (SELECT 0 AS s, CAST(pct * 6 AS BIGINT) AS c FROM levels UNION ALL SELECT s, (CAST(p * 6 AS BIGINT) + {lcg("s * 104729 + 5")} % 600) % 600 AS c FROM cs),
lm AS (SELECT DISTINCT s, (c + d + 600) % 600 AS bin FROM ls, (SELECT unnest(range(-3, 3)) AS d))"""


@query(EVT + _PX + ", " + _SETS + ", a AS (SELECT " + _BIN.replace("SZ", "243") + " AS bin, count(*) AS n FROM px GROUP BY ALL), b AS (SELECT " + _BIN.replace("SZ", "243") + """ AS bin, count(*) AS n FROM oc GROUP BY ALL),
hs AS (SELECT bin, coalesce(a.n, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM px) AS x, coalesce(b.n, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM oc) AS y FROM b FULL JOIN a USING (bin)),
ph AS (SELECT s, j, sum(x) AS x, sum(x) - sum(y) AS e FROM (SELECT s, j, (bin + j * 30) % 600 AS bin FROM lm, (SELECT unnest(range(0, 20)) AS j)) JOIN hs USING (bin) GROUP BY ALL),
m AS (SELECT s, max(x) FILTER (j = 0) AS x, round(max(e), 12) AS best FROM ph GROUP BY s), t AS (SELECT round(x, 12) AS tx, best AS tb FROM m WHERE s = 0)
SELECT round(max(tx), 6) AS rate, round(avg(x), 6) AS null_mean, round((max(tx) - avg(x)) / stddev_samp(x), 4) AS z, CAST(count(*) FILTER (round(x, 12) >= tx) + 1 AS BIGINT) AS rank,
round(max(tb), 6) AS best, round((max(tb) - avg(best)) / stddev_samp(best), 4) AS z_best, CAST(count(*) FILTER (best >= tb) + 1 AS BIGINT) AS rank_best FROM m, t WHERE s > 0""")
def level_set_null(spark, sf_dir):
    """Swings at levels, and the best of all phases, against sets with the levels' own gaps in another order and origin."""
    bars = bars_evt(spark, sf_dir)
    gaps = [(i, float(b - a)) for i, (a, b) in enumerate(zip(L.LEVELS, [*L.LEVELS[1:], 100]))]
    g = spark.createDataFrame(gaps, "idx int, gap double").withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(SETS))))
    u = S.lcg(F.col("s").cast("long") * 1000003 + F.col("idx") * 7919 + 17)
    w = Window.partitionBy("s").orderBy("u", "idx").rowsBetween(Window.unboundedPreceding, -1)
    c = F.coalesce(F.sum("gap").over(w), F.lit(0.0)) * 6
    sets = g.withColumn("u", u).select("s", F.pmod(c.cast("long") + S.lcg(F.col("s").cast("long") * 104729 + 5) % BINS, F.lit(BINS)).alias("c"))
    own = spark.range(1).select(F.lit(0).alias("s"), F.explode(L.levels()).alias("p")).select("s", (F.col("p") * 6).cast("long").alias("c"))
    mask = own.unionByName(sets).withColumn("d", F.explode(F.sequence(F.lit(-3), F.lit(2)))).select("s", F.pmod(F.col("c") + F.col("d"), F.lit(BINS)).alias("bin")).distinct()

    def share(px, name):
        n = px.agg(F.count("*").cast("double").alias("all"))
        return px.groupBy(bin_of(F.col("px"), F.lit(243.0)).alias("bin")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("bin", (F.col("n") / F.col("all")).alias(name))

    h = share(bars.select(F.explode(F.array("h", "l")).alias("px")), "y").join(share(swing_prices(bars), "x"), "bin", "full").na.fill(0.0)
    moved = mask.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(PHASES - 1)))).withColumn("bin", F.pmod(F.col("bin") + F.col("j") * 30, F.lit(BINS)))
    ph = moved.join(F.broadcast(h), "bin").groupBy("s", "j").agg(F.sum("x").alias("x"), (F.sum("x") - F.sum("y")).alias("e"))
    m = ph.groupBy("s").agg(F.round(F.max(F.when(F.col("j") == 0, F.col("x"))), 12).alias("x"), F.round(F.max("e"), 12).alias("best"))
    t = m.where("s = 0").select(F.col("x").alias("tx"), F.col("best").alias("tb"))
    both = m.where("s > 0").crossJoin(F.broadcast(t))  # one row
    return both.agg(
        F.round(F.max("tx"), 6).alias("rate"), F.round(F.avg("x"), 6).alias("null_mean"), F.round((F.max("tx") - F.avg("x")) / F.stddev_samp("x"), 4).alias("z"),
        (F.count_if(F.col("x") >= F.col("tx")) + 1).alias("rank"), F.round(F.max("tb"), 6).alias("best"), F.round((F.max("tb") - F.avg("best")) / F.stddev_samp("best"), 4).alias("z_best"),
        (F.count_if(F.col("best") >= F.col("tb")) + 1).alias("rank_best"),
    )


@query(EVT + _PX + ", " + _MASK.replace("HALF", "3") + ", pp AS (SELECT px, row_number() OVER (ORDER BY px) AS i FROM px), fr AS (SELECT unnest([0.0, 0.05, 0.1, 0.2]) AS f), "
+ f"sn AS (SELECT f, CASE WHEN {lcg('i * 48271 + 11')} % 10000 < f * 10000 THEN (round_even(px / 243 - 0.5, 0) + 0.5) * 243 + 0.1 ELSE px END AS px FROM pp, fr), "
+ "hb AS (SELECT f, " + _BIN.replace("SZ", "243") + """ AS bin, count(*) AS n FROM sn GROUP BY ALL), sh AS (SELECT j, (bin + j * 30) % 600 AS bin FROM mk, (SELECT unnest(range(0, 20)) AS j)),
rt AS (SELECT f, j, sum(n) / (SELECT CAST(count(*) AS DOUBLE) FROM px) AS x FROM hb JOIN sh USING (bin) GROUP BY ALL)
SELECT CAST(f AS DOUBLE) AS f, round(max(x) FILTER (j = 0), 6) AS rate, round((max(x) FILTER (j = 0) - avg(x) FILTER (j > 0)) / stddev_samp(x) FILTER (j > 0), 4) AS z FROM rt GROUP BY f""")
def injected_power(spark, sf_dir):
    """How the score of the swings grows when a share of them is moved onto the nearest middle of a block."""
    px = swing_prices(bars_evt(spark, sf_dir))
    # a draw for each price by its rank; which of equal prices has which rank changes nothing
    px = ranked(px, ["px", "series_id", "pos", "hi"], "rank").withColumn("i", F.col("rank") + 1).withColumn("f", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.05, 0.1, 0.2)])))
    n = px.where("f = 0").agg(F.count("*").cast("double").alias("all"))
    u = S.lcg(F.col("i").cast("long") * 48271 + 11) % 10000
    moved = F.when(u < F.col("f") * 10000, L.snap(F.col("px"), F.lit(50.0), F.lit(243.0), F.lit(0.0), 1.0) + 0.1).otherwise(F.col("px"))
    h = px.withColumn("px", moved).groupBy("f", bin_of(F.col("px"), F.lit(243.0)).alias("bin")).agg(F.count("*").alias("n"))
    sh = level_mask(spark, 3).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(PHASES - 1)))).select(F.pmod(F.col("bin") + F.col("j") * 30, F.lit(BINS)).cast("long").alias("bin"), "j")
    r = h.join(F.broadcast(sh), "bin").groupBy("f", "j").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(n)).withColumn("x", F.col("n") / F.col("all"))
    true, null = F.max(F.when(F.col("j") == 0, F.col("x"))), F.when(F.col("j") > 0, F.col("x"))
    return r.groupBy("f").agg(F.round(true, 6).alias("rate"), F.round((true - F.avg(null)) / F.stddev_samp(null), 4).alias("z"))


_SHUF = SWINGS + """, s1 AS (SELECT series_id, date, pos, hi, row_number() OVER (PARTITION BY series_id, date ORDER BY pos) AS i FROM swings),
rp AS (SELECT rep, series_id, date, hi, row_number() OVER (PARTITION BY rep, series_id, date ORDER BY CASE WHEN rep = 0 THEN i ELSE """ + lcg("rep * 7368787 + date % 100000 * 104729 + i * 15485863 + 1") + """ END, i) AS k FROM s1, (SELECT unnest(range(0, 101)) AS rep)),
pr AS (SELECT rep, hi <> lag(hi) OVER (PARTITION BY rep, series_id, date ORDER BY k) AS alt FROM rp), sc AS (SELECT rep, avg(CASE WHEN alt THEN 1.0 ELSE 0.0 END) AS x FROM pr WHERE alt IS NOT NULL GROUP BY rep)"""


@query(EVT + _SHUF + """ SELECT round(max(x) FILTER (rep = 0), 6) AS rate, round(avg(x) FILTER (rep > 0), 6) AS null_mean,
round((max(x) FILTER (rep = 0) - avg(x) FILTER (rep > 0)) / stddev_samp(x) FILTER (rep > 0), 4) AS z FROM sc""")
def shuffle_in_block(spark, sf_dir):
    """How often consecutive swings of a session alternate, against their order shuffled within it (100 times)."""
    s = X.fractal_swings(bars_evt(spark, sf_dir), 2).where("swing_hi OR swing_lo")
    s = s.select("series_id", "date", "pos", F.col("swing_hi").alias("hi"), F.row_number().over(Window.partitionBy("series_id", "date").orderBy("pos")).alias("i"))
    rep = s.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(100))))
    turn = F.when(F.col("rep") == 0, F.col("i").cast("long")).otherwise(S.lcg(F.col("rep").cast("long") * 7368787 + F.col("date") % 100000 * 104729 + F.col("i") * 15485863 + 1))
    pairs = rep.withColumn("turn", turn).withColumn("alt", F.col("hi") != F.lag("hi").over(Window.partitionBy("rep", "series_id", "date").orderBy("turn", "i")))
    sc = pairs.where("alt IS NOT NULL").groupBy("rep").agg(F.avg(F.col("alt").cast("double")).alias("x"))
    true, null = F.max(F.when(F.col("rep") == 0, F.col("x"))), F.when(F.col("rep") > 0, F.col("x"))
    return sc.agg(F.round(true, 6).alias("rate"), F.round(F.avg(null), 6).alias("null_mean"), F.round((true - F.avg(null)) / F.stddev_samp(null), 4).alias("z"))


@query(EVT + f", n AS (SELECT series_id, count(*) AS n FROM bars GROUP BY series_id), dr AS (SELECT DISTINCT series_id, {lcg('d * 1000003 + 77')} % n AS pos FROM n, (SELECT unnest(range(0, 2000)) AS d)), "
+ """q AS (SELECT dr.series_id, dr.pos, b.c FROM dr JOIN bars b USING (series_id, pos)), z AS (SELECT q.series_id, q.pos, min(b.pos - q.pos) FILTER (b.h >= q.c + 24.3) AS tu, min(b.pos - q.pos) FILTER (b.l <= q.c - 24.3) AS td
FROM q LEFT JOIN bars b ON b.series_id = q.series_id AND b.pos > q.pos AND b.pos <= q.pos + 96 GROUP BY ALL), o AS (SELECT series_id, CASE WHEN tu = td THEN NULL WHEN tu IS NULL AND td IS NULL THEN 0 WHEN td IS NULL OR tu < td THEN 1 ELSE -1 END AS o FROM z)
SELECT series_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o = 1) AS BIGINT) AS ups, CAST(count(*) FILTER (o = -1) AS BIGINT) AS downs, CAST(count(*) FILTER (o IS NULL) AS BIGINT) AS dropped FROM o GROUP BY series_id""")
def random_bar_drift(spark, sf_dir):
    """The symmetric race from bars drawn at random: what drift alone gives."""
    bars = bars_evt(spark, sf_dir)
    n = bars.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(1999))))
    drawn = n.select("series_id", (S.lcg(F.col("d").cast("long") * 1000003 + 77) % F.col("n")).alias("pos")).distinct()
    e = drawn.join(bars.select("series_id", "pos", "c"), ["series_id", "pos"])
    o = O.race(e, bars, ["series_id", "pos"], 96, F.col("bh") >= F.col("c") + 24.3, F.col("bl") <= F.col("c") - 24.3, tie="drop")
    return o.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == 1).alias("ups"), F.count_if(F.col("outcome") == -1).alias("downs"), F.count_if(F.col("outcome").isNull()).alias("dropped"))


_GRID = "(SELECT unnest([81.0, 100.0, 243.0, 250.0, 500.0, 729.0, 1000.0]) AS r)"


@query(EVT + f", x AS (SELECT b.series_id, b.pos, r, floor(c / r) AS bn, lag(floor(c / r)) OVER (PARTITION BY series_id, r ORDER BY pos) AS was FROM bars b, {_GRID}), "
+ """e AS (SELECT series_id, pos, r, bn > was AS up, CASE WHEN bn > was THEN bn ELSE bn + 1 END * r AS lv FROM x WHERE was IS NOT NULL AND bn <> was),
f AS (SELECT e.*, (SELECT CASE WHEN count(*) = 12 THEN max(b.h) END FROM bars b WHERE b.series_id = e.series_id AND b.pos > e.pos AND b.pos <= e.pos + 12) AS fh,
(SELECT CASE WHEN count(*) = 12 THEN min(b.l) END FROM bars b WHERE b.series_id = e.series_id AND b.pos > e.pos AND b.pos <= e.pos + 12) AS fl FROM e)
SELECT CAST(r AS DOUBLE) AS r, r IN (81, 243, 729) AS is_po3, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN up THEN CAST(fl < lv AS INT) ELSE CAST(fh > lv AS INT) END), 6) AS reverse_rate,
round(avg(CASE WHEN up THEN CAST(fl < lv AS INT) END) - avg(CASE WHEN NOT up THEN CAST(fh > lv AS INT) END), 6) AS up_less_down FROM f WHERE fh IS NOT NULL GROUP BY r""")
def round_lattice_control(spark, sf_dir):
    """Boundaries given back, on lattices of powers of three and of round numbers; and the contrast of the two sides."""
    bars = X.forward_extremes(bars_evt(spark, sf_dir), 12)
    sizes = (81.0, 100.0, 243.0, 250.0, 500.0, 729.0, 1000.0)
    e = V.close_crosses(bars, sizes[0]).withColumn("r", F.lit(sizes[0]))
    for r in sizes[1:]:
        e = e.unionByName(V.close_crosses(bars, r).withColumn("r", F.lit(r)))
    back = F.when(F.col("up"), F.col("fwd_lo") < F.col("line")).otherwise(F.col("fwd_hi") > F.col("line")).cast("double")
    up, down = F.avg(F.when(F.col("up"), back)), F.avg(F.when(~F.col("up"), back))
    return e.where("fwd_hi IS NOT NULL").groupBy("r", F.col("r").isin(81.0, 243.0, 729.0).alias("is_po3")).agg(F.count("*").alias("n"), F.round(F.avg(back), 6).alias("reverse_rate"), F.round(up - down, 6).alias("up_less_down"))


@query(EVT + """, x AS (SELECT j, series_id, pos, floor(((c - 12.15 * j) - 243 * floor((c - 12.15 * j) / 243)) / 243 * 5) AS st FROM bars, (SELECT unnest(range(0, 20)) AS j)),
m AS (SELECT j, st, lag(st) OVER (PARTITION BY j, series_id ORDER BY pos) AS was FROM x), k AS (SELECT j, was, st, count(*) AS n FROM m WHERE was <> st GROUP BY ALL),
s AS (SELECT j, was, st, n / sum(n) OVER (PARTITION BY j, was) AS share FROM k)
SELECT CAST(was AS BIGINT) AS was, CAST(st AS BIGINT) AS now, round(max(share) FILTER (j = 0), 6) AS share, round((max(share) FILTER (j = 0) - avg(share) FILTER (j > 0)) / stddev_samp(share) FILTER (j > 0), 3) AS z
FROM s GROUP BY was, st HAVING count(*) = 20""")
def transition_null(spark, sf_dir):
    """Shares of moves between fifths of a block, against the lattice shifted; only moves that all phases have."""
    x = bars_evt(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(PHASES - 1))))
    c = F.col("c") - F.lit(12.15) * F.col("j")
    x = x.withColumn("st", F.floor((c - 243 * F.floor(c / 243)) / 243 * 5))
    t = S.transitions(x, "st", ["j", "series_id"], "pos").groupBy("j", "was", "now").agg(F.sum("n").alias("n"))
    t = t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("j", "was")))
    true, null = F.max(F.when(F.col("j") == 0, F.col("share"))), F.when(F.col("j") > 0, F.col("share"))
    z = F.round((true - F.avg(null)) / F.stddev_samp(null), 3)
    return t.groupBy("was", "now").agg(F.round(true, 6).alias("share"), z.alias("z"), F.count("*").alias("k")).where("k = 20").drop("k")


@query(EVT + ", p AS (SELECT avg(CASE WHEN c > o THEN 1.0 ELSE 0.0 END) AS p FROM bars), x AS (SELECT series_id, hh, count(*) AS n, count(*) FILTER (c > o) AS k FROM bars GROUP BY ALL), "
+ "z AS (SELECT (k - n * p) / sqrt(n * p * (1 - p)) AS z FROM x, p) SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (abs(z) > 2) AS BIGINT) AS over2, CAST(count(*) FILTER (abs(z) > 3) AS BIGINT) AS over3, round(max(abs(z)), 5) AS most FROM z")
def multiple_comparisons(spark, sf_dir):
    """Up bars by series and hour: how many cells stand out by a binomial score."""
    bars = bars_evt(spark, sf_dir)
    up = (F.col("c") > F.col("o")).cast("double")
    p = bars.agg(F.avg(up).alias("p"))
    x = bars.groupBy("series_id", "hh").agg(F.count("*").alias("n"), F.sum(up).alias("k")).crossJoin(F.broadcast(p))  # one row
    z = F.abs(S.binomial_z(F.col("k"), F.col("n"), F.col("p")))
    return x.agg(F.count("*").alias("cells"), F.count_if(z > 2).alias("over2"), F.count_if(z > 3).alias("over3"), F.round(F.max(z), 5).alias("most"))


_BAND = _DAYS + """, d1 AS (SELECT series_id, date, fc - pc AS r, floor((pc - 243 * floor(pc / 243)) / 243 * 4) AS band, lag(floor((pc - 243 * floor(pc / 243)) / 243 * 4)) OVER (PARTITION BY series_id ORDER BY date) AS was FROM p WHERE pc IS NOT NULL),
ep AS (SELECT *, sum(CASE WHEN was = band THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY date) AS ep FROM d1)"""


def banded_days(bars):
    """Overnight returns with the quarter of the block where the day before closed, and runs of days in one quarter."""
    d = rth_days(bars).where("pc IS NOT NULL").withColumns({"r": F.col("fc") - F.col("pc"), "band": L.block_bin(F.col("pc"), F.lit(SIZE), 4)})
    w = Window.partitionBy("series_id").orderBy("date")
    return d.withColumn("new", F.when(F.lag("band").over(w) == F.col("band"), 0).otherwise(1)).withColumn("ep", F.sum("new").over(w))


@query(EVT + _BAND + f", c AS (SELECT sum(r) AS s, count(*) AS n, row_number() OVER (ORDER BY series_id, ep) - 1 AS i FROM ep GROUP BY series_id, ep), k AS (SELECT count(*) AS k FROM c), g AS (SELECT rep, {lcg('rep * 1000003 + i * 7919 + 12345')} % k AS j FROM c, k, (SELECT unnest(range(0, 2000)) AS rep)), "
+ "m AS (SELECT rep, sum(s) / sum(n) AS m FROM g JOIN c ON c.i = g.j GROUP BY rep) SELECT CAST(max(k) AS BIGINT) AS episodes, round(quantile_cont(m, 0.025), 5) AS lo, round(quantile_cont(m, 0.5), 5) AS mid, round(quantile_cont(m, 0.975), 5) AS hi FROM m, k")
def episode_bootstrap(spark, sf_dir):
    """Interval of the mean overnight return, runs of days in one quarter of a block drawn together."""
    c = banded_days(bars_evt(spark, sf_dir)).groupBy("series_id", "ep").agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    c = c.withColumn("at", F.struct("series_id", "ep"))
    m = S.cluster_bootstrap(c, 2000, "at")
    q = m.agg(*[F.round(F.percentile("mean", x), 5).alias(name) for name, x in (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))])
    return c.agg(F.count("*").alias("episodes")).crossJoin(q)  # one row each


@query(EVT + _BAND + f""", x AS (SELECT series_id, date, r, band, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS k FROM d1),
g AS (SELECT rep, a.band, b.r FROM x a, (SELECT unnest(range(0, 500)) AS rep), x b WHERE b.series_id = a.series_id AND b.i = (a.i + CASE WHEN rep = 0 THEN 0 ELSE {lcg('rep * 48271 + 3')} % a.k END) % a.k),
m AS (SELECT rep, round(max(v), 9) AS best FROM (SELECT rep, band, avg(r) AS v FROM g GROUP BY ALL) GROUP BY rep), t AS (SELECT best AS b FROM m WHERE rep = 0)
SELECT round(max(b), 5) AS best, round(avg(best), 5) AS null_mean, round((count(*) FILTER (best >= b) + 1) / 500.0, 5) AS p FROM m, t WHERE rep > 0""")
def max_statistic(spark, sf_dir):
    """The best quarter's mean overnight return, against returns rotated against their quarters: the p of the maximum."""
    w = Window.partitionBy("series_id")
    x = banded_days(bars_evt(spark, sf_dir)).select("series_id", "r", "band", (F.row_number().over(w.orderBy("date")) - 1).alias("i"), F.count("*").over(w).alias("k"))
    a = x.select("series_id", "band", "i", "k", F.explode(F.sequence(F.lit(0), F.lit(499))).alias("rep"))
    by = F.when(F.col("rep") == 0, F.lit(0).cast("long")).otherwise(S.lcg(F.col("rep").cast("long") * 48271 + 3) % F.col("k"))
    g = a.withColumn("i", (F.col("i") + by) % F.col("k")).join(x.select("series_id", F.col("i").cast("long").alias("i"), "r"), ["series_id", "i"])
    m = g.groupBy("rep", "band").agg(F.avg("r").alias("v")).groupBy("rep").agg(F.round(F.max("v"), 9).alias("best"))
    t = m.where("rep = 0").select(F.col("best").alias("b"))
    both = m.where("rep > 0").crossJoin(F.broadcast(t))  # one row
    return both.agg(F.round(F.max("b"), 5).alias("best"), F.round(F.avg("best"), 5).alias("null_mean"), F.round((F.count_if(F.col("best") >= F.col("b")) + 1) / F.lit(500.0), 5).alias("p"))


@query(EVT + ", x AS (SELECT CAST(floor((c - 729 * floor(c / 729)) / 729 * 729) AS BIGINT) AS bin, lead(c, 6) OVER (PARTITION BY series_id ORDER BY pos) - c AS f FROM bars), hb AS (SELECT bin, count(*) AS n, count(*) FILTER (f > 0) AS k FROM x WHERE f IS NOT NULL GROUP BY bin), "
+ f"{LEVELS}, bs AS (SELECT b, sum(CASE WHEN d <= 1 THEN 1 ELSE 0 END) AS depth FROM (SELECT b, s, min(least(abs(p - pct), 100 - abs(p - pct))) AS d FROM (SELECT b, s, ((b + 0.5) - s * floor((b + 0.5) / s)) / s * 100 AS p FROM (SELECT unnest(range(0, 729)) AS b), (SELECT unnest([27, 81, 243, 729]) AS s)), levels GROUP BY ALL) GROUP BY b), "
+ """mk AS (SELECT b AS bin FROM bs WHERE depth >= 2), ro AS (SELECT j, (bin + 3 * j) % 729 AS bin FROM mk, (SELECT unnest(range(0, 200)) AS j)), rt AS (SELECT j, sum(k) / CAST(sum(n) AS DOUBLE) AS x, sum(n) AS n FROM ro JOIN hb USING (bin) GROUP BY j)
SELECT CAST(max(n) FILTER (j = 0) AS BIGINT) AS n, round(max(x) FILTER (j = 0), 6) AS rate, round(avg(x) FILTER (j > 0), 6) AS null_mean, round((max(x) FILTER (j = 0) - avg(x) FILTER (j > 0)) / stddev_samp(x) FILTER (j > 0), 4) AS z FROM rt""")
def label_shift_null(spark, sf_dir):
    """Up moves from places where two scales or more have a level, against the map of such places rolled 199 times."""
    c = F.col("c")
    h = core(with_halo(bars_evt(spark, sf_dir), 0, 6).withColumn("f", F.lead("c", 6).over(ordered()) - c)).where("f IS NOT NULL")
    h = h.select(F.floor((c - 729 * F.floor(c / 729)) / 729 * 729).alias("bin"), "f")
    h = h.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("f") > 0).alias("k"))
    mid = F.col("id") + 0.5
    depth = sum((L.on_level(L.block_pct(mid, F.lit(float(s))), 1.0).cast("int") for s in (27, 81, 243, 729)), F.lit(0))
    mask = spark.range(729).where(depth >= 2).select("id", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("j"))
    r = mask.select("j", ((F.col("id") + 3 * F.col("j")) % 729).alias("bin")).join(F.broadcast(h), "bin").groupBy("j").agg((F.sum("k") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    true, null = F.col("j") == 0, F.when(F.col("j") > 0, F.col("x"))
    at = F.max(F.when(true, F.col("x")))
    return r.agg(F.max(F.when(true, F.col("n"))).alias("n"), F.round(at, 6).alias("rate"), F.round(F.avg(null), 6).alias("null_mean"), F.round((at - F.avg(null)) / F.stddev_samp(null), 4).alias("z"))
