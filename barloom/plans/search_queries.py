"""Searches over conjunctions of conditions: retests of every level, and straddles of higher time frames with stacked filters."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import lattice as L
from barloom.operators import features as X
from barloom.operators import outcomes as O
from barloom.operators.bars import daily, with_positions
from barloom.operators.halo import core, frame, ordered, with_halo
from barloom.operators.search import bitmap, conjunctions, name_of
from barloom.plans.inputs import EVT, bars_evt
from barloom.plans.registry import query
from barloom.plans.sql_parts import ATR
from barloom.sources.tables import cached, save

SIZE, HIGHER, GONE, BACK, HELD, RACE = 243.0, 729.0, 0.5, 48, 24, 48
SWEPT, COST, LEAST, MOST = 24, 1.0, 20, 3
#: Targets and stops in ATR, and targets in multiples of the structural risk.
FAV, ADV, MULTIPLES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0], [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0], [1.0, 1.5, 2.0, 3.0]
NESTED = [27, 729, 2187, 6561]
_NEVER = 9999


def first(path, cond):
    """1-based place of the first element of an array for which cond(element, index) holds; null if there is none."""
    return F.nullif(F.array_position(F.transform(path, cond), F.lit(True)), F.lit(0))


def level_retests(bars, size: float = SIZE, gone: float = GONE, back: int = BACK, ahead: int = RACE):
    """Retests of all levels: a close crosses the line, a later bar goes ``gone`` ATR beyond, a later one comes back.

    series_id, broke (the crossing bar), pct, up, lv, atr, pos (the retest), peak (excursion before it, in ATR), path (the
    bars from the retest on, itself included). One range join: the bars after a crossing are one bounded array an event.
    """
    df = with_halo(X.simple_atr(bars, 20), 1, 0)
    df = core(df.withColumn("c1", F.lag("c").over(ordered()))).where("c1 IS NOT NULL AND atr IS NOT NULL")
    df = df.select("series_id", "pos", "c", "c1", "atr", F.explode(L.levels()).alias("pct")).withColumn("off", F.col("pct") * size / 100)
    df = df.withColumns({"b": F.floor((F.col("c") - F.col("off")) / size), "was": F.floor((F.col("c1") - F.col("off")) / size)}).where("b <> was")
    up = F.col("b") > F.col("was")
    lv = F.when(up, F.col("b")).otherwise(F.col("b") + 1) * size + F.col("off")
    keys = ["series_id", "pos", "pct", "up", "lv", "atr"]
    rows = O.future(df.select("series_id", "pos", "pct", up.alias("up"), lv.alias("lv"), "atr"), bars, back + ahead).where("w IS NOT NULL")
    e = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("w", "bh", "bl", "bc"))).alias("path")).withColumnRenamed("pos", "broke")
    up, lv, atr = F.col("up"), F.col("lv"), F.col("atr")
    near = F.slice("path", 1, back)
    e = e.withColumn("t_gone", first(near, lambda x, i: F.when(up, x["bh"] >= lv + gone * atr).otherwise(x["bl"] <= lv - gone * atr)))
    returned = lambda x, i: (i + 1 > F.col("t_gone")) & F.when(up, x["bl"] <= lv).otherwise(x["bh"] >= lv)
    e = e.withColumn("t_back", first(near, returned).cast("int")).where("t_back IS NOT NULL")
    run = F.transform(F.slice(F.col("path"), F.lit(1), F.col("t_back") - 1), lambda x: F.when(up, x["bh"] - lv).otherwise(lv - x["bl"]))
    e = e.withColumns({"peak": F.array_max(run) / atr, "pos": F.col("broke") + F.col("t_back")})
    e = e.withColumn("path", F.slice(F.col("path"), F.col("t_back"), F.lit(ahead + 1)))
    return e.select("series_id", "broke", "pct", "up", "lv", "atr", "pos", "peak", "path")


def entry_features(bars, swept: int = SWEPT):
    """What is known at a bar: hour, relative volume, extremes of the last bars, the day before's high and low."""
    df = with_halo(bars, max(20, swept - 1), 0)
    df = core(df.withColumns({
        "vr": F.col("v") / F.avg("v").over(frame(-20, 0)), "rmax": F.max("h").over(frame(1 - swept, 0)), "rmin": F.min("l").over(frame(1 - swept, 0)),
    }))
    w = Window.partitionBy("series_id").orderBy("date")  # a row a day
    days = daily(bars).select("series_id", "date", F.lag("h").over(w).alias("pdh"), F.lag("l").over(w).alias("pdl"))
    return df.select("series_id", "pos", "ts", "date", "hh", "c", "vr", "rmax", "rmin").join(days, ["series_id", "date"])


def conditions():
    """What a trader could ask for at entry, by name, over the columns of level_retests and entry_features."""
    hh, pct, peak, vr, up = (F.col(x) for x in ("hh", "pct", "peak", "vr", "up"))
    sess = F.when(hh == 9, "open").when(hh.between(10, 15), "day").when((hh >= 20) | (hh < 2), "night").when(hh.between(3, 4), "early")
    swept = F.when(up, (F.col("rmin") < F.col("pdl")) & (F.col("c") > F.col("pdl"))).otherwise((F.col("rmax") > F.col("pdh")) & (F.col("c") < F.col("pdh")))
    swept = F.coalesce(swept, F.lit(False))
    depth = sum((L.on_level(L.block_pct(F.col("lv"), F.lit(float(s))), 0.5).cast("int") for s in NESTED), F.lit(0))
    out = {f"zone={z}": L.in_zone(pct, z) for z in L.ZONES}
    out |= {f"sess={s}": sess == s for s in ("open", "day", "night", "early")}
    out |= {"exc=near": peak < 1.5, "exc=mid": (peak >= 1.5) & (peak < 2.5), "exc=far": peak >= 2.5}
    out |= {"vol=low": vr < 0.85, "vol=mid": (vr >= 0.85) & (vr < 1.2), "vol=high": vr >= 1.2}
    out |= {"sweep": swept, "no_sweep": ~swept, "htf": L.on_level(L.block_pct(F.col("lv"), F.lit(HIGHER)), 0.5)}
    out |= {"shallow": peak < 2.5, "edge_or_middle": pct.isin(0.0, 50.0), "confluence>=3": depth >= 3, "confluence<=1": depth <= 1}
    return out | {f"level={p}": pct == p for p in L.LEVELS}


def plays(cost: float = COST):
    """(risk, hit times, array of (play, live, win, pnl, cost)): limits at the line by target and stop in ATR, structural entries at the close.

    The columns risk and hit times are to be added, in this order, before the array is used.
    """
    up, lv, atr, c = (F.col(x) for x in ("up", "lv", "atr", "c"))
    near, now = F.slice("path", 1, HELD + 1), F.element_at("path", 1)

    def ahead(line, start):  # a bar at or beyond a line on the trade's side, from the bar ``start`` on
        return lambda x, i: (i >= start) & F.when(up, x["bh"] >= line).otherwise(x["bl"] <= line)

    def behind(line, start):
        return lambda x, i: (i >= start) & F.when(up, x["bl"] <= line).otherwise(x["bh"] >= line)

    away = lambda base, far: F.when(up, base + far).otherwise(base - far)
    fav = [first(near, ahead(away(lv, f * atr), 1)) for f in FAV]
    adv = [first(near, behind(away(lv, -a * atr), 0)) for a in ADV]
    risk = F.greatest(F.when(up, c - now["bl"]).otherwise(now["bh"] - c) + 0.05 * atr, 0.05 * atr)
    stop = first(F.col("path"), behind(away(c, -F.col("risk")), 1))
    goal = [first(F.col("path"), ahead(away(c, m * F.col("risk")), 1)) for m in MULTIPLES]

    def play(name, t, s, gain, loss, at_risk):
        win = F.coalesce(t, F.lit(_NEVER)) < F.coalesce(s, F.lit(_NEVER))
        pnl = F.when(win, F.lit(gain)).otherwise(F.lit(-loss))
        return F.struct(F.lit(name).alias("play"), (t.isNotNull() | s.isNotNull()).alias("live"), win.alias("win"), pnl.alias("pnl"), (cost / at_risk).alias("cost"))

    limits = [play(f"limit {f:.2f}/{a:.2f}", F.col(f"f{i}"), F.col(f"a{j}"), f, a, a * atr) for i, f in enumerate(FAV) for j, a in enumerate(ADV)]
    structural = [play(f"structure {m:.1f}R", F.col(f"g{i}"), F.col("stop"), m, 1.0, F.col("risk")) for i, m in enumerate(MULTIPLES)]
    hits = {f"f{i}": x for i, x in enumerate(fav)} | {f"a{i}": x for i, x in enumerate(adv)} | {f"g{i}": x for i, x in enumerate(goal)}
    return risk, hits | {"stop": stop}, F.array(*limits, *structural)


def searched(events, names: list[str], most: int, least: int):
    """Cells from (bits, val, up, play, win, pnl, cost) rows of live trades: every play by every conjunction with enough of both halves."""
    per = events.groupBy("bits", "val", "up", "play").agg(
        F.count("*").alias("n"), F.count_if("win").alias("wins"), F.sum("pnl").alias("pnl"), F.sum("cost").alias("cost"),
    )
    per = save(per, "by_bitmap")
    # a conjunction's most live play bounds its cells from above
    seen = per.groupBy("bits", "play", "val").agg(F.sum("n").alias("n")).groupBy("bits", "val").agg(F.max("n").alias("n"))
    support = seen.groupBy("bits").agg(F.sum(F.when(~F.col("val"), F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("val"), F.col("n")).otherwise(0)).alias("n1"))
    cells = conjunctions(save(support, "support"), len(names), most, least).join(per, "bits")
    val, up = F.col("val"), F.col("up")

    def net(cond):
        n = F.sum(F.when(cond, F.col("n")))
        return (F.sum(F.when(cond, F.col("pnl"))) - F.sum(F.when(cond, F.col("cost")))) / n

    def sums(cond):
        n = F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
        return n, F.sum(F.when(cond, F.col("wins"))) / F.nullif(n, F.lit(0)), net(cond)

    (n0, p0, e0), (n1, p1, e1) = sums(~val), sums(val)
    out = cells.groupBy("mask", "play").agg(
        n0.alias("disc_n"), F.round(p0, 6).alias("disc_p"), F.round(e0, 6).alias("disc_ev"), n1.alias("val_n"), F.round(p1, 6).alias("val_p"), F.round(e1, 6).alias("val_ev"),
        F.round(net(up), 6).alias("long_ev"), F.round(net(~up), 6).alias("short_ev"),
    )
    out = out.where((F.col("disc_n") >= least) & (F.col("val_n") >= least))
    mirrored = F.coalesce((F.col("long_ev") > 0) & (F.col("short_ev") > 0), F.lit(False))
    return out.select("play", name_of(F.col("mask"), names).alias("cut"), "disc_n", "disc_p", "disc_ev", "val_n", "val_p", "val_ev", "long_ev", "short_ev", mirrored.alias("mirrored"))


def halves(bars, share: float = 0.5):
    """One row, split: the time that parts a share of the span from the rest."""
    span = bars.agg(F.min(F.unix_timestamp("ts")).alias("a"), F.max(F.unix_timestamp("ts")).alias("b"))
    return span.select((F.col("a") + (F.col("b") - F.col("a")) * share).alias("split"))


_LIST = str([float(x) for x in L.LEVELS])
_ON = "list_bool_or([least(abs({x} - v), 100 - abs({x} - v)) <= 0.5 for v in " + _LIST + "])"


def _on_level(size: int) -> str:
    return _ON.replace("{x}", f"((lv - {size} * floor(lv / {size})) / {size} * 100)")


_ZONE = {z: " OR ".join(f"(pct >= {a} AND pct < {b})" for a, b in bands) for z, bands in L.ZONES.items()}
_CONDITIONS = (
    [(f"zone={z}", c) for z, c in _ZONE.items()]
    + [("sess=open", "hh = 9"), ("sess=day", "hh BETWEEN 10 AND 15"), ("sess=night", "(hh >= 20 OR hh < 2)"), ("sess=early", "hh BETWEEN 3 AND 4")]
    + [("exc=near", "peak < 1.5"), ("exc=mid", "peak >= 1.5 AND peak < 2.5"), ("exc=far", "peak >= 2.5")]
    + [("vol=low", "vr < 0.85"), ("vol=mid", "vr >= 0.85 AND vr < 1.2"), ("vol=high", "vr >= 1.2")]
    + [("sweep", "swept"), ("no_sweep", "NOT swept"), ("htf", _on_level(729)), ("shallow", "peak < 2.5"), ("edge_or_middle", "pct IN (0, 50)")]
    + [("confluence>=3", "depth >= 3"), ("confluence<=1", "depth <= 1")]
    + [(f"level={p}", f"pct = {p}") for p in L.LEVELS]
)
_RETESTED = ATR + f""",
cr AS (SELECT series_id, pos AS broke, pct, atr, floor((c - pct * 243 / 100) / 243) AS b, floor((c1 - pct * 243 / 100) / 243) AS w
  FROM ats, (SELECT unnest({_LIST}::DOUBLE[]) AS pct) WHERE c1 IS NOT NULL AND atr IS NOT NULL),
e0 AS (SELECT *, b > w AS up, CASE WHEN b > w THEN b ELSE b + 1 END * 243 + pct * 243 / 100 AS lv FROM cr WHERE b <> w),
g AS (SELECT e0.*, min(x.pos - broke) AS t_gone FROM e0 JOIN bars x ON x.series_id = e0.series_id AND x.pos > broke AND x.pos <= broke + {BACK}
  AND CASE WHEN up THEN x.h >= lv + 0.5 * atr ELSE x.l <= lv - 0.5 * atr END GROUP BY ALL),
rt AS (SELECT g.*, min(x.pos - broke) AS t_back FROM g JOIN bars x ON x.series_id = g.series_id AND x.pos > broke + t_gone AND x.pos <= broke + {BACK}
  AND CASE WHEN up THEN x.l <= lv ELSE x.h >= lv END GROUP BY ALL),
pk AS (SELECT rt.series_id, broke, pct, up, lv, rt.atr, broke + t_back AS pos, max(CASE WHEN up THEN x.h - lv ELSE lv - x.l END) / max(rt.atr) AS peak
  FROM rt JOIN bars x ON x.series_id = rt.series_id AND x.pos > broke AND x.pos < broke + t_back GROUP BY ALL),
rx AS (SELECT series_id, pos, ts, date, hh, c, h, l, v / avg(v) OVER (w ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS vr,
  max(h) OVER (w ROWS BETWEEN {SWEPT - 1} PRECEDING AND CURRENT ROW) AS rmax, min(l) OVER (w ROWS BETWEEN {SWEPT - 1} PRECEDING AND CURRENT ROW) AS rmin
  FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
dy AS (SELECT series_id, date, max(h) AS h, min(l) AS l FROM bars GROUP BY ALL),
pd AS (SELECT series_id, date, lag(h) OVER w AS pdh, lag(l) OVER w AS pdl FROM dy WINDOW w AS (PARTITION BY series_id ORDER BY date)),
half AS (SELECT min(epoch(ts)) + (max(epoch(ts)) - min(epoch(ts))) * 0.5 AS split FROM bars),
an AS (SELECT row_number() OVER () AS id, pk.*, rx.hh, rx.c, rx.vr, epoch(rx.ts) >= split AS val,
  coalesce(CASE WHEN up THEN rmin < pdl AND c > pdl ELSE rmax > pdh AND c < pdh END, false) AS swept, {" + ".join(f"CAST({_on_level(s)} AS INT)" for s in NESTED)} AS depth,
  greatest(CASE WHEN up THEN c - l ELSE h - c END + 0.05 * atr, 0.05 * atr) AS risk
  FROM pk JOIN rx USING (series_id, pos) JOIN pd USING (series_id, date), half)"""
_PLAYED = f""",
th AS (SELECT id, x, min(b.pos - an.pos) FILTER (b.pos > an.pos AND CASE WHEN up THEN b.h >= lv + x * atr ELSE b.l <= lv - x * atr END) AS tf,
  min(b.pos - an.pos) FILTER (CASE WHEN up THEN b.l <= lv - x * atr ELSE b.h >= lv + x * atr END) AS ta
  FROM an, (SELECT unnest({ADV}) AS x) JOIN bars b ON b.series_id = an.series_id AND b.pos BETWEEN an.pos AND an.pos + {HELD} GROUP BY ALL),
ts AS (SELECT id, m, min(b.pos - an.pos) FILTER (CASE WHEN up THEN b.h >= an.c + m * risk ELSE b.l <= an.c - m * risk END) AS tf,
  min(b.pos - an.pos) FILTER (CASE WHEN up THEN b.l <= an.c - risk ELSE b.h >= an.c + risk END) AS ta
  FROM an, (SELECT unnest({MULTIPLES}) AS m) JOIN bars b ON b.series_id = an.series_id AND b.pos > an.pos AND b.pos <= an.pos + {RACE} GROUP BY ALL),
tr AS (SELECT p.id, format('limit {{:.2f}}/{{:.2f}}', CAST(p.x AS DOUBLE), CAST(q.x AS DOUBLE)) AS play, coalesce(p.tf, 9999) < coalesce(q.ta, 9999) AS win, CAST(p.x AS DOUBLE) AS gain, CAST(q.x AS DOUBLE) AS loss,
  {COST} / (q.x * atr) AS cost FROM th p JOIN th q USING (id) JOIN an USING (id) WHERE p.x IN ({", ".join(map(str, FAV))}) AND (p.tf IS NOT NULL OR q.ta IS NOT NULL)
  UNION ALL SELECT id, format('structure {{:.1f}}R', CAST(m AS DOUBLE)), coalesce(tf, 9999) < coalesce(ta, 9999), m, 1.0, {COST} / risk FROM ts JOIN an USING (id) WHERE tf IS NOT NULL OR ta IS NOT NULL)"""
_CELLS = f""",
co AS (SELECT id, unnest(list_filter([{", ".join(f"CASE WHEN {c} THEN {i} END" for i, (_, c) in enumerate(_CONDITIONS))}], lambda x: x IS NOT NULL)) AS k FROM an),
nm AS (SELECT unnest({[n for n, _ in _CONDITIONS]}) AS name, unnest(range({len(_CONDITIONS)})) AS k),
cu AS (SELECT id, 'all' AS cut FROM an UNION ALL SELECT id, name FROM co JOIN nm USING (k)
  UNION ALL SELECT a.id, x.name || '+' || y.name FROM co a JOIN co b ON a.id = b.id AND a.k < b.k JOIN nm x ON x.k = a.k JOIN nm y ON y.k = b.k
  UNION ALL SELECT a.id, x.name || '+' || y.name || '+' || z.name FROM co a JOIN co b ON a.id = b.id AND a.k < b.k JOIN co c ON c.id = a.id AND b.k < c.k
  JOIN nm x ON x.k = a.k JOIN nm y ON y.k = b.k JOIN nm z ON z.k = c.k),
ce AS (SELECT play, cut, count(*) FILTER (NOT val) AS disc_n, avg(CAST(win AS INT)) FILTER (NOT val) AS disc_p, avg(CASE WHEN win THEN gain ELSE -loss END - cost) FILTER (NOT val) AS disc_ev,
  count(*) FILTER (val) AS val_n, avg(CAST(win AS INT)) FILTER (val) AS val_p, avg(CASE WHEN win THEN gain ELSE -loss END - cost) FILTER (val) AS val_ev,
  avg(CASE WHEN win THEN gain ELSE -loss END - cost) FILTER (up) AS long_ev, avg(CASE WHEN win THEN gain ELSE -loss END - cost) FILTER (NOT up) AS short_ev
  FROM cu JOIN tr USING (id) JOIN an USING (id) GROUP BY play, cut)
SELECT play, cut, CAST(disc_n AS BIGINT) AS disc_n, round(disc_p, 6) AS disc_p, round(disc_ev, 6) AS disc_ev, CAST(val_n AS BIGINT) AS val_n, round(val_p, 6) AS val_p, round(val_ev, 6) AS val_ev,
round(long_ev, 6) AS long_ev, round(short_ev, 6) AS short_ev, coalesce(round(long_ev, 6) > 0 AND round(short_ev, 6) > 0, false) AS mirrored FROM ce WHERE disc_n >= {LEAST} AND val_n >= {LEAST}"""


@query(EVT + _RETESTED + _PLAYED + _CELLS)
def conjunction_search(spark, sf_dir):
    """46 plays at the retests of all levels, by every conjunction of up to three conditions with enough trades in both halves of time.

    Win rate and mean result after costs in either half, and of both sides; mirrored: long and short both gain.
    """
    bars = bars_evt(spark, sf_dir)
    e = level_retests(bars).join(entry_features(bars), ["series_id", "pos"]).crossJoin(F.broadcast(halves(bars)))
    asked = conditions()
    risk, hits, every = plays()
    e = e.withColumns({"bits": bitmap(asked), "val": F.unix_timestamp("ts") >= F.col("split"), "risk": risk}).withColumns(hits)
    t = e.select("bits", "val", "up", F.explode(every).alias("t")).select("bits", "val", "up", "t.*").where("live")
    return searched(t, list(asked), MOST, LEAST)


# --- stacked filters -------------------------------------------------------------------------------------------------

SCALES, SHIFTS = [243.0, 729.0], [12.5 * i for i in range(8)]
#: Stop and target in ATR of the candles.
BRACKETS = [(0.75, 1.5), (1.0, 1.0), (0.75, 2.25)]
CALM, FEW = 0.8, 10
FILTERS = ["quiet", "rth"]


def four_hours(bars):
    """Candles of four hours with their own positions (pos), the bar they end with (last), close before, ATR of 20 and median volume of 40."""
    c = bars.groupBy("series_id", "date", F.floor(F.col("hh") / 4).alias("k")).agg(
        F.min("ts").alias("ts"), F.max("pos").alias("last"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "pos").alias("c"), F.sum("v").alias("v"),
    )
    c = X.simple_atr(with_positions(c), 20)
    c = X.trailing_median(c, "v", 40)
    return core(with_halo(c, 1, 0).withColumn("prev", F.lag("c").over(ordered())))


def bracket_results(candles, bars, held: int = RACE, cost: float = COST):
    """Per candle an array of (side, stop, target, pnl): entries at its close, held to a stop, a target or the middle of the last bar.

    What a candle's trades bring does not depend on the lattice: they are resolved once for all scales and shifts.
    """
    e = candles.select("series_id", F.col("last").alias("pos"), "c", "atr")
    rows = O.future(e, bars, held).where("w IS NOT NULL")
    e = rows.groupBy("series_id", "pos", "c", "atr").agg(F.array_sort(F.collect_list(F.struct("w", "bh", "bl"))).alias("path"))
    c, atr = F.col("c"), F.col("atr")

    def trade(side, stop, target):
        s, t = c - side * stop * atr, c + side * target * atr
        hit_s = first(F.col("path"), lambda x, i: x["bl"] <= s) if side > 0 else first(F.col("path"), lambda x, i: x["bh"] >= s)
        hit_t = first(F.col("path"), lambda x, i: x["bh"] >= t) if side > 0 else first(F.col("path"), lambda x, i: x["bl"] <= t)
        last = F.element_at("path", -1)
        flat = side * ((last["bh"] + last["bl"]) / 2 - c)
        a, b = F.coalesce(hit_s, F.lit(_NEVER)), F.coalesce(hit_t, F.lit(_NEVER))
        pnl = F.when((a == _NEVER) & (b == _NEVER), flat).when(a <= b, side * (s - c)).otherwise(side * (t - c))
        return F.struct(F.lit(side).alias("side"), F.lit(stop).alias("stop"), F.lit(target).alias("target"), (pnl - cost).alias("pnl"))

    return e.select("series_id", F.col("pos").alias("last"), F.array(*[trade(s, *b) for s in (1, -1) for b in BRACKETS]).alias("trades"))


def straddles(candles, sizes=SCALES, shifts=SHIFTS):
    """Candles that hold a level, by scale and shift of the lattice: the level nearest to the close and what the close does to it."""
    c = candles.where("prev IS NOT NULL AND atr > 0 AND med IS NOT NULL")
    grid = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(p).alias("phase")) for r in sizes for p in shifts])
    c = c.withColumn("g", F.explode(grid)).select("*", "g.*").drop("g")
    off = F.col("r") * F.col("phase") / 100
    base = F.floor((F.col("l") - off) / F.col("r")) * F.col("r") + off
    lines = F.array(*[F.struct(F.lit(i + 20 * k).alias("i"), (base + k * F.col("r") + p * F.col("r") / 100).alias("lv")) for k in (0, 1) for i, p in enumerate(L.LEVELS)])
    held = F.filter(lines, lambda x: (x["lv"] >= F.col("l")) & (x["lv"] <= F.col("h")))
    near = F.array_min(F.transform(held, lambda x: F.struct(F.round(F.abs(x["lv"] - F.col("c")), 9).alias("d"), x["i"].alias("i"), x["lv"].alias("lv"))))
    c = c.withColumn("lv", near["lv"]).where("lv IS NOT NULL AND prev <> lv")
    below, over = F.col("prev") < F.col("lv"), F.col("c") > F.col("lv")
    setup = F.when(below & over, "break_up").when(below, "reject_up").when(F.col("c") < F.col("lv"), "break_dn").otherwise("reject_dn")
    return c.withColumn("setup", setup).withColumn("side", F.when(setup.isin("break_up", "reject_dn"), 1).otherwise(-1))


_STACKED = f""",
k0 AS (SELECT series_id, date, hh // 4 AS k, min(ts) AS ts, max(pos) AS last, max(h) AS h, min(l) AS l, arg_max(c, pos) AS c, sum(v) AS v FROM bars GROUP BY ALL),
k1 AS (SELECT *, row_number() OVER w - 1 AS p, lag(c) OVER w AS prev FROM k0 WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
k2 AS (SELECT *, greatest(h - l, coalesce(abs(h - prev), 0), coalesce(abs(l - prev), 0)) AS tr FROM k1),
k3 AS (SELECT *, CASE WHEN p >= 20 THEN avg(tr) OVER (PARTITION BY series_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS atr,
  CASE WHEN p >= 40 THEN quantile_cont(v, 0.5) OVER (PARTITION BY series_id ORDER BY p ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) END AS med FROM k2),
ck AS (SELECT * FROM k3 WHERE prev IS NOT NULL AND atr > 0 AND med IS NOT NULL),
sd AS (SELECT unnest([1, -1]) AS side), bk AS (SELECT unnest({[list(b) for b in BRACKETS]}) AS b),
q AS (SELECT series_id, last, side, CAST(b[1] AS DOUBLE) AS stop, CAST(b[2] AS DOUBLE) AS target, c, c - side * b[1] * atr AS s, c + side * b[2] * atr AS t FROM ck, sd, bk),
z AS (SELECT q.series_id, q.last, q.side, q.stop, q.target, q.c, q.s, q.t, min(x.pos) FILTER (CASE WHEN side > 0 THEN x.l <= s ELSE x.h >= s END) AS hs,
  min(x.pos) FILTER (CASE WHEN side > 0 THEN x.h >= t ELSE x.l <= t END) AS ht, arg_max((x.h + x.l) / 2, x.pos) AS mid
  FROM q JOIN bars x ON x.series_id = q.series_id AND x.pos > q.last AND x.pos <= q.last + {RACE} GROUP BY ALL),
rs AS (SELECT *, CASE WHEN hs IS NULL AND ht IS NULL THEN side * (mid - c) WHEN ht IS NULL OR hs <= ht THEN side * (s - c) ELSE side * (t - c) END - {COST} AS pnl FROM z),
gd AS (SELECT r, ph FROM (SELECT unnest({SCALES}::DOUBLE[]) AS r), (SELECT unnest({SHIFTS}::DOUBLE[]) AS ph)),
cn AS (SELECT series_id, last, r, ph, c, v.i + 20 * n AS i, floor((l - r * ph / 100) / r) * r + r * ph / 100 + n * r + v.p * r / 100 AS lv
  FROM ck, gd, (SELECT unnest({L.LEVELS}) AS p, unnest(range(20)) AS i) v, (SELECT unnest([0, 1]) AS n)
  WHERE floor((l - r * ph / 100) / r) * r + r * ph / 100 + n * r + v.p * r / 100 BETWEEN l AND h),
nr AS (SELECT * FROM cn QUALIFY row_number() OVER (PARTITION BY series_id, last, r, ph ORDER BY round(abs(lv - c), 9), i) = 1),
st AS (SELECT nr.series_id, nr.last, r, ph, CASE WHEN prev < lv AND ck.c > lv THEN 'break_up' WHEN prev < lv THEN 'reject_up' WHEN ck.c < lv THEN 'break_dn' ELSE 'reject_dn' END AS setup,
  h - l <= {CALM} * atr AND v <= med AS quiet, k IN (2, 3) AS rth, epoch(ts) >= split AS val
  FROM nr JOIN ck USING (series_id, last), (SELECT min(epoch(ts)) + (max(epoch(ts)) - min(epoch(ts))) * 0.5 AS split FROM bars) WHERE prev <> lv),
tr AS (SELECT st.*, stop, target, pnl FROM st JOIN rs ON rs.series_id = st.series_id AND rs.last = st.last AND rs.side = CASE WHEN setup IN ('break_up', 'reject_dn') THEN 1 ELSE -1 END),
fl AS (SELECT r, ph, setup, stop, target, val, pnl, unnest(list_filter(['all', CASE WHEN quiet THEN 'quiet' END, CASE WHEN rth THEN 'rth' END, CASE WHEN quiet AND rth THEN 'quiet+rth' END], lambda x: x IS NOT NULL)) AS cut FROM tr),
ce AS (SELECT r, ph, cut, stop, target, setup, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win, avg(pnl) AS net, avg(pnl) FILTER (NOT val) AS disc, avg(pnl) FILTER (val) AS vali
  FROM fl GROUP BY ALL HAVING count(*) >= {FEW}),
sh AS (SELECT r, cut, stop, target, setup, avg(net) AS shifted FROM ce WHERE ph > 0 GROUP BY ALL),
tl AS (SELECT *, min(net) OVER (PARTITION BY r, cut, stop, target, split_part(setup, '_', 1)) > 0 AND count(*) OVER (PARTITION BY r, cut, stop, target, split_part(setup, '_', 1)) = 2 AS mirrored FROM ce WHERE ph = 0)
SELECT tl.r, cut, stop, target, setup, CAST(n AS BIGINT) AS n, round(win, 6) AS win, round(net, 8) AS net, round(disc, 8) AS disc, round(vali, 8) AS val, round(shifted, 8) AS shifted, round(net - shifted, 8) AS diff, mirrored
FROM tl LEFT JOIN sh USING (r, cut, stop, target, setup)"""


@query(EVT + _STACKED)
def stacked_filters(spark, sf_dir):
    """Four-hour candles at a level, broken or rejected, under stacked filters (quiet arrival, day session) and three brackets.

    Net points of the true lattice by half of time beside those of seven shifted ones; mirrored: both sides gain.
    """
    bars = bars_evt(spark, sf_dir)
    candles = cached(spark, "four_hours", sf_dir, lambda: four_hours(bars))
    e = straddles(candles).crossJoin(F.broadcast(halves(bars))).withColumn("val", F.unix_timestamp("ts") >= F.col("split"))
    quiet = (F.col("h") - F.col("l") <= CALM * F.col("atr")) & (F.col("v") <= F.col("med"))
    e = e.withColumn("bits", bitmap({"quiet": quiet, "rth": F.col("k").isin(2, 3)}))
    t = e.join(bracket_results(candles.where("prev IS NOT NULL AND atr > 0 AND med IS NOT NULL"), bars), ["series_id", "last"])
    t = t.withColumn("t", F.explode(F.filter("trades", lambda x: x["side"] == F.col("side")))).select("bits", "r", "phase", "setup", "val", "t.stop", "t.target", "t.pnl")
    keys = ["r", "phase", "setup", "stop", "target"]
    per = t.groupBy("bits", "val", *keys).agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("pnl"))
    per = save(per, "by_bitmap")
    met = conjunctions(per.select("bits").distinct().withColumns({"n0": F.lit(1), "n1": F.lit(1)}), len(FILTERS), len(FILTERS), 1)
    half = lambda cond: F.sum(F.when(cond, F.col("pnl"))) / F.sum(F.when(cond, F.col("n")))
    cells = met.join(per, "bits").groupBy("mask", *keys).agg(
        F.sum("n").alias("n"), (F.sum("wins") / F.sum("n")).alias("win"), (F.sum("pnl") / F.sum("n")).alias("net"), half(~F.col("val")).alias("disc"), half(F.col("val")).alias("vali"),
    ).where(F.col("n") >= FEW)
    cells = save(cells, "cells")
    same = ["mask", "r", "stop", "target"]
    shifted = cells.where("phase > 0").groupBy(*same, "setup").agg(F.avg("net").alias("shifted"))
    both = Window.partitionBy(*same, F.substring_index("setup", "_", 1))  # two rows at most
    true = cells.where("phase = 0").withColumn("mirrored", (F.min("net").over(both) > 0) & (F.count("*").over(both) == 2))
    out = true.join(shifted, [*same, "setup"], "left")
    rounded = {x: F.round(x, 8) for x in ("net", "disc", "shifted")}
    return out.select(
        "r", name_of(F.col("mask"), FILTERS).alias("cut"), "stop", "target", "setup", "n", F.round("win", 6).alias("win"), *[x.alias(c) for c, x in rounded.items()],
        F.round("vali", 8).alias("val"), F.round(F.col("net") - F.col("shifted"), 8).alias("diff"), "mirrored",
    )
