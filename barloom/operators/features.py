"""Causal features of bars with chunk and core columns (see halo): every frame is finite, so chunks are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.halo import core, frame, ordered, with_halo
from barloom.operators.scan import running, zigzag  # noqa: F401  the zigzag is a feature, too


def full(n: int, a: int, b: int) -> Column:
    """The frame has all its n rows."""
    return F.count("*").over(frame(a, b)) == n


def fractal_swings(bars: DataFrame, k: int, blk: str | None = None) -> DataFrame:
    """swing_hi, swing_lo: strictly beyond the k bars on each side, all of them there (and in one blk if named)."""
    df = with_halo(bars, k, k)
    whole = full(k, -k, -1) & full(k, 1, k)
    if blk:
        whole = whole & (F.lag(blk, k).over(ordered()) == F.lead(blk, k).over(ordered()))
    hi = (F.col("h") > F.max("h").over(frame(-k, -1))) & (F.col("h") > F.max("h").over(frame(1, k)))
    lo = (F.col("l") < F.min("l").over(frame(-k, -1))) & (F.col("l") < F.min("l").over(frame(1, k)))
    return core(df.withColumns({"swing_hi": F.coalesce(whole & hi, F.lit(False)), "swing_lo": F.coalesce(whole & lo, F.lit(False))}))


def last_fractal(bars: DataFrame, k: int) -> DataFrame:
    """last_hi, last_lo: the latest fractal price known at the bar, k bars after it stood; edges of a series count."""
    df = with_halo(bars, 2 * k, k)
    top = F.greatest(F.max("h").over(frame(-k, -1)), F.max("h").over(frame(1, k)))
    low = F.least(F.min("l").over(frame(-k, -1)), F.min("l").over(frame(1, k)))
    df = df.withColumns({"_hi": F.when(F.col("h") > top, F.col("h")), "_lo": F.when(F.col("l") < low, F.col("l"))})
    df = core(df.withColumns({f"_k{x}": F.lag(f"_{x}", k).over(ordered()) for x in ("hi", "lo")}))
    return running(df, ["series_id"], {f"last_{x}": ("last", F.col(f"_k{x}")) for x in ("hi", "lo")}).drop("_hi", "_lo", "_khi", "_klo")


def forward_extremes(bars: DataFrame, m: int) -> DataFrame:
    """fwd_hi, fwd_lo over the next m bars; null where there are fewer."""
    df = with_halo(bars, 0, m)
    whole = full(m, 1, m)
    return core(df.withColumns({"fwd_hi": F.when(whole, F.max("h").over(frame(1, m))), "fwd_lo": F.when(whole, F.min("l").over(frame(1, m)))}))


def forward_extremes_doubled(bars: DataFrame, log2: int) -> DataFrame:
    """fwd_hi, fwd_lo over the next 2**log2 bars in log2 steps of lead: for horizons where a sliding frame costs more."""
    m = 1 << log2
    df = with_halo(bars, 0, m)
    w = ordered()
    df = df.withColumns({"fwd_hi": F.lead("h").over(w), "fwd_lo": F.lead("l").over(w)})
    for i in range(log2):
        df = df.withColumns({"_h": F.lead("fwd_hi", 1 << i).over(w), "_l": F.lead("fwd_lo", 1 << i).over(w)})
        df = df.withColumns({"fwd_hi": F.when(F.col("_h").isNotNull(), F.greatest("fwd_hi", "_h")), "fwd_lo": F.when(F.col("_l").isNotNull(), F.least("fwd_lo", "_l"))})
    return core(df.drop("_h", "_l"))


def trailing_extremes(bars: DataFrame, exclusive: int = 60, inclusive: int = 120) -> DataFrame:
    """Closes' extremes of the bars before (own close on the first bar), extremes of the bars up to this one, lows and highs before."""
    df = with_halo(bars, max(exclusive, inclusive - 1), 0)
    before, upto = frame(-exclusive, -1), frame(-(inclusive - 1), 0)
    return core(df.withColumns({
        "prev_max_c": F.coalesce(F.max("c").over(before), F.col("c")), "prev_min_c": F.coalesce(F.min("c").over(before), F.col("c")),
        "roll_hi": F.max("h").over(upto), "roll_lo": F.min("l").over(upto),
        "win_hi": F.max("h").over(before), "win_lo": F.min("l").over(before),
    }))


def true_range(w) -> Column:
    c1 = F.lag("c").over(w)
    return F.greatest(F.col("h") - F.col("l"), F.coalesce(F.abs(F.col("h") - c1), F.lit(0.0)), F.coalesce(F.abs(F.col("l") - c1), F.lit(0.0)))


def simple_atr(bars: DataFrame, n: int = 20) -> DataFrame:
    """atr: mean true range of the last n bars, from position n on."""
    df = with_halo(bars, n + 1, 0).withColumn("_tr", true_range(ordered()))
    return core(df.withColumn("atr", F.when(F.col("pos") >= n, F.avg("_tr").over(frame(-(n - 1), 0)))).drop("_tr"))


def wilder_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """atr: (atr * (n - 1) + tr) / n from the mean of the first n true ranges on; null before position n - 1.

    The recursion is a sum of true ranges with weights (1 - 1/n) ** age. In blocks of 8 n bars it is a running sum, each
    block's last value is carried on with its weight, and after CARRIED blocks the weight is below 1e-26: every frame is
    finite, and the work is linear in the bars.
    """
    block, carried, keep = 8 * n, 8, 1 - 1 / n
    df = with_halo(bars.select("series_id", "pos", "h", "l", "c"), n + 1, 0).withColumn("_tr", true_range(ordered()))
    seed = F.when(F.col("pos") == n - 1, F.sum("_tr").over(frame(-(n - 1), 0)))
    x = core(df.withColumn("_x", F.coalesce(seed, F.when(F.col("pos") >= n, F.col("_tr")), F.lit(0.0))))
    x = x.select("series_id", "pos", "_x", F.floor(F.col("pos") / block).alias("_b"), (F.col("pos") % block).alias("_k"))
    run = Window.partitionBy("series_id", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = F.sum(F.col("_x") * F.pow(F.lit(keep), -F.col("_k"))).over(run) * F.pow(F.lit(keep), "_k") / n
    ends = x.groupBy("series_id", F.col("_b").alias("pos")).agg((F.sum(F.col("_x") * F.pow(F.lit(keep), F.lit(block - 1) - F.col("_k"))) / n).alias("_end"))
    older = [F.coalesce(F.lag("_end", m).over(ordered()), F.lit(0.0)) * keep ** (block * (m - 1)) for m in range(1, carried + 1)]
    carry = core(with_halo(ends, carried, 0).withColumn("_carry", sum(older[1:], older[0]))).select("series_id", F.col("pos").alias("_b"), "_carry")
    out = x.withColumn("_local", local).join(carry, ["series_id", "_b"])
    atr = F.when(F.col("pos") >= n - 1, F.col("_local") + F.pow(F.lit(keep), F.col("_k") + 1) * F.col("_carry"))
    return bars.join(out.select("series_id", "pos", atr.alias("atr")), ["series_id", "pos"], "left")


def volume_features(bars: DataFrame, w: int = 20, climax: int = 20, near: int = 16) -> DataFrame:
    """rvol (volume over its trailing geometric mean), approach, climax, expansion."""
    df = with_halo(bars, max(w, climax, near), 0)
    geo = F.when(F.col("pos") > 0, F.exp(F.avg(F.ln(F.greatest(F.col("v"), F.lit(1)))).over(frame(-w, -1)))).otherwise(1.0)
    rng = F.col("h") - F.col("l")
    return core(df.withColumns({
        "rvol": F.col("v") / geo, "approach": F.avg("v").over(frame(-(near - 1), 0)),
        "climax": F.col("v") >= F.max("v").over(frame(-(climax - 1), 0)), "expansion": rng / F.nullif(F.avg(rng).over(frame(-w, 0)), F.lit(0.0)),
    }))


def session_running(bars: DataFrame, key: str = "date") -> DataFrame:
    """vwap, run_hi, run_lo from a session's start; a session is one window."""
    w = Window.partitionBy("series_id", key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tp = (F.col("h") + F.col("l") + F.col("c")) / 3
    return bars.withColumns({"vwap": F.sum(tp * F.col("v")).over(w) / F.greatest(F.sum("v").over(w), F.lit(1)), "run_hi": F.max("h").over(w), "run_lo": F.min("l").over(w)})


def trailing_median(bars: DataFrame, column: str, n: int) -> DataFrame:
    """med: exact median of the n bars before; null where there are fewer."""
    df = with_halo(bars, n, 0)
    return core(df.withColumn("med", F.when(full(n, -n, -1), F.percentile(column, 0.5).over(frame(-n, -1)))))


def seen_within(bars: DataFrame, flag: Column, n: int) -> DataFrame:
    """seen: the flag held on one of the n bars before."""
    df = with_halo(bars, n, 0).withColumn("_f", flag.cast("int"))
    return core(df.withColumn("seen", F.coalesce(F.max("_f").over(frame(-n, -1)), F.lit(0)) == 1).drop("_f"))


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """gap_up, gap_dn with edges: this low above the high two bars before, and the mirror."""
    df = with_halo(bars, 2, 0)
    h2, l2 = F.lag("h", 2).over(ordered()), F.lag("l", 2).over(ordered())
    df = df.withColumns({"gap_up": F.col("l") > h2, "gap_dn": F.col("h") < l2, "edge_lo": F.when(F.col("l") > h2, h2).when(F.col("h") < l2, F.col("h")), "edge_hi": F.when(F.col("l") > h2, F.col("l")).when(F.col("h") < l2, l2)})
    return core(df.na.fill({"gap_up": False, "gap_dn": False}))


def islands(df: DataFrame, flag: Column, keys: list[str]) -> DataFrame:
    """Runs of rows where flag holds: keys, first_pos, last_pos, n. A run is numbered by the rows without the flag before it."""
    rows = running(df.withColumn("_f", F.coalesce(flag, F.lit(False))), keys, {"_run": ("sum", (~F.col("_f")).cast("long"))}).where("_f")
    return rows.groupBy(*keys, "_run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n")).drop("_run")


def changes(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Rows whose value differs from the row before, the first included; step numbers them from 0."""
    kept = running(df, keys, {"_was": ("prev", F.col(value))}).where(F.col("_was").isNull() | (F.col("_was") != F.col(value)))
    return running(kept, keys, {"step": ("sum", F.lit(1).cast("long"))}).withColumn("step", F.col("step") - 1).drop("_was")
