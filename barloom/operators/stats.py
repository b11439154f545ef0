"""Scores against null models, resampling, trade statistics, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.scan import running


def score_against_phases(rates: DataFrame) -> DataFrame:
    """One row from (phase, rate, n): the true lattice's rate against its shifts: mean, deviation, z, rank (1: none as high)."""
    true, null = F.col("phase") == 0, F.col("phase") != 0
    base = rates.where(true).select(F.col("rate").alias("_r0"))
    mean, sd = F.avg(F.when(null, F.col("rate"))), F.stddev_samp(F.when(null, F.col("rate")))
    observed = F.max(F.when(true, F.col("rate")))
    return rates.crossJoin(F.broadcast(base)).agg(  # one row to few: a phase each
        F.max(F.when(true, F.col("n"))).alias("n"), F.round(observed, 6).alias("rate"), F.round(mean, 6).alias("null_mean"), F.round(sd, 6).alias("null_sd"),
        F.round((observed - mean) / F.nullif(sd, F.lit(0.0)), 4).alias("z"), (F.count_if(null & (F.col("rate") >= F.col("_r0"))) + 1).alias("rank"),
    )


def cells_against_phases(rates: DataFrame, keys: list[str]) -> DataFrame:
    """score_against_phases for each key of (keys, phase, rate, n): n, rate, null_mean, null_sd, z, rank."""
    true, null = F.col("phase") == 0, F.col("phase") != 0
    base = rates.where(true).select(*keys, F.col("rate").alias("_r0"), F.col("n").alias("_n0"))
    mean, sd = F.avg(F.when(null, F.col("rate"))), F.stddev_samp(F.when(null, F.col("rate")))
    return rates.join(base, keys).groupBy(*keys, "_r0", "_n0").agg(
        F.round(mean, 6).alias("null_mean"), F.round(sd, 6).alias("null_sd"), F.round((F.col("_r0") - mean) / F.nullif(sd, F.lit(0.0)), 4).alias("z"),
        (F.count_if(null & (F.col("rate") >= F.col("_r0"))) + 1).alias("rank"),
    ).select(*keys, F.col("_n0").alias("n"), F.round("_r0", 6).alias("rate"), "null_mean", "null_sd", "z", "rank")


def binomial_z(hits: Column, n: Column, p: Column) -> Column:
    return (hits - n * p) / F.sqrt(n * p * (1 - p))


def shifted_rates(histogram: DataFrame, mask: DataFrame, bins: int, shifts: int, step: int) -> DataFrame:
    """Share of a histogram (bin, cnt) under a mask (bin) moved by j * step bins, for every shift j: one equi-join."""
    moved = mask.select("bin", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))).alias("shift")).select(F.pmod(F.col("bin") + F.col("shift") * step, F.lit(bins)).alias("bin"), "shift")
    total = histogram.agg(F.sum("cnt").alias("_all"))
    hit = moved.join(histogram, "bin").groupBy("shift").agg(F.sum("cnt").alias("hits"))
    return hit.crossJoin(F.broadcast(total)).select("shift", "hits", (F.col("hits") / F.col("_all")).alias("rate"))


def lcg(x: Column, modulus: int = 2_147_483_647) -> Column:
    """Two rounds of the Lehmer generator (16807): a reproducible index that SQL can also make."""
    once = (x * 16807) % modulus
    return (once * 16807) % modulus


def cluster_bootstrap(clusters: DataFrame, replicates: int, order: str) -> DataFrame:
    """(rep, mean) from (order, s, n) rows, one per cluster: each replicate draws as many clusters with replacement.

    Clusters are few (days); replicates times clusters rows meet them in an equi-join on the drawn index.
    """
    w = Window.orderBy(order)  # one row per cluster
    indexed = clusters.withColumn("_i", F.row_number().over(w) - 1)
    k = indexed.agg(F.count("*").alias("_k"))
    draws = indexed.select("_i").crossJoin(F.broadcast(k)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.select("rep", (lcg(F.col("rep").cast("long") * 1000003 + F.col("_i") * 7919 + 12345) % F.col("_k")).alias("_i"))
    return draws.join(indexed, "_i").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("mean"))


def trade_stats(trades: DataFrame, keys: list[str], pnl: str, order: list[str]) -> DataFrame:
    """n, win rate, mean, profit factor (null without losses), t, total, greatest drawdown (from the first trade's equity)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = trades.withColumn("_eq", F.sum(pnl).over(w)).withColumn("_dd", F.max("_eq").over(w) - F.col("_eq"))
    x, loss = F.col(pnl), -F.sum(F.when(F.col(pnl) < 0, F.col(pnl)))
    sd = F.when(F.count("*") > 2, F.stddev_samp(pnl))
    return run.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((x > 0).cast("double")).alias("win"), F.avg(pnl).alias("mean"), (F.sum(F.when(x > 0, x)) / F.nullif(loss, F.lit(0.0))).alias("pf"),
        (F.avg(pnl) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.count("*"))).alias("t"), F.sum(pnl).alias("total"), F.max("_dd").alias("max_dd"),
    )


def weighted_trend(x: Column, y: Column, weight: Column) -> Column:
    """Slope of the least-squares line with squared weights ``weight``."""
    sw, sx, sy = F.sum(weight), F.sum(weight * x), F.sum(weight * y)
    return (sw * F.sum(weight * x * y) - sx * sy) / F.nullif(sw * F.sum(weight * x * x) - sx * sx, F.lit(0.0))


def transitions(df: DataFrame, state: str, keys: list[str], order: str) -> DataFrame:
    """(keys, was, now, n, share): counts of moves between different states, shares by where they left."""
    moves = running(df, keys, {"was": ("prev", F.col(state))}, order).where(F.col("was") != F.col(state))
    counts = moves.groupBy(*keys, "was", F.col(state).alias("now")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "was")))
