"""Sums over arcs of a circle of bins: prefix sums once round and again, so that any arc is a difference of two entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(histogram: DataFrame, keys: list[str], bins: int, columns: list[str]) -> DataFrame:
    """(keys, edge, columns): the sums of all bins before each edge, 0 to 2 * bins, going round twice. Absent bins count 0."""
    some = histogram.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = some.join(histogram, [*keys, "bin"], "left").na.fill(0, columns)
    twice = full.withColumn("edge", F.explode(F.array(F.col("bin") + 1, F.col("bin") + 1 + bins)))
    w = Window.partitionBy(*keys).orderBy("edge")  # 2 * bins rows
    sums = twice.select(*keys, "edge", *[F.sum(c).over(w).alias(c) for c in columns])
    zero = histogram.select(*keys).distinct().select(*keys, F.lit(0).alias("edge"), *[F.lit(0).cast(sums.schema[c].dataType).alias(c) for c in columns])
    return sums.unionByName(zero)


def arc_sums(arcs: DataFrame, prefix: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """arcs (keys, lo, hi and their own columns, 0 <= lo <= hi) with the sums of the bins from lo to hi - 1."""
    ends = {}
    for end in ("lo", "hi"):
        ends[end] = prefix.select(*keys, F.col("edge").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    both = arcs.join(ends["lo"], [*keys, "lo"]).join(ends["hi"], [*keys, "hi"])
    return both.select(*arcs.columns, *[(F.col(f"{c}_hi") - F.col(f"{c}_lo")).alias(c) for c in columns])


def cross_correlation(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For every shift s the sum of own[m] * other[m - s] round the circle; whole numbers stay exact."""
    n = len(own)
    return np.correlate(np.tile(own, 2)[: 2 * n - 1], other, "valid")


def best_shifts(profiles: DataFrame, keys: list[str], period: str, bins: int) -> DataFrame:
    """keys, period, n, shift, fit, at_zero, margin: by how much a period's profile (bin, n) stands later than that of all others.

    shift is the one of the highest correlation, the least of equals in size (the later of two), between -bins / 2 and
    bins / 2; fit and at_zero are its correlation and that of no shift, over the norms; margin is the lead over the best
    shift that is not next to it.
    """
    schema = ", ".join(f"{k} {profiles.schema[k].dataType.simpleString()}" for k in [*keys, period])
    whole = profiles.groupBy(*keys, "bin").agg(F.sum("n").alias("all"))
    full = profiles.select(*keys, period).distinct().join(whole, keys).join(profiles, [*keys, period, "bin"], "left").na.fill(0, ["n"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own, every = (np.bincount(pdf["bin"], pdf[c], bins).astype(np.int64) for c in ("n", "all"))
        other = every - own
        corr = cross_correlation(own, other)
        by_size = np.array(sorted(range(bins), key=lambda s: (min(s, bins - s), s > bins // 2)))
        best = int(by_size[np.argmax(corr[by_size])])
        apart = np.minimum((np.arange(bins) - best) % bins, (best - np.arange(bins)) % bins) > 1
        norm = float(np.sqrt((own**2).sum() * (other**2).sum())) or np.nan
        signed = best - bins if best > bins // 2 else best
        row = [*pdf[[*keys, period]].iloc[0], int(own.sum()), signed, corr[best] / norm, corr[0] / norm, (corr[best] - corr[apart].max()) / norm]
        return pd.DataFrame([row], columns=[*keys, period, "n", "shift", "fit", "at_zero", "margin"])

    return full.groupBy(*keys, period).applyInPandas(one, schema + ", n long, shift int, fit double, at_zero double, margin double")
