"""Resampling within tasks: labels permuted inside a cluster, clusters weighted at random; draws that SQL can make, too."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from barloom.operators.scan import by_group

BLOCK = 250  # replicates at once
#: Shares of the Poisson distribution of mean 1 up to 0, 1, 2...
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def lehmer(x: np.ndarray) -> np.ndarray:
    """Two rounds of the Lehmer generator, as stats.lcg."""
    return x * 16807 % 2147483647 * 16807 % 2147483647


def shuffled(cluster: int, n: int, replicates: np.ndarray) -> np.ndarray:
    """Row j of a replicate takes the value of row out[rep, j]: its rank by a draw that cluster, replicate and row fix."""
    row = np.arange(1, n + 1)
    draw = lehmer(replicates[:, None] * 7368787 + cluster % 100000 * 104729 + row[None, :] * 15485863 + 1)
    order = np.argsort(draw, axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(n), order.shape), axis=1)
    return out


def permuted_sums(df: DataFrame, cluster: str, order: list[str], label: str, value: str, replicates: int) -> DataFrame:
    """(rep, label, s, n): sums of a value by label, the labels permuted within each cluster, for every replicate.

    A task holds one cluster (an integer, such as a day) at a time and keeps one vector of sums a label; rows are not
    copied. ``order`` makes the order within a cluster a total one.
    """
    kinds = {f.name: f for f in df.schema.fields}
    schema = StructType([kinds[label]]).add("s", ArrayType(DoubleType())).add("n", LongType())

    def run(batches):
        sums: dict = {}
        kind = None
        for rows in by_group(batches, [cluster]):
            kind = rows.schema.field(label).type
            labels = rows.column(label).combine_chunks().dictionary_encode()
            codes, names = labels.indices.to_numpy(zero_copy_only=False), labels.dictionary.to_pylist()
            y = rows.column("_y").to_numpy()
            at = int(rows.column(cluster)[0].as_py())
            for name, k in zip(names, np.bincount(codes, minlength=len(names)).tolist()):
                total, n = sums.setdefault(name, (np.zeros(replicates), 0))
                sums[name] = (total, n + k)
            for lo in range(0, replicates, BLOCK):
                some = np.arange(lo, min(lo + BLOCK, replicates))
                moved = y[shuffled(at, len(y), some)]
                for c, name in enumerate(names):
                    sums[name][0][some] += moved[:, codes == c].sum(axis=1)
        if sums:
            arrays = [pa.array(list(sums), kind), pa.array([s for s, _ in sums.values()], pa.list_(pa.float64())), pa.array([n for _, n in sums.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [label, "s", "n"])

    few = df.select(cluster, *dict.fromkeys([label, *order]), F.col(value).cast("double").alias("_y"))
    parts = few.repartition(cluster).sortWithinPartitions(cluster, *order).mapInArrow(run, schema)
    each = parts.select(label, "n", F.posexplode("s").alias("rep", "s"))
    return each.groupBy("rep", label).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def poisson_weights(clusters: np.ndarray, replicates: int) -> np.ndarray:
    """(replicates, clusters): how often a replicate takes a cluster, Poisson of mean 1, fixed by both numbers."""
    draw = lehmer(np.arange(replicates)[:, None] * 1000003 + clusters[None, :] % 100000 * 7919 + 12345) / 2147483647.0
    return np.searchsorted(np.array(POISSON), draw, side="right")


def cluster_intervals(sums: DataFrame, keys: list[str], cluster: str, replicates: int, against: bool = False) -> DataFrame:
    """keys, clusters, n, mean, lo, hi, above: the mean of (s, n) rows, one per key and cluster, with its 95 % interval.

    A Poisson bootstrap: each replicate weighs whole clusters, so what moves together stays together, and all keys see the
    same weights. With ``against`` the statistic is the difference to the mean of s2 and n2. above is the share of
    replicates over zero. A key's rows, one a cluster, are in one task.
    """
    kinds = {f.name: f for f in sums.schema.fields}
    schema = StructType([kinds[k] for k in keys]).add("clusters", "long").add("n", "long")
    for c in ("mean", "lo", "hi", "above"):
        schema = schema.add(c, "double")

    def mean(s, n):
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, s / n, np.nan)

    def run(batches):
        for rows in by_group(batches, keys):
            s, n, at = (rows.column(c).to_numpy() for c in ("s", "n", cluster))
            w = poisson_weights(at.astype(np.int64), replicates)
            stat, true = mean(w @ s, w @ n), mean(s.sum(), n.sum())
            if against:
                s2, n2 = rows.column("s2").to_numpy(), rows.column("n2").to_numpy()
                stat, true = stat - mean(w @ s2, w @ n2), true - mean(s2.sum(), n2.sum())
            stat = stat[~np.isnan(stat)]
            lo, hi = np.percentile(stat, [2.5, 97.5]) if len(stat) else (None, None)
            figures = [len(at), int(n.sum()), float(true), lo, hi, float((stat > 0).mean()) if len(stat) else None]
            types = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
            heads = [rows.column(k).slice(0, 1).combine_chunks() for k in keys]
            yield pa.RecordBatch.from_arrays([*heads, *(pa.array([x], t) for x, t in zip(figures, types))], [*keys, "clusters", "n", "mean", "lo", "hi", "above"])

    return sums.repartition(*keys).sortWithinPartitions(*keys, cluster).mapInArrow(run, schema)
