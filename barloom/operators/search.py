"""Exhaustive search over conjunctions of conditions, on one bitmap of conditions per event.

Events are summed by bitmap first; what follows works on distinct bitmaps, whose number depends on the conditions and not
on the events. Conjunctions are enumerated level by level: one lives only if it has enough events in both samples, and
only living ones are extended, by a higher condition, so that no row is made for a conjunction that was pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.tables import save

MOST_CONDITIONS = 63


def bitmap(conditions: dict[str, Column]) -> Column:
    """Bit i is set where the i-th condition holds; null counts as no."""
    if len(conditions) > MOST_CONDITIONS:
        raise ValueError(f"a bitmap holds {MOST_CONDITIONS} conditions")
    out = F.lit(0).cast("long")
    for i, cond in enumerate(conditions.values()):
        out = out.bitwiseOR(F.when(cond, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def name_of(mask: Column, names: list[str]) -> Column:
    """The names of a mask's conditions in their order, joined by plus signs; "all" for none."""
    parts = F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(n)) for i, n in enumerate(names)])
    return F.when(mask == 0, "all").otherwise(F.concat_ws("+", F.filter(parts, lambda x: x.isNotNull())))


def conjunctions(support: DataFrame, n_conditions: int, most: int, least: int) -> DataFrame:
    """(bits, mask): the conjunctions of up to ``most`` conditions that each bitmap fulfils, those with enough events only.

    support has one row per bits: n0 and n1, its events in either sample; a conjunction needs ``least`` in both. The
    empty conjunction (mask 0) is one of them.
    """
    bits_of = F.array(*[F.lit(1 << i).cast("long") for i in range(n_conditions)])
    living = support.select("bits", "n0", "n1", F.lit(0).cast("long").alias("mask"))
    every = []
    for level in range(most + 1):
        if level:
            higher = F.filter(bits_of, lambda b: (b > F.col("mask")) & (F.col("bits").bitwiseAND(b) != 0))
            wider = living.withColumn("bit", F.explode(higher))
            living = wider.select("bits", "n0", "n1", F.col("mask").bitwiseOR(F.col("bit")).alias("mask"))
        enough = living.groupBy("mask").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).where(f"a >= {least} AND b >= {least}")
        living = save(living.join(enough.select("mask"), "mask", "left_semi"), "conjunctions")
        every.append(living)
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out.select("bits", "mask")
