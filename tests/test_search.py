"""Conjunctions of conditions against plain loops."""

import itertools
import random

from pyspark.sql import functions as F

from barloom.operators import search


def test_conjunctions_equal_plain_enumeration(spark):
    rng = random.Random(3)
    names = [f"c{i}" for i in range(7)]
    rows = [(*[rng.random() < 0.1 * (i + 2) if rng.random() < 0.95 else None for i in range(7)], rng.random() < 0.5) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in [*names, "late"]))
    df = df.withColumn("bits", search.bitmap({n: F.col(n) for n in names}))
    support = df.groupBy("bits").agg(F.count_if(~F.col("late")).alias("n0"), F.count_if("late").alias("n1"))
    got = search.conjunctions(support, 7, 3, 15)
    both = got.join(df, "bits").groupBy(search.name_of(F.col("mask"), names).alias("cut")).agg(F.count_if(~F.col("late")).alias("a"), F.count_if("late").alias("b"))
    want = {}
    for k in range(4):
        for some in itertools.combinations(range(7), k):
            hit = [r[7] for r in rows if all(r[i] for i in some)]
            if hit.count(False) >= 15 and hit.count(True) >= 15:
                want["+".join(names[i] for i in some) or "all"] = (hit.count(False), hit.count(True))
    assert {r.cut: (r.a, r.b) for r in both.collect()} == want and len(want) > 20
    assert search.conjunctions(support.limit(0), 7, 3, 1).count() == 0
