"""Clock nodes: reads of HH:MM, chains of nodes, the minute look-up table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The two chains as (label, values, terminal), in index order; the second is walked downwards.
CHAINS = {
    1: [("00", [0], False), ("11/14", [11, 14], False), ("41/44", [41, 44], False), ("03/7", [3, 7], False), ("17/23", [17, 23], False), ("71/77 · 29/35", [71, 77, 29, 35], True)],
    2: [("03/7", [3, 7], True), ("59/65", [59, 65], False), ("17/23", [17, 23], False), ("11/14", [11, 14], False), ("47/53", [47, 50, 53, 56], False), ("29/35", [29, 35], False)],
}
#: Names of the parts of a node that has two groups of values.
GROUPS = {71: "71/77", 77: "71/77", 29: "29/35", 35: "29/35"}
#: Tolerances of the streaming scorer, for the minute and for the other two reads.
STREAM_TOL = {"MM": 0, "HH+MM": 1, "|HH-MM|": 1}


def reads(hh: Column, mm: Column) -> Column:
    """The three reads in order: (method number, name, value, primary)."""
    return F.array(
        F.struct(F.lit(0).alias("m"), F.lit("MM").alias("method"), mm.alias("value"), F.lit(True).alias("primary")),
        F.struct(F.lit(1).alias("m"), F.lit("HH+MM").alias("method"), (hh + mm).alias("value"), F.lit(False).alias("primary")),
        F.struct(F.lit(2).alias("m"), F.lit("|HH-MM|").alias("method"), F.abs(hh - mm).alias("value"), F.lit(False).alias("primary")),
    )


def nodes(spark: SparkSession) -> DataFrame:
    """algo, idx, node, terminal, ord, target: one row per value of a node."""
    rows = [(a, i, label, end, k, v) for a, chain in CHAINS.items() for i, (label, values, end) in enumerate(chain) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "algo int, idx int, node string, terminal boolean, ord int, target int")


def minute_lut(spark: SparkSession, tol: int = 1, primary_only: bool = False) -> DataFrame:
    """Per minute of the day and algo its node: primary reads first, then distance, then order of the chain, method, value.

    1,440 minutes by two chains: a table of fixed size, made once and broadcast.
    """
    day = spark.range(1440).select(F.col("id").cast("int").alias("mod"), F.floor(F.col("id") / 60).cast("int").alias("hh"), (F.col("id") % 60).cast("int").alias("mm"))
    read = day.select("mod", "hh", "mm", F.inline(reads(F.col("hh"), F.col("mm"))))
    if primary_only:
        read = read.where("primary")
    hits = read.join(F.broadcast(nodes(spark)), F.abs(F.col("value") - F.col("target")) <= tol)
    rank = F.struct((~F.col("primary")).alias("sec"), F.abs(F.col("value") - F.col("target")).alias("dist"), "idx", "m", "ord")
    best = hits.groupBy("mod", "hh", "mm", "algo").agg(F.min_by(F.struct("idx", "node", "terminal", "method", "primary", "target"), rank).alias("b"), F.min(rank).alias("r"))
    label = F.coalesce(F.when(F.col("b.terminal") & (F.col("algo") == 1), F.create_map(*[x for k, v in GROUPS.items() for x in (F.lit(k), F.lit(v))])[F.col("b.target")]), F.col("b.node"))
    return best.select("mod", "hh", "mm", "algo", "b.idx", label.alias("label"), "b.terminal", "b.method", "b.primary", F.col("r.dist").alias("dist"), quality(F.col("b.primary"), F.col("r.dist")).alias("quality"))


def quality(primary: Column, dist: Column) -> Column:
    return F.when(primary & (dist == 0), 3).when(primary, 2).otherwise(1)


def both_reads(lut: DataFrame) -> DataFrame:
    """Per minute: the better quality, whether both algos have a node, and whether it is the same."""
    return lut.groupBy("mod").agg(F.max("quality").alias("quality"), (F.count("*") == 2).alias("both"), ((F.count("*") == 2) & (F.min("label") == F.max("label"))).alias("shared"))


def next_nodes(spark: SparkSession) -> DataFrame:
    """algo, idx, next_idx, next_node, end: one up in the first chain, one down in the second; none after the terminal."""
    n = nodes(spark).select("algo", "idx", "node", "terminal").distinct()
    nxt = n.select("algo", F.col("idx").alias("next_idx"), F.col("node").alias("next_node"), F.col("terminal").alias("end"))
    step = F.when(F.col("algo") == 1, F.col("idx") + 1).otherwise(F.col("idx") - 1)
    return n.withColumn("next_idx", step).join(F.broadcast(nxt), ["algo", "next_idx"]).select("algo", "idx", "node", "next_idx", "next_node", "end")


def first_future_time(spark: SparkSession, scan: int = 720, tol: int = 1) -> DataFrame:
    """Per minute, algo and node: steps to the first later minute within scan where a read hits it (over midnight)."""
    day = spark.range(1440).select(F.col("id").cast("int").alias("mod"))
    read = day.select("mod", F.inline(reads(F.floor(F.col("mod") / 60).cast("int"), (F.col("mod") % 60).cast("int"))))
    hit = read.join(F.broadcast(nodes(spark)), F.abs(F.col("value") - F.col("target")) <= tol).select("algo", "idx", F.col("mod").alias("at")).distinct()
    start = day.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(scan)))).withColumn("at", (F.col("mod") + F.col("step")) % 1440)
    return start.join(F.broadcast(hit), "at").groupBy("mod", "algo", "idx").agg(F.min("step").alias("step"))
