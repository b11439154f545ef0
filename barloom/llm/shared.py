"""What the corpus operators share: word patterns, written intermediate tables, distributed numbering, components."""

from __future__ import annotations

import math
import uuid
import warnings
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.tables import shared_dir

#: Word separators, and what is not part of an alphanumeric word, as Java and Python regular expressions.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """A column name for each wanted one that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/barloom/{tag}-{uuid.uuid4().hex}"


def read_back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """While it holds, rows go to Python in batches of so many: whole texts can be long, and memory goes with the batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive lost executors, and nothing is run twice."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = read_back(spark, path, df)
    out._barloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more, through Spark's own file system layer."""
    for df in tables:
        if path := getattr(df, "_barloom_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            try:
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            except Py4JJavaError as e:  # a file left over costs disk, not rows
                warnings.warn(f"{path} was not deleted: {e.java_exception}", stacklevel=2)


def words_of(text: Column) -> Column:
    """Array of the maximal runs without blanks; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), lambda w: w != "")


def radius_for(similarity: float, miss: float = 1e-8, bits: int = 64) -> int:
    """The least number of SimHash bits (64 or as many as given) that a pair of the similarity exceeds with probability miss at most.

    Sets of similarity s have a cosine of 2s / (1 + s) if they are equally large; each bit differs with the angle over pi.
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    tail, r, term = 1.0, -1, (1 - p) ** bits
    while tail > miss and r < bits:
        r += 1
        tail -= term
        term *= (bits - r) / (r + 1) * p / (1 - p)  # the number of ways alone is beyond a double for many bits
    return r


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge list of longs: (node, label), label the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
    2014): every step is a grouped minimum and a join with a unique key, so a hub's rows are never gathered, and the
    number of steps grows with the logarithm of the longest path. Each step is a written table.
    """
    now = save(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = save(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(now, least, large, least2)
        now = nxt
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a column of 0, 1, ... in the order of columns, which must be a total one; no task gathers more than its share.

    Rows are dealt by range and written, a task numbers its own; the driver sees one count a task. drop() the result
    when it has been read.
    """
    (at,) = free_names(df, "dealt_at")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    dealt = save(dealt, "dealt")
    task = F.shiftright(at, 33)
    counts = dealt.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()  # a row per task
    base, before = [], 0
    for r in counts:
        base.append((r["task"], before))
        before += r["n"]
    bases = df.sparkSession.createDataFrame(base, f"{at}_task long, {at}_base long")
    both = dealt.join(F.broadcast(bases), task == F.col(f"{at}_task"))
    out = both.withColumn(name, F.col(f"{at}_base") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name)
    out._barloom_path = dealt._barloom_path
    return out
