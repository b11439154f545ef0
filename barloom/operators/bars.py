"""Bars: resampling, positions, sessions, higher time frames, front-month roll."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.scan import running


def ohlcv(df: DataFrame, keys: list, price: str, order: Column, volume: Column | None = None) -> DataFrame:
    """Open and close by the least and greatest ``order`` (a total one), high, low, volume (rows unless given).

    One shuffle; Spark merges partial results per task.
    """
    vol = F.count("*") if volume is None else F.sum(volume)
    return df.groupBy(*keys).agg(F.min_by(price, order).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, order).alias("c"), vol.cast("long").alias("v"))


def merge_bars(parts: DataFrame, keys: list, order: str) -> DataFrame:
    """Bars of bars: first open, highest high, lowest low, last close, summed volume."""
    return parts.groupBy(*keys).agg(F.min_by("o", order).alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", order).alias("c"), F.sum("v").cast("long").alias("v"))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds 0, 1, ... in the order of columns to rows, without gathering them in one task.

    Rows are dealt by range and a task numbers its own; equal rows of ``order`` share a task. The driver sees one count
    per task. The dealt table must be read again unchanged, so it is written first.
    """
    from barloom.sources.tables import save

    dealt = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "positions")
    tasks = dealt.groupBy(F.shiftright("_at", 33).alias("_task")).agg(F.count("*").alias("n")).orderBy("_task").collect()
    base, before = [], 0
    for r in tasks:
        base.append((r["_task"], before))
        before += r["n"]
    bases = df.sparkSession.createDataFrame(base, "_task long, _base long")
    n = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_task", F.shiftright("_at", 33)).join(F.broadcast(bases), "_task").withColumn(name, n).drop("_at", "_task", "_base")


def with_positions(df: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Adds pos: 0, 1, ... within each series by ts: all rows are numbered, and the series' first number is taken off."""
    numbered = ranked(df, [series, ts], "_n")
    first = numbered.groupBy(series).agg(F.min("_n").alias("_first"))
    return numbered.join(first, series).withColumn("pos", F.col("_n") - F.col("_first")).drop("_n", "_first")


def gap_blocks(bars: DataFrame, seconds: int, series: str = "series_id", ts: str = "ts", order: str = "pos") -> DataFrame:
    """Adds blk: how many gaps of over ``seconds`` stand before the bar."""
    df = running(bars, [series], {"_was": ("prev", F.unix_timestamp(ts))}, order)
    new = F.when(F.unix_timestamp(ts) - F.col("_was") > seconds, 1).otherwise(0)
    return running(df.drop("blk"), [series], {"blk": ("sum", new)}, order).drop("_was")


def front_month(volumes: DataFrame, day: str, instrument: str, volume: str) -> DataFrame:
    """Per day the instrument of most volume, the lowest of equals."""
    total = volumes.groupBy(day, instrument).agg(F.sum(volume).alias("vol"))
    w = Window.partitionBy(day).orderBy(F.desc("vol"), F.asc(instrument))
    return total.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(day, F.col(instrument).alias("front"), "vol")


def roll_switches(front: DataFrame, day: str) -> DataFrame:
    """Days whose front differs from the day before."""
    w = Window.orderBy(day)  # one row per day: bounded by the calendar
    return front.withColumn("was", F.lag("front").over(w)).where("was IS NOT NULL AND was <> front").select(day, "was", "front")


def daily(bars: DataFrame) -> DataFrame:
    """Per series and date: first and last position, open, high, low, close, bars."""
    return bars.groupBy("series_id", "date").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("o", "pos").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "pos").alias("c"), F.count("*").alias("n"))


def nbar_ranges(bars: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Ranges of consecutive runs of n bars within keys; a shorter tail is left out."""
    w = Window.partitionBy(*keys).orderBy("pos")
    run = F.floor((F.row_number().over(w) - 1) / n)
    return bars.withColumn("run", run).groupBy(*keys, "run").agg((F.max("h") - F.min("l")).alias("range"), F.count("*").alias("n")).where(F.col("n") == n).drop("n")
