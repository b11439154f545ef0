"""Bars from the test tables, and the SQL of the same bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import ohlcv, with_positions
from barloom.sources.readers import date_parts
from barloom.sources.tables import cached


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly OHLCV of events per event_type, with pos and date parts; made once per session."""

    def make() -> DataFrame:
        ev = table(spark, sf_dir, "events")
        bars = ohlcv(ev, [F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts")], "value", F.struct("ts", "event_id"))
        return with_positions(bars).withColumns(date_parts(F.col("ts")))

    return cached(spark, "bars_evt", sf_dir, make)


def bars_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV of order prices as one series, with pos; made once per session."""

    def make() -> DataFrame:
        bars = ohlcv(table(spark, sf_dir, "orders"), [F.lit("ord").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("ts")], "o_totalprice", F.col("o_orderkey"))
        return with_positions(bars).withColumns(date_parts(F.col("ts")))

    return cached(spark, "bars_ord", sf_dir, make)


#: SQL of bars_evt; queries' SQL starts with it.
EVT = """WITH RECURSIVE b0 AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_min(value, {'t': ts, 'i': event_id}) AS o, max(value) AS h,
         min(value) AS l, arg_max(value, {'t': ts, 'i': event_id}) AS c, CAST(count(*) AS BIGINT) AS v
  FROM events GROUP BY event_type, date_trunc('hour', ts)),
bars AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS BIGINT) AS pos,
         CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS date, CAST(hour(ts) AS INT) AS hh
  FROM b0)
"""
#: SQL of bars_ord.
ORD = """WITH RECURSIVE b0 AS (
  SELECT 'ord' AS series_id, CAST(o_orderdate AS TIMESTAMP) AS ts, arg_min(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h,
         min(o_totalprice) AS l, arg_max(o_totalprice, o_orderkey) AS c, CAST(count(*) AS BIGINT) AS v
  FROM orders GROUP BY o_orderdate),
bars AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS BIGINT) AS pos,
         CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS date FROM b0)
"""
#: SQL of the levels.
LEVELS = "levels AS (SELECT CAST(u AS DOUBLE) AS pct, CAST(row_number() OVER (ORDER BY u) - 1 AS INT) AS idx FROM unnest([0,3,7,11,17,23,29,35,41,47,50,53,59,65,71,77,83,89,93,97]) t(u))"
