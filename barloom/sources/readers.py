"""Readers, inspection and sinks for tick and bar files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Accepted column names by role, in order of preference, compared without case.
ROLES = {
    "ts": ["ts_event", "ts_recv", "timestamp", "datetime", "date_time", "time", "date", "ts", "index", "__index_level_0__"],
    "instrument": ["instrument_id", "symbol_id", "product_id", "instrumentid", "raw_symbol"],
    "open": ["open", "o"], "high": ["high", "h"], "low": ["low", "l"], "close": ["close", "c", "price"], "volume": ["volume", "vol", "v", "size"],
}
FIXED_POINT, FIXED_POINT_FROM = 1e9, 1e6
VENDOR_SCHEMA = "ts string, o double, h double, l double, c double, v double"


@dataclass
class Inspection:
    rows: int
    columns: list[tuple[str, str]]
    first: object = None
    last: object = None
    roles: dict[str, str] = field(default_factory=dict)


def detect_roles(columns: list[str]) -> dict[str, str]:
    """Role to column name, from the names alone."""
    by_name = {c.lower(): c for c in reversed(columns)}
    return {role: by_name[names[0]] for role, aliases in ROLES.items() if (names := [a for a in aliases if a in by_name])}


def inspect_parquet(spark: SparkSession, path: str) -> Inspection:
    df = spark.read.parquet(path)
    roles = detect_roles(df.columns)
    aggs = [F.count("*").alias("n")] + ([F.min(roles["ts"]).alias("a"), F.max(roles["ts"]).alias("b")] if "ts" in roles else [])
    r = df.agg(*aggs).first()
    return Inspection(r["n"], df.dtypes, *((r["a"], r["b"]) if "ts" in roles else (None, None)), roles)


def text_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of comma, semicolon, tab and bar on the second line (the first of a one-line file)."""
    lines = [r[0] for r in spark.read.text(path).limit(2).collect()]
    probe = lines[-1] if lines else ""
    return max(",;\t|", key=lambda d: (probe.count(d), -",;\t|".index(d)))


def scale_of(close: Column) -> Column:
    """price_scale as an aggregate: 1e9 if the median size shows fixed-point integers, else 1.

    How many sizes are beyond the limit tells on which side of it the median lies; if that is just half of them, the
    median is midway between the nearest sizes on both sides. So a task holds two counts and two numbers, not the sizes.
    """
    size = F.abs(close.cast("double"))
    n, over = F.count(size), F.count_if(size > FIXED_POINT_FROM)
    below, above = F.max(F.when(size <= FIXED_POINT_FROM, size)), F.min(F.when(size > FIXED_POINT_FROM, size))
    beyond = (2 * over > n) | ((2 * over == n) & (below + (above - below) * 0.5 > FIXED_POINT_FROM))
    return F.when(beyond, FIXED_POINT).otherwise(1.0)


def price_scale(df: DataFrame, close: str, override: float | None = None) -> float:
    """1e9 if the median size of close shows fixed-point integers, else 1."""
    if override:
        return override
    return df.agg(scale_of(F.col(close))).first()[0]


def read_vendor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon files without header (``YYYYMMDD HHMMSS;o;h;l;c;v``); a glob reads many; equal stamps keep their first row."""
    df = spark.read.schema(VENDOR_SCHEMA).csv(path, sep=";").select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    df = df.withColumn("ts", F.to_timestamp("ts", "yyyyMMdd HHmmss"))
    return first_of_equal(df, ["ts"], ["_file", "_line"]).drop("_file", "_line")


def write_vendor_tree(bars: DataFrame, path: str, series: str = "series_id") -> None:
    """Bars (series, ts, o, h, l, c, v) as semicolon files without header, a folder for each series and day."""
    stamp = F.date_format("ts", "yyyyMMdd HHmmss")
    line = F.concat_ws(";", stamp, *[F.col(c).cast("double").cast("string") for c in "ohlcv"])
    bars.select(F.col(series).alias("series"), F.to_date("ts").alias("day"), line.alias("line")).write.partitionBy("series", "day").text(path)


def read_vendor_tree(spark: SparkSession, path: str) -> DataFrame:
    """The files of write_vendor_tree: series, day, ts, o, h, l, c, v; of equal stamps the first row of the first file stays.

    A filter on series or day reads those folders only.
    """
    df = spark.read.schema(VENDOR_SCHEMA + ", series string, day date").csv(path, sep=";")
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    df = df.withColumn("ts", F.to_timestamp("ts", "yyyyMMdd HHmmss"))
    return first_of_equal(df, ["series", "day", "ts"], ["_file", "_block", "_line"]).drop("_file", "_block", "_line")


def first_of_equal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per keys: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def new_york_to_zurich(local: Column) -> Column:
    """Local New York time as local Zurich time; a repeated hour is its daylight time, a skipped one moves to its end."""
    utc = F.to_utc_timestamp(local, "America/New_York")
    back = F.from_utc_timestamp(utc, "America/New_York")
    # a skipped local time comes back an hour later: its end is that hour's start
    utc = F.when(back != local, F.to_utc_timestamp(F.date_trunc("hour", back), "America/New_York")).otherwise(utc)
    return F.from_utc_timestamp(utc, "Europe/Zurich")


def utc_to_new_york(utc: Column) -> Column:
    return F.from_utc_timestamp(utc, "America/New_York")


def date_parts(ts: Column) -> dict[str, Column]:
    """date, yr, mo, dy, hh, mm, tod (hhmm) and sess of a local time; an evening session carries its own date."""
    date = (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("long")
    hh, mm = F.hour(ts), F.minute(ts)
    return {
        "date": date, "yr": F.year(ts), "mo": F.month(ts), "dy": F.dayofmonth(ts), "hh": hh, "mm": mm,
        "tod": hh * 100 + mm, "sess": date * 10 + F.when(hh >= 18, 1).otherwise(0),
    }


def slice_dates(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows of [start, end), as a filter that reaches the scan."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def write_year_buckets(df: DataFrame, path: str, ts: str = "ts", span: int = 1) -> None:
    bucket = (F.floor(F.year(ts) / span) * span).cast("int")
    df.withColumn("year_bucket", bucket).write.partitionBy("year_bucket").option("compression", "zstd").parquet(path)


def write_cube(df: DataFrame, path: str) -> None:
    df.write.json(path)


def merge_cubes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union of named JSON cubes with a ``cube`` column; columns that one lacks are null."""
    parts = [spark.read.json(p).withColumn("cube", F.lit(name)) for name, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
