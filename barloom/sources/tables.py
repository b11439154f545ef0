"""Intermediate tables in the folder that driver and executors share, written once per session and input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "/tmp/checkpoints"
_KEPT: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master LOCAL_DIR if that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/barloom/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str) -> DataFrame:
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The artifact ``name`` of an input folder: made once per application, read from the shared folder after that."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _KEPT:
        path = new_path(spark, name)
        make().write.option("compression", "zstd").parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def forget() -> None:
    """From here on every artifact is made anew (the files stay)."""
    _KEPT.clear()
