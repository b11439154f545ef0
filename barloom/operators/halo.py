"""Windows over a long series without gathering it: chunks of positions with copied edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 200_000


def with_halo(bars: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Adds chunk and core: each row in its own chunk (core) and, near an edge, copied to the neighbour that needs it.

    A frame of at most ``before`` rows back and ``after`` rows ahead by pos then gives the same values in core rows as
    an undivided window, if every chunk's pos are consecutive. At most two copies of a row are made.
    """
    if max(before, after) > chunk:
        raise ValueError("a frame may not reach beyond the next chunk")
    own = F.floor(F.col("pos") / chunk)
    place = F.col("pos") - own * chunk
    copies = F.array(own, F.when(place < after, own - 1), F.when(place >= chunk - before, own + 1))
    return bars.withColumn("_own", own).withColumn("chunk", F.explode(F.filter(F.array_distinct(copies), lambda x: x.isNotNull()))).withColumn("core", F.col("chunk") == F.col("_own")).drop("_own")


def core(df: DataFrame) -> DataFrame:
    return df.where("core").drop("core", "chunk")


def frame(a: int, b: int):
    return Window.partitionBy("series_id", "chunk").orderBy("pos").rowsBetween(a, b)


def ordered():
    return Window.partitionBy("series_id", "chunk").orderBy("pos")
