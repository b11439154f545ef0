"""Replays a table as a file stream and collects what a streaming query appends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.tables import shared_dir


def replay(table: DataFrame, order: str, query: Callable[[DataFrame], DataFrame], parts: int = 3, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Feed table in ``parts`` slices by ranges of a column, one a micro-batch, through query; read what its sink got.

    A slice is written by as many tasks as the table has; then the query runs until it has taken the slice in, and goes
    on from its own checkpoint with the next. Rows without an order come first. finish makes one more last slice: rows
    that move the watermark past all windows.
    """
    spark = table.sparkSession
    root = f"{shared_dir(spark)}/barloom/replay-{uuid.uuid4().hex}"
    x = F.col(order).cast("double")
    cuts = table.select(F.percentile(x, [i / parts for i in range(1, parts)]).alias("c")).first()["c"]
    edges = [None, *(cuts or []), None]
    out = None

    def feed(slice_: DataFrame) -> DataFrame:
        slice_.write.mode("append").parquet(f"{root}/in")
        made = query(spark.readStream.schema(table.schema).parquet(f"{root}/in"))
        sink = made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return made

    for a, b in zip(edges, edges[1:]):
        known = (F.lit(True) if a is None else x > a) & (F.lit(True) if b is None else x <= b)
        out = feed(table.where(known if a is not None else F.coalesce(known, F.lit(True))))
    if finish:
        out = feed(finish(table))
    return spark.read.schema(out.schema).parquet(f"{root}/out")
