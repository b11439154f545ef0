"""First-passage outcomes: one resolver for races between a stop and a target after an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def future(events: DataFrame, bars: DataFrame, horizon: int, start: int = 1) -> DataFrame:
    """Each event with the bars at pos + start to pos + horizon (columns w, bh, bl, bc): a bucketed range join.

    Bars are keyed by pos // horizon; an event goes to the buckets that its span covers, two as a rule, so the join is
    an equi-join with a residual test. Left outer: an event without later bars has one row of nulls.
    """
    wide = max(1, horizon)
    b = bars.select(F.col("series_id").alias("_s"), F.col("pos").alias("_p"), F.floor(F.col("pos") / wide).alias("_k"), F.col("h").alias("bh"), F.col("l").alias("bl"), F.col("c").alias("bc"))
    spans = F.sequence(F.floor((F.col("pos") + start) / wide), F.floor((F.col("pos") + horizon) / wide))
    e = events.withColumn("_bucket", F.explode(spans))
    on = (e["series_id"] == b["_s"]) & (e["_bucket"] == b["_k"]) & (b["_p"] >= e["pos"] + start) & (b["_p"] <= e["pos"] + horizon)
    return e.join(b, on, "left").withColumn("w", F.col("_p") - F.col("pos")).drop("_s", "_p", "_k", "_bucket")


def race(events: DataFrame, bars: DataFrame, keys: list[str], horizon: int, win: Column, lose: Column, tie: str = "lose", start: int = 1, lose_from: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """keys, carried columns, t_win, t_lose and outcome: 1 win, -1 loss, 0 neither within the horizon, null if dropped.

    win and lose are conditions over the event's columns and the bar's bh, bl, bc. start is the first bar that can win
    (0: the event's own); lose_from the first that can lose, if another. A bar that does both counts by tie: ``lose``
    or ``drop``.
    """
    lose_from = start if lose_from is None else lose_from
    rows = future(events, bars, horizon, min(start, lose_from))
    t_win = F.min(F.when((F.col("w") >= start) & win, F.col("w")))
    t_lose = F.min(F.when((F.col("w") >= lose_from) & lose, F.col("w")))
    out = rows.groupBy(*keys, *(carry or [])).agg(t_win.alias("t_win"), t_lose.alias("t_lose"))
    far = F.lit(1 << 30)
    a, b = F.coalesce("t_win", far), F.coalesce("t_lose", far)
    tied = F.lit(-1) if tie == "lose" else F.lit(None).cast("int")
    return out.withColumn("outcome", F.when((a == b) & (a < far), tied).when(a < b, 1).when(b < a, -1).otherwise(0))


def hit_times(events: DataFrame, bars: DataFrame, keys: list[str], horizon: int, conditions: dict[str, tuple[int, Column]]) -> DataFrame:
    """keys and, per name, the first w >= its start where its condition holds (null if never)."""
    rows = future(events, bars, horizon, min(s for s, _ in conditions.values()))
    return rows.groupBy(*keys).agg(*[F.min(F.when((F.col("w") >= s) & c, F.col("w"))).alias(name) for name, (s, c) in conditions.items()])


def retests(breaks: DataFrame, bars: DataFrame, keys: list[str], beyond: Column, back: Column, horizon: int) -> DataFrame:
    """t_gone: first bar beyond; t_back: first later bar back at the line (within the horizon); null if never."""
    rows = future(breaks, bars, horizon)
    gone = rows.groupBy(*keys).agg(F.min(F.when(beyond, F.col("w"))).alias("t_gone"))
    later = rows.join(gone, keys).where(back & (F.col("w") > F.col("t_gone"))).groupBy(*keys).agg(F.min("w").alias("t_back"))
    return gone.join(later, keys, "left")
