"""Swing-path scoring over bars: the same rows from a batch of bars and from a stream of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions import clock as C
from barloom.operators.features import fractal_swings

DEPTH = 8  # swings that a path looks back on
#: Steps that lock a path, points it must lead by, nodes a step may skip to, minutes before a node is due.
EVIDENCE, MARGIN, MOST_SKIP, SOON = 2, 2, 3, 5
#: Points for a step to the next node, for one that skips, for one the wrong way; by read code its quality.
STEP, SKIP, WRONG = 6, 3, -3
QUALITY = [0, 3, 2, 1, 1]

SWING = "struct<is_high:boolean, a1:int, q1:int, a2:int, q2:int>"


def stream_lut(spark: SparkSession) -> DataFrame:
    """mod, a1, q1, a2, q2: per minute and chain the node (-1: none) by the first read that hits, and its quality.

    The minute must hit exactly, the other two reads within one; reads go before the order of the chain.
    """
    day = spark.range(1440).select(F.col("id").cast("int").alias("mod"))
    read = day.select("mod", F.inline(C.reads(F.floor(F.col("mod") / 60).cast("int"), (F.col("mod") % 60).cast("int"))))
    tol = F.create_map(*[x for k, v in C.STREAM_TOL.items() for x in (F.lit(k), F.lit(v))])[F.col("method")]
    code = F.when(F.col("m") == 0, F.when(F.col("value") == F.col("target"), 1).otherwise(2)).otherwise(F.col("m") + 2)
    hit = read.join(F.broadcast(C.nodes(spark)), F.abs(F.col("value") - F.col("target")) <= tol).withColumn("code", code)
    turn = F.when(F.col("algo") == 1, F.col("idx")).otherwise(-F.col("idx"))
    best = hit.groupBy("mod", "algo").agg(F.min(F.struct("code", turn.alias("turn"), "idx")).alias("b"))
    quality = F.element_at(F.array(*map(F.lit, QUALITY)), F.col("b.code") + 1)
    each = best.groupBy("mod").agg(*[F.max(F.when(F.col("algo") == a, x)).alias(f"{name}{a}") for a in (1, 2) for name, x in (("a", F.col("b.idx")), ("q", quality))])
    return day.join(each, "mod", "left").na.fill(-1, ["a1", "a2"]).na.fill(0, ["q1", "q2"])


def path_state(history: Column, alternate: bool = True) -> dict[str, Column]:
    """Scores, evidence and the last node of each chain (-1: none) of a history (array of SWING, oldest first).

    With alternate, only steps between a high and a low count.
    """
    out = {}
    for algo, sign in ((1, 1), (2, -1)):
        each = F.transform(history, _step(history, f"a{algo}", f"q{algo}", sign, alternate))
        out[f"last{algo}"] = _last(history, f"a{algo}")
        out[f"score{algo}"] = F.aggregate(each, F.lit(0), lambda a, x: a + x["score"])
        out[f"evidence{algo}"] = F.aggregate(each, F.lit(0), lambda a, x: a + x["good"])
    return out


def _last(history: Column, node: str) -> Column:
    """The latest swing's node that is there; -1 if none is."""
    return F.coalesce(F.try_element_at(F.filter(history, lambda x: x[node] >= 0), F.lit(-1))[node], F.lit(-1))


def _step(history: Column, node: str, quality: str, sign: int, alternate: bool):
    """Score of the step from a swing to the next one of the other side; sign is the chain's direction."""

    def step(p: Column, i: Column) -> Column:
        n = F.get(history, i + 1)
        move = (n[node] - p[node]) * sign
        turned = p["is_high"] != n["is_high"] if alternate else F.lit(True)
        known = (i + 1 < F.size(history)) & turned & (p[node] >= 0) & (n[node] >= 0)
        good = known & (move > 0) & (move <= MOST_SKIP)
        score = F.when(good, F.when(move == 1, STEP).otherwise(SKIP) + p[quality] + n[quality]).when(known & (move < 0), WRONG).otherwise(0)
        return F.struct(score.alias("score"), F.when(good, 1).otherwise(0).alias("good"))

    return step


def status() -> Column:
    """Status of rows that have history and the columns of path_state; waiting before the first swing that has a node."""
    s1, s2, e1, e2 = (F.col(c) for c in ("score1", "score2", "evidence1", "evidence2"))
    last = F.element_at("history", -1)
    end = ((e1 >= EVIDENCE) & (last["a1"] == 5) & (s1 >= s2)) | ((e2 >= EVIDENCE) & (last["a2"] == 0) & (s2 >= s1))
    return (
        F.when(F.size("history") == 0, "waiting").when(end, "terminal").when((e1 >= EVIDENCE) & (s1 >= s2 + MARGIN), "locked 1").when((e2 >= EVIDENCE) & (s2 >= s1 + MARGIN), "locked 2")
        .when((e1 >= EVIDENCE) & (e2 >= EVIDENCE), "ambiguous").when(e1 > e2, "leaning 1").when(e2 > e1, "leaning 2").otherwise("unlocked")
    )


def scored(swings: DataFrame) -> DataFrame:
    """series_id, pos, is_high and the path's state at each swing that has a node."""
    return swings.withColumns(path_state(F.col("history"))).withColumn("status", status()).select("series_id", "pos", "is_high", "score1", "evidence1", "score2", "evidence2", "last1", "last2", "status")


def batch_paths(bars: DataFrame, k: int) -> DataFrame:
    """From a table of bars (series_id, pos, h, l, mod): windows alone."""
    sw = fractal_swings(bars, k).where("swing_hi OR swing_lo").join(F.broadcast(stream_lut(bars.sparkSession)), "mod").where("a1 >= 0 OR a2 >= 0")
    sw = sw.withColumn("is_high", F.col("swing_hi"))
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(-(DEPTH - 1), 0)
    return scored(sw.withColumn("history", F.collect_list(F.struct("is_high", "a1", "q1", "a2", "q2")).over(w)))


def stream_paths(bars: DataFrame, k: int) -> DataFrame:
    """From a stream of bars in order of pos per series: a ring of 2k + 1 bars and DEPTH swings are the state of a series.

    Bars of a trigger are sorted; a bar at or before the last one seen is late and dropped.
    """
    lut = {r["mod"]: (r["a1"], r["q1"], r["a2"], r["q2"]) for r in stream_lut(bars.sparkSession).where("a1 >= 0 OR a2 >= 0").collect()}  # 1,440 rows at most

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        ring, past = ([], []) if not state.exists else ([tuple(x) for x in state.get[0]], [tuple(x) for x in state.get[1]])
        found = []
        for bar in pd.concat(list(frames)).sort_values("pos")[["pos", "h", "l", "mod"]].itertuples(index=False, name=None):
            if ring and bar[0] <= ring[-1][0]:
                continue
            ring = [*ring, bar][-(2 * k + 1) :]
            if len(ring) == 2 * k + 1:
                mid, rest = ring[k], ring[:k] + ring[k + 1 :]
                high, low = all(mid[1] > x[1] for x in rest), all(mid[2] < x[2] for x in rest)
                if (high or low) and mid[3] in lut:
                    past = [*past, (high, *lut[mid[3]])][-DEPTH:]
                    found.append((key[0], int(mid[0]), high, [dict(zip(("is_high", "a1", "q1", "a2", "q2"), x)) for x in past]))
        state.update((ring, past))
        yield pd.DataFrame(found, columns=["series_id", "pos", "is_high", "history"])

    out = f"series_id string, pos long, is_high boolean, history array<{SWING}>"
    kept = f"ring array<struct<pos:long, h:double, l:double, mod:int>>, past array<{SWING}>"
    few = bars.select("series_id", "pos", "h", "l", F.col("mod").cast("int").alias("mod"))
    return scored(few.groupBy("series_id").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout))


def stream_hits(spark: SparkSession) -> DataFrame:
    """mod, algo, idx of all nodes that a read of the minute hits, with the tolerances of the scorer."""
    day = spark.range(1440).select(F.col("id").cast("int").alias("mod"))
    read = day.select("mod", F.inline(C.reads(F.floor(F.col("mod") / 60).cast("int"), (F.col("mod") % 60).cast("int"))))
    tol = F.create_map(*[x for k, v in C.STREAM_TOL.items() for x in (F.lit(k), F.lit(v))])[F.col("method")]
    return read.join(F.broadcast(C.nodes(spark)), F.abs(F.col("value") - F.col("target")) <= tol).select("mod", "algo", "idx").distinct()


def candidates(paths: DataFrame, soon: int = SOON) -> DataFrame:
    """Adds to rows of scored() with their minute, mod: each chain's next node and the minutes until it, the primary one of
    both (that of a locked path, else the nearer, the first chain's of equals), and whether it is soon or due.

    The tables joined have a row a minute, chain and node at most, so this is a projection with lookups for streams, too.
    """
    spark = paths.sparkSession
    hits = stream_hits(spark).withColumnRenamed("mod", "to")
    ahead = spark.range(1440).select(F.col("id").cast("int").alias("mod"), F.explode(F.sequence(F.lit(1), F.lit(720))).alias("step"))
    first = ahead.withColumn("to", (F.col("mod") + F.col("step")) % 1440).join(F.broadcast(hits), "to").groupBy("mod", "algo", "idx").agg(F.min("step").alias("step"))
    out = paths
    for algo, move in ((1, 1), (2, -1)):
        nxt = F.when((F.col(f"last{algo}") >= 0) & (F.col(f"last{algo}") + move).between(0, len(C.CHAINS[algo]) - 1), F.col(f"last{algo}") + move)
        table = first.where(F.col("algo") == algo).select("mod", F.col("idx").alias(f"next{algo}"), F.col("step").alias(f"step{algo}"))
        out = out.withColumn(f"next{algo}", nxt).join(F.broadcast(table), ["mod", f"next{algo}"], "left")
    far = F.lit(999_999)
    s1, s2 = F.coalesce("step1", far), F.coalesce("step2", far)
    primary = F.when(F.col("status") == "locked 1", 1).when(F.col("status") == "locked 2", 2).when(s1 <= s2, 1).otherwise(2)
    out = out.withColumn("primary", primary).withColumn("primary_step", F.when(F.col("primary") == 1, F.col("step1")).otherwise(F.col("step2")))
    return out.withColumns({"soon": F.coalesce(F.col("primary_step") == soon, F.lit(False)), "due": F.coalesce(F.col("primary_step") == 1, F.lit(False))})


def minute_bars(ticks: DataFrame, ts: str, price: str, order: str, keys: list[str], late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Tumbling OHLCV bars of a stream; rows later than the watermark are dropped."""
    t = ticks.withWatermark(ts, late)
    o = F.struct(ts, order)
    return t.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.min_by(price, o).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, o).alias("c"), F.count("*").alias("v")).select(*keys, F.col("w.start").alias("ts"), "o", "h", "l", "c", "v")


def activity_sessions(ticks: DataFrame, ts: str, keys: list[str], gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows of a stream: runs of rows with no gap of ``gap``."""
    t = ticks.withWatermark(ts, late)
    return t.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "n")


def sliding_bars(ticks: DataFrame, ts: str, value: str, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Counts, highs and lows of a stream in overlapping windows; a window is given once the watermark has passed its end."""
    t = ticks.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), *keys)
    return t.agg(F.count("*").alias("n"), F.max(value).alias("h"), F.min(value).alias("l")).select(*keys, F.col("w.start").alias("start_ts"), "n", "h", "l")


def counted_late(ticks: DataFrame, ts: str, keys: list[str], late_seconds: int) -> DataFrame:
    """Per key and micro-batch: rows in time, rows too late, and by how many seconds the latest of them was.

    A row is too late if its key had a row more than late_seconds after it in an earlier batch: what a watermark of the
    same delay would drop is counted in a row of its own. The state is one number a key.
    """
    kinds = ", ".join(f"{k} {ticks.schema[k].dataType.simpleString()}" for k in keys)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        before = state.get[0] if state.exists else None
        newest, n, late, worst = before, 0, 0, 0.0
        for f in frames:
            at = (f[ts] - pd.Timestamp(0)).dt.total_seconds()
            behind = before - late_seconds - at if before is not None else at * 0 - 1
            n, late, worst = n + int((behind <= 0).sum()), late + int((behind > 0).sum()), max(worst, float(behind.max()))
            newest = float(at.max()) if newest is None else max(newest, float(at.max()))
        state.update((newest,))
        yield pd.DataFrame([(*key, n, late, worst)], columns=[*keys, "in_time", "late", "most_behind"])

    few = ticks.select(*keys, ts)
    return few.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, in_time long, late long, most_behind double", "newest double", "append", GroupStateTimeout.NoTimeout)
