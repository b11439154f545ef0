"""Scans of long series in chunks: what a chunk does to the state that enters it, carried over one row a chunk, then applied.

A running value or a state machine over a whole series would be one task a series. Here a chunk of positions is a task. A
first pass sums a chunk up, a second carries the state from chunk to chunk over one row each, a third goes through the
chunks again from the state that enters them. Keys are not null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from barloom.sources.tables import save

CHUNK = 100_000


def running(df: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], order: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Adds running values by ``order``, an integer: name -> (kind, column).

    Kinds: ``last`` (latest value that is not null), ``sum`` and ``max`` up to the row, ``prev`` (the row before, if any).
    """
    at, own = "_chunk", {n: f"_{n}" for n in values}
    rows = df.withColumns({own[n]: c for n, (_, c) in values.items()}).withColumn(at, F.floor(F.col(order) / chunk))
    end = {
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))), "sum": F.sum, "max": F.max,
        "prev": lambda c: F.max_by(F.struct(c), F.col(order)),
    }
    ends = rows.groupBy(*keys, at).agg(*[end[k](own[n]).alias(f"{own[n]}_end") for n, (k, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    over = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max, "prev": lambda c: F.last(c)}
    carried = ends.select(*keys, at, *[over[k](f"{own[n]}_end").over(before).alias(f"{own[n]}_in") for n, (k, _) in values.items()])
    w = Window.partitionBy(*keys, at).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n, (kind, _) in values.items():
        c, into = own[n], F.col(f"{own[n]}_in")
        if kind == "last":
            out[n] = F.coalesce(F.last(c, ignorenulls=True).over(upto), into)
        elif kind == "sum":
            local = F.sum(c).over(upto)
            out[n] = F.when(into.isNull(), local).when(local.isNull(), into).otherwise(local + into)
        elif kind == "max":
            out[n] = F.greatest(F.max(c).over(upto), into)
        else:
            out[n] = F.coalesce(F.lag(F.struct(c)).over(w), into)[c]
    return rows.join(carried, [*keys, at]).withColumns(out).drop(at, *own.values(), *[f"{c}_in" for c in own.values()])


def by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The runs of rows of equal values in some columns, each whole; what is held is one run and one batch."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch])
        cut = np.zeros(whole.num_rows, bool)
        for c in names:
            col = whole.column(c).combine_chunks()
            cut[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        if held and any(held[-1].column(c)[-1] != whole.column(c)[0] for c in names):
            cut[0] = True
        starts = np.flatnonzero(cut).tolist()
        for a, b in zip([0, *starts], [*starts, whole.num_rows]):
            if b > a or a in starts:
                if a in starts and held:
                    yield pa.concat_tables(held).combine_chunks()
                    held = []
                if b > a:
                    held.append(whole.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


Map = list[list[float]]


def segmented(
    df: DataFrame, keys: list[str], order: str, chunk: int, summary: Callable[[pa.Table], Map], step: Callable[[list[float], Map], list[float]],
    start: list[float], replay: Callable[[pa.Table, list[float]], pa.Table], out: StructType,
) -> DataFrame:
    """A state machine over each key's rows by ``order``: ``replay`` on every chunk from the state that enters it.

    summary gives a chunk's map from any state to the state behind it, as lists of numbers; step applies one. Both passes
    over rows are independent by chunk; the one between goes over a key's maps in order and keeps one state.
    """
    names = [*keys, "_chunk"]
    rows = save(df.withColumn("_chunk", F.floor(F.col(order) / chunk)), "scan")
    kinds = {f.name: f for f in rows.schema.fields}

    def first_pass(batches):
        for rows in by_group(batches, names):
            cols = [rows.column(c).slice(0, 1).combine_chunks() for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([summary(rows)], pa.list_(pa.list_(pa.float64())))], [*names, "map"])

    def carry(batches):
        known, state = None, start
        for batch in batches:
            entries = []
            for *key, m in zip(*(batch.column(c).to_pylist() for c in [*keys, "map"])):
                if key != known:
                    known, state = key, start
                entries.append(list(state))
                state = step(state, m)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(entries, pa.list_(pa.float64()))], [*names, "state"])

    def second_pass(batches):
        for rows in by_group(batches, names):
            yield from replay(rows.drop_columns(["state"]), rows.column("state")[0].as_py()).to_batches()

    key_types = [kinds[c] for c in names]
    dealt = lambda x: x.repartition(*names).sortWithinPartitions(*names, order)
    maps = dealt(rows.select(*names, *[c for c in df.columns if c not in keys])).mapInArrow(first_pass, StructType([*key_types]).add("map", ArrayType(ArrayType(DoubleType()))))
    entries = maps.repartition(*keys).sortWithinPartitions(*names).mapInArrow(carry, StructType([*key_types]).add("state", ArrayType(DoubleType())))
    both = dealt(rows.join(save(entries, "states"), names))
    return both.mapInArrow(second_pass, out)


# --- greedy de-duplication -------------------------------------------------------------------------------------------


def keep_map(at: np.ndarray, gap: int) -> Map:
    """Of a chunk's sorted distinct positions: those that can be the first kept, and the last kept then.

    Whatever was kept before the chunk bars less than ``gap`` of its places, so the first kept is one of the positions
    there, or the first behind them.
    """
    follow = np.searchsorted(at, at + gap)  # the next kept one, if this is kept
    last = np.arange(len(at))
    jump = np.append(np.where(follow < len(at), follow, last), 0)[:-1]
    while True:  # pointer doubling to the end of each chain
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    n = min(int(np.searchsorted(at, at[0] + gap)) + 1, len(at)) if len(at) else 0
    return [at[:n].astype(float).tolist(), at[jump][:n].astype(float).tolist()]


def keep_step(state: list[float], m: Map, gap: int) -> list[float]:
    first, last = m
    i = int(np.searchsorted(first, state[0] + gap)) if state else 0
    return [last[i]] if i < len(first) else state


def keep_replay(at: np.ndarray, state: list[float], gap: int) -> np.ndarray:
    """Which of a chunk's sorted positions are kept; equal ones stay or go together."""
    kept, i = np.zeros(len(at), bool), int(np.searchsorted(at, state[0] + gap)) if state else 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i], "right"))
        kept[i:j] = True
        i = int(np.searchsorted(at, at[i] + gap))
    return kept


def dedup(events: DataFrame, keys: list[str], gap: int, pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Greedy: the first event of each key stays, then each that is at least gap after the last one kept.

    Rows of equal key and position stay or go together; keys and positions are not null.
    """
    if gap > chunk:
        raise ValueError("the gap may not reach beyond the next chunk")
    columns = events.columns

    def summary(rows: pa.Table) -> Map:
        return keep_map(np.unique(rows.column(pos).to_numpy()), gap)

    def replay(rows: pa.Table, state: list[float]) -> pa.Table:
        return rows.filter(pa.array(keep_replay(rows.column(pos).to_numpy(), state, gap))).select(columns)

    return segmented(events, keys, pos, chunk, summary, lambda s, m: keep_step(s, m, gap), [], replay, events.schema)


# --- zigzag ----------------------------------------------------------------------------------------------------------


def walk(h: list[float], low: list[float], reversal: float, up: bool, ext: float, at: int, start: int, stop: Callable[[bool, int], bool] | None = None):
    """Goes through bars from ``start`` on: (up, ext, at, turns); ends early where the extreme moves to a bar that stop() knows."""
    turns = []
    for i in range(start, len(h)):
        if up and h[i] > ext or not up and low[i] < ext:
            ext, at = (h[i] if up else low[i]), i
        elif up and low[i] < ext * (1 - reversal) or not up and h[i] > ext * (1 + reversal):
            turns.append((i, at, ext, up))
            ext, at, up = (low[i] if up else h[i]), i, not up
        else:
            continue
        if stop and stop(up, i):
            break
    return up, ext, at, turns


def leg_map(h: list[float], low: list[float], pos: list[int], reversal: float) -> Map:
    """A chunk's highs above all before, and lows below: place, price and the state behind the chunk from there.

    Whatever leg enters the chunk, the first bar that moves its extreme or turns it is one of these; from there on the
    entering state is forgotten.
    """
    behind: dict[tuple[bool, int], tuple[bool, float, int]] = {}
    tops, lows = [], []
    for i in range(len(h)):
        if not tops or h[i] > h[tops[-1]]:
            tops.append(i)
        if not lows or low[i] < low[lows[-1]]:
            lows.append(i)
    known = lambda up, i: (up, i) in behind
    for i, up in sorted([(i, True) for i in tops] + [(i, False) for i in lows], reverse=True):
        new_up, ext, at, _ = walk(h, low, reversal, up, h[i] if up else low[i], i, i + 1, known)
        behind[up, i] = behind.get((new_up, at), (new_up, ext, at)) if (new_up, at) != (up, i) else (up, ext, at)
    out: Map = []
    for up, places, price in ((True, tops, h), (False, lows, low)):
        ends = [behind[up, i] for i in places]
        out += [[float(i) for i in places], [price[i] for i in places], [float(e[0]) for e in ends], [e[1] for e in ends], [float(pos[e[2]]) for e in ends]]
    return out


def leg_step(state: list[float], m: Map, reversal: float) -> list[float]:
    up, ext, _ = state
    over = ext if up else ext * (1 + reversal)
    under = ext * (1 - reversal) if up else ext
    i = int(np.searchsorted(m[1], over, "right"))  # the first top above
    j = int(np.searchsorted(-np.asarray(m[6]), -under, "right"))  # the first low below
    top, low = (m[0][i] if i < len(m[0]) else np.inf), (m[5][j] if j < len(m[5]) else np.inf)
    if top == low == np.inf:
        return state
    # of a bar that does both, what moves the extreme counts
    if top < low or top == low and up:
        return [m[2][i], m[3][i], m[4][i]]
    return [m[7][j], m[8][j], m[9][j]]


def zigzag(bars: DataFrame, reversal: float, chunk: int = CHUNK) -> DataFrame:
    """Confirmed turning points: pos of the confirming bar, ext_pos and px of the extreme, is_high.

    A leg starts upwards from the first high. Upwards, a higher high moves the extreme; otherwise a low more than
    ``reversal`` (a fraction) below it confirms it as a swing high and turns the leg downwards from that low; downwards
    likewise.
    """
    names = ["series_id", "pos", "ext_pos", "px", "is_high"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())

    def lists(rows: pa.Table) -> list[list]:
        return [rows.column(c).to_pylist() for c in ("h", "l", "pos")]

    def summary(rows: pa.Table) -> Map:
        return leg_map(*lists(rows), reversal)

    def replay(rows: pa.Table, state: list[float]) -> pa.Table:
        h, low, pos = lists(rows)
        up, ext, at = bool(state[0]), state[1], int(state[2]) if np.isfinite(state[2]) else 0
        *_, turns = walk(h, low, reversal, up, ext, -1, 0)
        series = rows.column("series_id")[0].as_py()
        # an extreme that came in stands before the chunk
        found = [(series, pos[i], pos[e] if e >= 0 else at, px, top) for i, e, px, top in turns]
        cols = list(zip(*found)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    few = bars.select(F.col("series_id").cast("string"), F.col("pos").cast("long"), F.col("h").cast("double"), F.col("l").cast("double"))
    out = StructType().add("series_id", "string").add("pos", "long").add("ext_pos", "long").add("px", "double").add("is_high", "boolean")
    # before the first bar: an upward leg below any price
    return segmented(few, ["series_id"], "pos", chunk, summary, lambda s, m: leg_step(s, m, reversal), [1.0, float("-inf"), -1.0], replay, out)
