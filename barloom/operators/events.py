"""Event builders: touches, arrivals, crossings; greedy de-duplication is scan.dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import lattice as L
from barloom.operators.halo import core, ordered, with_halo
from barloom.operators.scan import dedup  # noqa: F401  one of the event builders


def level_grid(df: DataFrame, phases: Column | None = None) -> DataFrame:
    """df once per level percentage (column pct), and per phase: the lattice moved by phase percent points."""
    out = df.withColumn("pct", F.explode(L.levels()))
    return out if phases is None else out.withColumn("phase", F.explode(phases))


def touched_cells(df: DataFrame, size: Column, phases: int) -> DataFrame:
    """df once per level (pct) and phase (0 to 100, of ``phases`` equal steps) that the bar's range touches.

    The lines of a level over all phases stand size / phases apart, so a range lists its own: no cell is made that the
    range does not come within a billionth of. A range of a block or more touches every phase once.
    """

    def of_level(p):
        lo, hi = ((F.col(c) / size - p / 100) * phases for c in ("l", "h"))
        a, b = F.ceil(lo - 1e-9), F.floor(hi + 1e-9)
        lines = F.when(a <= b, F.sequence(a, F.least(b, a + phases - 1))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda j: F.struct(p.alias("pct"), (F.lit(100.0) * F.pmod(j, F.lit(phases)) / phases).alias("phase")))

    cells = df.withColumn("_cell", F.explode(F.flatten(F.transform(L.levels(), of_level)))).select(*df.columns, "_cell.*")
    shift = size * F.col("phase") / 100
    return cells.where(F.floor((F.col("h") - shift) / size - F.col("pct") / 100) >= F.ceil((F.col("l") - shift) / size - F.col("pct") / 100))


def touched(size: Column, pct: Column) -> Column:
    """The bar's range holds a price of that percentage."""
    return F.floor(F.col("h") / size - pct / 100) >= F.ceil(F.col("l") / size - pct / 100)


def arrivals(bars: DataFrame, size: float, away: float, atr: str = "atr", pcts: list[float] | None = None, lookback: int = 60) -> DataFrame:
    """Touches of the next line above or below the previous close, from at least ``away`` ATR within the look-back.

    pct is the level, above whether the line stood above the previous close; line its price, fixed by that close.
    """
    df = with_halo(bars, lookback + 1, 0)
    w = ordered()
    before = w.rowsBetween(-lookback, -1)
    df = df.withColumns({"_c1": F.lag("c").over(w), "_lo": F.min("c").over(before), "_hi": F.max("c").over(before)})
    df = core(df).where("_c1 IS NOT NULL").withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in pcts or L.LEVELS])))
    base = F.col("_c1") / size - F.col("pct") / 100
    up, dn = (F.floor(base) + 1 + F.col("pct") / 100) * size, (F.ceil(base) - 1 + F.col("pct") / 100) * size
    far = F.col(atr) * away
    sides = F.array(
        F.when((F.col("h") >= up) & (up - F.col("_lo") >= far), F.struct(up.alias("line"), F.lit(True).alias("above"))),
        F.when((F.col("l") <= dn) & (F.col("_hi") - dn >= far), F.struct(dn.alias("line"), F.lit(False).alias("above"))),
    )
    return df.withColumn("_s", F.explode(F.filter(sides, lambda s: s.isNotNull()))).select("*", "_s.*").drop("_s", "_c1", "_lo", "_hi")


def close_crosses(bars: DataFrame, size: float, offset: float = 0.0) -> DataFrame:
    """Bars whose close lies in another block than the close before: up, and the boundary (line) that was crossed last."""
    df = with_halo(bars, 1, 0)
    block = F.floor((F.col("c") - offset) / size)
    df = core(df.withColumn("blk_no", block).withColumn("was", F.lag(block).over(ordered())))
    up = F.col("blk_no") > F.col("was")
    return df.where("was IS NOT NULL AND blk_no <> was").withColumns({"up": up, "line": F.when(up, F.col("blk_no")).otherwise(F.col("blk_no") + 1) * size + offset})
