"""Price lattice: blocks of size R with fixed percentage levels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The levels of a block in percent (100 is 0 of the next block).
LEVELS = [0, 3, 7, 11, 17, 23, 29, 35, 41, 47, 50, 53, 59, 65, 71, 77, 83, 89, 93, 97]
#: The edges of the layers, and zones as half-open percent ranges.
LAYER_EDGES = [0, 11, 23, 41, 59, 77, 89, 100]
ZONES = {"EXT": [(0, 3), (97, 100)], "EQ": [(47, 53)], "FV": [(27.5, 30.5), (69.5, 72.5)], "GIP": [(15.5, 18.5), (81.5, 84.5)]}
PO3 = [81, 243, 729, 2187, 6561]
ROUND_STEPS = [25, 50, 100, 500, 1000]


def levels() -> Column:
    return F.array(*[F.lit(float(x)) for x in LEVELS])


def block_pct(price: Column, size: Column, phase: Column | None = None) -> Column:
    """Place in the block, in percent of [0, 100); phase moves the lattice by percent points of the block."""
    x = price if phase is None else price - size * phase / 100
    return (x - size * F.floor(x / size)) / size * 100


def block_bin(price: Column, size: Column, bins: int) -> Column:
    """Which of ``bins`` equal parts of the block holds the price; not by way of percent, which rounds across an edge."""
    return F.floor((price - size * F.floor(price / size)) / size * bins)


def circular(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 100 - d)


def on_level(pct: Column, tol: float) -> Column:
    return F.exists(levels(), lambda x: circular(pct, x) <= tol)


def level_index(pct: Column, tol: float) -> Column:
    """Index of the nearest level, the first of equals, or -1 if it is farther than tol."""
    best = F.array_min(F.transform(levels(), lambda x, i: F.struct(circular(pct, x).alias("d"), i.alias("i"))))
    return F.when(best["d"] <= tol, best["i"]).otherwise(-1)


def level_floor(pct: Column) -> Column:
    """Index of the highest level at or below pct."""
    return F.size(F.filter(levels(), lambda x: x <= pct)) - 1


def level_price(block: Column, pct: Column, size: Column) -> Column:
    return (block + pct / 100) * size


def absolute_level_price(j: Column, size: Column) -> Column:
    """Price of the absolute level j: 20 to a block."""
    n = len(LEVELS)
    return level_price(F.floor(j / n), F.element_at(levels(), (F.pmod(j, F.lit(n)) + 1).cast("int")), size)


def nearest_level_price(price: Column, pct: Column, size: Column) -> Column:
    """The nearest price with that percentage; halves go to the even block."""
    return (F.rint(price / size - pct / 100) + pct / 100) * size


def layer_index(pct: Column) -> Column:
    out = F.lit(None).cast("int")
    for i in range(len(LAYER_EDGES) - 2, -1, -1):
        out = F.when((pct >= LAYER_EDGES[i]) & (pct < LAYER_EDGES[i + 1]), i).otherwise(out)
    return out


def in_zone(pct: Column, zone: str) -> Column:
    out = F.lit(False)
    for lo, hi in ZONES[zone]:
        out = out | ((pct >= lo) & (pct < hi))
    return out


def nearest_po3(x: Column, sizes: list[int] = [27, *PO3]) -> Column:  # noqa: B006
    """The power of three nearest in log space, the smaller of equals."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.ln(x) - F.ln(F.lit(float(p)))).alias("d"), F.lit(p).alias("p")) for p in sizes]))
    return near["p"]


def round_distance(price: Column, step: float) -> Column:
    rest = price - step * F.floor(price / step)
    return F.least(rest, step - rest)


def round_depth(price: Column, tol: float) -> Column:
    return sum((F.when(round_distance(price, s) <= tol, 1).otherwise(0) for s in ROUND_STEPS), F.lit(0))


def snap(price: Column, pct: Column, size: Column, u: Column, fraction: float) -> Column:
    """Moves the rows with u < fraction onto the nearest level price: a known effect for power tests."""
    return F.when(u < fraction, nearest_level_price(price, pct, size)).otherwise(price)
