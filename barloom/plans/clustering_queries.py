"""Do swings cluster at levels? The grid of sizes, swing widths and tolerances, by circular prefix sums of one histogram each."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import lattice as L
from barloom.operators import features as X
from barloom.operators.resampling import lehmer
from barloom.plans.inputs import EVT, LEVELS, bars_evt
from barloom.plans.registry import query
from barloom.plans.sql_parts import lcg

SIZES, WIDTHS, TOLERANCES = [81.0, 243.0, 729.0, 2187.0], [3, 5, 10, 20], [0.25, 0.5, 1.0]
BINS, SHIFTS, SETS = 2400, 60, 600
PER_CENT, STEP = BINS // 100, BINS // SHIFTS


def level_sets(sets: int = SETS) -> np.ndarray:
    """(sets + 1, levels) of bins: the levels, then sets with their gaps in another order and origin."""
    gaps = np.diff([*L.LEVELS, 100])
    idx, out = np.arange(len(gaps)), [np.array(L.LEVELS) * PER_CENT]
    for s in range(1, sets + 1):
        order = np.lexsort((idx, lehmer(s * 1000003 + idx * 7919 + 17)))
        starts = np.concatenate([[0], np.cumsum(gaps[order])[:-1]])
        out.append((starts * PER_CENT + int(lehmer(np.int64(s * 104729 + 5))) % BINS) % BINS)
    return np.array(out)


def near_levels(hist: np.ndarray, sets: np.ndarray, half: int) -> np.ndarray:
    """(sets, shifts): how much of a circular histogram lies within ``half`` bins of a set's places, moved by every shift.

    Prefix sums make every window a difference of two entries; the windows of one set do not overlap.
    """
    total = np.concatenate([[0], np.cumsum(np.tile(hist, 3))])
    window = total[np.arange(BINS) + BINS + half] - total[np.arange(BINS) + BINS - half]
    moved = (sets[:, None, :] + np.arange(SHIFTS)[None, :, None] * STEP) % BINS
    return window[moved].sum(axis=2)


_SWINGS_OF = " UNION ALL ".join(
    f"SELECT {k} AS k, unnest(list_filter([CASE WHEN h > greatest(a, b) THEN h END, CASE WHEN l < least(c_, d) THEN l END], lambda x: x IS NOT NULL)) AS px FROM"
    f" (SELECT h, l, max(h) OVER p AS a, max(h) OVER f AS b, min(l) OVER p AS c_, min(l) OVER f AS d, count(*) OVER p + count(*) OVER f AS whole FROM bars"
    f" WINDOW p AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING))"
    f" WHERE whole = {2 * k}"
    for k in WIDTHS
)
_GRID = f""", {LEVELS}, sw AS ({_SWINGS_OF}), oc AS (SELECT h AS px FROM bars UNION ALL SELECT l FROM bars), rs AS (SELECT unnest({SIZES}::DOUBLE[]) AS r),
hs AS (SELECT r, k, CAST(floor((px - r * floor(px / r)) / r * {BINS}) AS BIGINT) AS bin, count(*) AS n FROM sw, rs GROUP BY ALL),
ho AS (SELECT r, CAST(floor((px - r * floor(px / r)) / r * {BINS}) AS BIGINT) AS bin, count(*) AS n FROM oc, rs GROUP BY ALL),
tl AS (SELECT unnest({TOLERANCES}::DOUBLE[]) AS tol), bn AS (SELECT unnest(range({BINS})) AS bin),
ws AS (SELECT r, k, tol, (bin + {BINS} - d) % {BINS} AS bin, sum(n) AS x FROM hs, tl, (SELECT unnest(range(-{PER_CENT}, {PER_CENT})) AS d) WHERE d >= -tol * {PER_CENT} AND d < tol * {PER_CENT} GROUP BY ALL),
wo AS (SELECT r, tol, (bin + {BINS} - d) % {BINS} AS bin, sum(n) AS y FROM ho, tl, (SELECT unnest(range(-{PER_CENT}, {PER_CENT})) AS d) WHERE d >= -tol * {PER_CENT} AND d < tol * {PER_CENT} GROUP BY ALL),
gp AS (SELECT idx, coalesce(lead(pct) OVER (ORDER BY idx), 100) - pct AS gap FROM levels),
st AS (SELECT s, idx, gap, {lcg("s * 1000003 + idx * 7919 + 17")} AS u FROM gp, (SELECT unnest(range(1, {SETS + 1})) AS s)),
cs AS (SELECT s, sum(gap) OVER (PARTITION BY s ORDER BY u, idx) - gap AS p FROM st),
ls AS (SELECT 0 AS s, CAST(pct * {PER_CENT} AS BIGINT) AS c FROM levels UNION ALL SELECT s, (CAST(p * {PER_CENT} AS BIGINT) + {lcg("s * 104729 + 5")} % {BINS}) % {BINS} FROM cs),
mv AS (SELECT s, j, (c + j * {STEP}) % {BINS} AS bin FROM ls, (SELECT unnest(range({SHIFTS})) AS j)),
xs AS (SELECT r, k, tol, s, j, sum(x) AS x FROM mv JOIN ws USING (bin) GROUP BY ALL), ys AS (SELECT r, tol, s, j, sum(y) AS y FROM mv JOIN wo USING (bin) GROUP BY ALL),
ns AS (SELECT k, CAST(count(*) AS DOUBLE) AS n FROM sw GROUP BY k), no AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM oc),
al AS (SELECT rs.r, ns.k, tl.tol, sj.s, sj.j, ns.n, coalesce(x, 0) / n AS x, coalesce(y, 0) / m AS y, round(coalesce(x, 0) / n - coalesce(y, 0) / m, 12) AS e
  FROM rs CROSS JOIN ns CROSS JOIN tl CROSS JOIN (SELECT DISTINCT s, j FROM mv) sj CROSS JOIN no LEFT JOIN xs ON xs.r = rs.r AND xs.k = ns.k AND xs.tol = tl.tol AND xs.s = sj.s AND xs.j = sj.j
  LEFT JOIN ys ON ys.r = rs.r AND ys.tol = tl.tol AND ys.s = sj.s AND ys.j = sj.j),
t0 AS (SELECT r, k, tol, n, x AS x0, y AS y0, e AS e0 FROM al WHERE s = 0 AND j = 0),
fz AS (SELECT r, k, tol, avg(x) AS xm, stddev_samp(x) AS xd, avg(e) AS em, stddev_samp(e) AS ed FROM al WHERE s = 0 AND j > 0 GROUP BY ALL),
fr AS (SELECT r, k, tol, count(*) FILTER (x >= x0) AS rank, count(*) FILTER (e >= e0) AS rank_adj, max(e) AS best FROM al JOIN t0 USING (r, k, tol) WHERE s = 0 GROUP BY ALL),
be AS (SELECT r, k, tol, s, max(x) FILTER (j = 0) AS x, max(e) AS best FROM al WHERE s > 0 GROUP BY ALL),
fs AS (SELECT r, k, tol, avg(be.x) AS sm, stddev_samp(be.x) AS sd, count(*) FILTER (be.x >= x0) + 1 AS set_rank, avg(be.best) AS bm, stddev_samp(be.best) AS bd, count(*) FILTER (be.best >= fr.best) + 1 AS best_rank
  FROM be JOIN t0 USING (r, k, tol) JOIN fr USING (r, k, tol) GROUP BY ALL)
SELECT r, CAST(k AS INT) AS k, tol, CAST(n AS BIGINT) AS n, round(x0, 6) AS rate, round(y0, 6) AS occupancy, round((x0 * n - n * tol * 0.4) / sqrt(n * tol * 0.4 * (1 - tol * 0.4)), 4) AS z_uniform,
round((x0 * n - n * y0) / nullif(sqrt(n * y0 * (1 - y0)), 0), 4) AS z_occupancy, round((x0 - xm) / nullif(xd, 0), 4) AS z_phase, round((e0 - em) / nullif(ed, 0), 4) AS z_phase_adj,
CAST(rank AS BIGINT) AS rank, CAST(rank_adj AS BIGINT) AS rank_adj, round((x0 - sm) / nullif(sd, 0), 4) AS z_set, CAST(set_rank AS BIGINT) AS set_rank, round(best, 6) AS best,
round((best - bm) / nullif(bd, 0), 4) AS z_best, CAST(best_rank AS BIGINT) AS best_rank FROM t0 JOIN fz USING (r, k, tol) JOIN fr USING (r, k, tol) JOIN fs USING (r, k, tol)"""

_OUT = (
    "r double, k int, tol double, n long, rate double, occupancy double, z_uniform double, z_occupancy double, z_phase double, z_phase_adj double, "
    "rank long, rank_adj long, z_set double, set_rank long, best double, z_best double, best_rank long"
)


def _score(true, null) -> float | None:
    sd = null.std(ddof=1)
    return round((true - null.mean()) / sd, 4) if sd > 0 else None


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """All tolerances of one size and width, from its histograms of swings and of all extremes."""
    r, k = float(pdf["r"].iloc[0]), int(pdf["k"].iloc[0])
    swings, every = (np.bincount(pdf["bin"], pdf[c], BINS).astype(np.int64) for c in ("swings", "every"))
    n, m, sets, rows = int(swings.sum()), int(every.sum()), level_sets(), []
    for tol in TOLERANCES if n else []:
        half = int(tol * PER_CENT)
        x, y = near_levels(swings, sets, half) / n, near_levels(every, sets, half) / m
        e = np.round(x - y, 12)
        x0, y0, e0, cover = x[0, 0], y[0, 0], e[0, 0], len(L.LEVELS) * 2 * half / BINS
        best = e.max(axis=1)
        spread = np.sqrt(n * y0 * (1 - y0))
        rows.append((
            r, k, tol, n, round(x0, 6), round(y0, 6), round((x0 * n - n * cover) / np.sqrt(n * cover * (1 - cover)), 4), round((x0 * n - n * y0) / spread, 4) if spread > 0 else None,
            _score(x0, x[0, 1:]), _score(e0, e[0, 1:]), int((x[0] >= x0).sum()), int((e[0] >= e0).sum()), _score(x0, x[1:, 0]), int((x[1:, 0] >= x0).sum()) + 1,
            round(best[0], 6), _score(best[0], best[1:]), int((best[1:] >= best[0]).sum()) + 1,
        ))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])


@query(EVT + _GRID)
def swing_robustness(spark, sf_dir):
    """48 cells: sizes, swing widths and tolerances; swings at levels against occupancy, 59 shifts, 600 level sets and their best shifts."""
    bars = bars_evt(spark, sf_dir)
    swings = None
    for k in WIDTHS:
        s = X.fractal_swings(bars, k)
        both = F.filter(F.array(F.when(F.col("swing_hi"), F.col("h")), F.when(F.col("swing_lo"), F.col("l"))), lambda x: x.isNotNull())
        s = s.select(F.lit(k).alias("k"), F.explode(both).alias("px"), F.lit(1).alias("swings"), F.lit(0).alias("every"))
        swings = s if swings is None else swings.unionByName(s)
    every = bars.select(F.explode(F.array(*map(F.lit, WIDTHS))).alias("k"), "h", "l").select("k", F.explode(F.array("h", "l")).alias("px"), F.lit(0).alias("swings"), F.lit(1).alias("every"))
    px, r = F.col("px"), F.col("r")
    at = swings.unionByName(every).withColumn("r", F.explode(F.array(*map(F.lit, SIZES))))
    at = at.groupBy("r", "k", F.floor((px - r * F.floor(px / r)) / r * BINS).alias("bin")).agg(F.sum("swings").alias("swings"), F.sum("every").alias("every"))
    return at.groupBy("r", "k").applyInPandas(_cell, _OUT)  # a histogram each, of BINS rows at most
