"""Pieces of SQL that several queries' oracles share; each follows inputs.EVT or another list of common tables."""

#: swings: bars whose high (hi) or low (lo) stands strictly beyond two bars on each side.
SWINGS = """, sx AS (SELECT *, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) = 2 AND count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) = 2 AS whole,
greatest(max(h) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), max(h) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS mh,
least(min(l) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), min(l) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS ml
FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
swings AS (SELECT *, h > mh AS hi, l < ml AS lo FROM sx WHERE whole AND (h > mh OR l < ml))"""

#: ats: bars with their true range tr, the close before c1 and the mean true range of 20 bars, atr.
ATR = """, tr0 AS (SELECT *, lag(c) OVER w AS c1, greatest(h - l, coalesce(abs(h - lag(c) OVER w), 0), coalesce(abs(l - lag(c) OVER w), 0)) AS tr
FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
ats AS (SELECT *, CASE WHEN pos >= 20 THEN avg(tr) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS atr FROM tr0)"""

LCG = "((({x}) * 16807 % 2147483647) * 16807 % 2147483647)"


def lcg(x: str) -> str:
    return LCG.replace("{x}", x)


def kept(name: str, source: str, keys: str, gap: int) -> str:
    """A table of the rows (keys, pos) of source that greedy de-duplication keeps."""
    cols = [k.strip() for k in keys.split(",")]
    t, same = ", ".join(f"t.{k}" for k in cols), " AND ".join(f"t.{k} = k.{k}" for k in cols)
    s = ", ".join(f"s.{k}" for k in cols)
    return f""", {name} AS (SELECT {keys}, min(pos) AS pos FROM {source} GROUP BY ALL
UNION ALL SELECT {s}, s.pos FROM (SELECT {t}, t.pos, row_number() OVER (PARTITION BY {t} ORDER BY t.pos) AS rn
FROM {name} k JOIN (SELECT DISTINCT {keys}, pos FROM {source}) t ON {same} AND t.pos >= k.pos + {gap}) s WHERE s.rn = 1)"""
