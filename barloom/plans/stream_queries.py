"""Streaming queries by replay, and the batch twins they must equal."""

from pyspark.sql import functions as F

from barloom.functions import clock as C
from barloom.plans.inputs import EVT, bars_evt, table
from barloom.plans.registry import query
from barloom.streaming import paths as P
from barloom.streaming.replay import replay


def minute_of_day(bars):
    """The hourly test bars with a spread-out minute of day, so that clock nodes occur."""
    return bars.select("series_id", "pos", "h", "l", ((F.col("hh") * 60 + F.col("pos") * 7) % 1440).cast("int").alias("mod"))


#: The scoring rule over pairs of swings: the history of eight swings is the last seven pairs.
_PATHS = EVT + f""", m AS (SELECT unnest(range(0, 1440)) AS mod), r AS (SELECT mod, 0 AS m, mod % 60 AS v FROM m UNION ALL SELECT mod, 1, mod // 60 + mod % 60 FROM m UNION ALL SELECT mod, 2, abs(mod // 60 - mod % 60) FROM m),
nd AS (SELECT * FROM (VALUES {", ".join(f"({a}, {i}, {v})" for a, chain in C.CHAINS.items() for i, (_, vals, _) in enumerate(chain) for v in vals)}) t(algo, idx, target)),
hit AS (SELECT mod, algo, idx, CASE WHEN m = 0 THEN 1 ELSE m + 2 END AS code FROM r JOIN nd ON abs(v - target) <= CASE WHEN m = 0 THEN 0 ELSE 1 END),
bst AS (SELECT mod, algo, arg_min(idx, code * 100 + CASE WHEN algo = 1 THEN idx ELSE -idx END) AS idx, min(code) AS code FROM hit GROUP BY mod, algo),
lut AS (SELECT mod, coalesce(max(idx) FILTER (algo = 1), -1) AS a1, coalesce(max(CASE WHEN code = 1 THEN 3 ELSE 1 END) FILTER (algo = 1), 0) AS q1,
coalesce(max(idx) FILTER (algo = 2), -1) AS a2, coalesce(max(CASE WHEN code = 1 THEN 3 ELSE 1 END) FILTER (algo = 2), 0) AS q2 FROM bst GROUP BY mod),
fx AS (SELECT series_id, pos, h, l, (hh * 60 + pos * 7) % 1440 AS mod, count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 AND count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3 AS whole,
greatest(max(h) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), max(h) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS mh,
least(min(l) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), min(l) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS ml FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
sw AS (SELECT series_id, pos, mod, h > mh AS is_high, a1, q1, a2, q2 FROM fx JOIN lut USING (mod) WHERE whole AND (h > mh OR l < ml)),
pr AS (SELECT *, lag(is_high) OVER w <> is_high AS alt, lag(a1) OVER w AS p1, lag(q1) OVER w AS pq1, lag(a2) OVER w AS p2, lag(q2) OVER w AS pq2 FROM sw WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
mv AS (SELECT *, CASE WHEN alt AND a1 >= 0 AND p1 >= 0 THEN a1 - p1 END AS m1, CASE WHEN alt AND a2 >= 0 AND p2 >= 0 THEN p2 - a2 END AS m2 FROM pr),
pt AS (SELECT *, CASE WHEN m1 = 1 THEN 6 + q1 + pq1 WHEN m1 BETWEEN 2 AND 3 THEN 3 + q1 + pq1 WHEN m1 < 0 THEN -3 ELSE 0 END AS s1, CASE WHEN m1 BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS e1,
CASE WHEN m2 = 1 THEN 6 + q2 + pq2 WHEN m2 BETWEEN 2 AND 3 THEN 3 + q2 + pq2 WHEN m2 < 0 THEN -3 ELSE 0 END AS s2, CASE WHEN m2 BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS e2 FROM mv),
sm AS (SELECT series_id, pos, mod, is_high, a1, a2, sum(s1) OVER w AS s1, sum(e1) OVER w AS e1, sum(s2) OVER w AS s2, sum(e2) OVER w AS e2,
coalesce(last_value(CASE WHEN a1 >= 0 THEN a1 END IGNORE NULLS) OVER v, -1) AS last1, coalesce(last_value(CASE WHEN a2 >= 0 THEN a2 END IGNORE NULLS) OVER v, -1) AS last2
FROM pt WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), v AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
ps AS (SELECT series_id, pos, mod, is_high, CAST(s1 AS INT) AS score1, CAST(e1 AS INT) AS evidence1, CAST(s2 AS INT) AS score2, CAST(e2 AS INT) AS evidence2, CAST(last1 AS INT) AS last1, CAST(last2 AS INT) AS last2,
CASE WHEN (e1 >= 2 AND a1 = 5 AND s1 >= s2) OR (e2 >= 2 AND a2 = 0 AND s2 >= s1) THEN 'terminal' WHEN e1 >= 2 AND s1 >= s2 + 2 THEN 'locked 1' WHEN e2 >= 2 AND s2 >= s1 + 2 THEN 'locked 2'
WHEN e1 >= 2 AND e2 >= 2 THEN 'ambiguous' WHEN e1 > e2 THEN 'leaning 1' WHEN e2 > e1 THEN 'leaning 2' ELSE 'unlocked' END AS status FROM sm)"""
_STATE = _PATHS + " SELECT series_id, pos, is_high, score1, evidence1, score2, evidence2, last1, last2, status FROM ps"
K = 3


@query(_STATE)
def path_state(spark, sf_dir):
    return P.batch_paths(minute_of_day(bars_evt(spark, sf_dir)), K)


@query(_STATE)
def stream_path_state(spark, sf_dir):
    return replay(minute_of_day(bars_evt(spark, sf_dir)), "pos", lambda s: P.stream_paths(s, K))


@query(_PATHS + """, fs AS (SELECT a.mod, h.algo, h.idx, min(st) AS step FROM (SELECT DISTINCT mod FROM ps) a, (SELECT unnest(range(1, 721)) AS st) JOIN (SELECT DISTINCT mod AS tm, algo, idx FROM hit) h ON h.tm = (a.mod + st) % 1440 GROUP BY ALL),
cd AS (SELECT ps.*, f1.step AS t1, f2.step AS t2 FROM ps LEFT JOIN fs f1 ON f1.mod = ps.mod AND f1.algo = 1 AND last1 >= 0 AND f1.idx = last1 + 1 LEFT JOIN fs f2 ON f2.mod = ps.mod AND f2.algo = 2 AND last2 >= 0 AND f2.idx = last2 - 1),
pc AS (SELECT *, CASE WHEN status = 'locked 1' THEN 1 WHEN status = 'locked 2' THEN 2 WHEN coalesce(t1, 999999) <= coalesce(t2, 999999) THEN 1 ELSE 2 END AS "primary" FROM cd), pq AS (SELECT *, CASE WHEN "primary" = 1 THEN t1 ELSE t2 END AS ptime FROM pc)
SELECT series_id, pos, CASE WHEN last1 BETWEEN 0 AND 4 THEN last1 + 1 END AS next1, CASE WHEN last2 BETWEEN 1 AND 5 THEN last2 - 1 END AS next2, CAST(t1 AS INT) AS step1, CAST(t2 AS INT) AS step2,
CAST("primary" AS INT) AS primary_chain, CAST(ptime AS INT) AS primary_step, coalesce(ptime = 5, false) AS soon, coalesce(ptime = 1, false) AS due FROM pq""")
def path_candidates(spark, sf_dir):
    """The last node of each chain, the next one and its time, the primary of both, and its alerts."""
    bars = minute_of_day(bars_evt(spark, sf_dir))
    rows = P.candidates(P.batch_paths(bars, K).join(bars.select("series_id", "pos", "mod"), ["series_id", "pos"]))
    return rows.select("series_id", "pos", "next1", "next2", "step1", "step2", F.col("primary").alias("primary_chain"), "primary_step", "soon", "due")


@query("""SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, arg_min(value, {'t': ts, 'i': event_id}) AS o, max(value) AS h, min(value) AS l,
arg_max(value, {'t': ts, 'i': event_id}) AS c, CAST(count(*) AS BIGINT) AS v FROM events GROUP BY ALL""")
def stream_bars(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    end = lambda t: t.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    out = replay(ev, "event_id", lambda s: P.minute_bars(s, "ts", "value", "event_id", ["event_type"], late="60 days", width="1 hour"), finish=end)
    return out.where("event_type <> 'end'").select("event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "o", "h", "l", "c", "v")


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT event_type, run, count(*) AS n FROM
(SELECT *, sum(CASE WHEN d < 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM
(SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS d FROM events)) GROUP BY event_type, run) GROUP BY event_type""")
def stream_sessions(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    end = lambda t: t.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("end").alias("event_type"))
    out = replay(ev, "event_id", lambda s: P.activity_sessions(s, "ts", ["event_type"], "30 minutes", "60 days"), finish=end)
    return out.where("event_type <> 'end'").groupBy("event_type").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("""WITH w AS (SELECT event_type, value, date_trunc('hour', ts) - to_hours(k) AS start FROM events, (SELECT unnest([0, 1, 2]) AS k))
SELECT event_type, strftime(start, '%Y-%m-%d %H') AS hour, CAST(count(*) AS BIGINT) AS n, max(value) AS h, min(value) AS l FROM w GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    """Windows of three hours, one an hour, over a stream."""
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")

    def end(t):
        last = [F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value")]
        return t.limit(1).select(*last)

    out = replay(ev, "event_id", lambda s: P.sliding_bars(s, "ts", "value", ["event_type"], "3 hours", "1 hour", "60 days"), finish=end)
    return out.where("event_type <> 'end'").select("event_type", F.date_format("start_ts", "yyyy-MM-dd HH").alias("hour"), "n", "h", "l")


LATE_SECONDS, SLICES = 86400, 3


@query(f"""WITH d AS (SELECT event_type, event_id * 7919 % 10007 AS arrival, ts FROM events), c AS (SELECT {", ".join(f"quantile_cont(CAST(arrival AS DOUBLE), {i / SLICES!r}) AS c{i}" for i in range(1, SLICES))} FROM d),
s AS (SELECT event_type, epoch(ts) AS at_, CASE WHEN arrival <= c1 THEN 1 WHEN arrival <= c2 THEN 2 ELSE 3 END AS k FROM d, c),
m AS (SELECT event_type, k, max(at_) AS newest FROM s GROUP BY ALL),
b AS (SELECT s.event_type, s.at_, (SELECT max(newest) FROM m WHERE m.event_type = s.event_type AND m.k < s.k) AS before FROM s)
SELECT event_type, CAST(count(*) FILTER (before IS NULL OR at_ >= before - {LATE_SECONDS}) AS BIGINT) AS in_time, CAST(count(*) FILTER (at_ < before - {LATE_SECONDS}) AS BIGINT) AS late,
round(coalesce(max(before - {LATE_SECONDS} - at_) FILTER (at_ < before - {LATE_SECONDS}), 0), 3) AS most_behind FROM b GROUP BY event_type""")
def stream_late_rows(spark, sf_dir):
    """Events that arrive out of order: how many come a day or more after a later one of their type, counted instead of dropped."""
    ev = table(spark, sf_dir, "events").select((F.col("event_id") * 7919 % 10007).alias("arrival"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = replay(ev, "arrival", lambda s: P.counted_late(s, "ts", ["event_type"], LATE_SECONDS), parts=SLICES)
    return out.groupBy("event_type").agg(F.sum("in_time").alias("in_time"), F.sum("late").alias("late"), F.round(F.max("most_behind"), 3).alias("most_behind"))
