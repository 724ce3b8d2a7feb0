"""Queries of the live signals' batch twins over the events, with recursive statements of the same folds in DuckDB.

Windows of seconds are scaled to hours, as the table has one event of a user in many hours.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import desync as Y
from evidentia.plans.queries import HOUR, _tel_sql, query
from evidentia.sources.telemetry import events_as_telemetry
from evidentia.streaming import signals as S


@query(_tel_sql(f"""
, m AS (SELECT session_id AS s, 'r' || (id % 2) AS key, t, seq, CASE k WHEN 'err' THEN 'drop' WHEN 'nav' THEN 'reopen' WHEN 'net.res' THEN 'open' ELSE 'seen' END AS what, 'x' || (id % 4) AS res, (floor(dur)::BIGINT % 3)::VARCHAR AS digest FROM tel)
, b AS (SELECT a.* FROM m a WHERE a.what = 'reopen' AND (SELECT arg_max(c.what, (c.t, c.seq)) FROM m c WHERE c.s = a.s AND c.key = a.key AND c.what <> 'seen' AND (c.t, c.seq) < (a.t, a.seq)) = 'drop')
, p AS (SELECT *, lag(t) OVER w AS bt, lag(seq) OVER w AS bs, lag(digest) OVER w AS bd FROM m WHERE what = 'seen' WINDOW w AS (PARTITION BY s, key, res ORDER BY t, seq))
, c AS (SELECT p.s, p.key, p.res, p.t, p.seq, max((b.t, b.seq)) AS since FROM p JOIN b ON b.s = p.s AND b.key = p.key AND (b.t, b.seq) < (p.t, p.seq) WHERE p.bd <> p.digest GROUP BY ALL)
, f AS (SELECT c.s, c.key, since, arg_min(c.res, (c.t, c.seq)) AS res FROM c JOIN p USING (s, key, res, t, seq) WHERE (p.bt, p.bs) < c.since AND c.t - c.since[1] <= 48 * {HOUR} GROUP BY ALL)
SELECT b.s AS session_id, b.key, b.t, CASE WHEN f.res IS NULL THEN 'unverified' ELSE 'changed' END AS what, coalesce(f.res, '') AS detail FROM b LEFT JOIN f ON f.s = b.s AND f.key = b.key AND f.since = (b.t, b.seq)"""))
def stream_reconnects(spark, sf_dir):
    """Every reconnect of a connection, and whether what it shows had changed."""
    what = F.when(F.col("k") == "err", "drop").when(F.col("k") == "nav", "reopen").when(F.col("k") == "net.res", "open").otherwise("seen")
    detail = F.concat(F.lit("x"), (F.col("id") % 4).cast("string"), F.lit(" "), (F.floor("dur") % 3).cast("string"))
    marks = events_as_telemetry(spark, sf_dir).select("session_id", F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("key"), "t", "seq", what.alias("what"), detail.alias("detail"))
    return Y.reconnects(marks, 48 * HOUR)


@query(_tel_sql(f"""
, f AS (SELECT k, request_id, min(t) AS t FROM tel GROUP BY ALL)
SELECT k AS service, 'auto-' || k || '-' || (f.t // (12 * {HOUR})) AS session_id, count(*)::BIGINT AS n, count(DISTINCT request_id)::BIGINT AS traces FROM tel JOIN f USING (k, request_id) GROUP BY ALL"""))
def trace_sessions(spark, sf_dir):
    """Rows of each service by the tumbling session that their trace belongs to."""
    rows = events_as_telemetry(spark, sf_dir).select(F.col("k").alias("service"), F.col("request_id").alias("trace_id"), "t", "seq")
    return S.tumbling_sessions(rows, 12 * 60).groupBy("service", "session_id").agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("traces"))


@query(_tel_sql(f"""
, e AS (SELECT session_id AS s, t, lead(t) OVER (PARTITION BY session_id ORDER BY t) AS nxt FROM tel WHERE k = 'err')
, d AS (SELECT s, t + 6 * {HOUR} AS due FROM e WHERE nxt IS NULL OR nxt - t >= 6 * {HOUR})
, l AS (SELECT s, min(due) AS due FROM d GROUP BY s)
, looks AS (WITH RECURSIVE r AS (SELECT s, due FROM l UNION ALL SELECT s, (SELECT min(d.due) FROM d WHERE d.s = r.s AND d.due >= r.due + 72 * {HOUR}) FROM r WHERE r.due IS NOT NULL) SELECT * FROM r WHERE due IS NOT NULL)
SELECT s AS session_id, due AS look_t FROM looks"""))
def early_session_looks(spark, sf_dir):
    """When each session is looked at early after its errors."""
    return S.early_looks(events_as_telemetry(spark, sf_dir).where("k = 'err'").select("session_id", "t"), 6 * HOUR, 72 * HOUR)


@query(_tel_sql(f"""
, e AS (SELECT session_id AS s, t, CASE k WHEN 'clk' THEN 1 WHEN 'net.res' THEN 2 WHEN 'nav' THEN 3 END AS e, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS i FROM tel WHERE k IN ('clk', 'net.res', 'nav'))
, runs AS (WITH RECURSIVE r AS (
    SELECT s, 0::BIGINT AS i, 0 AS n, NULL::BIGINT AS last, NULL::BIGINT AS fired FROM (SELECT DISTINCT s FROM e)
    UNION ALL
    SELECT s, i, CASE WHEN e = 1 THEN n + 1 WHEN e = 3 OR hit THEN 0 ELSE n END, CASE WHEN e = 1 THEN t ELSE last END, CASE WHEN hit THEN t END
    FROM (SELECT e.*, r.n, r.last, e.e = 2 AND r.n >= 2 AND e.t - r.last <= 24 * {HOUR} AS hit FROM r JOIN e ON e.s = r.s AND e.i = r.i + 1)
  ) SELECT * FROM r)
SELECT s AS session_id, fired AS t FROM runs WHERE fired IS NOT NULL"""))
def abandoned_sessions(spark, sf_dir):
    """Clicks stand for inputs, answers for hidden pages and navigations for mutations."""
    kind = F.create_map(*[F.lit(x) for p in {"clk": "inp", "net.res": "vis", "nav": "net.req"}.items() for x in p])
    rows = events_as_telemetry(spark, sf_dir).where("k IN ('clk', 'net.res', 'nav')").select("session_id", "seq", "t", kind[F.col("k")].alias("k"), F.lit("hidden").alias("msg"), F.lit("POST").alias("method"))
    return S.abandoned_flows(rows, 24 * HOUR, 2)


@query(_tel_sql(f"""
, e AS (SELECT session_id AS s, 'r' || (id % 3) AS key, what, t, row_number() OVER (PARTITION BY session_id, id % 3, what ORDER BY t) AS i, CASE what WHEN 'requests' THEN 4 ELSE 2 END AS least
  FROM (SELECT *, unnest(CASE WHEN k = 'net.req' THEN ['requests'] WHEN k = 'net.res' AND st >= 400 THEN ['failures'] ELSE [] END) AS what FROM tel))
, runs AS (WITH RECURSIVE r AS (
    SELECT s, key, what, 0::BIGINT AS i, []::BIGINT[] AS times, NULL::BIGINT AS fired FROM (SELECT DISTINCT s, key, what FROM e)
    UNION ALL
    SELECT s, key, what, i, CASE WHEN len(x) >= least THEN [] ELSE x END, CASE WHEN len(x) >= least THEN t END
    FROM (SELECT e.*, list_append(list_filter(r.times, lambda y: e.t - y < 96 * {HOUR}), e.t) AS x FROM r JOIN e ON e.s = r.s AND e.key = r.key AND e.what = r.what AND e.i = r.i + 1)
  ) SELECT * FROM r)
SELECT s AS session_id, key, what AS kind, fired AS t FROM runs WHERE fired IS NOT NULL"""))
def retry_storm_bursts(spark, sf_dir):
    """Bursts of requests and of failures on one endpoint, each starting anew when it fires."""
    e = events_as_telemetry(spark, sf_dir).withColumn("endpoint", F.concat(F.lit("r"), (F.col("id") % 3).cast("string")))
    return S.retry_storms(e, F.col("endpoint"), 96 * HOUR).select("session_id", "key", "kind", "t")
