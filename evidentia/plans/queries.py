"""Registered queries over the shared tables, and their DuckDB forms.

`events` stands in for telemetry through the adapter; windows of seconds are scaled to the table's density where they would be empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import stats
from evidentia.functions import text as X
from evidentia.operators import aggregates as A
from evidentia.operators import compare as C
from evidentia.operators import detectors as D
from evidentia.operators import graph as G
from evidentia.operators import joins as J
from evidentia.operators import locate as L
from evidentia.operators import projections as P
from evidentia.operators import window_correlation as WC
from evidentia.sources.telemetry import TELEMETRY_SQL, events_as_telemetry, millis
from evidentia.streaming import signals

HOUR = 3_600_000
#: A highlight window inside January 2024.
T0, T1 = 1_705_276_800_000, 1_705_622_400_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _tel_sql(body: str) -> str:
    return f"WITH {TELEMETRY_SQL} {body}"


def _r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with its DuckDB form."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- window correlation

_ERFC = "CASE WHEN {x} >= 0 THEN {tau} ELSE 2.0 - {tau} END"


def _erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    inner = str(stats.ERFC_COEFFICIENTS[-1])
    for c in reversed(stats.ERFC_COEFFICIENTS[:-1]):
        inner = f"({c}::DOUBLE + {t} * {inner})"
    return _ERFC.format(x=x, tau=f"({t} * exp(-{x} * {x} + {inner}))")


_Q_SQL = "CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), lambda j: 2.0 * (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * lam * lam))))) END"
_BASE = T0 - 4 * (T1 - T0)
_VOLUME_SQL = f"""
, c AS (SELECT k, count(*) FILTER (t >= {_BASE} AND t < {T0}) AS b, count(*) FILTER (t BETWEEN {T0} AND {T1}) AS h FROM tel WHERE t BETWEEN {_BASE} AND {T1} GROUP BY k HAVING count(*) >= 25)
, z AS (SELECT *, greatest(0.0, (abs(h - (b + h) * 0.2::DOUBLE) - 0.5) / sqrt((b + h) * (0.2::DOUBLE * (1 - 0.2::DOUBLE)))) / sqrt(2.0::DOUBLE) AS x FROM c)
, v AS (SELECT 'volume' AS dimension, k AS kind, 'count' AS field, least(1.0, {_erfc_sql('x')}) AS p_value, CASE WHEN h > b / 4.0 THEN 'increase' WHEN h < b / 4.0 THEN 'decrease' ELSE 'flat' END AS direction,
  floor(b / 4.0 * 1000 + 0.5) / 1000 AS baseline_stat, h::DOUBLE AS highlight_stat FROM z)"""
_KS_SQL = f"""
, s AS (SELECT k AS kind, CASE WHEN t < {T0} THEN 0 ELSE 1 END AS side, dur AS v FROM tel WHERE k IN ('net.res', 'net.req') AND t BETWEEN {_BASE} AND {T1} AND dur IS NOT NULL)
, g AS (SELECT kind, v, sum((side = 0)::INT) AS a, sum((side = 1)::INT) AS b FROM s GROUP BY kind, v)
, f AS (SELECT kind, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY kind) AS n, sum(b) OVER (PARTITION BY kind) AS m FROM g WINDOW w AS (PARTITION BY kind ORDER BY v ROWS UNBOUNDED PRECEDING))
, d AS (SELECT kind, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m, max(abs(ca / n - cb / m)) AS d FROM f WHERE n > 0 AND m > 0 GROUP BY kind HAVING max(n) >= 8 AND max(m) >= 8)
, l AS (SELECT *, (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * d AS lam FROM d)
, md AS (SELECT kind, median(v) FILTER (side = 0) AS mb, median(v) FILTER (side = 1) AS mh FROM s GROUP BY kind)
, ks AS (SELECT 'distribution' AS dimension, l.kind, 'dur' AS field, {_Q_SQL} AS p_value, CASE WHEN mh > mb THEN 'increase' WHEN mh < mb THEN 'decrease' ELSE 'flat' END AS direction,
  floor(mb * 1000 + 0.5) / 1000 AS baseline_stat, floor(mh * 1000 + 0.5) / 1000 AS highlight_stat FROM l JOIN md USING (kind))"""


@query(_tel_sql(f"{_VOLUME_SQL} SELECT dimension, kind, field, round(p_value, 6) AS p_value, direction, baseline_stat, highlight_stat FROM v"))
def window_volume_delta(spark, sf_dir):
    return WC.volume_delta(events_as_telemetry(spark, sf_dir), T0, T1).withColumn("p_value", _r("p_value"))


@query(_tel_sql(f"{_KS_SQL} SELECT dimension, kind, field, round(p_value, 6) AS p_value, direction, baseline_stat, highlight_stat FROM ks"))
def window_distribution_shift(spark, sf_dir):
    return WC.distribution_shift(events_as_telemetry(spark, sf_dir), {"net.res": ["dur"], "net.req": ["dur"]}, T0, T1).withColumn("p_value", _r("p_value"))


@query(_tel_sql(f"""{_VOLUME_SQL}{_KS_SQL}, u AS (SELECT * FROM v UNION ALL SELECT * FROM ks)
, r AS (SELECT *, row_number() OVER (ORDER BY p_value, kind, field) AS bh_rank, count(*) OVER () AS n FROM u)
SELECT kind, field, round(p_value, 6) AS p_value, bh_rank::BIGINT AS bh_rank, round(bh_rank / n * 0.5::DOUBLE, 6) AS bh_threshold,
  bh_rank <= max(CASE WHEN p_value <= bh_rank / n * 0.5::DOUBLE THEN bh_rank ELSE 0 END) OVER () AS rejected FROM r"""))
def window_correlation(spark, sf_dir):
    out = WC.correlate_window(events_as_telemetry(spark, sf_dir), T0, T1, {"net.res": ["dur"], "net.req": ["dur"]}, q=0.5)
    return out.select("kind", "field", _r("p_value").alias("p_value"), F.col("bh_rank").cast("long").alias("bh_rank"), _r("bh_threshold").alias("bh_threshold"), "rejected")


# ---- counts, projections, filters


@query(_tel_sql("SELECT session_id, k, count(*)::BIGINT AS n FROM tel GROUP BY ALL"))
def counts_by_kind(spark, sf_dir):
    return A.counts_by_kind(events_as_telemetry(spark, sf_dir))


@query("SELECT user_id AS session_id, count(*) FILTER (event_type IN ('error'))::BIGINT AS indexed, count(DISTINCT event_type) FILTER (event_type NOT IN ('error'))::BIGINT AS unrecognized, arg_min(event_type, event_id) FILTER (event_type NOT IN ('error')) AS first_unrecognized FROM events GROUP BY user_id")
def kind_report(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), X.canonical_kind(F.concat(F.lit(" "), F.initcap("event_type"))).alias("k0"), "event_type")
    return A.kind_report(e.select("session_id", "seq", F.when(F.col("k0") == "err", "err").otherwise(F.col("event_type")).alias("k")))


@query(_tel_sql(f"SELECT session_id, seq, t, k FROM tel WHERE k = 'err' AND t >= {T0} AND t <= {T1}"))
def events_filtered(spark, sf_dir):
    return P.filter_events(events_as_telemetry(spark, sf_dir), "err", T0, T1).select("session_id", "seq", "t", "k")


@query(_tel_sql("SELECT session_id, seq, t, id, st, url FROM tel WHERE k = 'net.res' AND st >= 400"))
def failed_requests(spark, sf_dir):
    return events_as_telemetry(spark, sf_dir).where("k = 'net.res' AND st >= 400").select("session_id", "seq", "t", "id", "st", "url")


@query(_tel_sql("""SELECT session_id, CASE WHEN count(*) FILTER (k = 'err') > 0 THEN 'high' WHEN count(*) FILTER (k = 'net.res' AND st >= 400) > 0 THEN 'medium' ELSE 'low' END AS severity,
 coalesce(arg_min(msg, seq) FILTER (k = 'err'), arg_min(url, seq) FILTER (k = 'net.res' AND st >= 400), 'session') AS title, arg_min(t, seq) AS start, arg_max(t, seq) AS "end", count(*)::BIGINT AS n FROM tel GROUP BY session_id"""))
def session_summary(spark, sf_dir):
    return P.session_summaries(events_as_telemetry(spark, sf_dir))


@query(_tel_sql("""SELECT a.session_id FROM tel a GROUP BY a.session_id HAVING count(*) FILTER (k = 'err' OR (k = 'net.res' AND st >= 400)) > 0"""))
def error_class_sessions(spark, sf_dir):
    return P.error_class_sessions(events_as_telemetry(spark, sf_dir))


@query(_tel_sql("SELECT session_id, t, id FROM tel WHERE k = 'err' ORDER BY t DESC, session_id DESC, seq DESC LIMIT 1"))
def latest_issue(spark, sf_dir):
    return events_as_telemetry(spark, sf_dir).where("k = 'err'").orderBy(F.desc("t"), F.desc("session_id"), F.desc("seq")).limit(1).select("session_id", "t", "id")


@query(_tel_sql(f"""SELECT session_id, seq, t, st FROM (SELECT r.*, row_number() OVER (PARTITION BY r.session_id ORDER BY r.t DESC, r.seq DESC) AS rn FROM tel r JOIN (SELECT session_id, min(t) AS err_t FROM tel WHERE k IN ('err', 'rej') GROUP BY 1) e
 ON r.session_id = e.session_id AND r.t < err_t AND r.t >= err_t - {200 * HOUR} WHERE r.k = 'net.res' AND r.st < 400) WHERE rn <= 12"""))
def preceding_successes(spark, sf_dir):
    return A.preceding_successes(events_as_telemetry(spark, sf_dir), 200 * HOUR).select("session_id", "seq", "t", "st")


# ---- joins


@query(_tel_sql("""SELECT session_id, seq, t, id, st, req_seq, t - req_t AS wait_ms FROM (SELECT *, last_value(CASE WHEN k = 'net.req' THEN seq END IGNORE NULLS) OVER w AS req_seq,
 last_value(CASE WHEN k = 'net.req' THEN t END IGNORE NULLS) OVER w AS req_t FROM tel WHERE k IN ('net.req', 'net.res', 'net.err') WINDOW w AS (PARTITION BY session_id, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE k <> 'net.req'"""))
def response_request_join(spark, sf_dir):
    return J.match_responses(events_as_telemetry(spark, sf_dir)).select("session_id", "seq", "t", "id", "st", "req_seq", "wait_ms")


_STACK_SQL = """
, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq DESC, session_id DESC) AS rn FROM (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'q' || (o_orderkey // 2) END AS request_id, o_custkey AS session_id, epoch_ms(o_orderdate)::BIGINT AS t FROM orders)))
, b AS (SELECT CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 'q' || l_orderkey END AS request_id, CASE WHEN l_orderkey % 5 = 0 THEN -1 ELSE s END AS session_id, t,
   CASE WHEN l_orderkey % 7 = 0 THEN 'generated-request-id' WHEN l_orderkey % 17 = 0 THEN 'missing-session' END AS status
  FROM (SELECT l_orderkey, min(epoch_ms(l_shipdate))::BIGINT AS t FROM lineitem GROUP BY 1) JOIN (SELECT o_orderkey // 2 AS k, max_by(o_custkey, o_orderkey) AS s FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1) ON k = l_orderkey)
, j AS (SELECT CASE WHEN f.t IS NOT NULL AND b.t IS NOT NULL AND f.session_id = b.session_id THEN 'linked' WHEN b.t IS NULL THEN 'frontend-only' WHEN status = 'generated-request-id' THEN 'backend-generated-request-id'
   WHEN status = 'missing-session' THEN 'backend-missing-session' ELSE 'backend-only' END AS type, coalesce(f.request_id, b.request_id) AS request_id, coalesce(b.session_id, f.session_id) AS session_id, coalesce(f.t, b.t) AS t
  FROM (SELECT * FROM f WHERE rn = 1 AND request_id IS NOT NULL) f FULL JOIN (SELECT * FROM b WHERE request_id IS NOT NULL) b ON f.request_id = b.request_id
  UNION ALL SELECT 'client-missing-request-id', NULL, session_id, t FROM f WHERE request_id IS NULL UNION ALL SELECT 'backend-missing-request-id', NULL, session_id, t FROM b WHERE request_id IS NULL)"""


def _stack(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    front = o.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("q"), F.floor(F.col("o_orderkey") / 2).cast("string"))).alias("request_id"), F.col("o_custkey").alias("session_id"), millis("o_orderdate").alias("t"))
    ship = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(millis("min(l_shipdate)").alias("t"))
    owner = o.where("o_orderkey % 11 <> 0").groupBy(F.floor(F.col("o_orderkey") / 2).alias("l_orderkey")).agg(F.max_by("o_custkey", "o_orderkey").alias("s"))
    back = ship.join(owner, "l_orderkey").select(
        F.when(F.col("l_orderkey") % 13 != 0, F.concat(F.lit("q"), F.col("l_orderkey").cast("string"))).alias("request_id"), F.when(F.col("l_orderkey") % 5 == 0, -1).otherwise(F.col("s")).alias("session_id"), "t",
        F.when(F.col("l_orderkey") % 7 == 0, "generated-request-id").when(F.col("l_orderkey") % 17 == 0, "missing-session").alias("status"))
    return J.full_stack(front, back)


@query("WITH x AS (SELECT 1)" + _STACK_SQL + " SELECT type, request_id, session_id, t FROM j")
def full_stack_requests(spark, sf_dir):
    return _stack(spark, sf_dir)


@query("WITH x AS (SELECT 1)" + _STACK_SQL + """ SELECT g.type, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['frontend-only', 'backend-only', 'backend-generated-request-id', 'backend-missing-session', 'backend-missing-request-id', 'backend-missing-session-and-request-id', 'client-missing-request-id']) AS type) g
 LEFT JOIN (SELECT type, count(*) AS n FROM j GROUP BY 1) c ON g.type = c.type""")
def gap_histogram(spark, sf_dir):
    return J.gap_histogram(_stack(spark, sf_dir))


@query(_tel_sql("SELECT session_id, id, arg_min(request_id, seq) AS request_id FROM tel WHERE k IN ('net.req', 'net.res', 'net.err') AND id IS NOT NULL GROUP BY 1, 2"))
def request_aliases(spark, sf_dir):
    return J.first_aliases(events_as_telemetry(spark, sf_dir))


@query(_tel_sql(f"""SELECT session_id, err_seq, seq, t, k, rank FROM (SELECT e.session_id, e.seq AS err_seq, x.seq, x.t, x.k, row_number() OVER (PARTITION BY e.session_id, e.seq ORDER BY abs(x.t - e.t), x.seq) AS rank
 FROM tel e JOIN tel x ON e.session_id = x.session_id AND abs(x.t - e.t) <= {6 * HOUR} AND x.seq <> e.seq WHERE e.k IN ('err', 'rej')) WHERE rank <= 100"""))
def error_context(spark, sf_dir):
    return J.error_context(events_as_telemetry(spark, sf_dir), 6 * HOUR).select("session_id", "err_seq", "seq", "t", "k", F.col("rank").cast("long").alias("rank"))


@query(_tel_sql(f"""SELECT session_id, seq, t, CASE WHEN t - ct <= {2 * HOUR} THEN cs END AS trigger_seq, t - ct AS delta_ms FROM (SELECT *, last_value(CASE WHEN k = 'clk' THEN seq END IGNORE NULLS) OVER w AS cs, last_value(CASE WHEN k = 'clk' THEN t END IGNORE NULLS) OVER w AS ct
 FROM tel WINDOW w AS (PARTITION BY session_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE k = 'net.req'"""))
def nearest_trigger(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    e = events_as_telemetry(spark, sf_dir).withColumn("ct", F.last(F.when(F.col("k") == "clk", F.col("t")), ignorenulls=True).over(w))
    out = J.nearest_before(e, F.col("k") == "net.req", F.col("k") == "clk", 2 * HOUR)
    return out.select("session_id", "seq", "t", F.col("trigger.seq").alias("trigger_seq"), (F.col("t") - F.col("ct")).alias("delta_ms"))


@query("""WITH a AS (SELECT o_custkey % 50 AS anchor, o_orderpriority AS route, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey % 50, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 2 = 0),
 b AS (SELECT o_custkey % 50 AS anchor, o_orderpriority AS route, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey % 50, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 2 = 1)
 SELECT coalesce(a.anchor, b.anchor) AS anchor, coalesce(a.route, b.route) AS route, a.o_orderkey AS a_key, b.o_orderkey AS b_key, CASE WHEN a.rn IS NULL THEN 'added' WHEN b.rn IS NULL THEN 'missing' ELSE 'paired' END AS change,
 coalesce(b.o_totalprice - a.o_totalprice >= 250 AND b.o_totalprice >= 3 * a.o_totalprice, false) AS slower FROM a FULL JOIN b ON a.anchor = b.anchor AND a.route = b.route AND a.rn = b.rn""")
def fifo_match(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("anchor"), F.col("o_orderpriority").alias("route"), "o_orderkey", "o_totalprice")
    m = J.fifo_match(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["anchor", "route"], "o_orderkey")
    return m.select("anchor", "route", F.col("a.o_orderkey").alias("a_key"), F.col("b.o_orderkey").alias("b_key"), "change", F.coalesce(L.latency_verdict(F.col("a.o_totalprice"), F.col("b.o_totalprice")), F.lit(False)).alias("slower"))


@query("""WITH a AS (SELECT c_name AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_name AS key, CAST(CASE WHEN c_custkey % 7 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS VARCHAR) AS value FROM customer WHERE c_custkey % 5 <> 0)
 SELECT coalesce(a.key, b.key) AS key, a.value AS before, b.value AS after, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def environment_diff(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    a = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("key"), F.col("c_nationkey").cast("string").alias("value"))
    b = c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).cast("string").alias("value"))
    return J.env_diff(a, b)


# ---- aggregates and windows


@query(_tel_sql(f"SELECT k, median(dur) AS median_dur, count(*)::BIGINT AS n FROM tel WHERE t >= {T0} GROUP BY k"))
def exact_median(spark, sf_dir):
    return A.exact_medians(events_as_telemetry(spark, sf_dir).where(F.col("t") >= T0), ["k"], "dur").withColumnRenamed("median", "median_dur")


@query(_tel_sql("""SELECT session_id, trim(regexp_replace(regexp_replace(lower(msg), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS signature, min(seq) AS seq, arg_min(msg, seq) AS msg, CASE WHEN count(*) > 1 THEN count(*) END AS count,
 CASE WHEN count(*) > 1 THEN min(t) END AS first_at, CASE WHEN count(*) > 1 THEN max(t) END AS last_at FROM tel WHERE k = 'err' GROUP BY 1, 2"""))
def run_compaction(spark, sf_dir):
    return A.compact_runs(events_as_telemetry(spark, sf_dir).where("k = 'err'"), X.summary_signature(F.col("msg")))


@query(_tel_sql("""SELECT session_id, metric, value, CASE WHEN value <= good THEN 'good' WHEN value > poor THEN 'poor' ELSE 'needs_improvement' END AS rating FROM (
 SELECT session_id, metric, arg_max(dur, seq) AS value FROM (SELECT *, list_extract(['lcp', 'inp', 'ttfb', 'cls', 'other'], (id % 5)::INT + 1) AS metric FROM tel) WHERE metric <> 'other' GROUP BY 1, 2)
 JOIN (VALUES ('lcp', 2500.0, 4000.0), ('cls', 0.1, 0.25), ('inp', 200.0, 500.0), ('ttfb', 800.0, 1800.0)) b(m, good, poor) ON metric = m"""))
def vitals_summary(spark, sf_dir):
    metric = F.element_at(F.array(*map(F.lit, ("lcp", "inp", "ttfb", "cls", "other"))), (F.col("id") % 5 + 1).cast("int"))
    return A.vitals(events_as_telemetry(spark, sf_dir), metric, F.col("dur"))


_GAPPED = "SELECT *, CASE WHEN k = 'nav' THEN 'capture_gap' WHEN k = 'net.req' AND session_id % 2 = 0 THEN 'backend.req.start' WHEN k = 'clk' AND session_id % 3 = 0 THEN 'db.diff' ELSE k END AS kk FROM tel WHERE session_id % 4 <> 0 OR k <> 'nav'"


@query(_tel_sql(f"""SELECT session_id, gaps, surfaces, dropped, CASE WHEN gaps = 0 THEN 'complete' WHEN b AND d THEN 'degraded' ELSE 'fragmentary' END AS grade FROM (SELECT session_id, count(*) FILTER (kk = 'capture_gap')::BIGINT AS gaps,
 count(DISTINCT id % 6) FILTER (kk = 'capture_gap')::BIGINT AS surfaces, coalesce(sum(id) FILTER (kk = 'capture_gap' AND id > 0), 0)::BIGINT AS dropped, bool_or(starts_with(kk, 'backend.req.')) AS b, bool_or(kk = 'db.diff') AS d FROM ({_GAPPED}) GROUP BY 1)"""))
def capture_completeness(spark, sf_dir):
    e = events_as_telemetry(spark, sf_dir).where("session_id % 4 <> 0 OR k <> 'nav'")
    k = F.when(F.col("k") == "nav", "capture_gap").when((F.col("k") == "net.req") & (F.col("session_id") % 2 == 0), "backend.req.start").when((F.col("k") == "clk") & (F.col("session_id") % 3 == 0), "db.diff").otherwise(F.col("k"))
    return A.completeness(e.withColumn("k", k), (F.col("id") % 6).cast("string"), F.col("id")).drop("backend", "db")


@query(_tel_sql(""", s AS (SELECT session_id FROM tel GROUP BY 1 ORDER BY min(t) DESC, session_id DESC LIMIT 60)
 SELECT detector, count(DISTINCT session_id)::BIGINT AS sessions, (SELECT count(*) FROM s)::BIGINT AS window_sessions FROM (SELECT session_id, 'd' || (id % 9) AS detector FROM tel WHERE k = 'err') JOIN s USING (session_id) WHERE (SELECT count(*) FROM s) >= 12 GROUP BY 1"""))
def detector_prevalence(spark, sf_dir):
    e = events_as_telemetry(spark, sf_dir)
    findings = e.where("k = 'err'").select("session_id", F.concat(F.lit("d"), (F.col("id") % 9).cast("string")).alias("detector"))
    return A.prevalence(findings, e.groupBy("session_id").agg(F.min("t").alias("start")), recent=60)


@query(_tel_sql("SELECT 'el' || (id % 40) AS signature, count(*)::BIGINT AS n, arg_min(t, (t, session_id, seq)) AS first_t FROM tel WHERE k IN ('clk', 'inp') GROUP BY 1"))
def element_usage(spark, sf_dir):
    return A.element_usage(events_as_telemetry(spark, sf_dir), F.concat(F.lit("el"), (F.col("id") % 40).cast("string")))


@query(_tel_sql("""SELECT signature, CASE WHEN count(DISTINCT k) = 1 THEN min(k) END AS k, CASE WHEN count(DISTINCT request_id) = 1 THEN min(request_id) END AS request_id, row_number() OVER (ORDER BY min((t, session_id, seq)))::BIGINT AS ref
 FROM (SELECT *, request_id || '/' || (id % 3) AS signature FROM tel) GROUP BY 1"""))
def signature_dictionary(spark, sf_dir):
    d = A.signature_dictionary(events_as_telemetry(spark, sf_dir), F.concat_ws("/", "request_id", (F.col("id") % 3).cast("string")), ["k", "request_id"])
    return d.withColumn("ref", F.col("ref").cast("long"))


_CAND = """cand AS (SELECT session_id, seq AS candidate_id, 'd' || (id % 9) AS detector, CASE WHEN id % 4 = 0 THEN NULL ELSE request_id END AS request_id, 'sig' || (id % 9) AS signature,
 list_extract(['low', 'medium', 'high', 'critical'], (seq % 4)::INT + 1) AS severity, floor(dur * 100)::BIGINT AS score, t FROM tel WHERE k IN ('err', 'net.res'))"""


def _candidates(spark, sf_dir):
    e = events_as_telemetry(spark, sf_dir).where("k IN ('err', 'net.res')")
    return e.select("session_id", F.col("seq").alias("candidate_id"), F.concat(F.lit("d"), (F.col("id") % 9).cast("string")).alias("detector"), F.when(F.col("id") % 4 != 0, F.col("request_id")).alias("request_id"),
                    F.concat(F.lit("sig"), (F.col("id") % 9).cast("string")).alias("signature"), F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (F.col("seq") % 4 + 1).cast("int")).alias("severity"), F.floor(F.col("dur") * 100).alias("score"), "t")


@query(f"WITH {TELEMETRY_SQL}, {_CAND} SELECT session_id, candidate_id, detector, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, score DESC, t, candidate_id)::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, detector ORDER BY score DESC, t, candidate_id) AS turn FROM cand)) WHERE rank <= 12")
def candidate_cap(spark, sf_dir):
    return A.diversity_cap(_candidates(spark, sf_dir), 12).select("session_id", "candidate_id", "detector", "score", F.col("rank").cast("long").alias("rank"))


_BUGS = f"""{_CAND}, c1 AS (SELECT session_id, coalesce(request_id, signature) AS cluster, array_to_string(list_sort(list(DISTINCT signature)), '|') AS sigs, list(DISTINCT request_id) FILTER (request_id IS NOT NULL) AS reqs, count(*) AS n,
 max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS sev, min(t) AS lo, max(t) AS hi, max((score, candidate_id)) AS best FROM cand GROUP BY 1, 2)
, bugs AS (SELECT session_id, sigs, count(*)::BIGINT AS occurrences, sum(n)::BIGINT AS candidates, max(sev)::BIGINT AS severity_rank, min(lo) AS first_seen, max(hi) AS last_seen, len(list_distinct(flatten(list(coalesce(reqs, []))))) AS requests, max(best)[2] AS representative FROM c1 GROUP BY 1, 2)"""


@query(f"WITH {TELEMETRY_SQL}, {_BUGS} SELECT session_id, sigs, occurrences, candidates, severity_rank, first_seen, last_seen, requests::BIGINT AS requests, representative FROM bugs")
def distinct_bugs(spark, sf_dir):
    b = A.distinct_bugs(_candidates(spark, sf_dir))
    return b.select("session_id", F.array_join("signatures", "|").alias("sigs"), "occurrences", "candidates", F.col("severity_rank").cast("long").alias("severity_rank"), "first_seen", "last_seen", F.size("request_ids").cast("long").alias("requests"), "representative")


@query(f"""WITH {TELEMETRY_SQL}, {_BUGS}, s AS (SELECT session_id, min(t) AS start, 'v' || (session_id % 5) AS release FROM tel GROUP BY 1)
 SELECT sigs, count(DISTINCT session_id)::BIGINT AS session_count, sum(occurrences)::BIGINT AS occurrences, min(first_seen) AS first_seen, max(last_seen) AS last_seen, arg_min(release, (start, session_id)) AS first_release, arg_max(release, (start, session_id)) AS last_release FROM bugs JOIN s USING (session_id) GROUP BY 1""")
def bug_recurrence(spark, sf_dir):
    b = A.distinct_bugs(_candidates(spark, sf_dir))
    s = events_as_telemetry(spark, sf_dir).groupBy("session_id").agg(F.min("t").alias("start")).withColumn("release", F.concat(F.lit("v"), (F.col("session_id") % 5).cast("string")))
    sigs = F.array_join("signatures", "|")
    names = b.select("signature", sigs.alias("sigs")).distinct()
    return A.recurrence(b, s).join(names, "signature").drop("signature")


@query(_tel_sql("""SELECT session_id, plane, ordinal, cost, upto <= room AS kept FROM (WITH i AS (SELECT session_id, (id % 3 + 1)::INT AS plane, seq AS ordinal, ceil(length(msg) / 4.0)::BIGINT AS cost FROM tel WHERE k = 'err'),
 r AS (SELECT *, sum(cost) OVER (PARTITION BY session_id, plane ORDER BY ordinal)::BIGINT AS upto FROM i),
 p1 AS (SELECT session_id, coalesce(max(upto) FILTER (plane = 1 AND upto <= 40), 0) AS u1 FROM r GROUP BY 1),
 p2 AS (SELECT r.session_id, u1, coalesce(max(upto) FILTER (plane = 2 AND upto <= 40 - u1), 0) AS u2 FROM r JOIN p1 ON r.session_id = p1.session_id GROUP BY 1, 2),
 p3 AS (SELECT r.session_id, u1, u2, coalesce(max(upto) FILTER (plane = 3 AND upto <= 40 - u1 - u2), 0) AS u3 FROM r JOIN p2 ON r.session_id = p2.session_id GROUP BY 1, 2, 3)
 SELECT r.*, CASE plane WHEN 1 THEN u1 WHEN 2 THEN u2 ELSE u3 END AS room FROM r JOIN p3 ON r.session_id = p3.session_id)"""))
def token_budget(spark, sf_dir):
    items = events_as_telemetry(spark, sf_dir).where("k = 'err'").select("session_id", (F.col("id") % 3 + 1).cast("int").alias("plane"), F.col("seq").alias("ordinal"), X.token_estimate(F.col("msg")).alias("cost"))
    return A.budget_fill(items, 40).select("session_id", "plane", "ordinal", "cost", "kept")


_RUNS = """runs AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS arm, l_suppkey AS bug_id, l_partkey % 10 AS run_index, l_orderkey * 10 + l_linenumber AS ordinal, l_returnflag <> 'N' AS correct, l_quantity AS seconds, l_extendedprice AS tokens, l_discount * 10 AS confidence FROM lineitem),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm, bug_id, run_index ORDER BY ordinal) AS rn FROM runs) WHERE rn = 1)"""


def _runs(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("arm"), F.col("l_suppkey").alias("bug_id"), (F.col("l_partkey") % 10).alias("run_index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
                                                    (F.col("l_returnflag") != "N").alias("correct"), F.col("l_quantity").alias("seconds"), F.col("l_extendedprice").alias("tokens"), (F.col("l_discount") * 10).alias("confidence"))


@query(f"WITH {_RUNS} SELECT arm, count(*)::BIGINT AS runs, count(*) FILTER (correct)::BIGINT AS identified, round(count(*) FILTER (correct) / count(*), 6) AS rate, median(seconds) FILTER (correct) AS median_seconds, round(median(tokens) FILTER (correct), 4) AS median_tokens, count(*) FILTER (NOT correct AND confidence >= 0.8)::BIGINT AS confident_errors FROM one GROUP BY 1")
def arm_metrics(spark, sf_dir):
    return A.arm_metrics(_runs(spark, sf_dir)).withColumn("rate", _r("rate")).withColumn("median_tokens", _r("median_tokens", 4))


@query(f"""WITH {_RUNS}, p AS (SELECT count(*)::BIGINT AS pairs, count(*) FILTER (x.correct AND NOT y.correct)::BIGINT AS only_a, count(*) FILTER (NOT x.correct AND y.correct)::BIGINT AS only_b FROM one x JOIN one y ON x.bug_id = y.bug_id AND x.run_index = y.run_index AND x.arm = 'a' AND y.arm = 'b')
 SELECT pairs, only_a, only_b, round(least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) + (only_a + only_b) * ln(0.5))))), 4) AS p_value FROM p""")
def paired_arms_mcnemar(spark, sf_dir):
    return A.benchmark_pairs(_runs(spark, sf_dir), "a", "b").withColumn("p_value", _r("p_value", 4))


@query(_tel_sql("SELECT session_id, n, dur AS latency FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY dur DESC, id) - 1 AS rank, count(*) OVER (PARTITION BY session_id) AS n FROM (SELECT session_id, id, max(dur) AS dur FROM tel WHERE k = 'clk' GROUP BY 1, 2)) WHERE rank = least(n // 50, least(n, 1000) - 1)"))
def interaction_latency(spark, sf_dir):
    return A.interaction_latency(events_as_telemetry(spark, sf_dir).where("k = 'clk'"))


@query("SELECT conv_id, turn, role, before FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE role IS DISTINCT FROM before")
def emit_on_change(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").withColumnRenamed("turn", "seq")
    return A.emit_on_change(c, ["conv_id"], "role").select("conv_id", F.col("seq").alias("turn"), "role", "before")


@query(_tel_sql(f"""SELECT session_id, min(t) AS start, (max(t) + {12 * HOUR})::BIGINT AS "end", count(*)::BIGINT AS n FROM (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t, seq) >= {12 * HOUR} THEN 1 ELSE 0 END AS new FROM tel)) GROUP BY session_id, g"""))
def idle_sessions(spark, sf_dir):
    return signals.idle_sessions(events_as_telemetry(spark, sf_dir), "12 hours")


@query(_tel_sql(f"""SELECT session_id, seq, t, count(*) OVER (PARTITION BY session_id, k ORDER BY t RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW)::BIGINT AS n FROM tel"""))
def sliding_counts(spark, sf_dir):
    return A.sliding_counts(events_as_telemetry(spark, sf_dir), ["session_id", "k"], 24 * HOUR).select("session_id", "seq", "t", "n")


# ---- graph

_NODES_SQL = """, n0 AS (SELECT session_id, seq, t, k, st, request_id, CASE k WHEN 'clk' THEN 'user.click' WHEN 'nav' THEN 'user.nav' WHEN 'err' THEN 'frontend.error' ELSE k END AS kind FROM tel)
, n1 AS (SELECT *, kind || ':' || t || ':r=' || request_id AS base FROM n0), n2 AS (SELECT *, row_number() OVER (PARTITION BY session_id, base ORDER BY t, seq) - 1 AS c FROM n1)
, n3 AS (SELECT session_id, base || CASE WHEN c > 0 THEN '#' || c ELSE '' END AS id, kind, t, request_id, k = 'net.res' AND coalesce(st, 0) >= 400 AS failed, seq FROM n2)
, n AS (SELECT *, sum((kind = 'user.nav')::INT) OVER (PARTITION BY session_id ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT AS nav_epoch FROM n3)"""


@query(_tel_sql(_NODES_SQL + " SELECT session_id, id, kind, t, request_id, failed, nav_epoch, seq FROM n"))
def causal_nodes(spark, sf_dir):
    return G.build_nodes(events_as_telemetry(spark, sf_dir))


_W2, _H2 = 4 * HOUR, HOUR


@query(_tel_sql(_NODES_SQL + f"""
, sp AS (SELECT session_id, id AS src, lead(id) OVER (PARTITION BY session_id, request_id ORDER BY t, CASE kind WHEN 'net.req' THEN 0 ELSE 4 END, id) AS dst FROM n WHERE kind IN ('net.req', 'net.res'))
, s AS (SELECT *, last_value(CASE WHEN kind = 'user.click' THEN struct_pack(id, t, nav_epoch) END IGNORE NULLS) OVER b AS touch, last_value(CASE WHEN kind IN ('user.click', 'user.nav', 'net.res', 'net.req') THEN struct_pack(id, t, nav_epoch) END IGNORE NULLS) OVER b AS cause,
   first_value(CASE WHEN kind = 'frontend.error' THEN struct_pack(id, t, nav_epoch) END IGNORE NULLS) OVER a AS sym FROM n
   WINDOW b AS (PARTITION BY session_id ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY session_id ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
, strong AS (SELECT DISTINCT * FROM (SELECT session_id, src, dst, 'request' AS kind, 'high' AS confidence FROM sp WHERE dst IS NOT NULL
   UNION ALL SELECT session_id, touch.id, id, 'interaction', CASE WHEN t - touch.t <= {_H2} AND nav_epoch = touch.nav_epoch THEN 'high' ELSE 'medium' END FROM s WHERE kind = 'net.req' AND t - touch.t <= {_W2}
   UNION ALL SELECT session_id, id, sym.id, 'symptom', CASE WHEN sym.t - t <= {_H2} THEN 'high' ELSE 'medium' END FROM s WHERE failed AND sym.t - t <= {_W2}))
SELECT * FROM strong UNION ALL SELECT session_id, cause.id, id, 'temporal', 'low' FROM s WHERE kind = 'frontend.error' AND t - cause.t <= {_W2} AND NOT EXISTS (SELECT 1 FROM strong g WHERE g.session_id = s.session_id AND g.dst = s.id)"""))
def causal_edges(spark, sf_dir):
    return G.build_edges(G.build_nodes(events_as_telemetry(spark, sf_dir)), _W2, _H2)


# ---- text, hashing, search


@query(None)
def text_signatures(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", X.fnv1a_base36(F.col("text"), X.fnv1a_texts).alias("hash"), F.size(X.issue_tokens(F.col("text"))).alias("n_tokens"), X.summary_signature(F.col("text")).alias("signature"), X.redact(F.col("text")).alias("redacted"))


@query("""SELECT page_id, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS path, array_to_string(list_transform(string_split(CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]{2,}') THEN '<id>' ELSE s END), '/') AS route,
 'GET ' || regexp_replace(url, '\\?.*$', '') AS endpoint FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS p FROM pages)""")
def url_routes(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", X.url_path(F.col("url")).alias("path"), X.route(F.col("url")).alias("route"), X.endpoint_key(F.lit("get"), F.col("url")).alias("endpoint"))


_PROFILE = "SELECT doc_id AS bug_id, source AS session_id, lang AS error, 'r' || (doc_id % 5) AS route, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '\\[redacted\\]', ' ', 'g'), '[^a-z0-9]+'), lambda t: length(t) > 1 AND length(t) < 40) AS tokens, [source, lang] AS facets FROM documents"
_SCORE_SQL = f"""WITH q AS (SELECT ['and', 'the', 'attion', 'to', 'thanedble', 'anea', 'eriner', 'thanea'] AS q), b AS ({_PROFILE}),
 s AS (SELECT bug_id, session_id, route, 0.6::DOUBLE * coalesce(len(list_intersect(list_distinct(tokens), q)) / nullif(len(list_distinct(list_concat(tokens, q))), 0), 0) + 0.2::DOUBLE * (route = 'r1')::INT + 0.1::DOUBLE * (error = 'en')::INT
  + 0.1::DOUBLE * (len(list_intersect(facets, ['src1', 'en'])) / len(list_distinct(list_concat(facets, ['src1', 'en'])))) AS score FROM b, q)"""


def _scored(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("bug_id"), F.col("source").alias("session_id"), F.col("lang").alias("error"), F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("route"), X.issue_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), F.array("source", "lang").alias("facets"))
    return L.score_issue(d, "And the attion to thanedble anea eriner thanea", "R1", "en", ["src1", "en"])


@query(_SCORE_SQL + " SELECT bug_id, round(score, 6) AS score FROM s WHERE score > 0")
def recall_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("bug_id", _r("score").alias("score"))


@query(_SCORE_SQL + f""", c AS (SELECT bug_id, least(1.0, score + 0.1::DOUBLE * pow(0.5, (1000 - bug_id % 1000) * {HOUR}::DOUBLE / 604800000.0) + CASE WHEN bug_id % 3 = 0 THEN 0.1::DOUBLE ELSE 0 END) AS confidence, bug_id % 1000 AS tm, session_id FROM s WHERE score > 0)
 SELECT bug_id, round(confidence, 6) AS confidence FROM c ORDER BY round(confidence, 9) DESC, tm DESC, bug_id, session_id LIMIT 20""")
def locate_incident(spark, sf_dir):
    now = 1_000_000 * HOUR
    s = _scored(spark, sf_dir).withColumn("session_time", F.lit(now) - (1000 - F.col("bug_id") % 1000) * HOUR).withColumn("release", F.when(F.col("bug_id") % 3 == 0, "V2 ").otherwise("v1"))
    return L.locate(s, now, "v2").where("rank <= 20").select("bug_id", _r("confidence").alias("confidence"))


@query(r"""WITH e AS (SELECT item_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 3))) AS token FROM benchmark), c AS (SELECT page_id AS sha, unnest(list_distinct(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda t: length(t) >= 3))) AS token FROM pages)
 SELECT id, sha, shared FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, sha) AS r FROM (SELECT id, sha, count(*)::BIGINT AS shared FROM e JOIN c USING (token) GROUP BY 1, 2)) WHERE r = 1""")
def commit_matches(spark, sf_dir):
    e = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return L.commit_matches(e, _read(spark, sf_dir, "pages").select(F.col("page_id").alias("sha"), F.col("url").alias("text")))


# ---- row-image invariants on orders and lineitem


@query("""SELECT o_orderkey, o_totalprice AS declared, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS summed, abs(o_totalprice - sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))) > 0.01 AS diverges FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def declared_total_divergence(spark, sf_dir):
    o, l_ = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    total = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    return l_.groupBy("l_orderkey").agg(total.alias("s")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.col("o_totalprice").alias("declared"), _r("s", 2).alias("summed"), (F.abs(F.col("o_totalprice") - F.col("s")) > 0.01).alias("diverges"))


# ---- detectors, comparison and evidence


def _payload(spark, sf_dir):
    """The telemetry with a payload, as the detectors read it; a request and its response share an id of their own."""
    e = events_as_telemetry(spark, sf_dir)
    columns = {"method": F.lit("GET"), "table": F.lit(None).cast("string"), "op": F.lit(None).cast("string"), "d": F.parse_json(F.to_json(F.struct("msg", "st")))}
    return e.withColumns(columns).withColumn("id", F.col("id").cast("string"))


_NET = """net AS (SELECT session_id, id, min(seq) FILTER (k = 'net.req') IS NOT NULL AS sent, min(t) FILTER (k = 'net.res') IS NOT NULL AS done, max(st) AS st, max(dur) AS dur FROM tel WHERE k IN ('net.req', 'net.res') GROUP BY 1, 2)"""


@query(f"""WITH {TELEMETRY_SQL}, {_NET} SELECT session_id, detector, count(*)::BIGINT AS n, max(score)::BIGINT AS top FROM (
 SELECT session_id, 'http_error' AS detector, 90 AS score FROM net WHERE st >= 400 UNION ALL SELECT session_id, 'pending_request', 58 FROM net WHERE sent AND NOT done
 UNION ALL SELECT session_id, 'uncaught_error', 88 FROM tel WHERE k = 'err') GROUP BY 1, 2""")
def detector_findings(spark, sf_dir):
    found = D.run_detectors(_payload(spark, sf_dir), ["http_error", "pending_request", "uncaught_error"])
    return found.groupBy("session_id", "detector").agg(F.count("*").alias("n"), F.max("score").cast("long").alias("top"))


@query(None)
def evidence_candidates(spark, sf_dir):
    return D.evidence_candidates(_payload(spark, sf_dir), ["http_error", "pending_request", "uncaught_error", "latency_outlier", "slow_request", "response_race"])


@query(None)
def aligned_steps(spark, sf_dir):
    """Odd sessions against the even ones before them, greedily aligned."""
    s = C.steps(events_as_telemetry(spark, sf_dir).withColumn("sig", (F.col("id") % 4).cast("string")))
    pair = F.floor(F.col("session_id") / 2).cast("string").alias("pair")
    return C.align_steps(s.where("session_id % 2 = 0").select(pair, "idx", "kind", "sig"), s.where("session_id % 2 = 1").select(pair, "idx", "kind", "sig"))


@query(_tel_sql("""SELECT session_id, seq, anchor FROM (SELECT session_id, seq, k, last_value(CASE WHEN k IN ('nav', 'clk', 'inp') THEN idx END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t, (k = 'net.res')::INT, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS anchor
 FROM (SELECT *, row_number() OVER (PARTITION BY session_id, k IN ('nav', 'clk', 'inp') ORDER BY t, seq) - 1 AS idx FROM tel)) WHERE k = 'net.res'"""))
def anchored_calls(spark, sf_dir):
    e = events_as_telemetry(spark, sf_dir)
    marks = C.steps(e.withColumn("sig", F.lit("")))
    return C.anchor(e.where("k = 'net.res'").select("session_id", "seq", "t"), marks).select("session_id", "seq", F.col("anchor").cast("long").alias("anchor"))


_EVIDENCE = "ev AS (SELECT session_id % 7 AS bundle, session_id * 100000 + seq AS id, t, list_extract(['observed', 'derived', 'inferred'], (seq % 3)::INT + 1) AS provenance, CASE WHEN id % 3 = 0 THEN NULL ELSE request_id END AS rid, k AS lane FROM tel WHERE k IN ('err', 'net.res'))"


def _evidence(spark, sf_dir):
    e = events_as_telemetry(spark, sf_dir).where("k IN ('err', 'net.res')")
    return e.select((F.col("session_id") % 7).alias("bundle"), (F.col("session_id") * 100000 + F.col("seq")).alias("eid"), "t", F.element_at(F.array(*map(F.lit, ("observed", "derived", "inferred"))), (F.col("seq") % 3 + 1).cast("int")).alias("provenance"), F.when(F.col("id") % 3 != 0, F.col("request_id")).alias("rid"), F.col("k").alias("lane")).withColumnRenamed("eid", "id")


_EDGES_SQL = """, c AS (SELECT *, CASE provenance WHEN 'observed' THEN 0.9::DOUBLE WHEN 'derived' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS sure FROM ev WHERE rid IS NOT NULL)
, edges AS (SELECT * FROM (SELECT bundle, id AS src, lead(id) OVER w AS dst, 'rid' AS key, least(sure, lead(sure) OVER w) AS confidence FROM c WINDOW w AS (PARTITION BY bundle, rid ORDER BY t, id)) WHERE dst IS NOT NULL)"""


@query(f"WITH {TELEMETRY_SQL}, {_EVIDENCE}{_EDGES_SQL} SELECT bundle, src, dst, key, confidence FROM edges")
def evidence_edges(spark, sf_dir):
    return C.evidence_edges(_evidence(spark, sf_dir), ["rid"])


@query(f"WITH {TELEMETRY_SQL}, {_EVIDENCE}{_EDGES_SQL} SELECT bundle, id FROM ev WHERE NOT EXISTS (SELECT 1 FROM edges g WHERE g.bundle = ev.bundle AND (g.src = ev.id OR g.dst = ev.id))")
def evidence_islands(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    return C.islands(e, C.evidence_edges(e, ["rid"]))


@query("""SELECT coalesce(a.k, b.k) AS l_suppkey, coalesce(a.n, 0)::BIGINT AS before, coalesce(b.n, 0)::BIGINT AS after, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'stopped' ELSE 'unchanged' END AS verdict
 FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_discount > 0.09 AND l_quantity < 3 GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_tax > 0.07 AND l_quantity < 3 GROUP BY 1) b ON a.k = b.k""")
def backtest_findings(spark, sf_dir):
    l_ = _read(spark, sf_dir, "lineitem").where("l_quantity < 3")
    return C.backtest(l_.where("l_discount > 0.09"), l_.where("l_tax > 0.07"), ["l_suppkey"])


@query("""SELECT o_custkey AS session_id, o_orderkey AS seq, o_orderkey AS t, o_orderpriority AS url, CASE WHEN o_orderkey = f THEN o_orderstatus END AS body, CASE WHEN o_orderkey <> f THEN f END AS same_as
 FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus) AS f FROM orders)""")
def body_references(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("t"), F.col("o_orderpriority").alias("url"), F.col("o_orderstatus").alias("body"))
    return C.body_references(o)
