"""Queries over the orders telemetry, and the same from the two tables in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import projections as P
from evidentia.plans.queries import query
from evidentia.sources.commerce import ORDERS_SQL, orders_as_telemetry


def _sql(body: str) -> str:
    return f"WITH {ORDERS_SQL} {body}"


@query(_sql("SELECT s AS session_id, k * 1024 + 6 AS seq, 'E' || (k % 5) AS code FROM o WHERE k % 19 = 0"))
def application_failures(spark, sf_dir):
    return P.application_failures(orders_as_telemetry(spark, sf_dir)).select("session_id", "seq", "code")


@query(_sql("SELECT s AS session_id, k * 1024 + 6 AS seq, CASE WHEN k % 17 = 0 THEN 500 ELSE 200 END AS st, k % 19 = 0 AS by_body FROM o WHERE k % 17 = 0 OR k % 19 = 0"))
def failed_responses(spark, sf_dir):
    return P.failed_responses(orders_as_telemetry(spark, sf_dir)).select("session_id", "seq", "st", "by_body")


@query(_sql("SELECT s AS session_id, k * 1024 + 6 AS seq FROM o WHERE k % 17 = 0 OR (k % 21 = 0 AND k % 19 <> 0)"))
def causal_failed_responses(spark, sf_dir):
    return orders_as_telemetry(spark, sf_dir).where(P.causal_failed()).select("session_id", "seq")


@query(_sql("SELECT s AS session_id, k * 1024 + 7 AS seq FROM o WHERE k % 23 = 0 AND k % 46 <> 0"))
def countable_network_failures(spark, sf_dir):
    return orders_as_telemetry(spark, sf_dir).where(P.countable_network_failure()).select("session_id", "seq")


@query(_sql("""SELECT kind, count(*)::BIGINT AS n FROM (SELECT unnest([CASE WHEN k % 23 = 0 THEN 'net.err' END, CASE WHEN k % 23 = 0 THEN 'rej' END, CASE WHEN k % 17 = 0 AND k % 8 <> 0 THEN 'backend.req.error' END, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN 'net.res' END,
 CASE WHEN k % 17 = 0 AND k % 8 <> 0 THEN 'backend.req.end' END, CASE WHEN k % 26 = 0 THEN 'backend.otel.span' END, CASE WHEN k % 62 = 0 THEN 'backend.otel.log' END]) AS kind FROM o) WHERE kind IS NOT NULL GROUP BY kind"""))
def high_severity_events(spark, sf_dir):
    return orders_as_telemetry(spark, sf_dir).where(P.high_severity()).groupBy(F.col("k").alias("kind")).agg(F.count("*").alias("n"))


@query(_sql("SELECT s AS session_id, k * 1024 + 8 AS seq, k * 1024 + 7 AS cause_seq, 5::BIGINT AS wait_ms FROM o WHERE k % 23 = 0 AND k % 46 <> 0 AND k % 69 <> 0"))
def rejection_causes(spark, sf_dir):
    return P.rejection_causes(orders_as_telemetry(spark, sf_dir)).select("session_id", "seq", "cause_seq", "wait_ms")


@query(_sql("""SELECT s AS session_id, 'q' || k AS request_id, CASE WHEN k % 8 <> 0 THEN 'POST' END AS method, CASE WHEN k % 8 <> 0 AND (k % 13 <> 0 OR true) THEN '/api/orders/:id' WHEN k % 13 = 0 THEN 'charge' END AS route,
 CASE WHEN k % 8 <> 0 THEN CASE WHEN k % 17 = 0 THEN 500 ELSE 200 END END AS status, CASE WHEN k % 8 <> 0 THEN k % 400 END::DOUBLE AS duration_ms, CASE WHEN k % 13 = 0 THEN 'otlp-trace-id' END AS request_id_source,
 CASE WHEN k % 8 <> 0 THEN t0 + 20 ELSE t0 + 50 END AS start_t, CASE WHEN k % 8 <> 0 THEN t0 + 60 END AS end_t, CASE WHEN k % 17 = 0 AND k % 8 <> 0 THEN t0 + 61 WHEN k % 26 = 0 THEN t0 + 50 END AS error_t,
 CASE WHEN k % 17 = 0 AND k % 8 <> 0 THEN 'order ' || k || ' was refused' WHEN k % 26 = 0 THEN 'charge' END AS error FROM o WHERE k % 8 <> 0 OR k % 13 = 0"""))
def backend_requests(spark, sf_dir):
    return P.backend_requests(orders_as_telemetry(spark, sf_dir)).drop("url", "pathname")


@query(_sql("SELECT s AS session_id, k AS id, 'mutation' AS op, 'Place' || (k % 4) AS name FROM o WHERE k % 7 = 0"))
def graphql_operations(spark, sf_dir):
    rows = orders_as_telemetry(spark, sf_dir).where("k = 'net.req'").withColumn("g", P.graphql_identity(P.get("body")))
    return rows.where("g IS NOT NULL").select("session_id", F.col("id").cast("long").alias("id"), "g.op", "g.name")


@query(_sql("SELECT s AS session_id, k * 1024 + 6 AS seq, t0 + 10 AS t, 'POST' AS method, CASE WHEN k >= 10 THEN '/api/orders/<id>' ELSE '/api/orders/' || k END AS route, CASE WHEN k % 17 = 0 THEN 500 ELSE 200 END AS st, (k % 900)::DOUBLE AS dur, 'q' || k AS request_id FROM o"))
def network_calls(spark, sf_dir):
    return P.network_calls(orders_as_telemetry(spark, sf_dir))


@query(_sql("""SELECT engine, op, "table", count(*)::BIGINT AS n, count(DISTINCT request_id)::BIGINT AS requests FROM (SELECT CASE WHEN k % 2 = 0 THEN 'mysql' ELSE 'postgres' END AS engine, 'insert' AS op, 'orders' AS "table", 'q' || k AS request_id FROM o
 UNION ALL SELECT 'postgres', 'insert', 'order_items', 'q' || l_orderkey FROM lineitem JOIN o ON l_orderkey = k) GROUP BY ALL"""))
def db_writes(spark, sf_dir):
    return P.db_writes(orders_as_telemetry(spark, sf_dir)).where(F.col("table").isin("orders", "order_items")).groupBy("engine", "op", "table").agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("requests"))


@query(_sql("""SELECT s AS session_id, 'flags.flag' || f AS key, arg_max(k % 2, k)::VARCHAR AS value FROM (SELECT *, k % 3 AS f FROM o WHERE k % 5 = 0) GROUP BY s, f
 UNION ALL SELECT s, 'release', 'v' || arg_max(k % 6, k) FROM o WHERE k % 5 = 0 GROUP BY s"""))
def environment_merge(spark, sf_dir):
    return P.environment(orders_as_telemetry(spark, sf_dir)).where("key <> 'flagChanges'")


@query(_sql("SELECT s AS session_id, 'v' || arg_max(k % 6, k) AS release, NULL::VARCHAR AS build FROM o WHERE k % 5 = 0 GROUP BY s"))
def release_and_build(spark, sf_dir):
    return P.release_and_build(P.environment(orders_as_telemetry(spark, sf_dir)))


@query(_sql("""SELECT s AS session_id, 'q' || k AS request_id, 'mysql' AS engine, 'SELECT * FROM orders WHERE id = ?' AS shape, t0 + 45 AS t FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t0, k) AS r FROM o WHERE k % 3 = 0) WHERE r <= 200"""))
def db_reads(spark, sf_dir):
    return P.db_reads(orders_as_telemetry(spark, sf_dir)).select("session_id", "request_id", "engine", "shape", "t")


@query(_sql("SELECT s AS session_id, 'q' || k AS request_id, k % 2 AS row_count, 'update' AS op FROM o WHERE k % 3 = 0 AND k % 6 <> 0"))
def db_statements(spark, sf_dir):
    return P.db_statements(orders_as_telemetry(spark, sf_dir)).select("session_id", "request_id", "row_count", "op")


@query(_sql("SELECT s AS session_id, 'q' || k AS request_id, '23505' AS code, 'UnknownError' AS error_name FROM o WHERE k % 17 = 0"))
def db_errors(spark, sf_dir):
    return P.db_errors(orders_as_telemetry(spark, sf_dir)).select("session_id", "request_id", "code", "error_name")


@query(_sql("SELECT s AS session_id, 'q' || k AS request_id, 'redis' AS system, 'GET' AS operation, 'pay' AS service FROM o WHERE k % 13 = 0"))
def db_activity(spark, sf_dir):
    return P.db_activity(orders_as_telemetry(spark, sf_dir)).select("session_id", "request_id", "system", "operation", "service")


@query(_sql("""SELECT s AS session_id, 'q' || k AS request_id, 'mail' AS service, 202 AS status, (k % 70)::DOUBLE AS duration_ms, '{"template":"t' || (k % 3) || '"}' AS detail FROM o WHERE k % 11 = 0"""))
def outbound_calls(spark, sf_dir):
    return P.outbound_calls(orders_as_telemetry(spark, sf_dir)).where("service = 'mail'").select("session_id", "request_id", "service", "status", "duration_ms", "detail")


@query(_sql("SELECT s AS session_id, t0 + 70 AS t, 'cart' || (k % 3) AS key, k::VARCHAR AS new_value FROM o WHERE k % 9 = 0"))
def storage_changes(spark, sf_dir):
    return P.storage_changes(orders_as_telemetry(spark, sf_dir)).select("session_id", "t", "key", "new_value")


@query(_sql("SELECT s AS session_id, t0 + 5 AS t, 'flag' || (k % 3) AS flag, 'a' AS before, 'b' AS after FROM o WHERE k % 15 = 0"))
def flag_changes(spark, sf_dir):
    return P.flag_changes(orders_as_telemetry(spark, sf_dir)).select("session_id", "t", "flag", "before", "after")


@query(_sql("SELECT s AS session_id, 'q' || k AS request_id, 1 AS ordinal, count(*)::BIGINT AS n FROM o WHERE k % 3 = 0 GROUP BY ALL"))
def capped_reads(spark, sf_dir):
    return P.capped_reads(orders_as_telemetry(spark, sf_dir)).groupBy("session_id", "request_id", "ordinal").agg(F.count("*").alias("n"))


#: Detector -> the order keys on which it fires.
_FIRES = {
    "http_error": "k % 17 = 0", "app_2xx_failure": "k % 19 = 0 AND k % 17 <> 0", "network_error": "k % 23 = 0", "unhandled_rejection": "k % 23 = 0", "backend_request_error": "k % 17 = 0 AND k % 8 <> 0",
    "otel_span_error": "k % 26 = 0", "otel_log_error": "k % 62 = 0", "db_statement_failed": "k % 17 = 0", "duplicate_write": "k % 29 = 0", "repeated_clicks": "k % 37 = 0", "pricing_total_ignored_by_checkout": "k % 82 = 0",
    "checkout_committed_after_pricing_timeout": "k % 43 = 0", "declined_payment_ordered": "k % 47 = 0", "duplicate_charge": "k % 53 = 0", "order_committed_with_negative_inventory": "k % 59 = 0", "money_scale_shift": "k % 61 = 0", "counter_contradiction": "k % 67 = 0",
}


@query(_sql("SELECT session_id, detector, count(*)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT s AS session_id, '{name}' AS detector FROM o WHERE {where}" for name, where in [*_FIRES.items(), ("duplicate_write", "k % 53 = 0")]) + ") GROUP BY ALL"))
def commerce_findings(spark, sf_dir):
    """All of these detectors over one stored scan of the telemetry."""
    from evidentia.operators import detectors as D

    found = D.run_detectors(orders_as_telemetry(spark, sf_dir), list(_FIRES))
    return found.groupBy("session_id", "detector").agg(F.count("*").alias("n"))


@query(_sql("SELECT s AS session_id, 'q' || k AS request_id, '2 equal inserts into notes' AS message FROM o WHERE k % 29 = 0 UNION ALL SELECT s, 'q' || k, '2 equal inserts into payments' FROM o WHERE k % 53 = 0"))
def duplicate_writes(spark, sf_dir):
    from evidentia.operators import detectors as D

    return D.duplicate_write(orders_as_telemetry(spark, sf_dir)).select("session_id", "request_id", "message")


@query(_sql("SELECT s AS session_id, t0 + 2000 AS t, 'buy-' || (k % 3) AS subject FROM o WHERE k % 37 = 0"))
def repeated_clicks(spark, sf_dir):
    from evidentia.operators import detectors as D

    return D.repeated_clicks(orders_as_telemetry(spark, sf_dir)).select("session_id", "t", "subject")
