"""Queries of the derived views, with their DuckDB forms. Bundles, bugs and findings are made of the shared tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import projections as P
from evidentia.operators import views as V
from evidentia.plans.queries import HOUR, _read, _tel_sql, query
from evidentia.sources.commerce import orders_as_telemetry
from evidentia.sources.telemetry import events_as_telemetry

# ---- over the events


@query(_tel_sql("""
, s AS (SELECT *, CASE WHEN k = 'err' THEN msg END AS summary, min(seq) OVER p AS f, max(seq) OVER p AS l, arg_min(t, seq) OVER p AS start, max((k = 'err')::INT) OVER (PARTITION BY session_id, t, k) = 1 AS told FROM tel WINDOW p AS (PARTITION BY session_id))
, e AS (SELECT session_id, seq, t, k, start, coalesce(summary, CASE WHEN NOT told AND seq = f THEN 'first recorded event (' || k || ')' WHEN NOT told AND seq = l THEN 'last recorded event (' || k || ')' END) AS summary,
 CASE WHEN summary IS NOT NULL OR told THEN 0 WHEN seq = f THEN -1 ELSE 1 END AS p FROM s)
SELECT session_id, t, k, summary, t - start AS offset_ms, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, p, seq)::INT AS r FROM e WHERE summary IS NOT NULL) WHERE r <= 40"""))
def key_timeline(spark, sf_dir):
    return V.key_timeline(events_as_telemetry(spark, sf_dir), F.when(F.col("k") == "err", F.col("msg")))


@query(_tel_sql("""
, i AS (SELECT *, row_number() OVER (PARTITION BY session_id, k = 'clk' ORDER BY t DESC, seq DESC) AS i FROM tel)
SELECT session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, seq DESC) AS r FROM i WHERE k <> 'clk' OR i <= 3) WHERE r <= 12"""))
def bounded_timeline(spark, sf_dir):
    return V.bounded_timeline(events_as_telemetry(spark, sf_dir), F.col("k") == "clk", 12, 3).select("session_id", "seq")


@query(_tel_sql("""
, r AS (SELECT *, k = 'net.res' AND coalesce(st, 0) >= 400 AS bad FROM tel), c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bad DESC, t, seq) AS n FROM r)
SELECT session_id, seq, bad AS failed, row_number() OVER (PARTITION BY session_id ORDER BY t, seq)::INT AS place FROM c WHERE n <= 10"""))
def failures_first(spark, sf_dir):
    e = events_as_telemetry(spark, sf_dir)
    return V.failures_first(e, (F.col("k") == "net.res") & (F.coalesce("st", F.lit(0)) >= 400), 10).select("session_id", "seq", "failed", "place")


@query(_tel_sql("SELECT session_id, min(t) AS first_error FROM tel WHERE k IN ('err', 'rej', 'net.err') OR (k = 'net.res' AND st >= 400) GROUP BY session_id"))
def first_error_times(spark, sf_dir):
    return V.first_error_times(events_as_telemetry(spark, sf_dir))


@query(_tel_sql(f"SELECT k, bool_or(t < {1_705_276_800_000}) AS in_a, bool_or(t >= {1_705_276_800_000}) AS in_b FROM tel GROUP BY k"))
def kind_union(spark, sf_dir):
    e = events_as_telemetry(spark, sf_dir)
    return V.kind_union(e.where("t < 1705276800000"), e.where("t >= 1705276800000"))


_BUGS_SQL = ", bug AS (SELECT session_id, msg AS bug_id, CASE WHEN count(*) > 1 THEN 'high' WHEN min(id) % 3 = 0 THEN 'medium' ELSE 'low' END AS severity, min(t) AS first_seen, max(t) AS last_seen, min(id) % 7 AS d FROM tel WHERE k = 'err' GROUP BY ALL)"


def _bugs(spark, sf_dir) -> DataFrame:
    g = events_as_telemetry(spark, sf_dir).where("k = 'err'").groupBy("session_id", F.col("msg").alias("bug_id"))
    severity = F.when(F.count("*") > 1, "high").when(F.min("id") % 3 == 0, "medium").otherwise("low")
    return g.agg(severity.alias("severity"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.concat(F.lit("d"), (F.min("id") % 7).cast("string")).alias("detector"))


_RANK_SQL = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@query(_tel_sql(f"{_BUGS_SQL} SELECT session_id, bug_id, row_number() OVER (PARTITION BY session_id ORDER BY {_RANK_SQL} DESC, last_seen DESC, bug_id)::INT AS place FROM bug"))
def ranked_bugs(spark, sf_dir):
    return V.rank_bugs(_bugs(spark, sf_dir)).select("session_id", "bug_id", "place")


@query(_tel_sql(f"{_BUGS_SQL} SELECT session_id, bug_id FROM bug QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY {_RANK_SQL} DESC, first_seen, bug_id) = 1"))
def strongest_bugs(spark, sf_dir):
    return V.strongest_bug(_bugs(spark, sf_dir)).select("session_id", "bug_id")


@query(_tel_sql(f"""{_BUGS_SQL}, w AS (SELECT DISTINCT bug_id AS signature FROM bug WHERE session_id % 5 = 0), h AS (SELECT bug_id AS signature, min((session_id, bug_id)) AS f, count(*)::BIGINT AS seen FROM bug WHERE bug_id IN (SELECT signature FROM w) GROUP BY 1)
SELECT signature, f[1] AS session_id, seen FROM h ORDER BY session_id, f[2] LIMIT 50"""))
def duplicate_bugs(spark, sf_dir):
    bugs = _bugs(spark, sf_dir).withColumn("signature", F.col("bug_id"))
    return V.duplicates_by_signature(bugs, bugs.where("session_id % 5 = 0")).select("signature", "session_id", "seen")


@query(_tel_sql(f"""{_BUGS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_RANK_SQL} DESC, last_seen DESC, bug_id) AS place FROM bug), q AS (SELECT session_id, 'd' || d AS detector, min(place) AS place FROM p GROUP BY ALL)
SELECT session_id, detector, row_number() OVER (PARTITION BY session_id ORDER BY place)::INT AS place, CASE WHEN detector IN ('d1', 'd2') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS share FROM q"""))
def prevalence_rows(spark, sf_dir):
    known = spark.createDataFrame([("d1", 0.5), ("d2", 0.5)], "detector string, share double")
    return V.prevalence_rows(V.rank_bugs(_bugs(spark, sf_dir)), known)


_TOP_SQL = f"""
, cand AS (SELECT session_id, 'c' || seq AS id, request_id, 60 + id % 30 AS score, t, t - {6 * HOUR} AS a, t + {6 * HOUR} AS z FROM tel WHERE k = 'err')
, top AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, t, id) = 1)
, lnk AS (SELECT tel.session_id, tel.request_id, tel.t FROM tel JOIN top USING (session_id) WHERE tel.k = 'net.req' AND (tel.request_id = top.request_id OR tel.t BETWEEN a AND z))
, ids AS (SELECT session_id, request_id FROM lnk UNION SELECT session_id, request_id FROM top)"""


def _top(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = events_as_telemetry(spark, sf_dir)
    cand = e.where("k = 'err'").select("session_id", F.concat(F.lit("c"), F.col("seq").cast("string")).alias("id"), "request_id", (60 + F.col("id") % 30).alias("score"), "t", (F.col("t") - 6 * HOUR).alias("window_start"), (F.col("t") + 6 * HOUR).alias("window_end"))
    return e, V.top_findings(cand), e.where("k = 'net.req'").select("session_id", "request_id", F.col("t").alias("f_t"))


@query(_tel_sql(f"{_TOP_SQL} SELECT session_id, request_id, t AS f_t FROM lnk"))
def linked_requests(spark, sf_dir):
    _, top, linked = _top(spark, sf_dir)
    return V.linked_requests(top, linked)


@query(_tel_sql(f"{_TOP_SQL} SELECT r.session_id, r.seq FROM tel r LEFT JOIN top USING (session_id) WHERE r.k = 'net.res' AND (coalesce(r.t BETWEEN a AND z, false) OR (r.session_id, r.request_id) IN (SELECT session_id, request_id FROM ids))"))
def primary_window_rows(spark, sf_dir):
    e, top, linked = _top(spark, sf_dir)
    return V.primary_window_rows(e.where("k = 'net.res'").select("session_id", "t", "request_id", "seq"), top, linked).select("session_id", "seq")


# ---- over the orders


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS s, o_totalprice AS price FROM orders WHERE o_orderkey % 4 = 0), i AS (SELECT s, k * 1024 + 16 AS seq, 'Total' AS label, price AS v, 'r' || (k % 2) AS region FROM o UNION ALL SELECT s, k * 1024 + 16, 'Count ' || (k % 50), (k % 7)::DOUBLE, 'r' || (k % 2) FROM o)
, d AS (SELECT s, label, v, min(seq) AS seen FROM i GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY s, label ORDER BY seen, v) AS n, count(*) OVER (PARTITION BY s, label) AS c FROM d)
, g AS (SELECT s, label, list(v ORDER BY n) AS vals, max(c) AS n_values, min(seen) AS seen FROM p WHERE n < 6 OR n = c GROUP BY ALL), r AS (SELECT s, label, count(DISTINCT region)::INT AS n_regions FROM i GROUP BY ALL)
SELECT s AS session_id, label, len(vals)::INT AS shown, vals[1] AS first_value, vals[-1] AS last_value, n_values::BIGINT AS n_values, n_regions, place FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY len(vals) DESC, seen, label)::INT AS place FROM g JOIN r USING (s, label)) WHERE place <= 40""")
def screen_numbers(spark, sf_dir):
    e = orders_as_telemetry(spark, sf_dir).where("k = 'ui.num'")
    items = F.from_json(F.to_json(P.get("items", "variant")), "array<struct<label:string,value:double>>")
    shown = e.select("session_id", "seq", P.get("region").alias("region"), F.explode(items).alias("i")).select("session_id", "seq", "region", "i.label", "i.value")
    out = V.screen_numbers(shown)
    return out.select("session_id", "label", F.size("values").alias("shown"), F.element_at("values", 1).alias("first_value"), F.element_at("values", -1).alias("last_value"), F.col("n_values").cast("long").alias("n_values"), F.size("regions").alias("n_regions"), "place")


@query("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_partkey FROM lineitem)
SELECT 'q' || k AS request_id, 3 AS emitted, (max(i) - 3)::INT AS truncated, list(l_partkey ORDER BY i) FILTER (i > 3 AND i <= 5) AS sample_keys FROM l GROUP BY k HAVING max(i) > 3""")
def truncation_summary(spark, sf_dir):
    order = F.row_number().over(V.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = _read(spark, sf_dir, "lineitem").select(F.lit(1).alias("session_id"), F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("request_id"), F.lit("order_items").alias("table"), F.lit("insert").alias("op"), order.alias("seq"), F.col("l_partkey").alias("pk"))
    return V.truncation_summary(rows, 3, 2).select("request_id", "emitted", "truncated", "sample_keys")


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS s FROM orders) SELECT s AS session_id, bool_or(k % 5 = 0) AS has_environment, true AS has_network, bool_or(k % 8 <> 0 OR k % 11 = 0 OR k % 13 = 0 OR k % 31 = 0) AS has_backend, true AS has_db, false AS has_gaps FROM o GROUP BY s""")
def session_inspection(spark, sf_dir):
    return V.session_inspection(orders_as_telemetry(spark, sf_dir)).select("session_id", "has_environment", "has_network", "has_backend", "has_db", "has_gaps")


@query("""SELECT o_custkey AS session_id, o_orderkey AS bug_id, ['order_items', 'orders'] AS tables FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT o_custkey, o_orderkey, ['orders'] FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def bug_tables(spark, sf_dir):
    bugs = _read(spark, sf_dir, "orders").where("o_orderkey % 17 = 0").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("bug_id"), F.array(F.concat(F.lit("q"), F.col("o_orderkey").cast("string"))).alias("request_ids"))
    return V.bug_tables(bugs, orders_as_telemetry(spark, sf_dir).where("k = 'db.diff' AND table IN ('orders', 'order_items')"))


@query("""WITH c AS (SELECT o_custkey AS s, o_orderkey AS k, 'f' || (o_orderkey % 9) || '.ts' AS file, o_orderkey % 40 AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), f AS (SELECT s, file, line, min(place) AS place, arg_min(k, place) AS k FROM c GROUP BY ALL)
SELECT s AS session_id, file, line, rank, k AS signal_id FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY place, file, line)::INT AS rank FROM f) WHERE rank <= 12""")
def code_locations(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("id"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("request_id"))
    sites = o.select("session_id", F.col("id").alias("seq"), "request_id", F.concat(F.lit("f"), (F.col("id") % 9).cast("string"), F.lit(".ts")).alias("file"), (F.col("id") % 40).alias("line"))
    ranked = o.withColumn("place", F.row_number().over(V.Window.partitionBy("session_id").orderBy("id")))
    out = V.code_locations(ranked, V.request_callsites(sites, sites.withColumn("line", F.col("line"))))
    return out.select("session_id", "file", "line", "rank", "signal_id")


_ITEMS_SQL = """WITH b AS (SELECT o_orderkey AS bundle, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'order ' || o_orderpriority || ' slow checkout' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN '/part/' || (o_orderkey % 200) END AS url FROM orders WHERE o_orderkey % 4 = 0)
, i AS (SELECT l_orderkey AS bundle, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS idx, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, ['db', 'network', 'env', 'browser', 'logs', 'other', 'flow'][l_linenumber] AS lane,
 'order line slow GET /part/' || (l_partkey % 200) AS brief, 'net status' AS kind, l_discount = 0 AS meant FROM lineitem WHERE l_orderkey % 4 = 0)"""


def _bundles(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = _read(spark, sf_dir, "orders").where("o_orderkey % 4 = 0")
    title = F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.concat(F.lit("order "), F.col("o_orderpriority"), F.lit(" slow checkout")))
    b = o.select(F.col("o_orderkey").alias("bundle"), title.alias("title"), F.lit(None).cast("string").alias("description"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/part/"), (F.col("o_orderkey") % 200).cast("string"))).alias("url"))
    lane = F.element_at(F.array(*[F.lit(x) for x in ("db", "network", "env", "browser", "logs", "other", "flow")]), F.col("l_linenumber"))
    idx = F.row_number().over(V.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    i = _read(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0").select(
        F.col("l_orderkey").alias("bundle"), idx.alias("idx"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), lane.alias("lane"),
        F.concat(F.lit("order line slow GET /part/"), (F.col("l_partkey") % 200).cast("string")).alias("brief"), F.lit("net status").alias("kind"), F.lit(None).cast("string").alias("sig"), "l_discount")
    return b, i, i.where("l_discount = 0").select("bundle", "id")


_TOKENS_SQL = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: len(x) >= 3)"


@query(f"""{_ITEMS_SQL}, t AS (SELECT *, list_distinct({_TOKENS_SQL.format('title')}) AS x, list_distinct({_TOKENS_SQL.format("brief || ' ' || kind")}) AS y FROM i JOIN b USING (bundle))
, s AS (SELECT bundle, idx, lane, least(1.0::DOUBLE, CASE WHEN url IS NOT NULL AND contains(lower(' ' || brief), lower(url)) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.3::DOUBLE * (len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))) + CASE lane WHEN 'db' THEN 0.2::DOUBLE WHEN 'network' THEN 0.2::DOUBLE WHEN 'flow' THEN 0.15::DOUBLE WHEN 'env' THEN 0.1::DOUBLE WHEN 'browser' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END) AS score FROM t)
SELECT bundle, idx, round(score, 6) AS score, row_number() OVER (PARTITION BY bundle ORDER BY round(score, 9) DESC, idx)::INT AS rank FROM s""")
def evidence_relevance(spark, sf_dir):
    b, i, _ = _bundles(spark, sf_dir)
    return V.evidence_relevance(i, b).select("bundle", "idx", F.round("score", 6).alias("score"), "rank")


_HYPO_SQL = f"""{_ITEMS_SQL}, m AS (SELECT i.*, (bundle, id) IN (SELECT bundle, id FROM i WHERE meant) AS why FROM i)
, h AS (SELECT bundle, 'intentional-change' AS kind, 0.7::DOUBLE AS confidence, 1::BIGINT AS n FROM m WHERE why
 UNION ALL SELECT bundle, 'regression', least(0.9::DOUBLE, 0.4::DOUBLE + 0.1::DOUBLE * count(*)), count(*) FROM m WHERE NOT why AND lane IN ('network', 'db', 'flow') GROUP BY bundle
 UNION ALL SELECT bundle, 'environment', 0.5::DOUBLE, count(*) FROM m WHERE NOT why AND lane = 'env' GROUP BY bundle UNION ALL SELECT bundle, 'client-side', 0.5::DOUBLE, count(*) FROM m WHERE NOT why AND lane = 'browser' GROUP BY bundle
 UNION ALL SELECT bundle, 'latent', 0.3::DOUBLE, 0 FROM b WHERE title <> '' AND bundle NOT IN (SELECT bundle FROM i))
, a AS (SELECT * FROM h UNION ALL SELECT bundle, 'inconclusive', 0.2::DOUBLE, 0 FROM b WHERE bundle NOT IN (SELECT bundle FROM h))"""


@query(f"{_HYPO_SQL} SELECT bundle, kind, round(confidence, 6) AS confidence, n::INT AS n, count(*)::BIGINT AS times FROM a GROUP BY ALL")
def hypotheses(spark, sf_dir):
    b, i, meant = _bundles(spark, sf_dir)
    out = V.hypotheses(b, i, meant).select("bundle", "kind", F.round("confidence", 6).alias("confidence"), F.size("evidence").alias("n"))
    return out.groupBy("bundle", "kind", "confidence", "n").agg(F.count("*").alias("times"))


@query(f"{_HYPO_SQL} SELECT bundle, bundle % 20 = 0 OR bool_and(kind = 'inconclusive') AS recommended FROM a GROUP BY bundle")
def escalations(spark, sf_dir):
    b, i, meant = _bundles(spark, sf_dir)
    level = b.select("bundle", F.when(F.col("bundle") % 20 == 0, "low").otherwise("high").alias("level"))
    return V.escalations(V.hypotheses(b, i, meant), level)


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k, CASE WHEN k % 3 = 0 THEN 's' || k WHEN k % 5 = 0 THEN 'h' || k END AS session_id, CASE WHEN k % 4 = 0 THEN 'r' || k WHEN k % 7 = 0 THEN lpad(k::VARCHAR, 31, '0') || 'a' ELSE 'gen' END AS request_id,
 CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN CASE WHEN k % 4 = 0 OR k % 7 = 0 THEN 'linked' ELSE 'generated-request-id' END WHEN k % 4 = 0 OR k % 7 = 0 THEN 'missing-session' ELSE 'missing-session-and-request-id' END AS status,
 CASE WHEN k % 4 = 0 THEN 'option' WHEN k % 7 = 0 THEN 'traceparent' ELSE 'generated' END AS request_source, CASE WHEN k % 7 = 0 AND k % 3 <> 0 AND k % 5 <> 0 THEN 'header_stripped' END AS gap FROM o""")
def correlation_resolution(spark, sf_dir):
    k = F.col("k").cast("string")
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(
        "k", F.when(F.col("k") % 3 == 0, F.concat(F.lit("s"), k)).alias("option_session"), F.when(F.col("k") % 4 == 0, F.concat(F.lit("r"), k)).alias("option_request"), F.when((F.col("k") % 5 == 0) & (F.col("k") % 3 != 0), F.concat(F.lit("h"), k)).alias("header_session"),
        F.lit(None).cast("string").alias("header_request"), F.when(F.col("k") % 7 == 0, F.concat(F.lit("00-"), F.lpad(k, 31, "0"), F.lit("a-00000000000000ab-01"))).alias("traceparent"), F.lit("gen").alias("generated"))
    return V.resolve_correlation(o).select("k", "session_id", "request_id", "status", "request_source", "gap")


@query("""WITH o AS (SELECT o_custkey AS s, o_orderkey AS k, 'v' || (o_orderkey % 6) AS v FROM orders WHERE o_orderkey % 5 = 0), l AS (SELECT *, lag(v) OVER (PARTITION BY s ORDER BY k) AS b, row_number() OVER (PARTITION BY s ORDER BY k) AS r FROM o)
SELECT s AS session_id, k AS seq, b AS before, v AS value, CASE WHEN r = 1 THEN 'set' ELSE 'changed' END AS change FROM l WHERE r = 1 OR b <> v""")
def environment_deltas(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), F.create_map(F.lit("release"), F.concat(F.lit("v"), (F.col("o_orderkey") % 6).cast("string"))).alias("values"))
    return V.environment_deltas(o).drop("key")


@query("""SELECT o_orderkey AS "case", CASE WHEN o_orderkey % 6 = 0 THEN CASE WHEN o_orderkey % 12 = 0 THEN 'error' ELSE 'gapped' END WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'partial' ELSE 'full' END AS grade FROM orders WHERE o_orderkey < 400""")
def topology_fidelity(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").where("o_orderkey < 400").select(F.col("o_orderkey").alias("case"))
    want = o.select("case", F.lit("row").alias("row"), F.lit(2).alias("n"))
    got = o.select("case", F.lit("row").alias("row"), F.when((F.col("case") % 7 == 0) | (F.col("case") % 6 == 0), 1).otherwise(2).alias("n"))
    gaps = o.where("case % 6 = 0").select("case", F.lit("db").alias("surface"), F.lit("lost").alias("reason"), F.lit(True).alias("required"), (F.col("case") % 12 != 0).alias("emitted"))
    cases = o.select("case", F.lit(1).alias("action_t"), F.lit(2).alias("request_t"), F.lit(3).alias("first_row_t"), (F.col("case") % 5 != 0).alias("complete"))
    return V.topology_fidelity(want, got, gaps, cases)


@query("""WITH d AS (SELECT l_orderkey AS pair, ['db', 'flow', 'env', 'network', 'network', NULL, NULL][l_linenumber] AS plane, l_linenumber = 4 AS status FROM lineitem)
SELECT pair, CASE WHEN count(plane) = 0 OR bool_or(plane IN ('db', 'flow', 'env')) THEN 'high' WHEN bool_or(status) THEN 'medium' ELSE 'low' END AS confidence FROM d GROUP BY pair""")
def comparison_confidence(spark, sf_dir):
    plane = F.element_at(F.array(*[F.lit(x) for x in ("db", "flow", "env", "network", "network", None, None)]), F.col("l_linenumber"))
    d = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), plane.alias("plane"), F.when(F.col("l_linenumber") == 4, "net.status").otherwise("other").alias("kind"))
    return P.comparison_confidence(d)


@query("""SELECT 'network:net.missing:' || coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 's' || o_orderkey END, CASE WHEN o_orderkey % 2 = 0 THEN 'q' || o_orderkey END, o_orderkey::VARCHAR) || '#' || o_orderkey AS id, 'network' AS lane FROM orders""")
def divergence_evidence(spark, sf_dir):
    k = F.col("o_orderkey")
    d = _read(spark, sf_dir, "orders").select(k.alias("idx"), F.lit("network").alias("plane"), F.lit("net.missing").alias("kind"), F.lit("gone").alias("brief"), F.when(k % 3 == 0, F.concat(F.lit("s"), k.cast("string"))).alias("sig"), F.when(k % 2 == 0, F.concat(F.lit("q"), k.cast("string"))).alias("request_id"), F.lit(None).cast("string").alias("table"))
    return P.divergences_to_evidence(d).select("id", "lane")


@query("""SELECT s AS session_id, t, coalesce(nullif(left(d, 120), ''), NULL) AS detail, CASE WHEN n >= 0 THEN n END AS dropped, greatest(0, t - 1000) AS offset_ms FROM (SELECT o_custkey AS s, o_orderkey AS t, 'lost ' || (o_orderkey % 7) || ' rows' AS d, (o_orderkey % 5) - 1 AS n FROM orders)""")
def gap_events(spark, sf_dir):
    k = F.col("o_orderkey")
    g = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), k.alias("t"), F.lit("db").alias("surface"), F.lit("lost").alias("reason"), F.concat(F.lit("lost  "), (k % 7).cast("string"), F.lit(" rows ")).alias("detail"), F.lit("q").alias("request_id"), (k % 5 - 1).alias("dropped"), F.lit(1000).alias("started"))
    return V.gap_events(g).select("session_id", "t", "detail", "dropped", "offset_ms")


@query("""SELECT o_orderkey AS id, o_orderpriority AS class, (o_orderkey % 3)::BIGINT AS runs FROM orders WHERE o_orderkey % 3 < 2""")
def underfilled_runs(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("class"))
    runs = o.select("id", F.explode(F.expr("slice(array(1, 2), 1, CAST(id % 3 AS INT))")).alias("run"))
    return V.missing_classes(o, runs, 2)[1]
