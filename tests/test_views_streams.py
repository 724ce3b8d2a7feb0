"""Views without a DuckDB form, streams and graph walks on fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.operators import graph as G
from evidentia.operators import joins as J
from evidentia.operators import views as V
from evidentia.sources import telemetry
from evidentia.streaming import signals as S


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_roots_follow_long_chains_and_clamp_writes(spark):
    ids = [f"n{k:03}" for k in range(40)]
    nodes = spark.createDataFrame([("s", i, "db.write" if i in ("n000", "n039", "w") else "net.req") for i in [*ids, "w"]], "session_id string, id string, kind string")
    edges = [("s", a, b, "high") for a, b in zip(ids, ids[1:], strict=False)] + [("s", "w", "n000", "high"), ("s", "n001", "n000", "low")]
    edges = spark.createDataFrame(edges, "session_id string, src string, dst string, confidence string")
    owned = spark.createDataFrame([("s", "n000"), ("s", "n039"), ("s", "w")], "session_id string, id string")
    assert rows(G.roots(nodes, edges, owned), "id", "root", "sure", "hops") == [("n000", "w", 1, 1), ("n039", "n000", 1, 39)]


def test_null_safe_joins(spark):
    a = spark.createDataFrame([("m", None, 1)], "method string, route string, t int")
    assert [r["change"] for r in J.fifo_match(a, a, ["method", "route"], "t").collect()] == ["paired"]
    left = spark.createDataFrame([("a", None), ("b", "1"), ("c", None)], "key string, value string")
    right = spark.createDataFrame([("a", None), ("b", None), ("d", None)], "key string, value string")
    assert rows(J.env_diff(left, right), "key", "change") == [("b", "changed"), ("c", "removed"), ("d", "added")]
    f = spark.createDataFrame([("s", "r", 1, None)], "session_id string, request_id string, seq int, t long")
    b = spark.createDataFrame([("s", "r", None, None)], "session_id string, request_id string, t long, status string")
    assert rows(J.full_stack(f, b), "type") == [("linked",)]


def test_ndjson_lines_keep_their_place_when_files_are_split(spark, tmp_path):
    lines = [json.dumps({"t": k, "k": "clk", "d": {"n": k}}) if k % 7 else "" for k in range(400)]
    (tmp_path / "one.ndjson").write_text("\n".join(lines))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = telemetry.read_sessions_ndjson(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= 1 and rows(got, "seq", "t") == sorted(((k, k) for k in range(400) if k % 7), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_auto_flags(spark, tmp_path):
    sent = [("s", 1000, "a", "x"), ("s", 1050, "b", "y"), ("s", 1060, "a", "x"), ("s", 1500, "c", "z"), ("s", 1900, "d", "w"), ("u", 1005, "a", "x")]
    signals = spark.createDataFrame(sent, "session_id string, t long, key string, tag string")
    assert rows(S.auto_flags(signals, 100, 2), "session_id", "t", "key") == [("s", 1000, "a"), ("s", 1500, "c"), ("u", 1005, "a")]
    signals.coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(signals.schema).json(f"{tmp_path}/in")
    q = S.auto_flags_stream(stream, 100, 2, "0 seconds").writeStream.format("memory").queryName("flags").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert {(r["session_id"], r["t"]) for r in spark.table("flags").collect()} >= {("s", 1000), ("s", 1500)}


def test_buffers_and_late_data(spark):
    e = spark.createDataFrame([("s", k, 100 * k) for k in range(10)], "session_id string, seq long, t long")
    at = spark.createDataFrame([("s", 500)], "session_id string, flag_t long")
    assert rows(S.ring_snapshot(e, at, 350, 3), "seq") == [(3,), (4,), (5,)]
    kept, drops = S.bounded_bus(e, F.floor(F.col("seq") / 5), 3)
    assert rows(kept, "seq") == [(2,), (3,), (4,), (7,), (8,), (9,)] and rows(drops, "batch", "dropped") == [(0, 2), (1, 2)]
    t = spark.createDataFrame([("s", x) for x in (0, 10, 200, 500, 2000)], "session_id string, t long")
    assert rows(S.early_looks(t, 100, 400), "look_t") == [(110,), (2100,), (600,)]
    done = spark.createDataFrame([("s", 800), ("u", 0)], "session_id string, end long")
    assert rows(S.late_sessions(e, done, 50), "session_id", "newest") == [("s", 900)]


def test_chains_and_trees(spark):
    c = spark.createDataFrame([("a", "r", "http", 90, 1, None), ("a", "x", "err", 80, 2, None), ("b", "i", "err", 70, 1, "h"), ("c", "l", "err", 70, 1, None), ("d", "q", "err", 50, 1, None)], "session_id string, id string, detector string, score int, t long, contended_by string")
    r = spark.createDataFrame([("a", "r", "root", None, ["x", "gone"]), ("a", "x", "symptom", "r", None), ("b", "i", "isolated", None, None), ("c", "l", "isolated", None, None), ("d", "q", "root", None, ["nothing"])], "session_id string, id string, role string, root string, causes array<string>")
    got = {x["session_id"]: (x["root"], x["symptoms"], x["absence"]) for x in V.causal_chains(c, r).collect()}
    assert got == {"a": ("r", ["x"], None), "b": (None, None, "top_candidate_lost_contention"), "c": (None, None, "top_candidate_isolated"), "d": (None, None, "root_attributed_no_symptoms")}
    assert rows(V.causal_trees(c, r), "session_id", "root", "symptoms") == [("a", "r", ["x"])]


def test_summaries(spark):
    e = spark.createDataFrame([("s", 1, "tab.boundary", "kept"), ("s", 2, "tab.boundary", None), ("s", 3, "probe.ready", None), ("s", 4, "probe.error", None)], "session_id string, seq long, k string, what string")
    b = V.boundary_summary(e, F.col("what")).first()
    assert (b["decisions"], b["n"], b["last"]) == ({"kept": 1, "unknown": 1}, 2, "unknown")
    assert rows(V.probe_summary(e), "ready", "failed", "working") == [(1, 1, False)]
    f = spark.createDataFrame([("s", "redacted", "jwt", "a"), ("s", "redacted", "jwt", "a"), ("s", "dropped", "size", "b")], "session_id string, action string, reason string, path string")
    assert rows(V.redaction_summary(f), "action", "n", "paths") == [("dropped", 1, 1), ("redacted", 2, 1)]
    st = spark.createDataFrame([("s", 2, "local", {"a": "1", "b": "2"}), ("s", 1, "local", {"a": "1"})], "session_id string, seq long, area string, items map<string,string>")
    assert rows(V.storage_summary(st), "area", "n_keys") == [("local", 1)]


def test_orders_of_requests_and_gaps(spark):
    linked = spark.createDataFrame([("s", 5, None, "b"), ("s", 5, 1, "a"), ("s", 1, 9, "c")], "session_id string, f_t long, b_start long, request_id string")
    assert rows(V.linked_order(linked), "place", "request_id") == [(1, "c"), (2, "b"), (3, "a")]
    gaps = spark.createDataFrame([("s", "x", None, 4, None, None, None), ("s", "a", 4, None, None, None, "r"), ("s", "z", None, None, None, None, None)], "session_id string, type string, f_t long, b_start long, b_end long, b_error long, request_id string")
    assert rows(V.gap_order(gaps), "place", "type") == [(1, "z"), (2, "a"), (3, "x")]


def test_recall_sections_and_evidence(spark):
    scored = spark.createDataFrame([("q", "b1", "s1", 0.9), ("q", "b2", "s2", 0.5), ("q", "b3", None, 0.4)], "query_session string, bug_id string, signature string, score double").withColumn("session_id", F.lit("z"))
    assert rows(V.best_per_signature(scored.unionByName(scored)), "bug_id") == [("b1",), ("b2",), ("b3",), ("b3",)]
    dup = spark.createDataFrame([("q", "b1", "s1")], "query_session string, bug_id string, signature string")
    q = spark.createDataFrame([("q",)], "query_session string")
    assert rows(V.precedents(q, scored.where("signature IS NOT NULL"), dup), "section", "bug_id") == [("duplicate", "b1"), ("precedent", "b2")]
    out = spark.createDataFrame([(1, "matched", "s1"), (2, "ambiguous", "s1"), (3, "inconclusive", None)], "incident int, outcome string, session_id string")
    ranked = spark.createDataFrame([(2, f"s{k}", 0.5 + k / 10) for k in range(5)], "incident int, session_id string, confidence double")
    got = {x["incident"]: (x["kind"], x["session_id"], x["reason"], x["candidates"]) for x in V.located_evidence(out, ranked).collect()}
    assert got == {1: ("evidence", "s1", None, None), 2: ("gap", None, "ambiguous", ["s4", "s3", "s2"]), 3: ("gap", None, "inconclusive", None)}
    h = spark.createDataFrame([("b", "regression", ["e1", "e2", "e3", "e4"]), ("c", "inconclusive", ["e1"])], "bundle string, kind string, evidence array<string>")
    items = spark.createDataFrame([("b", "e1", "db", "t", '{"id":1}', "r", None), ("b", "e2", "network", None, None, "r", None), ("b", "e3", "flow", None, None, None, "sig"), ("b", "e4", "db", "t", "{}", None, None), ("c", "e1", "db", "t", "{}", "r", None)],
                                  "bundle string, id string, lane string, table string, pk string, request_id string, sig string")
    assert rows(V.verifications(h, items), "id", "how") == [("e1", "db"), ("e2", "request"), ("e3", "session")]
    b = spark.createDataFrame([("b", "t", "u", None, None, " given ", None), ("c", "t", "u", None, "r", None, "s9")], "bundle string, title string, url string, source string, release string, error_sig string, located string")
    got = {x["bundle"]: (x["signature"], x["canonical_id"]) for x in V.capsule_identity(b).collect()}
    assert got["b"] == ("given", "given") and got["c"][0].startswith("sig_") and got["c"][1] == "s9"


@pytest.mark.parametrize("most", [1, 2])
def test_key_timeline_keeps_its_ends(spark, most):
    e = spark.createDataFrame([("s", k, 10 * k, "clk") for k in range(5)], "session_id string, seq long, t long, k string")
    got = V.key_timeline(e, F.when(F.col("seq") == 2, "told"), most).collect()
    assert [x["summary"] for x in sorted(got, key=lambda x: x["rank"])] == ["first recorded event (clk)", "told"][:most]


def test_bursts_sessions_and_shifts(spark):
    from evidentia.operators import aggregates as A

    net = [("s", k, 100 * k, "net.req", None, "GET /a", None) for k in range(5)] + [("s", 10, 9000, "net.req", None, "GET /b", None)] + [("s", 20 + k, 600 + k, "net.res", 500, "GET /a", None) for k in range(2)] + [("u", k, 1000 * k, "net.res", 200, "GET /c", 3500.0) for k in range(3)]
    e = spark.createDataFrame(net, "session_id string, seq long, t long, k string, st int, url string, dur double")
    assert rows(S.retry_storms(e, F.col("url")), "session_id", "key", "t", "kind") == [("s", "GET /a", 300, "requests"), ("s", "GET /a", 601, "failures")]
    assert rows(S.slow_responses(e), "session_id", "t") == [("u", 2000)]
    spans = spark.createDataFrame([("pay", "a", 10), ("pay", "a", 1_900_000), ("pay", "b", 1_900_000)], "service string, trace_id string, t long")
    assert rows(S.tumbling_sessions(spans), "trace_id", "session_id", "t") == [("a", "auto-pay-0", 10), ("a", "auto-pay-0", 1_900_000), ("b", "auto-pay-1", 1_900_000)]
    shifts = spark.createDataFrame([("s", k, t, v) for k, (t, v) in enumerate([(0, 0.1), (500, 0.2), (2000, 0.25), (2900, 0.1)])], "session_id string, seq long, t long, value double")
    got = A.layout_shift(shifts).first()
    assert round(got["score"], 6) == 0.35 and got["windows"] == 2


def test_outcomes_scopes_and_samples(spark):
    from evidentia.functions import text as X
    from evidentia.operators import compare as C
    from evidentia.operators import locate as L
    from evidentia.operators import projections as P

    def outcome(*confidences):
        ranked = spark.createDataFrame([(k + 1, c) for k, c in enumerate(confidences)], "rank int, confidence double")
        return L.outcome(ranked).first()["outcome"]

    assert (outcome(0.9, 0.5), outcome(0.9, 0.85), outcome(0.4), outcome(0.7)) == ("matched", "ambiguous", "inconclusive", "matched")
    scoped = spark.createDataFrame([("T", "p"), (None, None), ("other", "p"), ("t ", "q"), ("", "P")], "tenant string, app string")
    assert rows(scoped.where(P.in_scope("t", "p")), "tenant", "app") == [("", "P"), ("T", "p"), (None, None)]
    ids = spark.range(20000).select(F.col("id").cast("string").alias("session_id"))
    n = ids.where(P.admitted(0.25)).count()
    assert 4700 < n < 5300 and ids.repartition(7).where(P.admitted(0.25)).count() == n
    one = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(X.traceparent(F.lit("00-" + "0" * 31 + "a-" + "0" * 15 + "b-01")))], X.fnv1a_hex(F.lit("hello"), "s").alias("h"), X.fnv1a_hex(F.lit("shello")).alias("g")).first()
    assert (one["c0"], one["c1"]) == ("0" * 31 + "a", "0" * 15 + "b") and one["h"] == one["g"] and len(one["h"]) == 8
    w = "pair string, anchor int, engine string, table string, op string, t long"
    left = spark.createDataFrame([("p", None, None, "t", None, 1), ("p", 1, "mysql", "t", "update", 2)], w)
    right = spark.createDataFrame([("p", None, "postgres", "t", "insert", 1)], w)
    assert rows(C.write_diff(left, right), "table", "op", "change") == [("t", "insert", "paired"), ("t", "update", "missing")]
    ev = spark.createDataFrame([("b", "db"), ("b", "network"), ("b", "env"), ("c", "logs")], "bundle string, lane string")
    gaps = spark.createDataFrame([("c", "source-unavailable")], "bundle string, kind string")
    assert rows(L.completeness(ev, gaps), "bundle", "level") == [("b", "medium"), ("c", "low")]
