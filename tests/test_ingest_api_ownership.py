"""Ingestion, the bounded read API, and ownership of nodes, on fixtures."""

import json

from pyspark.sql import functions as F

from evidentia import api
from evidentia.operators import ownership as O
from evidentia.sources import ingest, sinks
from evidentia.sources.telemetry import promote

LINES = [
    json.dumps({"t": 1, "k": " Error ", "d": {"msg": "x"}, "sessionId": "s"}), json.dumps({"t": "1", "k": "err", "d": {}}), json.dumps({"t": 1, "k": " ", "d": {}}), json.dumps({"t": 1, "k": "err", "d": 3}),
    json.dumps({"t": 1, "k": "err", "d": {}, "schemaVersion": 9}), json.dumps({"t": 1, "k": "err", "d": {}, "platform": "toaster"}), "[1]", "not json", json.dumps({"t": 2.5, "k": "odd.kind", "d": {}, "sessionId": "s"}),
]
ERRORS = [None, "t must be a finite number", "k must be a non-empty string", "d must be an object", "schemaVersion must be 1", "platform is unknown", "must be an object", "must be an object", None]


def test_validation_of_batches_and_streams(spark, tmp_path):
    table = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = {r["line"]: (r["error"], r["k"]) for r in ingest.validate(table).collect()}
    assert [got[x][0] for x in LINES] == ERRORS and got[LINES[0]][1] == "err"
    assert [r["k"] for r in ingest.unrecognised(ingest.validate(table).where("error IS NULL")).collect()] == ["odd.kind"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(LINES))
    q = ingest.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state")
    assert q.awaitTermination(180)
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2 and spark.read.parquet(f"{tmp_path}/bad").count() == 7


def test_scans_commits_and_sources(spark):
    e = spark.createDataFrame([("s", 1, 7, None), ("s", 2, None, "own")], "session_id string, seq long, ref int, name string")
    words = spark.createDataFrame([(7, "seven")], "ref int, name string")
    stubs = spark.createDataFrame([("s", 9), ("u", 1)], "session_id string, seq long")
    got = sorted((r["session_id"], r["seq"], r["name"]) for r in ingest.comparison_scan(e, words, stubs, "ref", ["name"]).collect())
    assert got == [("s", 1, "seven"), ("s", 2, "own"), ("u", 1, None)]
    commits = spark.createDataFrame([("main", k, f"c{k}", "m") for k in range(6)] + [("other", 1, "c1", "m")], "branch string, position int, sha string, message string")
    assert [(r["rank"], r["sha"]) for r in ingest.commits_between(commits, "c1", "c4").orderBy("rank").collect()] == [(1, "c4"), (2, "c3"), (3, "c2")]
    ingest.evidence_source("tickets-test", "tickets")(lambda s: s.select("bundle", F.lit("t1").alias("id"), F.lit("ticket").alias("kind"), F.lit("slow").alias("brief")))
    rows = ingest.gather_evidence(spark.createDataFrame([("b",)], "bundle string"), ["tickets-test"]).collect()
    assert [(r["bundle"], r["lane"], r["request_id"]) for r in rows] == [("b", "tickets", None)]


def test_sinks_cap_append_and_manifest(spark, tmp_path):
    e = spark.createDataFrame([("s", k, "x" * 9, "2024-01-01") for k in range(5)], "session_id string, seq long, line string, date string")
    kept, counts = sinks.cap_bytes(e, "line", 30)
    assert sorted(r["seq"] for r in kept.collect()) == [0, 1, 2] and [(r["accepted"], r["dropped"], r["truncated"]) for r in counts.collect()] == [(3, 2, True)]
    for _ in range(2):
        sinks.append_log(kept, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6
    m = {r["artifact"]: (r["rows"], r["raw_bytes"]) for r in sinks.manifest({"events": e}, {"events": "line"}).collect()}
    assert m == {"events": (5, 45)}


def _events(spark):
    rows = [("s", 1, 10, "net.req", {"id": "a", "url": "/x"}), ("s", 2, 20, "net.res", {"id": "a", "st": 500}), ("s", 3, 30, "err", {"msg": "m"}), ("s", 4, 40, "stor", {"key": "k", "newVal": "v"}), ("u", 1, 5, "clk", {})]
    raw = spark.createDataFrame([(s, q, t, k, json.dumps(d)) for s, q, t, k, d in rows], "session_id string, seq long, t long, k string, d string")
    return promote(raw.withColumn("d", F.parse_json("d")))


def test_bounded_reads(spark):
    e = _events(spark)
    assert [r["seq"] for r in api.get_events(e, "s", after=20, before=30).collect()] == [2, 3] and api.get_events(e, "s", limit=0).count() == 1
    window, counts = api.get_window(e, "s", 40, 20, 2)
    assert [r["seq"] for r in window.collect()] == [2, 3] and tuple(counts.first()) == (3, 2)
    assert [r["seq"] for r in api.get_failed_requests(e, "s").collect()] == [2]
    assert {r["seq"] for r in api.get_error_context(e, "s").collect()} == {1, 2, 4}
    assert [r["key"] for r in api.get_storage_changes(e, "s").collect()] == ["k"]
    sessions = spark.createDataFrame([("a", 1, 9, 0, "x"), ("b", 2, 3, 1, "y"), ("c", 3, 4, 0, "x")], "session_id string, start long, end long, errors int, app string")
    assert [r["session_id"] for r in api.list_sessions(sessions, app="x").collect()] == ["c", "a"] and api.get_latest_issue(sessions).first()["session_id"] == "b"
    c = spark.createDataFrame([("a", "z", "r1", 5), ("b", "a", "r2", 9), ("d", "q", "r2", 7)], "id string, signature string, request_id string, score int")
    assert [r["id"] for r in api.get_evidence(c, "a").collect()] == ["a"] and [r["id"] for r in api.get_evidence(c, "r2").collect()] == ["b", "d"]
    bugs = spark.createDataFrame([("s", "b1", "low", 1, 2), ("s", "b2", "high", 1, 2), ("s", None, "high", 1, 2)], "session_id string, bug_id string, severity string, first_seen long, last_seen long")
    assert [r["bug_id"] for r in api.list_distinct_bugs(bugs, "s").collect()] == ["b2", "b1"]
    cand = spark.createDataFrame([("s", "f", "http_error", 90, 20, "a", 10, 25)], "session_id string, id string, detector string, score int, t long, request_id string, window_start long, window_end long")
    roles = spark.createDataFrame([("s", "f", "isolated", None, None)], "session_id string, id string, role string, root string, causes array<string>")
    linked = spark.createDataFrame([("s", "a", 10)], "session_id string, request_id string, f_t long")
    ctx = api.get_fix_context(cand, roles, linked, {"events": e.select("session_id", "t", "request_id", "seq")}, "s")
    assert [r["seq"] for r in ctx["events"].collect()] == [1, 2] and ctx["chain"].first()["absence"] == "top_candidate_isolated" and ctx["requests"].count() == 1


def test_ownership_of_nodes(spark):
    nodes = [("s", "res1", "net.res", 100, "r1"), ("s", "w1", "db.write", 90, "r1"), ("s", "w2", "db.write", 95, "r1"), ("s", "fe", "frontend.error", 500, None)]
    n = spark.createDataFrame(nodes, "session_id string, id string, kind string, t long, request_id string")
    cands = [("s", "c1", "db_mutation", 90, None), ("s", "c2", "db_client_supplied_value", 90, None), ("s", "c3", "uncaught_error", 600, None), ("s", "c4", "uncaught_error", 700, None), ("s", "c5", "user_marker", 100, None), ("s", "c6", "http_error", 101, "r1"), ("s", "c7", "otel_log_error", 100, None)]
    c = spark.createDataFrame(cands, "session_id string, id string, detector string, t long, request_id string")
    got = {r["id"]: (r["node"], r["cause"], r["held_by"]) for r in O.own_nodes(c, n).collect()}
    assert got == {
        "c2": ("w1", None, None), "c1": (None, "lost-contention", "c2"), "c3": ("fe", None, None), "c4": (None, "lost-contention", "c3"), "c5": (None, "no-node-family", None), "c6": ("res1", None, None), "c7": (None, "no-compatible-node", None),
    }
