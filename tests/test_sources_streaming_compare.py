import json

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import compare as C
from evidentia.sources import sinks, telemetry
from evidentia.streaming import signals


def test_ndjson_keeps_file_order_and_drops_bad_lines(spark, tmp_path):
    lines = ['{"t": 5, "k": "Error", "d": {"msg": "x", "requestId": "r"}}', "", "not json", '{"k": "nav"}', '{"t": 5, "k": "clk", "d": {"id": 7}}']
    (tmp_path / "s1.ndjson").write_text("\n".join(lines))
    (tmp_path / "s2.ndjson").write_text("")
    rows = telemetry.promote(telemetry.read_sessions_ndjson(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r["session_id"], r["seq"], r["t"], r["k"]) for r in rows] == [("s1", 0, 5, "err"), ("s1", 4, 5, "clk")]
    assert rows[0]["msg"] == "x" and rows[0]["request_id"] == "r" and rows[1]["id"] == "7"


def test_otlp_spans_and_logs(spark):
    value = lambda v: {"stringValue": v}
    span = {"traceId": "t1", "spanId": "s1", "name": "op", "startTimeUnixNano": "5000000", "endTimeUnixNano": "9000000", "status": {"code": "2"}, "attributes": [{"key": "a", "value": value("1")}, {"key": "a", "value": value("2")}], "events": [{"name": str(i), "timeUnixNano": "1"} for i in range(40)]}
    traces = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": value("api")}]}, "scopeSpans": [{"spans": [span]}]}]}
    logs = {"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "0", "observedTimeUnixNano": "7000000", "severityNumber": 17, "body": value("bad"), "traceId": "t1"}]}]}]}
    s = telemetry.read_otlp_spans(spark.createDataFrame([(json.dumps(traces),)], "body string")).first()
    assert (s["t"], s["dur"], s["request_id"], s["attributes"], s["resource"]) == (5, 4.0, "t1", {"a": "2"}, {"service.name": "api"}) and len(s["span_events"]) == 32
    r = telemetry.read_otlp_logs(spark.createDataFrame([(json.dumps(logs),)], "body string")).first()
    assert (r["t"], r["msg"], r["severity_number"]) == (7, "bad", 17)


def test_rehydrate_prefers_the_row(spark):
    e = spark.createDataFrame([(1, None), (1, "own"), (9, None)], "sigRef int, tag string")
    d = spark.createDataFrame([(1, "button")], "ref int, tag string")
    assert sorted(str(r["tag"]) for r in telemetry.rehydrate(e, d, "sigRef", ["tag"]).collect()) == ["None", "button", "own"]


def test_seal_and_idempotent_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d1", "s1", 0, 1), ("a", "d2", "s2", 0, 2)], "app string, date string, session_id string, seq int, v int")
    sinks.seal(rows, str(tmp_path / "cold"))
    assert spark.read.parquet(str(tmp_path / "cold")).count() == 2
    for _ in range(2):
        sinks.overwrite_sessions(rows.where("date = 'd1'").withColumn("v", F.lit(7)), str(tmp_path / "gold"))
        sinks.overwrite_sessions(rows.where("date = 'd2'"), str(tmp_path / "gold"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "gold")).collect()) == [2, 7]


def test_sessions_are_replaced_one_by_one(spark, tmp_path):
    path, schema = str(tmp_path / "gold"), "date string, session_id string, v int"
    write = lambda rows: sinks.overwrite_sessions(spark.createDataFrame(rows, schema), path, buckets=2)
    read = lambda: sorted(map(tuple, sinks.read_sessions(spark, path).select("date", "session_id", "v").collect()), key=repr)
    write([("d1", "a", 1), ("d1", "a", 2), ("d1", "b", 3), ("d2", "c", 4), ("d1", None, 5)])
    write([("d1", "a", 7)])
    assert read() == sorted([("d1", "a", 7), ("d1", "b", 3), ("d2", "c", 4), ("d1", None, 5)], key=repr)
    for _ in range(2):
        write([("d3", "c", 8), ("d1", None, 6)])  # one session moves to another date
        assert read() == sorted([("d1", "a", 7), ("d1", "b", 3), ("d3", "c", 8), ("d1", None, 6)], key=repr)


def test_a_job_deletes_its_own_tables_only(spark):
    from evidentia.session import Tables, job, path_exists

    outer = Tables(spark, "outer")
    kept = outer.store("t", spark.range(5))
    with job(spark):
        inner = Tables(spark, "inner")
        assert inner.store("t", spark.range(3)).count() == 3
        with job(spark):
            nested = Tables(spark, "nested")
            nested.store("t", spark.range(1))
        assert not path_exists(spark, nested.folder) and path_exists(spark, inner.folder)
    assert not path_exists(spark, inner.folder) and kept.count() == 5
    outer.close()
    assert not path_exists(spark, outer.folder)


CLICKS = [("s", "b", t) for t in (0, 100, 200, 300, 400, 9000)]


def test_burst_resets_when_it_fires(spark):
    got = signals.bursts(spark.createDataFrame(CLICKS, "session_id string, key string, t long")).collect()
    assert [(r["t"], r["n"]) for r in got] == [(300, 4)]


def test_stream_agrees_with_its_batch_twin(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame(CLICKS, "session_id string, key string, t long").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("session_id string, key string, t long").json(str(source))
    q = signals.bursts_stream(stream).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["t"], r["n"]) for r in spark.table("fired").collect()] == [(300, 4)]


def test_abandoned_flow_and_throttle(spark):
    rows = [("s", n, t, k, m, None) for n, (t, k, m) in enumerate([(0, "inp", None), (10, "inp", None), (500, "vis", "hidden"), (600, "inp", None), (700, "vis", "hidden")])]
    rows += [("u", 0, 0, "inp", None, None), ("u", 1, 10, "inp", None, None), ("u", 2, 20, "net.req", None, "POST"), ("u", 3, 30, "vis", "hidden", None)]
    e = spark.createDataFrame(rows, "session_id string, seq long, t long, k string, msg string, method string")
    assert [(r["session_id"], r["t"]) for r in signals.abandoned_flows(e).collect()] == [("s", 500)]
    ts = spark.createDataFrame([("a", t) for t in (0, 60, 120, 130, 240)], "k string, t long")
    assert sorted(r["t"] for r in signals.throttle(ts, ["k"], 100).collect()) == [0, 120, 240]


def test_greedy_alignment(spark):
    def side(*sigs):
        return spark.createDataFrame([("p", i, "clk", s) for i, s in enumerate(sigs)], "pair string, idx int, kind string, sig string")

    got = C.align_steps(side("a", "b", "c", "z"), side("b", "a", "c", "c")).collect()
    assert sorted((str(r["a_idx"]), str(r["b_idx"]), r["change"]) for r in got) == [("0", "1", "paired"), ("1", "0", "paired"), ("2", "2", "paired"), ("3", "None", "missing"), ("None", "3", "added")]


def test_network_diff_and_cookies(spark):
    schema = "pair string, anchor int, method string, url string, st int, dur double, t long"
    a = spark.createDataFrame([("p", 0, "GET", "http://x/o/12", 200, 100.0, 1), ("p", 0, "GET", "/gone", 200, 1.0, 2), ("p", 1, "GET", "/slow", 200, 100.0, 3)], schema)
    b = spark.createDataFrame([("p", 0, "GET", "/o/99", 500, 90.0, 1), ("p", 1, "GET", "/slow", 200, 400.0, 3)], schema)
    assert {r["route"]: r["divergence"] for r in C.network_diff(a, b).collect()} == {"/o/<id>": "status", "/gone": "missing", "/slow": "slower"}
    snaps = spark.createDataFrame([("s", 0, 0, {"a": "1"}), ("s", 1, 1, {"a": "2", "b": "1"}), ("s", 2, 2, {"b": "1"})], "session_id string, seq int, t long, cookies map<string,string>")
    assert sorted((r["seq"], r["name"], r["change"]) for r in C.cookie_changes(snaps).collect()) == [(0, "a", "set"), (1, "a", "mod"), (1, "b", "set"), (2, "a", "del")]


def test_noise_lanes_and_roles(spark):
    d = spark.createDataFrame([("id 123e4567-e89b-12d3-a456-426614174000 at 2024-01-02T03:04:05Z, 1700000000000",), ("plain",)], "v string")
    value, rules = C.without_noise(F.col("v"))
    assert [(r[0], r[1]) for r in d.select(value, rules).collect()] == [("id <uuid> at <ts>, <epoch>", ["uuid", "timestamp", "epoch"]), ("plain", [])]
    e = spark.createDataFrame([(1, "db"), (1, "db"), (1, "ui")], "bundle int, lane string")
    r = C.lane_report(e, ["ui", "net"]).first()
    assert (r["present"], r["missing"]) == (["db", "ui"], ["net"])
    c = spark.createDataFrame([("s", x) for x in "abz"], "session_id string, id string")
    f = spark.createDataFrame([("s", "b", "a", 2)], "session_id string, id string, root string, sure int")
    assert {x["id"]: (x["role"], x["causes"]) for x in C.roles(c, f).collect()} == {"a": ("root", ["b"]), "b": ("symptom", None), "z": ("isolated", None)}


@pytest.mark.parametrize(("expression", "want"), [
    (lambda: X.fnv1a_base36(F.lit("hello")), "m3bicr"), (lambda: X.luhn_valid(F.lit("4111111111111111")), True), (lambda: X.luhn_valid(F.lit("4111111111111112")), False),
    (lambda: X.shannon_entropy(F.lit("aabb")), 1.0), (lambda: X.statement_class(F.lit("-- x\nWITH a AS (SELECT 1) INSERT INTO t SELECT 1")), "mutation"), (lambda: X.statement_class(F.lit("select 1")), "read"),
    (lambda: X.statement_shape(F.lit("SELECT * FROM t WHERE a = 'x' AND b IN (1, 2)")), "SELECT * FROM t WHERE a = ? AND b IN (?)"), (lambda: X.route(F.lit("https://h/a/123/b?x=1")), "/a/<id>/b"),
])
def test_functions(spark, expression, want):
    assert spark.range(1).select(expression().alias("v")).first()["v"] == want
