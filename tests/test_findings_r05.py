"""Findings of round 5: each of these failed before its mend, or holds what the mend must keep."""

import json
import re

import duckdb
from pyspark.sql import functions as F

from evidentia import session
from evidentia.operators import detectors as D
from evidentia.operators import row_versions as V
from evidentia.plans import commerce_queries as C
from evidentia.plans import integrity_queries as I
from evidentia.plans import queries as Q
from evidentia.session import Tables
from evidentia.sources import commerce
from evidentia.sources import ledger as L
from evidentia.sources import telemetry as T

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _stored(spark, monkeypatch, run):
    kept, store = {}, Tables.store

    def keep(self, name, df, partition=None):
        kept.setdefault(name, []).append(partition)
        return store(self, name, df, partition)

    monkeypatch.setattr(Tables, "store", keep)
    return run(), kept


def test_relational_findings_store_row_changes_by_table_and_look_at_names_once(spark, monkeypatch):
    df, kept = _stored(spark, monkeypatch, lambda: I.relational_findings(spark, SF))
    assert kept == {"row_changes": ["folder"], "references": [None], "pointing_columns": [None], "report_sums": [None]}
    assert re.search(r"PartitionFilters: \[[^]]*folder", df._jdf.queryExecution().executedPlan().toString()), "tables are told apart by folder"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLES['relational_findings']})").fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)


def test_a_table_by_folders_is_written_with_files_side_by_side(spark, monkeypatch):
    key, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    rows, before, setting = spark.range(1000).selectExpr("id", "concat('k', id % 7) AS k"), spark.conf.get(key), session._setting
    monkeypatch.setattr(session, "_setting", lambda *named: seen.append(named[1:]) or setting(*named))
    back = Tables(spark, "folders").store("t", rows, "k")
    assert seen == [(key, str(session.OPEN_FILES))] and spark.conf.get(key) == before
    assert sorted(map(tuple, back.select("id", "k").collect())) == sorted(map(tuple, rows.collect()))


def test_row_changes_of_odd_payloads_and_names(spark):
    payloads = [
        '{"pk":{"id":7},"after":{"a":1,"b":null,"c":{"x":[1]}},"before":{"a":"0"}}', '{"pk":{"a":1,"b":"2"},"after":null,"before":{"a":1.50}}', '{"pk":5,"after":"text","before":[1]}', '{"pk":"k","after":{}}',
        '{"pk":{},"after":{"id":3}}', '{"pk":null,"before":{"id":4}}', '{"pk":[1,2]}', '{"pk":{"id":null},"after":{"id":8}}', '{"pk":{"id":""},"after":{"id":8}}', "{}", "7", "[]", "null", None,
    ]
    rows = [(i, table, text) for i, text in enumerate(payloads) for table in ("Orders", "", None, "a/b=c", "01")]
    events = spark.createDataFrame(rows, "seq long, table string, text string").selectExpr("1 AS session_id", "seq", "seq AS t", "'db.diff' AS k", "'q' AS request_id", "'UPDATE' AS op", "table", "parse_json(text) AS d")
    field = lambda path, kind: F.try_variant_get("d", f"$.{path}", kind)
    image = "map<string,string>"
    keys = F.map_values(field("pk", image))
    pk = F.coalesce(F.when(F.size(keys) > 0, F.array_join(keys, " ")), field("pk", "string"), field("after", image)["id"], field("before", image)["id"])
    text = lambda c: F.to_json(c)
    want = events.select("seq", F.lower("table").alias("table"), pk.alias("pk"), text(field("before", image)).alias("before"), text(field("after", image)).alias("after"))
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    told = lambda df: df.select("seq", "table", "pk", text(F.col("before")).alias("before"), text(F.col("after")).alias("after"))
    assert as_rows(told(V.row_changes(events))) == as_rows(want)
    D._STORED[id(events)] = (events, Tables(spark, "odd"), {})
    try:
        assert as_rows(told(V.row_changes(events))) == as_rows(want)
    finally:
        D._STORED.pop(id(events))


def test_ledger_payloads_are_those_of_json_text(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").limit(40)
    odd = lines.limit(6).withColumn("l_quantity", F.lit(None).cast("double")).unionByName(lines.limit(5).withColumn("l_partkey", F.lit(None).cast("long")))
    lines.unionByName(odd).write.parquet(f"{tmp_path}/lineitem.parquet")
    events = L.ledger_as_telemetry(spark, str(tmp_path)).collect()
    whole = lambda x: all(map(whole, x.values())) if isinstance(x, dict) else x is not None
    assert events and all(whole(json.loads(str(e["d"]))) for e in events)
    assert any("inventory" not in json.loads(str(e["d"]))["after"] for e in events if e["table"] == "products"), "a value that is not there is no field"
    assert _plan(L.ledger_as_telemetry(spark, SF)).count("to_variant_object") > 0


def test_orders_are_cut_into_tasks_by_their_number(spark, monkeypatch):
    plain = sorted(map(repr, commerce.orders_as_telemetry(spark, SF).drop("d").collect()))
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    monkeypatch.setattr(commerce, "TASK_ORDERS", 100)
    assert "RepartitionByExpression [k#" in _plan(commerce.orders_as_telemetry(spark, SF))
    for most, tasks in ((200_000, min(-(-n // 100), 4 * spark.sparkContext.defaultParallelism)), (20, -(-n // 20))):
        monkeypatch.setattr(commerce, "MOST_ORDERS", most)
        rows = commerce.orders_as_telemetry(spark, SF)
        assert f", {tasks}\n" in _plan(rows)
        assert sorted(map(repr, rows.drop("d").collect())) == plain


def test_hot_fields_of_orders_are_those_of_their_payloads(spark):
    rows = commerce.orders_as_telemetry(spark, SF)
    own = T.promote(rows.select("session_id", "seq", "t", "k", "d"))
    assert own.count() > 10_000 and rows.drop("d").exceptAll(own.drop("d")).isEmpty()
    assert "NULL" not in commerce._hot("st")._jc.toString() and commerce._hot("request_id")._jc.toString().count("WHEN") == 1


def test_commerce_findings_are_written_in_methods_that_the_jvm_compiles(spark, monkeypatch):
    limits, store, key = [], Tables.store, "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    monkeypatch.setattr(Tables, "store", lambda self, *more, **named: limits.append(spark.conf.get(key)) or store(self, *more, **named))
    df = C.commerce_findings(spark, SF)
    assert set(limits) == {"8000"} and spark.conf.get(key) == before
    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLES['commerce_findings']})").fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)
