"""Findings of round 3: each of these failed before its mend."""

from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import source_maps as M
from evidentia.functions import stats
from evidentia.functions import text as X
from evidentia.operators import detectors as D
from evidentia.operators import detectors_screen as S
from evidentia.operators import detectors_values as W
from evidentia.plans import commerce_queries, view_queries  # noqa: F401  register their queries
from evidentia.plans import integrity_queries as I
from evidentia.plans import queries as Q
from evidentia.session import Tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stock_history_makes_its_changes_once_and_only_those_of_products(spark):
    plan = _plan(I.stock_history(spark, SF))
    assert plan.count("Relation [") == 1 and plan.count("parseJson") == 1
    made = plan.index("parseJson")
    assert "true WHEN" in plan[made:] and "lower" not in plan[plan.index("Filter", made):], "the tables are told apart before payloads are made"


def test_relational_findings_store_row_changes_and_no_events(spark, monkeypatch):
    kept, store = [], Tables.store
    monkeypatch.setattr(Tables, "store", lambda self, name, *more, **named: kept.append(name) or store(self, name, *more, **named))
    assert I.relational_findings(spark, SF).count() > 0
    assert "row_changes" in kept and not {"events", "column_versions"} & set(kept)


def test_mcnemar_of_many_pairs(spark):
    def exact(b, c):
        n, total, term = b + c, 0, 1
        for i in range(min(b, c) + 1):
            total, term = total + term, term * (n - i) // (i + 1)
        return min(1.0, 2 * float(Fraction(total, 2**n)))

    cases = [(3, 9), (0, 5), (20, 21), (2600, 2500), (2400, 2600), (5, 4000)]
    rows = spark.createDataFrame(cases, "b long, c long").select("b", "c", stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    assert all(abs(r["p"] - exact(r["b"], r["c"])) < 1e-9 for r in rows), rows


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """Orders of one instant in a few sessions, with every fault between them, and sessions of one order that its back end told nothing of."""
    folder = str(tmp_path_factory.mktemp("crowd"))
    keys = [(i * 3000 + s, s) for i in range(600) for s in range(3)] + [(k, k) for k in (328, 344, 376)]
    one = spark.read.parquet(f"{SF}/orders.parquet").limit(1).drop("o_orderkey", "o_custkey").withColumn("o_orderdate", F.lit("2024-01-05").cast("timestamp_ntz"))
    one.crossJoin(spark.createDataFrame(keys, "o_orderkey long, o_custkey long")).write.parquet(f"{folder}/orders.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(50).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def _same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = Q.QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLES[name]})").fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)


def test_repeated_clicks_of_one_instant(spark, crowd):
    _same_as_sql(spark, crowd, "repeated_clicks")


def test_session_inspection_of_one_instant(spark, crowd):
    _same_as_sql(spark, crowd, "session_inspection")


def test_commerce_findings_of_one_instant(spark, crowd):
    _same_as_sql(spark, crowd, "commerce_findings")


def test_text_signatures_hash_whole_texts_in_batches(spark):
    texts = ["", None, "hello", "a😀é", "x" * 70_000, *[f"text {k} " * (k % 90) for k in range(200)]]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    assert all(r["a"] == r["b"] for r in rows.select(X.fnv1a("text").alias("a"), X.fnv1a_texts(F.col("text")).alias("b")).collect())
    plan = Q.QUERIES["text_signatures"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan, "no text is cut into one string for each character"


def test_maps_are_encoded_as_arrays(spark):
    r = np.random.default_rng(3)
    for n, most in ((1, 1), (1, 40), (50, 3), (400, 9)):
        rows = np.column_stack([np.sort(r.integers(0, most, n)), r.integers(0, 100_000, n), r.integers(0, 3, n), r.integers(0, 1 << 20, n), r.integers(0, 70, n)])
        rows = rows[np.lexsort(rows.T[::-1])]
        assert M.encode_array(rows) == M.encode([tuple(map(int, x)) for x in rows])
        assert (M.decode(M.encode_array(rows))[:, :5] == rows).all()
    assert M.encode_array(np.zeros((0, 5), np.int64)) == ""


def test_frames_are_ordered_with_segments_of_their_lines_only(spark):
    frames = spark.createDataFrame([(1, "a.js", 2, 5), (2, "a.js", 9, 5), (3, None, 2, 5)], "frame long, file string, line int, column int")
    mapped = spark.createDataFrame([("a.js", 2, 4, "a.ts", 7, 1, None), ("a.js", 3, 4, "a.ts", 8, 1, None), ("b.js", 2, 4, "b.ts", 9, 1, None)], "file string, line int, column int, source string, source_line int, source_column int, name string")
    placed = M.place_frames(frames, mapped)
    assert sorted((r["frame"], r["source_line"]) for r in placed.collect()) == [(1, 7), (2, None), (3, None)]
    plan = _plan(placed)
    assert plan.index("Window") < plan.index("LeftSemi")


def test_labels_meet_their_fields_in_one_sort_and_in_tasks_of_bounded_rows(spark, monkeypatch):
    cols = ("session_id", "t", "order", "seq", "i", "label", "shown", "field", "key", "exact")
    rows = spark.range(9).selectExpr("id % 2", "id", "CAST(id % 2 AS INT)", "id", "1", "'x'", "1.0D", "named_struct('request_id', 'q', 'place', 1, 'amount', 2.0D)", "'x'", "id % 3 = 0").toDF(*cols)
    for by in (["session_id"], ["session_id", "label"]):
        assert _plan(S._as_of(rows, by)).count("Window [") == 1
    want = sorted(map(tuple, I.screen_findings(spark, SF).collect()))
    monkeypatch.setattr(D, "TASK_ROWS", 200)
    spread, tasks = D.spread, []
    monkeypatch.setattr(S, "spread", lambda events, rows, stored, *keys: tasks.append(-(-stored.count() // 200)) or spread(events, rows, stored, *keys))
    few = I.screen_findings(spark, SF)
    assert min(tasks) > 4 and f"RepartitionByExpression [session_id" in _plan(few) and f", {tasks[0]}" in _plan(few)
    assert sorted(map(tuple, few.collect())) == want


def test_column_ledger_reads_one_image_of_each_payload(spark):
    events = spark.range(4).selectExpr("id % 2 AS session_id", "id AS seq", "id AS t", "'q' AS request_id", "IF(id < 3, 'db.diff', 'db.read') AS k", "'Orders' AS table", "'insert' AS op", """parse_json(concat('{"after":{"id":', id, ',"v":null},"row":{"id":1}}')) AS d""")
    led = W.column_ledger(events)
    assert _plan(led).count("try_variant_get") == 2, "one for the writes, one for the reads"
    assert sorted(map(tuple, led.collect())) == [(0, "orders", "id", 2, 0, 0, 0), (0, "orders", "v", 2, 2, 0, 0), (1, "orders", "id", 1, 0, 1, 0), (1, "orders", "v", 1, 1, 0, 0)]


def test_duplicate_write_takes_each_payload_apart_once(spark):
    events = spark.range(6).selectExpr("1 AS session_id", "id AS t", "'db.diff' AS k", "'insert' AS op", "'q' AS request_id", "'notes' AS table", """parse_json(concat('{"after":{"text":"', id % 4, '","id":', id, '}}')) AS d""")
    hit = D.duplicate_write(events)
    assert _plan(hit).count("try_variant_get") == 1
    assert sorted(r["subject"] for r in hit.collect()) == [f'q notes [{{"key":"text","value":"{n}"}}]' for n in (0, 1)]
