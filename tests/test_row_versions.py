"""Histories of stored rows and the detectors over them: firing and silent cases, each a session."""

import json
import random

import pytest

from evidentia.operators import detectors as D
from evidentia.operators import joins as J
from evidentia.operators import row_versions as V
from tests.test_detectors import diff
from tests.test_detectors_business import call, ins
from tests.test_detectors_screen import telemetry

STOCK = diff(100, "stock-1", {"id": 7, "inventory": 1}, {"id": 7, "inventory": 11}, "products", 7)
LINE = {"orderId": 1, "itemId": 2, "index": 0, "qty": 5}
PRICES = [diff(100 + n, "bulk-1", {"id": n, "price_cents": 7900}, {"id": n, "price_cents": 8100}, "products", n) for n in (6, 7)]
MOVED = diff(100, "refund-1", {"id": 1, "total_cents": 35700}, {"id": 1, "total_cents": 35200}, "orders", 1)


def audit(entity):
    return ins(120, "audit_log", {"id": 1, "entity": entity, "entity_id": 1, "action": "completed"}, "bulk-1")


def report(t, total, note="order=1"):
    return ins(t, "ops_reports", {"id": 1, "kind": "order-totals", "total_cents": total, "note": note}, "report-1")


def batch(n, staged=1):
    return [*[ins(100 + i, "reprice_stage", {"id": i, "batch_id": 4}, "b") for i in range(staged)], diff(200, "b", {"id": 4, "rows_applied": 0}, {"id": 4, "rows_applied": n}, "reprice_batches", 4)]


#: detector -> (cases that fire, cases that stay silent)
CASES = {
    "existing_children_reparented_to_new_row": (
        [[ins(100, "orders", {"id": 3, "status": "placed"}, "d"), diff(110, "d", {"id": 1, "order_id": 1}, {"id": 1, "order_id": 3}, "order_items", 1)],
         [*[ins(n, "folders", {"id": n}, "x") for n in (1, 2)], *[ins(10 + n, "notes", {"id": n, "parent_id": n}, "x") for n in (1, 2)], ins(30, "folders", {"id": 3}, "d"), diff(40, "d", {"id": 1, "parent_id": 1}, {"id": 1, "parent_id": 3}, "notes", 1)]],
        [[ins(100, "orders", {"id": 3}, "d"), ins(110, "order_items", {"id": 5, "order_id": 3}, "d")], [ins(100, "orders", {"id": 3}, "c"), diff(110, "d", {"id": 1, "order_id": 1}, {"id": 1, "order_id": 3}, "order_items", 1)],
         [ins(100, "orders", {"id": 3}, "d"), diff(110, "d", {"id": 1, "order_id": None}, {"id": 1, "order_id": 3}, "order_items", 1)], [ins(100, "invoices", {"id": 3}, "d"), diff(110, "d", {"id": 1, "order_id": 1}, {"id": 1, "order_id": 3}, "order_items", 1)]],
    ),
    "stale_value_writeback": (
        [[STOCK, diff(200, "form-1", {"id": 7, "inventory": 11}, {"id": 7, "inventory": 1}, "products", 7)], [STOCK, diff(150, "x", {"name": "a"}, {"name": "b"}, "products", 7), diff(200, "form-1", {"inventory": 11}, {"inventory": 1}, "products", 7)]],
        [[STOCK, diff(200, "stock-2", {"id": 7, "inventory": 11}, {"id": 7, "inventory": 12}, "products", 7)], [STOCK, diff(200, "stock-1", {"id": 7, "inventory": 11}, {"id": 7, "inventory": 1}, "products", 7)], [STOCK, diff(200, "form-1", {"id": 8, "inventory": 11}, {"id": 8, "inventory": 1}, "products", 8)],
         [diff(1, "a", {"status": "x"}, {"status": "y"}, "orders", 1), diff(2, "b", {"status": "y"}, {"status": "x"}, "orders", 1)]],
    ),
    "request_target_row_mismatch": (
        [[*call(100, "edit-1", "POST", "http://x/api/ops/order-line", LINE), diff(110, "edit-1", {"id": 1, "qty": 2}, {"id": 1, "qty": 5}, "order_items", 1)]],
        [[*call(100, "edit-1", "POST", "http://x/api/ops/order-line", LINE), diff(110, "edit-1", {"id": 2, "qty": 2}, {"id": 2, "qty": 5}, "order_items", 2)], [*call(100, "edit-1", "POST", "http://x/api/ops/order-line", LINE, st=409), diff(110, "edit-1", {"id": 1}, {"id": 1, "qty": 5}, "order_items", 1)],
         [*call(100, "edit-1", "POST", "http://x/api/ops/order-line", LINE), diff(110, "other", {"id": 1}, {"id": 1, "qty": 5}, "order_items", 1)], [*call(100, "edit-1", "POST", "http://x/api/ops", LINE), *[diff(110 + n, "edit-1", {"id": n}, {"id": n, "qty": 5}, "order_items", n) for n in (1, 2)]]],
    ),
    "mutations_missing_entity_audit": ([[*PRICES, audit("reprice_batches")]], [[*PRICES, audit("products")], [*PRICES, audit("product")], PRICES, [PRICES[0], audit("reprice_batches")]]),
    "batch_applied_count_exceeds_staged_rows": ([batch(2), batch(4, 3)], [batch(1), batch(3, 3), batch(2, 0)]),
    "report_total_contradicts_source_row": ([[MOVED, report(200, 35700)]], [[MOVED, report(200, 35200)], [report(50, 35700), MOVED], [MOVED, report(200, 35700, "order=2")], [MOVED, report(200, 35700, "nightly")]]),
}


@pytest.fixture(scope="module")
def found(spark):
    sessions = {f"{name}/{kind}/{n}": events for name, (fires, silent) in CASES.items() for kind, cases in (("fires", fires), ("silent", silent)) for n, events in enumerate(cases)}
    log = telemetry(spark, sessions).cache()
    return {(r["session_id"], r["detector"]): r for r in D.run_detectors(log, list(CASES)).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_fires_and_stays_silent(found, name):
    fires, silent = CASES[name]
    assert [n for n in range(len(fires)) if (f"{name}/fires/{n}", name) not in found] == []
    assert [n for n in range(len(silent)) if (f"{name}/silent/{n}", name) in found] == []


def test_column_versions(spark):
    events = [diff(1, "a", {"id": 1, "q": 1}, {"id": 1, "q": 2}, "t"), diff(2, "b", {"id": 1}, {"id": 1, "q": 2}, "t"), diff(3, "c", {}, {"q": 5}, "t"), diff(4, "d", {"id": 1, "q": 5}, None, "t", op="delete"), ins(5, "t", {"id": 2, "q": None}, "e")]
    rows = V.column_versions(telemetry(spark, {"s": events})).where("col = 'q'").collect()
    got = sorted(((r["pk"], -1 if r["begins"] is None else r["begins"], r["value"], r["was"], r["op"], r["request_id"], r["ends"]) for r in rows), key=repr)
    assert got == sorted([("1", -1, "1", None, None, None, 0), ("1", 0, "2", "1", "update", "a", 2), ("1", 2, "5", "2", "update", "c", 3), ("1", 3, None, "5", "delete", "d", None), ("2", 4, None, None, "insert", "e", None)], key=repr)


def test_references_by_name_and_by_inclusion(spark):
    events = [*[ins(n, "folders", {"id": n}, "x") for n in (1, 2, 3)], *[ins(9 + n, "notes", {"id": 50 + n, "parent_id": n, "owner_id": n * 100}, "x") for n in (1, 2, 3)], ins(30, "order_items", {"id": 1, "order_id": 9}), ins(31, "orders", {"id": 8}), ins(32, "stages", {"id": 1, "batch_id": 2}), ins(33, "reprice_batches", {"id": 7})]
    got = {tuple(r) for r in V.references(telemetry(spark, {"s": events})).collect()}
    assert got == {("notes", "parent_id", "folders"), ("order_items", "order_id", "orders"), ("stages", "batch_id", "reprice_batches")}


def test_as_of_is_the_latest_row_before(spark):
    r = random.Random(1)
    left = [(r.choice("ab"), r.randrange(40), i) for i in range(60)]
    right = [(r.choice("ab"), t, f"v{t}") for t in r.sample(range(40), 20)]
    for strict in (True, False):
        rows = J.as_of(spark.createDataFrame(left, "k string, t long, n long"), spark.createDataFrame(right, "k string, t long, v string"), ["k"], "t", strict).collect()
        got = {x["n"]: x["match"]["v"] if x["match"] else None for x in rows}
        want = {n: max(((u, v) for j, u, v in right if j == k and (u < t or (u == t and not strict))), default=(None, None))[1] for k, t, n in left}
        assert got == want
