"""Firing and silent cases of the detectors of broken invariants; every case is a session, and one run covers them all."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.operators import detectors as D
from evidentia.operators import detectors_business as B
from evidentia.sources.telemetry import promote
from tests.test_detectors import diff, req, res


def ins(t, table, after, rid="a", pk=None):
    return (t, "db.diff", {"op": "insert", "table": table, "pk": {"id": pk if pk is not None else after.get("id")}, "after": after, "requestId": rid})


def row(t, table, values, rid="a", pk=None):
    return (t, "db.read", {"table": table, "pk": {"id": pk if pk is not None else values.get("id")}, "row": values, "requestId": rid})


def call(t, i, method, url, body=None, st=200, told=None, **d):
    """A request and its answer."""
    return [req(t, i, url, method, requestId=i, **({"body": json.dumps(body)} if body is not None else {})), res(t + 10, i, st, **({"body": told} if told is not None else {}), **d)]


def http(t, service, rid="a", **d):
    return (t, "backend.http", {"service": service, "requestId": rid, **d})


def inp(t, trusted, n, name="coupon", **d):
    return (t, "inp", {"el": {"name": name}, "val": "*" * n, "valSummary": {"originalLength": n}, **({} if trusted is None else {"trusted": trusted}), **d})


def nums(t, *items, lang="en", region="r"):
    return (t, "ui.num", {"region": region, "lang": lang, "items": [dict(zip(("label", "value", "unit"), i, strict=False)) for i in items]})


def nav(t, to, how="push"):
    return (t, "nav", {"to": to, "type": how})


CHARGE = {"order_id": 1, "amount_cents": 5900, "status": "succeeded"}
ITEM = {"order_id": 7, "product_id": 3, "qty": 2}
UPLOAD = "sku,price\nalpha,1\nbeta,2"
CART, CSV = "http://x/api/cart", {"content-type": "text/csv", "content-length": "0"}
REACTIVE = [nav(1000, "/p?c=all", "init"), nav(2000, "/p?c=audio"), req(2100, "n1", "http://x/api/p?c=audio")]
SEED = call(1, "w0", "POST", CART, {"a": 1})


def stock(t, rid, a, b):
    return diff(t, rid, {"id": 3, "inventory": a}, {"id": 3, "inventory": b}, "products", 3)


def cart(t, i, n):
    return call(t, i, "GET", CART, told={"items": [{"productId": 1}] * n})


CASES = {
    "duplicate_charge": ([[ins(1, "payments", {"id": 1, **CHARGE}), ins(2, "payments", {"id": 2, **CHARGE})]], [[ins(1, "payments", {"id": 1, **CHARGE}), ins(2, "payments", {"id": 2, **CHARGE, "amount_cents": 3})], [ins(1, "payments", {"id": 1, **CHARGE, "status": "failed"}), ins(2, "payments", {"id": 2, **CHARGE})], [ins(1, "payments", {"id": 1, **CHARGE}), ins(2, "payments", {"id": 2, **CHARGE, "order_id": 2})]]),
    "money_scale_shift": ([[diff(1, "a", {"amount_cents": 19900}, {"amount_cents": 199}, "payments")]], [[diff(1, "a", {"total_cents": 19900}, {"total_cents": 21542}, "orders")], [diff(1, "a", {"total_cents": 100}, {"total_cents": 200})], [diff(1, "a", {"stock_count": 100}, {"stock_count": 1})], [diff(1, "a", {"total_cents": 0}, {"total_cents": 0})]]),
    "refund_total_exceeded": ([[row(1, "orders", {"id": 7, "total_cents": 10000}), *[ins(t, "refunds", {"id": t, "order_id": 7, "amount_cents": 6000, "status": "issued"}) for t in (2, 3)]]], [[row(1, "orders", {"id": 7, "total_cents": 10000}), *[ins(t, "refunds", {"id": t, "order_id": 7, "amount_cents": 5000, "status": "issued"}) for t in (2, 3)]]]),
    "duplicate_restock": ([[row(1, "order_items", ITEM, "r1", 1), stock(2, "r1", 8, 10), row(3, "order_items", ITEM, "r2", 1), stock(4, "r2", 10, 12)]], [[row(1, "order_items", ITEM, "r1", 1), stock(2, "r1", 8, 10), row(3, "order_items", ITEM, "r2", 1)]]),
    "declined_payment_ordered": ([[http(100, "payments", chargeStatus="declined"), ins(120, "orders", {"id": 1})]], [[http(100, "payments", chargeStatus="approved"), ins(120, "orders", {"id": 1})], [http(100, "payments", chargeStatus="declined")]]),
    "pricing_total_ignored_by_checkout": ([[http(100, "pricing", status=200, totalCents=21542), ins(120, "orders", {"id": 1, "total_cents": 23319})]], [[http(100, "pricing", status=200, totalCents=21542), ins(120, "orders", {"id": 1, "total_cents": 21542})]]),
    "checkout_committed_after_pricing_timeout": ([[http(100, "pricing", status=0, errorKind="timeout"), ins(120, "orders", {"id": 1, "total_cents": 2})]], [[http(100, "pricing", status=0, errorKind="timeout")]]),
    "downstream_succeeded_after_timeout": ([[http(1, "mail", errorKind="timeout"), (9, "backend.otel.span", {"traceId": "a", "spanId": "s", "serviceName": "mail", "statusCode": "OK"})]], [[http(1, "mail", errorKind="timeout"), (9, "backend.otel.span", {"traceId": "a", "spanId": "s", "serviceName": "other", "statusCode": "OK"})], [http(1, "mail", status=200)]]),
    "order_committed_with_negative_inventory": ([[stock(1, "a", 0, -1), ins(2, "orders", {"id": 1})]], [[stock(1, "a", 1, 0), ins(2, "orders", {"id": 1})], [stock(1, "b", 0, -1), ins(2, "orders", {"id": 1})]]),
    "cart_lost_after_session_expiry": ([[*cart(10, "b", 1), (100, "db.diff", {"op": "delete", "table": "sessions", "requestId": "c"}), *cart(120, "c2", 0)]], [[*cart(10, "b", 1), (100, "db.diff", {"op": "delete", "table": "sessions", "requestId": "c"}), *cart(120, "c2", 1)], [*cart(10, "b", 1), *cart(120, "c2", 0)]]),
    "cart_remerged_on_login": ([[*call(1, "l1", "POST", "http://x/api/login", {}, told={"mergedLines": 1}), *cart(20, "c1", 1), *call(40, "l2", "POST", "http://x/api/login", {}, told={"mergedLines": 1}), *cart(60, "c2", 2)]], [[*call(1, "l1", "POST", "http://x/api/login", {}, told={"mergedLines": 1}), *cart(20, "c1", 1), *call(40, "l2", "POST", "http://x/api/login", {}, told={"mergedLines": 1}), *cart(60, "c2", 1)]]),
    "duplicate_readback": ([[row(1, "shipments", {"id": 1, "order_id": 1, "created_at": "A"}), row(2, "shipments", {"id": 2, "order_id": 1, "created_at": "B"})]], [[row(1, "items", {"id": 1, "order_id": 1, "qty": 1}), row(2, "items", {"id": 2, "order_id": 1, "qty": 2})], [row(1, "s", {"id": 1, "order_id": 1})] * 2, [row(1, "jobs", {"id": 1, "status": "p"}), row(2, "jobs", {"id": 2, "status": "p"})]]),
    "orphaned_reference": ([[ins(1, "ledger", {"id": 1, "shipment_id": None}), ins(51, "shipments", {"id": 1})]], [[ins(1, "shipments", {"id": 1}), ins(51, "ledger", {"id": 1, "shipment_id": None})], [ins(1, "ledger", {"id": 1, "shipment_id": 2}), ins(51, "shipments", {"id": 3})], [ins(1, "ledger", {"id": 1, "shipment_id": None})]]),
    "counter_contradiction": ([[ins(1, "exports", {"id": 1, "rows_expected": 8, "rows_written": 3})], [ins(1, "ops_reports", {"id": 1, "rows_returned": 3, "total_claimed": 8})]], [[ins(1, "exports", {"id": 1, "rows_expected": 8, "rows_written": 8})], [ins(1, "batches", {"id": 1, "status": "pending", "rows_total": 2, "rows_applied": 0})]]),
    "derived_count_below_observed_inserts": ([[ins(1, "reviews", {"id": 1, "product_id": 2}), ins(2, "reviews", {"id": 2, "product_id": 2}), diff(3, "b", {}, {"product_id": 2, "rating_count": 1}, "cache")]], [[ins(1, "reviews", {"id": 1, "product_id": 2}), diff(3, "b", {}, {"product_id": 2, "rating_count": 1}, "cache")]]),
    "db_field_divergence": ([[ins(1, "orders", {"id": 5, "total_cents": 900}), ins(2, "payments", {"id": 1, "order_id": 5, "amount_cents": 500})]], [[ins(1, "orders", {"id": 5, "total_cents": 900}), ins(2, "payments", {"id": 1, "order_id": 5, "amount_cents": 900})], [ins(1, "orders", {"id": 5, "total_cents": 900}), ins(2, "payments", {"id": 1, "order_id": 6, "amount_cents": 5})]]),
    "same_request_row_rewritten": ([[*call(1, "a", "POST", "http://x/api/import", UPLOAD), diff(2, "a", {"p": 1}, {"p": 2}, "t", 1), diff(3, "a", {"p": 2}, {"p": 3}, "t", 1)]], [[*call(1, "a", "POST", "http://x/api/import", UPLOAD), diff(2, "a", {"p": 1}, {"p": 2}, "t", 1), diff(3, "a", {"p": 2}, {"p": 3}, "t", 2)]]),
    "db_client_supplied_value": ([[*call(1, "a", "POST", "http://x/api/o", {"total": 23319}), ins(5, "orders", {"id": 1, "total_cents": 23319})]], [[*call(1, "a", "POST", "http://x/api/o", {"total": 23319}), ins(5, "orders", {"id": 1, "total_cents": 19900})], [*call(1, "a", "POST", "http://x/api/o", {"qty": 233}), ins(5, "orders", {"id": 1, "qty": 233})]]),
    "fractional_cent_rounding": ([[*call(1, "a", "POST", "http://x/api/o", {"total": 21541.75}), ins(5, "orders", {"id": 1, "total_cents": 21542})]], [[*call(1, "a", "POST", "http://x/api/o", {"total": 21542}), ins(5, "orders", {"id": 1, "total_cents": 21542})], [*call(1, "a", "POST", "http://x/api/o", {"quantity": 21541.75}), ins(5, "orders", {"id": 1, "total_cents": 21542})]]),
    "db_unrequested_clear": ([[*call(1, "a", "PATCH", "http://x/api/t", {"status": "x"}), diff(5, "a", {"status": "o", "description": "long", "updated_at": "1"}, {"status": "x", "description": None, "updated_at": "2"}, "tasks")]], [[*call(1, "a", "PATCH", "http://x/api/t", {"status": "x", "description": ""}), diff(5, "a", {"status": "o", "description": "long"}, {"status": "x", "description": ""}, "tasks")], [*call(1, "a", "PATCH", "http://x/api/t", {"status": "x", "dueDate": None}), diff(5, "a", {"status": "o", "due_date": "d"}, {"status": "x", "due_date": None}, "tasks")]]),
    "response_count_mismatch": ([[*call(1, "a", "POST", "http://x/api/b", {"ids": [1]}, told={"updated": 4}), *[diff(t, "a", {"s": 1}, {"s": 2}, "tasks", t) for t in (2, 3, 4)]]], [[*call(1, "a", "POST", "http://x/api/b", {"ids": [1]}, told={"updated": 2}), *[diff(t, "a", {"s": 1}, {"s": 2}, "tasks", t) for t in (2, 3)]], [*call(1, "a", "POST", "http://x/api/b", {"ids": [1]}, told={"updated": 4, "created": 1}), diff(2, "a", {"s": 1}, {"s": 2}, "tasks")]]),
    "db_delta_mismatch": ([[*call(1, "a", "POST", "http://x/api/o", {"items": [{"productId": 3, "qty": 2}]}), stock(2, "a", 9, 6)]], [[*call(1, "a", "POST", "http://x/api/o", {"items": [{"productId": 3, "qty": 2}]}), stock(2, "a", 9, 7)], [*call(1, "a", "POST", "http://x/api/o", {"items": [{"productId": 3, "qty": 1}, {"productId": 3, "qty": 1}]}), stock(2, "a", 9, 7)]]),
    "accepted_text_was_truncated": ([[*call(1, "a", "POST", "http://x/api/n", {"note": "a long note that goes on"}), ins(2, "notes", {"id": 1, "note": "a long note"})]], [[*call(1, "a", "POST", "http://x/api/n", {"note": "a long note"}), ins(2, "notes", {"id": 1, "note": "a long note"})], [*call(1, "a", "POST", "http://x/api/n", {"note": "a long note that goes on"}, st=400), ins(2, "notes", {"id": 1, "note": "a long note"})]]),
    "result_row_loss": ([[*call(10, "a", "GET", "http://x/api/p", told=[{"id": 1}, {"id": 2}]), *[row(12 + n, "products", {"id": n}) for n in range(3)]], [*call(10, "a", "GET", "http://x/api/p", told={"items": [{"id": 1}], "page": 1}), *[row(12 + n, "products", {"id": n}) for n in range(4)]]], [[*call(10, "a", "GET", "http://x/api/p", told=[{"id": 1}, {"id": 2}]), *[row(12 + n, "products", {"id": n}) for n in range(2)]], [*call(10, "a", "GET", "http://x/api/p", told=[{"id": 1}]), row(12, "p", {"id": 1}), row(13, "q", {"id": 1})]]),
    "response_exceeded_requested_limit": ([[*call(10, "a", "GET", "http://x/api/p?limit=1", told=[{"id": 1}, {"id": 2}])]], [[*call(10, "a", "GET", "http://x/api/p?limit=2", told=[{"id": 1}, {"id": 2}])]]),
    "filter_contradiction": ([[*call(10, "a", "GET", "http://x/api/p?category=audio"), row(12, "products", {"id": 2, "category": "desk"})], [*call(10, "a", "GET", "http://x/api/p?inStock=true"), row(12, "products", {"id": 2, "inventory": 0})]], [[*call(10, "a", "GET", "http://x/api/p?category=audio"), row(12, "products", {"id": 2, "category": "audio"})], [*call(10, "a", "GET", "http://x/api/p?category=audio,video"), row(12, "products", {"id": 2, "category": "video"})], [*call(10, "a", "GET", "http://x/api/p?q=audio"), row(12, "products", {"id": 2, "q": "desk"})], [*call(10, "a", "GET", "http://x/api/p?minPrice=5"), row(12, "p", {"id": 1, "min_price": 2})]]),
    "shared_state_bleed": ([[*SEED, *call(100, "r1", "GET", CART, told=[{"id": 1}]), *call(200, "r2", "GET", CART, told=[{"id": 1}, {"id": 2}])], [*SEED, *call(100, "r1", "GET", CART, told=[{"id": 1}, {"id": 2}]), *call(200, "r2", "GET", CART, told=[{"id": 1}, {"id": 9}])]],
                           [[*SEED, *call(100, "r1", "GET", CART, told=[{"id": 1}]), *call(150, "w1", "POST", CART + "/items", {"p": 2}), *call(200, "r2", "GET", CART, told=[{"id": 1}, {"id": 2}])], [*call(100, "r1", "GET", CART, told=[{"id": 1}]), *call(200, "r2", "GET", CART, told=[{"id": 2}])], [*SEED, *call(100, "r1", "GET", CART, told=[{"id": 1}, {"id": 2}]), *call(200, "r2", "GET", CART, told=[{"id": 2}, {"id": 1}])], [*SEED, *call(100, "r1", "GET", CART + "?v=a", told=[{"id": 1}]), *call(200, "r2", "GET", CART + "?v=b", told=[{"id": 2}])]]),
    "acknowledged_write_lost": ([[*call(10, "b", "GET", CART, told=[]), *call(100, "w1", "POST", CART, {"productId": 7, "qty": 1}), *call(200, "w2", "POST", CART, {"productId": 7, "qty": 1}), *call(300, "r", "GET", CART, told=[{"productId": 7, "qty": 1}])]], [[*call(10, "b", "GET", CART, told=[]), *call(100, "w1", "POST", CART, {"productId": 7, "qty": 1}), *call(200, "w2", "POST", CART, {"productId": 7, "qty": 1}), *call(300, "r", "GET", CART, told=[{"productId": 7, "qty": 2}])], [*call(10, "b", "GET", CART, told=[]), *call(100, "w1", "POST", CART, {"qty": 1}), *call(300, "r", "GET", CART, told=[])]]),
    "acknowledged_batch_rows_missing": ([[*call(1, "a", "POST", "http://x/api/i", UPLOAD, told={"total": 4, "applied": 4, "errors": [], "rows": []})]], [[*call(1, "a", "POST", "http://x/api/i", UPLOAD, told={"total": 2, "applied": 1, "errors": [{"row": 2}], "rows": [{"row": 1}]})]]),
    "download_empty_body": ([[*call(1, "a", "GET", "http://x/api/e.csv", hdrs=CSV)]], [[*call(1, "a", "GET", "http://x/api/e.csv", hdrs={**CSV, "content-length": "156"})], [*call(1, "a", "GET", "http://x/api/e.csv", st=204, hdrs=CSV)], [*call(1, "a", "HEAD", "http://x/api/e.csv", hdrs=CSV)], [*call(1, "a", "GET", "http://x/api/t", hdrs={"content-type": "application/json", "content-length": "0"})]]),
    "content_type_body_mismatch": ([[*call(1, "a", "GET", "http://x/api/e.xlsx", told={"b": 1}, hdrs={"content-type": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"})]], [[*call(1, "a", "GET", "http://x/api/t", told={"b": 1}, hdrs={"content-type": "application/json"})], [*call(1, "a", "GET", "http://x/api/e.csv", told="[REDACTED]", hdrs={"content-type": "text/csv"})]]),
    "api_route_returned_document": ([[*call(1, "a", "GET", "http://x/api/t", hdrs={"content-type": "text/html; charset=utf-8"})]], [[*call(1, "a", "GET", "http://x/page", hdrs={"content-type": "text/html"})]]),
    "input_reverted": ([[inp(1000, True, 8), inp(1500, False, 0)], [inp(1000, True, 12), inp(1200, False, 4)], [inp(1000, True, 5, val="audio"), inp(1200, False, 5, val="video")]], [[inp(1000, True, 3), inp(1200, False, 12)], [inp(1000, True, 8), inp(12000, False, 0)], [inp(1000, True, 8), inp(1500, True, 0)], [inp(1000, None, 8), inp(1500, None, 0)], [inp(1000, True, 8), inp(1500, False, 0, "search")]]),
    "form_reset_after_error": ([[inp(100, True, 1, ev="submit"), res(120, "a", 400), *[inp(800 + n, False, 0, f"f{n}", ev="state") for n in range(3)]]], [[inp(100, True, 1, ev="submit"), res(120, "a", 200), *[inp(800 + n, False, 0, f"f{n}", ev="state") for n in range(2)]], [inp(100, True, 1, ev="submit"), res(120, "a", 400), inp(800, False, 0, "f", ev="state")]]),
    "click_target_intercepted": ([[(1, "clk", {"el": {"path": "div[id=o]"}, "covered": [{"path": "button"}]})]], [[(1, "clk", {"el": {"path": "button"}})]]),
    "ui_arithmetic_mismatch": ([[nums(1, ("Subtotal", 199.0), ("Tax (8.25%)", 16.42), ("Total", 199.0))], [nums(1, ("Subtotal", 100.0), ("Tax", 10.0), ("Total", 110.03))], [nums(1, ("Subtotal", 100.0), ("Discount", 20.0), ("Total", 100.0))]], [[nums(1, ("Subtotal", 199.0), ("Tax", 16.42), ("Total", 215.42))], [nums(1, ("Subtotal", 100.0), ("Tax", 10.0), ("Total", 110.02))], [nums(1, ("Subtotal", 100.0), ("Discount", 20.0), ("Total", 80.0))], [nums(1, ("Subtotal", 100.0), ("Total", 80.0))]]),
    "currency_locale_mismatch": ([[nums(1, ("a", 40, "$"), ("b", 5, "$"), lang="de-DE")], [nums(1, ("a", 40, "$"), lang="de-DE"), nums(2, ("a", 45, "$"), lang="de-DE")], [nums(1, ("a", 40, "$"), ("b", 5, "$"), lang="en-GB")]], [[nums(1, ("a", 40, "$"), lang="de-DE")], [nums(1, ("a", 40, "£"), ("b", 5, "£"), lang="en-GB")], [nums(1, ("a", 40, "$"), ("b", 5, "$"), lang="xx")]]),
    "stale_view_after_pop": ([[*REACTIVE, nav(3000, "/p?c=all", "pop")]], [[*REACTIVE, nav(3000, "/p?c=all", "pop"), req(3200, "n2", "http://x/api/p?c=all")], [nav(1000, "/p?c=all", "init"), nav(2000, "/p?c=audio"), nav(3000, "/p?c=all", "pop")], [*REACTIVE, nav(3000, "/cart", "pop")], [*REACTIVE, nav(3000, "/p?c=audio", "pop")], [*REACTIVE, nav(3000, "/p?c=lamp")]]),
    "ineffective_submit": ([[inp(1, True, 1, ev="submit")]], [[inp(1, True, 1, ev="submit"), req(50, "a")], [inp(1, True, 1, ev="submit"), nav(50, "/x")]]),
    "casefold_duplicate_identity_accepted": ([[*call(1, "a", "POST", "http://x/s", {"email": {"hash8": "r1", "casefoldHash8": "f"}}), ins(5, "users", {"id": 1}, "a"), *call(20, "b", "POST", "http://x/s", {"email": {"hash8": "r2", "casefoldHash8": "f"}}), ins(25, "users", {"id": 2}, "b")]], [[*call(1, "a", "POST", "http://x/s", {"email": {"hash8": "r1", "casefoldHash8": "f"}}), ins(5, "users", {"id": 1}, "a"), *call(20, "b", "POST", "http://x/s", {"email": {"hash8": "r2", "casefoldHash8": "g"}}), ins(25, "users", {"id": 2}, "b")]]),
    "request_reconnect_storm": ([[req(100 * n, f"i{n}", "http://x/stream") for n in range(8)]], [[req(3000 * n, f"i{n}", "http://x/stream") for n in range(8)], [req(100 * n, f"i{n}", "http://x/stream") for n in range(3)]]),
    "stale_client_build": ([[(1, "env", {"build": "a1"}), res(2, "i", hdrs={"x-build": "b2"})]], [[(1, "env", {"build": "a1"}), res(2, "i", hdrs={"x-build": "a1"})]]),
    "otel_db_activity": ([[(1, "backend.otel.span", {"traceId": "t", "spanId": "s", "attributes": {"db.system": "redis"}}), (500, "err", {"msg": "x"})]], [[(1, "backend.otel.span", {"traceId": "t", "spanId": "s", "attributes": {"db.system": "redis"}}), (9000, "err", {"msg": "x"})]]),
    "tab_boundary_gap": ([[(1, "tab.gap", {})]], [[(1, "tab.boundary", {})]]), "media_degradation": ([[(1, "media.degraded", {})]], [[(1, "media.video", {})]]), "transcript_complaint": ([[(1, "media.complaint", {})]], [[(1, "media.voice", {})]]),
    "network_error": ([[(1, "net.err", {"id": "i"})]], [[res(1, "i")]]), "uncaught_error": ([[(1, "err", {"msg": "m"})]], [[(1, "con", {"msg": "m"})]]), "unhandled_rejection": ([[(1, "rej", {"msg": "m"})]], [[(1, "err", {"msg": "m"})]]),
    "console_error": ([[(1, "con", {"lv": "error", "msg": "m"})]], [[(1, "con", {"lv": "log", "msg": "m"})]]), "console_warning": ([[(1, "con", {"lv": "warn", "msg": "m"})]], [[(1, "con", {"lv": "log", "msg": "m"})]]),
    "runtime_warning": ([[(1, "backend.warning", {"name": "MaxListeners", "msg": "leak"})]], [[(1, "backend.log", {"msg": "leak"})]]), "db_statement_failed": ([[(1, "db.error", {"shape": "x", "code": "1"})]], [[(1, "db.statement", {"shape": "x"})]]),
    "user_flag": ([[(1, "bug.flag", {})]], [[(1, "mark", {})]]), "user_marker": ([[(1, "mark", {})]], [[(1, "bug.flag", {})]]), "native_crash": ([[(1, "native-crash", {})]], [[(1, "err", {})]]), "page_probe_failure": ([[(1, "probe.error", {})]], [[(1, "probe.ready", {})]]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for name, (fires, silent) in CASES.items():
        for kind, cases in (("fires", fires), ("silent", silent)):
            for n, events in enumerate(cases):
                rows += [(f"{name}/{kind}/{n}", seq, t, k, json.dumps(d)) for seq, (t, k, d) in enumerate(events)]
    raw = spark.createDataFrame(rows, "session_id string, seq long, t long, k string, d string")
    log = promote(raw.withColumn("d", F.parse_json("d"))).cache()
    got = {}
    functions = [n for n in D.DETECTORS if D.DETECTORS[n].__module__.endswith("business") or n in CASES or n == "order_totals_diverge"]
    for name in functions:
        for r in D.DETECTORS[name](log).select("session_id", "detector").distinct().collect():
            got.setdefault(r["session_id"], set()).add(r["detector"])
    return got


@pytest.mark.parametrize("name", list(CASES))
def test_fires_and_stays_silent(found, name):
    fires, silent = CASES[name]
    assert [n for n in range(len(fires)) if name not in found.get(f"{name}/fires/{n}", ())] == []
    assert [n for n in range(len(silent)) if name in found.get(f"{name}/silent/{n}", ())] == []


def test_demotion_and_ranking(spark):
    events = [e for n in range(4) for e in call(1000 * n, f"b{n}", "POST", "http://x/api/login", {}, st=401, told='{"error":"invalid"}')] + call(9000, "g", "GET", "http://x/api/jobs", st=404)
    events += [(9500, "rej", {"msg": "Failed to fetch"}), (9500, "net.err", {"id": "z", "url": "https://www.google-analytics.com/g/collect?v=2"})]
    raw = spark.createDataFrame([("s", seq, t, k, json.dumps(d)) for seq, (t, k, d) in enumerate(events)], "session_id string, seq long, t long, k string, d string")
    log = promote(raw.withColumn("d", F.parse_json("d")))
    got = B.demote(D.dedupe(D.run_detectors(log, ["http_error", "network_error", "unhandled_rejection"])), log).collect()
    by = {(r["detector"], r["subject"]): r for r in got}
    login = next(r for (d, s), r in by.items() if d == "http_error" and "login" in s)
    assert (login["severity"], login["occurrences"], login["t"]) == ("low", 4, 10) and login["score"] <= 30
    jobs = next(r for (d, s), r in by.items() if d == "http_error" and "jobs" in s)
    assert (jobs["severity"], jobs["score"]) == ("medium", 70)
    assert all(r["severity"] == "low" and r["score"] <= 15 for r in got if r["detector"] != "http_error")

    rows = [("s", "root", "high", 70, 5), ("s", "sym1", "high", 60, 6), ("s", "sym2", "high", 40, 7), ("s", "alone", "high", 74, 1), ("s", "loose", "low", 50, 2)]
    cand = spark.createDataFrame(rows, "session_id string, candidate_id string, severity string, score int, t long")
    links = spark.createDataFrame([("s", "sym1", "root", 3), ("s", "sym2", "root", 2), ("s", "loose", "root", 1)], "session_id string, id string, root string, sure int")
    ranked = sorted(B.rank_candidates(cand, links).collect(), key=lambda r: r["rank"])
    assert [r["id"] for r in ranked] == ["root", "sym1", "sym2", "alone", "loose"] and [r["score"] for r in ranked][:2] == [70, 60]
