"""Values held against each other: firing and silent cases, each a session."""

import json

import pytest

from evidentia.operators import detectors as D
from evidentia.operators import detectors_values as W
from tests.test_detectors import diff
from tests.test_detectors_business import call, ins, nav, row
from tests.test_detectors_screen import telemetry


def views(**after):
    return ins(1120, "saved_views", {"id": 5, "name": "My items", **after}, "r1")


def reads(*rows, table="saved_views"):
    return [row(1200 + n, table, {"id": n, **r}, "r2") for n, r in enumerate(rows)]


SPLIT = views(filters=None, filters_json='{"status":"todo"}')
SET = call(100, "w", "POST", "http://x/api/stock/emit", {"productId": 1, "inventory": 0}, told='{"ok":true}')


def levels(t, n, url="http://x/api/stock/levels", pid=1):
    return call(t, f"r{t}", "GET", url, told=json.dumps({"levels": [{"productId": pid, "inventory": n}]}))


def script(t, size=0):
    return (t, "perf", {"metric": "res", "name": "https://shop.test/tag/gtm.js", "initiatorType": "script", "transferSize": size})


def click(t, what):
    return (t, "clk", {"el": {"path": f"button[data-testid={what}]"}})


BOOKED = call(100, "b", "POST", "http://x/api/bookings/42/passengers", {"passengerId": 7}, told='{"bookingId":42}')


def hook(sig, st=200, write=True):
    return [(100, "net.req", {"id": "h", "requestId": "h", "method": "POST", "url": "http://x/hooks/pay", "hdrs": {"X-Webhook-Signature": sig}}), *([ins(110, "payments", {"id": 1, "status": "paid"}, "h")] if write else []), (120, "net.res", {"id": "h", "requestId": "h", "st": st})]


def upload(csv, *rows):
    return [*call(100, "u", "POST", "http://x/api/import", csv, told='{"total":4}'), *[diff(105 + n, "u", {"sku": s, "price_cents": 1}, {"sku": s, "price_cents": v}, "products", n) for n, (s, v) in enumerate(rows)]]


CSV = "sku,price_cents\nalpha,10100\nbeta,10200\ngamma,10300\ndelta,10400"


def address(country, st=400):
    return call(10, "r1", "POST", "http://x/api/addresses", {"country": country, "postalCode": {"$redacted": "[REDACTED]", "len": 8}}, st=st, told='{"error":"validation_failed","errors":{"postalCode":"Invalid postal code"}}')


def credit(cents, raw, locale="de-DE"):
    return call(10, "r1", "POST", "http://x/api/addresses/store-credit", {"amountCents": cents, "raw": raw, "locale": locale}, told='{"ok":true}')


def days(value, zone="America/Los_Angeles", iso="2026-07-01T03:30:00.000Z", unit="iso-day"):
    return [(1, "env", {"timezone": zone}), (2, "net.res", {"id": "1", "requestId": "q", "st": 200, "body": json.dumps({"orders": [{"created_at": iso}]})}), (3, "ui.num", {"region": "l", "items": [{"label": "Order #1", "value": value, "unit": unit}]})]


def coupon(told, st=200, body=None, table=None, t=1000, rid="r1"):
    return [*call(t, rid, "POST", "http://x/api/checkout", body or {"couponCode": "EXPIRED5", "cartId": 9}, st=st, told=told), *([ins(t + 5, table, {"id": 1}, rid)] if table else [])]


#: detector -> (cases that fire, cases that stay silent)
CASES = {
    "db_write_read_column_split": (
        [[SPLIT, *reads({"filters": None}, {"filters": None}, {"filters": ""})]],
        [[SPLIT, *reads({"filters": None}, {"filters": None}, {"filters": None, "filters_json": "{}"})], [SPLIT, *reads({"filters": None})], [SPLIT, *reads({"filters": None}, {"filters": "x"}, {"filters": None})],
         [ins(1120, "comments", {"id": 5, "author": "alice", "body": "hello"}, "r1"), *reads({"author": "a"}, {"author": "b"}, {"author": "c"}, table="comments")]],
    ),
    "acknowledged_state_contradicted_by_read": (
        [[*SET, *levels(200, 25)], [*levels(50, 25), *SET, *levels(200, 25)]],
        [[*SET, *levels(200, 0)], [*SET, *call(150, "w2", "POST", "http://x/api/stock/emit", {"productId": 2, "inventory": 9}), *levels(200, 25)], [*SET, *levels(200, 25, "http://x/api/orders")], [*SET, *levels(200, 25, pid=2)],
         [*SET, *levels(200, 0.0), *levels(300, 25)], [*call(100, "w", "POST", "http://x/api/stock/emit", {"productId": 1, "inventory": 0}, st=409), *levels(200, 25)]],
    ),
    "ineffective_input": (
        [coupon('{"total":100,"discount":0}'), coupon('{"total":100,"discount":0}', table="orders"), coupon("{}", body={"password": {"$redacted": "[REDACTED]", "len": 8}, "giftMessage": "happy birthday"})],
        [coupon('{"total":100,"discount":0}', table="coupon_redemptions"), coupon('{"total":95,"discount":5}'), coupon('{"discount":0}', 422), coupon('{"discount":0}', body="[REDACTED]"), coupon("OK"), coupon("{}", body={"password": "hunter22", "authToken": "abc"})],
    ),
    "batch_value_shift": ([upload(CSV, ("alpha", 10200), ("beta", 10300), ("gamma", 10400))], [upload(CSV, ("alpha", 10200), ("beta", 10200)), upload(CSV, ("alpha", 10100), ("beta", 10200), ("gamma", 10300)), upload(CSV, ("alpha", 10200))]),
    "invalid_webhook_signature_accepted": ([hook("sha256=0bad0bad")], [hook("sha256=" + "a" * 64), hook("sha256=0bad0bad", 401), hook("sha256=0bad0bad", write=False), hook("[REDACTED]")]),
    "blocked_script_prevented_action": (
        [[*BOOKED, script(150), click(200, "confirm-purchase")]],
        [[*BOOKED, script(150), click(200, "cart-checkout"), (220, "net.req", {"requestId": "c", "id": "c", "method": "POST", "url": "/api/checkout"})], [script(50), click(100, "confirm-purchase"), *call(200, "b", "POST", "http://x/api/bookings", {})],
         [*call(100, "s", "GET", "http://x/api/flights", told="{}"), script(150), click(200, "submit-search")], [*BOOKED, script(150, 900), click(200, "confirm-purchase")], [*BOOKED, script(150), click(200, "confirm-purchase"), nav(250, "/done")]],
    ),
    "country_postal_validation_mismatch": ([address("GB")], [address("US"), address("GB", 500), call(10, "r1", "POST", "http://x/api/addresses", {"country": "GB", "name": ""}, st=400, told='{"errors":{"name":"missing"}}')]),
    "locale_decimal_scale_shift": ([credit(19900, "1,99"), credit(19900, {"$redacted": "[REDACTED]", "len": 4, "charset": "mixed"}), credit(12345600, "1.234,56")], [credit(199, "1,99"), credit(19900, "199"), credit(19900, "1,99", "en-US"), credit(199, {"$redacted": "[REDACTED]", "len": 4, "charset": "mixed"})]),
    "display_date_timezone_mismatch": ([days(20635)], [days(20634), days(20635, "Europe/Paris"), days(20635, "No/Where"), days(20635, unit="count"), days(20000)]),
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


def test_messages_name_what_is_meant(found):
    r = found["db_write_read_column_split/fires/0", "db_write_read_column_split"]
    assert "saved_views.filters_json" in r["message"] and "3 reads select saved_views.filters" in r["message"]
    assert found["ineffective_input/fires/0", "ineffective_input"]["request_id"] == "r1" and "couponCode" in found["ineffective_input/fires/0", "ineffective_input"]["message"]
    assert "giftMessage" in found["ineffective_input/fires/2", "ineffective_input"]["message"]
    assert found["display_date_timezone_mismatch/fires/0", "display_date_timezone_mismatch"]["request_id"] == "q"


def test_three_ineffective_inputs_a_session_and_one_a_field(spark):
    events = [*coupon('{"discount":0}'), *coupon('{"discount":0}', t=1500, rid="r5", body={"couponCode": "B"}), *coupon("{}", t=2000, rid="r2", body={"giftMessage": "hello"}), *coupon("{}", t=3000, rid="r3", body={"referralSource": "friend"}), *coupon("{}", t=4000, rid="r4", body={"deliveryNote": "at door"})]
    got = {r["subject"]: r["t"] for r in W.ineffective_input(telemetry(spark, {"s": events})).collect()}
    assert got == {"couponCode": 1000, "giftMessage": 2000, "referralSource": 3000}


def test_records_of_a_body():
    body = {"id": 1, "n": 2, "list": [{"productId": 3, "stock": 0, "tag": "x"}, {"name": "no key"}], "hid": {"$redacted": 1, "id": 4, "v": 5}}
    assert sorted(W.records_of(json.dumps(body))) == sorted([("id", "1", "n", "2"), ("productId", "3", "stock", "0"), ("productId", "3", "tag", '"x"')])
    assert list(W.records_of("x")) == list(W.records_of(None)) == []
