"""Screen numbers against response fields: firing and silent cases, each a session, and the number reader on its own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import detectors as D
from evidentia.operators import detectors_screen as S
from evidentia.operators import joins as J
from evidentia.sources.telemetry import promote


def told(t, i, body, st=200):
    return (t, "net.res", {"id": i, "st": st, "body": body if isinstance(body, str) else json.dumps(body)})


def shown(t, *items):
    return (t, "ui.num", {"region": "totals", "items": [{"label": label, "value": value} for label, value in items]})


def nav(t):
    return (t, "nav", {"to": "https://shop.example/checkout"})


def read(t, i, body):
    return [(t, "net.req", {"id": i, "requestId": f"r{i}", "m": "GET", "url": "https://app.test/api/cards/1"}), (t + 20, "net.res", {"id": i, "requestId": f"r{i}", "st": 200, "body": json.dumps(body)})]


FIRST, SECOND = read(1, 1, {"balanceCents": 5000}), read(1000, 2, {"balanceCents": 1250})
CARD = {"card": {"code": "GC-1", "initialCents": 5000, "balanceCents": 1250}}

#: detector -> (cases that fire, cases that stay silent)
CASES = {
    "ui_api_divergence": (
        [
            [told(1000, "r1", {"total": 215.42, "subtotal": 199.0}), shown(1500, ("Total", 199.0))],
            [nav(2000), told(2500, "r1", {"total": 215.42}), shown(3000, ("Total", 199.0))],
            [told(1000, "r1", {"total": 215.42, "totalItems": 3}), shown(1500, ("Total", 199.0))],
            [told(1000, "r1", {"total": 215.42}), told(1100, "r2", {"totalAmount": 215.42}), shown(1500, ("Total", 199.0))],
            [told(1000, "r1", {"total": 108.75}), shown(1500, ("Total", 108.0))],
            [told(1000, "r1", {"total": 108.5}), shown(1500, ("Total", 1.08))],
            [told(1000, "r1", {"order": {"total_amount": 20}}), shown(1500, ("Total", 21.5))],
            [told(1000, "r1", {"total": 215.42}), shown(1500, ("Total", 215.45))],
        ],
        [
            [told(1000, "r1", {"total": 215.42}), shown(1500, ("Total", 215.42))],
            [told(1000, "r1", {"total": 215.42}), shown(1500, ("Total", 215.43))],
            [told(1000, "r1", {"total": 215.42}), nav(2000), shown(3000, ("Total", 199.0))],
            [told(2000, "r1", {"total": 215.42}), nav(2000), shown(3000, ("Total", 199.0))],
            [told(1000, "r1", "[REDACTED]"), shown(1500, ("Total", 199.0))],
            [told(1000, "r1", {"total": {"$redacted": "[REDACTED]", "len": 5}}), shown(1500, ("Total", 199.0), ("len", 9.0))],
            [told(1000, "r1", {"total": 215.42}), shown(1500, ("[REDACTED]", 199.0))],
            [told(1000, "r1", {"total": 215.42}), told(1100, "r2", {"total": 220.0}), shown(1500, ("Total", 199.0))],
            [told(1000, "r1", {"totalItems": 3}), shown(1500, ("Total", 215.42))],
            [told(1000, "r1", {"totalAmount": 215.42, "totalDue": 220.0}), shown(1500, ("Total", 199.0))],
            [told(1000, "r1", {"total": 10800}), shown(1500, ("Total", 108.0))],
            [told(1000, "r1", {"total": 2500}), shown(1500, ("Total", 25))],
            [told(1000, "r1", {"total": 215.42}, st=500), shown(1500, ("Total", 199.0))],
            [shown(500, ("Total", 199.0)), told(1000, "r1", {"total": 215.42})],
            [told(1000, "r1", {"total": 215.42})],
        ],
    ),
    "stale_value_rendered": (
        [[*FIRST, *SECOND, shown(2000, ("Balance", 50))], [*FIRST, *SECOND, shown(1500, ("Balance", 12.5)), shown(2000, ("Balance", 50.01))], [*FIRST, *SECOND, *read(3000, 3, {"balanceCents": 800}), shown(4000, ("Balance", 50))]],
        [[*FIRST, *SECOND, shown(2000, ("Balance", 12.5))], [*read(1, 1, {"limit": 20}), *read(1000, 2, {"limit": 20}), shown(2000, ("Per page", 20), ("Limit", 20))], [*FIRST, *SECOND, shown(2000, ("Shipping", 4.99), ("Balance", 4.99))],
         [*FIRST, shown(500, ("Balance", 50)), *SECOND], [*FIRST, *SECOND, *read(3000, 3, {"balanceCents": 5000}), shown(4000, ("Balance", 50))],
         [*read(1, 1, {"id": 7, "balanceCents": 5000}), *read(1000, 2, {"id": 8, "balanceCents": 1250}), shown(2000, ("Balance", 50))]],
    ),
    "displayed_field_mismatch": (
        [[*read(1, 1, CARD), shown(500, ("Balance", 50))], [*read(1, 1, [{"id": 1, "price": 3, "tax": 9.99}]), shown(500, ("Price", 9.99))]],
        [[*read(1, 1, CARD), shown(500, ("Balance", 12.5))], [*read(1, 1, CARD), shown(500, ("Balance", 99))], [*read(1, 1, CARD), shown(500, ("Shipping", 50))], [shown(1, ("Balance", 50)), *read(500, 1, CARD)],
         [*read(1, 1, {"a": {"balance": 1}, "b": {"initial": 50}}), shown(500, ("Balance", 50))]],
    ),
}


def telemetry(spark, sessions):
    rows = [(s, seq, t, k, json.dumps(d)) for s, events in sessions.items() for seq, (t, k, d) in enumerate(events)]
    raw = spark.createDataFrame(rows, "session_id string, seq long, t long, k string, d string")
    return promote(raw.withColumn("d", F.parse_json("d")))


@pytest.fixture(scope="module")
def found(spark):
    sessions = {f"{name}/{kind}/{n}": events for name, (fires, silent) in CASES.items() for kind, cases in (("fires", fires), ("silent", silent)) for n, events in enumerate(cases)}
    log = telemetry(spark, sessions).cache()
    return {(r["session_id"], name): r for name in CASES for r in D.DETECTORS[name](log).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_fires_and_stays_silent(found, name):
    fires, silent = CASES[name]
    assert [n for n in range(len(fires)) if (f"{name}/fires/{n}", name) not in found] == []
    assert [n for n in range(len(silent)) if (f"{name}/silent/{n}", name) in found] == []


def test_findings_say_what_was_shown_and_sent(found):
    r = found["ui_api_divergence/fires/0", "ui_api_divergence"]
    assert (r["severity"], r["score"], r["request_id"]) == ("medium", 55, "r1") and "Total" in r["message"] and "215.42" in r["message"] and "199" in r["message"]
    r = found["stale_value_rendered/fires/0", "stale_value_rendered"]
    assert r["severity"] == "high" and r["request_id"] == "r2" and "1250" in r["message"]
    r = found["displayed_field_mismatch/fires/0", "displayed_field_mismatch"]
    assert r["severity"] == "high" and r["request_id"] == "r1" and all(x in r["message"] for x in ("initialCents", "balanceCents", "GC-1"))


def test_three_divergences_a_session_and_one_a_name(spark):
    body = {"total": 215.42, "subtotal": 200.0, "tax": 16.42, "shipping": 9.99, "tip": 5.5}
    labels = [("Total", 1.0), ("Subtotal", 2.0), ("Tax", 3.0), ("Shipping", 4.0), ("Tip", 6.0)]  # 2 and 200 are one amount
    log = telemetry(spark, {"s": [told(1000, "r1", body), shown(1500, *labels), shown(2500, ("Total", 1.0))]})
    assert sorted(r["subject"] for r in S.ui_api_divergence(log).collect()) == ["shipping", "tax", "total"]


def test_numbers_of_a_body():
    body = {"a": 1, "list": [1.5, {"id": 9, "n": 2, "deep": [[{"x": -3}]]}], "ok": True, "t": "5", "z": {"$redacted": "x", "len": 4}, "big": 10**400}
    got = sorted((record, name, value) for _, record, name, value in S.numbers_of(json.dumps(body)))
    assert got == sorted([("", "a", 1.0), ("", "list", 1.5), (".list[]#9", "id", 9.0), (".list[]#9", "n", 2.0), (".list[].deep[][]", "x", -3.0)])
    assert list(S.numbers_of("[REDACTED]")) == list(S.numbers_of(None)) == list(S.numbers_of("")) == []
    assert [v for *_, v in S.numbers_of("[" * 200 + "7" + "]" * 200)] == [7.0]


def test_near_join_is_the_pairs_within_the_tolerance(spark):
    r = random.Random(4)
    left = [(i % 3, round(r.uniform(-2, 2), 3)) for i in range(120)] + [(0, None), (1, float("nan")), (2, 215.42)]
    right = [(i % 3, round(r.uniform(-2, 2), 3)) for i in range(120)] + [(0, None), (1, float("nan")), (2, 215.43), (2, 215.431)]
    a, b = spark.createDataFrame(left, "k int, x double"), spark.createDataFrame(right, "k int, y double")
    got = sorted(map(tuple, J.near_join(a, b, ["k"], "x", "y", 0.01).select("k", "x", "y").collect()))
    want = sorted((k, x, y) for k, x in left for j, y in right if j == k and x is not None and y is not None and x == x and y == y and abs(x - y) <= 0.01 + 1e-9 * max(abs(x), 1))
    assert got == want and (2, 215.42, 215.43) in got
