"""Source maps in a round trip against a scalar reader, frames placed in them, and ranking by the user's last action."""

import json
import random

import pytest

from evidentia.functions import source_maps as M
from evidentia.operators import detectors as D
from evidentia.operators import detectors_business as B
from evidentia.operators import graph as G
from tests.test_detectors_screen import telemetry


def scalar(mappings):
    """Reads a mappings text digit by digit."""
    out, held = [], [0, 0, 0, 0]
    for line, part in enumerate(mappings.split(";")):
        column = 0
        for segment in filter(None, part.split(",")):
            values, n, shift = [], 0, 0
            for c in segment:
                d = M.DIGITS.index(c)
                n |= (d & 31) << shift
                shift += 5
                if d < 32:
                    values.append(-(n >> 1) if n & 1 else n >> 1)
                    n = shift = 0
            column += values[0]
            row = [line, column, -1, -1, -1, -1]
            for k, v in enumerate(values[1:]):
                held[k] += v
                row[k + 2] = held[k]
            out.append(row)
    return out


def made(r):
    rows = []
    for line in sorted(r.sample(range(30), r.randrange(1, 12))):
        for column in sorted(r.sample(range(5000), r.randrange(1, 20))):
            kind = r.random()
            rows.append((line, column) if kind < 0.1 else (line, column, r.randrange(3), r.randrange(900), r.randrange(200), *([r.randrange(4)] if kind > 0.6 else [])))
    return rows


def test_round_trip_of_generated_maps():
    r = random.Random(1)
    for _ in range(200):
        rows = made(r)
        text = M.encode(rows)
        want = [[*row, *[-1] * (6 - len(row))] for row in rows]
        assert M.decode(text).tolist() == want == scalar(text)
    assert M.decode("").tolist() == [] and M.decode(";;,").tolist() == []
    assert M.decode("AAAA,gBACE;AAEA").tolist() == [[0, 0, 0, 0, 0, -1], [0, 16, 0, 1, 2, -1], [1, 0, 0, 3, 2, -1]]


@pytest.mark.parametrize("text", ["A!", "g", "AA", "AAA", "gg,A", "D", "AAAAAA", "é", "AAAA,gBACD"])
def test_broken_mappings_give_nothing(text):
    assert M.decode(text) is None


def test_frames_are_placed(spark):
    r = random.Random(5)
    rows = made(r)
    doc = {"version": 3, "sources": ["webpack://_N_E/./src/a.ts", "./b.ts", "c.ts"], "names": ["f", "g", "h", "i"], "mappings": M.encode(rows)}
    maps = [("x/app.js", json.dumps(doc)), ("bad.js", "{no"), ("old.js", json.dumps({**doc, "version": 2})), ("index.js", json.dumps({"version": 3, "sections": [], "mappings": ""})), ("none.js", None), ("few.js", json.dumps({**doc, "sources": []}))]
    mapped = M.segments(spark.createDataFrame(maps, "file string, map string"))
    frames = [("s", n, r.choice(["x/app.js", "x/app.js", "bad.js", "old.js", "gone.js"]), r.randrange(1, 32), r.randrange(1, 5200)) for n in range(300)] + [("s", 999, "x/app.js", None, None)]
    got = {x["n"]: (x["source"], x["source_line"], x["source_column"], x["name"]) for x in M.place_frames(spark.createDataFrame(frames, "session_id string, n int, file string, line int, column int"), mapped).collect()}
    paths, hits = ["src/a.ts", "b.ts", "c.ts"], 0
    for _, n, file, line, column in frames:
        own = [x for x in rows if line is not None and file == "x/app.js" and x[0] == line - 1 and x[1] <= column - 1]
        last = own[-1] if own else ()
        want = (paths[last[2]], last[3] + 1, last[4] + 1, doc["names"][last[5]] if len(last) > 5 else None) if len(last) > 2 else (None, None, None, None)
        assert got[n] == want
        hits += len(last) > 2
    assert hits > 20 and len(got) == len(frames)


# ---- the user's last action


def thread(t, rid, table):
    return [(t, "backend.req.start", {"requestId": rid, "route": "/r"}), (t + 100, "db.diff", {"op": "insert", "table": table, "pk": {"id": 1}, "after": {"id": 1}, "requestId": rid}), (t + 200, "backend.req.end", {"requestId": rid})]


ACT = [(5000, "clk", {"el": {"txt": "Continue"}})]
EARLY, LATE = thread(1000, "e", "settings"), thread(9000, "l", "sessions")
NO_LINKS = "session_id string, id string, root string, sure int"


def ranked(spark, events, links=(), reach=None):
    log = telemetry(spark, {"s": events})
    rows = D.dedupe(D.run_detectors(log, ["db_mutation"])).selectExpr("*", "split(subject, ' ')[0] AS candidate_id")
    r = None if reach is None else spark.createDataFrame(reach, "session_id string, id string, hops int")
    out = B.rank_candidates(rows, spark.createDataFrame(list(links), NO_LINKS), B.last_actions(log), r).orderBy("rank").collect()
    return [x["id"] for x in out], {x["score"] for x in out}


def test_threads_that_reach_the_last_action_lead(spark):
    assert ranked(spark, [*EARLY, *ACT, *LATE])[0] == ["sessions", "settings"]
    assert ranked(spark, [*EARLY, *LATE])[0] == ["settings", "sessions"]
    assert ranked(spark, [*EARLY, *LATE, (20_000, "clk", {})])[0] == ["settings", "sessions"]  # neither reaches it
    order, scores = ranked(spark, [*EARLY, *ACT, *LATE], [("s", "sessions", "settings", 2)])
    assert order == ["settings", "sessions"] and len(scores) == 1  # one thread, and it reaches


def test_findings_that_the_action_caused_lead(spark):
    other = thread(8000, "o", "carts")
    assert ranked(spark, [*ACT, *other, *LATE])[0] == ["carts", "sessions"]
    assert ranked(spark, [*ACT, *other, *LATE], reach=[("s", "sessions", 2)])[0] == ["sessions", "carts"]
    assert ranked(spark, [*ACT, *other, *LATE], reach=[("s", "sessions", 3), ("s", "carts", 1)])[0] == ["carts", "sessions"]


def test_walk_back_to_the_action(spark):
    nodes = spark.createDataFrame([("s", i, k) for i, k in (("act", "ui.click"), ("req", "net.req"), ("err", "fe.error"), ("far", "fe.error"), ("lone", "fe.error"))], "session_id string, id string, kind string")
    edges = spark.createDataFrame([("s", "act", "req", "interaction", "high"), ("s", "req", "err", "symptom", "high"), ("s", "err", "far", "temporal", "low")], "session_id string, src string, dst string, kind string, confidence string")
    one = lambda *ids: spark.createDataFrame([("s", i) for i in ids], "session_id string, id string")
    got = {(x["id"], x["hops"]) for x in B.reached_by(nodes, edges, one("act"), one("err", "far", "lone")).collect()}
    assert got == {("err", 2)}  # far hangs on err, whose thread it joins
    assert G.roots(nodes, edges, one("act", "far")).collect()[0]["hops"] == 3
