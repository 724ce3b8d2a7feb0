"""Context of a finding assembled for many sessions at once: what differs between two runs, and all that is known of a request.

Both take a table of what is asked (pairs of sessions, or requests), so one plan answers a caller's single question and a nightly job over all alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import compare as C
from evidentia.operators import projections as P
from evidentia.operators.detectors import field
from evidentia.operators.joins import first_aliases, full_stack

#: How far the window reaches beyond the divergent rows of the second run.
PAD_MS = 1000


def with_signatures(events: DataFrame) -> DataFrame:
    """Events with `sig`: the element of an interaction, or the route of a navigation."""
    return events.withColumn("sig", F.coalesce(field("el.sig"), field("el.path"), field("el.name"), X.url_path(F.coalesce(field("to"), "url"))))


def regression_context(events: DataFrame, pairs: DataFrame, pad_ms: int = PAD_MS) -> dict[str, DataFrame]:
    """pairs(pair, left, right) of sessions -> tables keyed by pair:

    steps(a_idx, b_idx, change, kind, sig, t), calls and writes with their divergence and the second run's time and request, environment(key, before,
    after, change), window(t0, t1, requests): the stretch of the second run around what diverged there, and summary: how much diverged in each plane.
    """
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("left").alias("session_id")), F.struct(F.lit("b").alias("side"), F.col("right").alias("session_id")))).alias("s")).select("pair", "s.*")
    rows = with_signatures(events.join(sides.select("session_id").distinct(), "session_id", "left_semi"))
    marks = C.steps(rows)
    of = lambda df, side: sides.where(F.col("side") == side).join(df, "session_id").drop("side")
    left, right = of(marks, "a"), of(marks, "b")
    aligned = C.align_steps(left, right).where("change <> 'paired'")
    told = lambda df, idx: df.select("pair", F.col("idx").alias(idx), F.struct("kind", "sig", "t").alias(f"{idx}_step"))
    steps = aligned.join(told(left, "a_idx"), ["pair", "a_idx"], "left").join(told(right, "b_idx"), ["pair", "b_idx"], "left").withColumn("s", F.coalesce("a_idx_step", "b_idx_step"))
    steps = steps.select("pair", "a_idx", "b_idx", "change", "s.kind", "s.sig", "s.t")

    calls = C.anchor(P.network_calls(rows).withColumn("url", F.col("route")), marks)
    network = C.network_diff(of(calls, "a"), of(calls, "b"), keep=("t", "request_id")).where("divergence IS NOT NULL")
    writes = C.anchor(P.db_writes(rows), marks)
    stored = C.write_diff(of(writes, "a"), of(writes, "b"), keep=("t", "request_id", "pk", "before", "after")).where("change <> 'paired'")
    env = P.environment(rows)
    environment = _env_diff(of(env, "a"), of(env, "b"))

    late = network.select("pair", F.col("b_t").alias("t"), F.col("b_request_id").alias("request_id")).unionByName(stored.select("pair", F.col("b_t").alias("t"), F.col("b_request_id").alias("request_id")))
    window = late.where("t IS NOT NULL").groupBy("pair").agg(F.greatest(F.lit(0), F.min("t") - pad_ms).alias("t0"), (F.max("t") + pad_ms).alias("t1"), F.array_sort(F.collect_set(F.nullif("request_id", F.lit("")))).alias("requests"))
    planes = (("flow", steps), ("network", network), ("db", stored), ("env", environment))
    counts = None
    for name, df in planes:
        one = df.groupBy("pair").agg(F.lit(name).alias("plane"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return {"steps": steps, "calls": network, "writes": stored, "environment": environment, "window": window, "summary": counts}


def _env_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """As `joins.env_diff`, for many pairs."""
    a = left.select("pair", "key", F.col("value").alias("before"), F.lit(True).alias("__l"))
    b = right.select("pair", "key", F.col("value").alias("after"), F.lit(True).alias("__r"))
    change = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return a.join(b, ["pair", "key"], "full_outer").withColumn("change", change).where("change IS NOT NULL").drop("__l", "__r")


def linked_request_context(events: DataFrame, requests: DataFrame, most: int = 200) -> dict[str, DataFrame]:
    """requests(session_id, request_id) -> status of each (linked, or the type of its gap, or unknown), and the rows of every plane that name it.

    A browser request may go by its own id: the request id that its events name first stands for it. The earliest `most` rows of a plane and request are
    returned; `matched` says how many there are.
    """
    asked = requests.select("session_id", "request_id").distinct()
    alias = first_aliases(events).select("session_id", "id", F.col("request_id").alias("__alias"))
    rows = events.join(alias, ["session_id", "id"], "left").withColumn("request_id", F.coalesce("request_id", "__alias", F.when(F.col("k").startswith("net."), F.col("id")))).drop("__alias")
    mine = rows.join(asked, ["session_id", "request_id"], "left_semi")
    front = mine.where("k = 'net.req'").select("session_id", "request_id", "seq", "t")
    back = mine.where("k LIKE 'backend.req.%'").groupBy("session_id", "request_id").agg(F.min("t").alias("t")).select("session_id", "request_id", "t", F.lit(None).cast("string").alias("status"))
    joined = full_stack(front, back).select("session_id", "request_id", "type")
    status = asked.join(joined, ["session_id", "request_id"], "left").select("session_id", "request_id", F.coalesce("type", F.lit("unknown")).alias("status"))
    plane = F.when(F.col("k").startswith("net."), "network").when(F.col("k").startswith("db."), "db").when(F.col("k").startswith("backend.http"), "outbound").when(F.col("k").startswith("backend.otel"), "trace").when(F.col("k").startswith("backend."), "backend").otherwise("frontend")
    w = Window.partitionBy("session_id", "request_id", "plane")
    placed = mine.withColumn("plane", plane).withColumn("place", F.row_number().over(w.orderBy("t", "seq"))).withColumn("matched", F.count("*").over(w))
    return {"status": status, "rows": placed.where(F.col("place") <= most).select("session_id", "request_id", "plane", "place", "matched", "seq", "t", "k", F.to_json("d").alias("d"))}
