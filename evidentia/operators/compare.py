"""Comparing two sessions: steps, network calls, writes, environment; and the evidence a comparison leaves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators.joins import fifo_match
from evidentia.operators.locate import latency_verdict

#: Fixed value: how far a matching step may lie from its place.
ALIGN_REACH = 2
ALIGNED = "pair string, a_idx int, b_idx int, change string"


def steps(events: DataFrame) -> DataFrame:
    """session_id, idx, t, seq, kind, sig: navigations, clicks and inputs in order, numbered from 0."""
    rows = events.where("k IN ('nav', 'clk', 'inp')")
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    return rows.select("session_id", (F.row_number().over(order) - 1).alias("idx"), "t", "seq", F.col("k").alias("kind"), F.coalesce("sig", F.lit("")).alias("sig"))


def _align(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    a, b = (d.sort_values("idx") if len(d) else pd.DataFrame({"idx": [], "kind": [], "sig": []}) for d in (a, b))
    right = list(zip(b["kind"], b["sig"], strict=True))
    free = [True] * len(right)
    out = []
    for i, step in enumerate(zip(a["kind"], a["sig"], strict=True)):
        reach = range(max(0, i - ALIGN_REACH), min(len(right), i + ALIGN_REACH + 1))
        j = next((j for j in reach if free[j] and right[j] == step), None)
        if j is not None:
            free[j] = False
        out.append((key[0], i, j, "missing" if j is None else "paired"))
    out += [(key[0], None, j, "added") for j, unused in enumerate(free) if unused]
    return pd.DataFrame(out, columns=["pair", "a_idx", "b_idx", "change"]).astype({"a_idx": "Int32", "b_idx": "Int32"})


def align_steps(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right(pair, idx, kind, sig) -> each left step with the first unused equal step within reach; the rest missing or added.

    Greedy matching depends on what earlier steps took, so it runs in order inside one pair; pairs are spread over tasks, and a pair
    is two sessions' interactions, which the source bounds at 50 MiB a session.
    """
    columns = ["pair", "idx", "kind", "sig"]
    right = right.select(*[F.col(c).alias(f"__{c}") for c in columns]).toDF(*columns)  # columns of its own, where both sides are cut from one table
    return left.select(columns).groupBy("pair").cogroup(right.select(columns).groupBy("pair")).applyInPandas(_align, ALIGNED)


def anchor(calls: DataFrame, marks: DataFrame) -> DataFrame:
    """Each call with the idx of the last step at or before its time (null before the first)."""
    both = calls.withColumn("idx", F.lit(None).cast("int")).withColumn("__call", F.lit(1)).unionByName(marks.select("session_id", "t", F.col("idx").cast("int").alias("idx"), F.lit(0).alias("__call")), allowMissingColumns=True)
    order = Window.partitionBy("session_id").orderBy("t", "__call").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("anchor", F.last("idx", ignorenulls=True).over(order)).where("__call = 1").drop("__call", "idx")


def _kept(keep: tuple[str, ...]) -> list[Column]:
    return [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("a", "b") for c in keep]


def network_diff(left: DataFrame, right: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Calls of two runs matched in order of (pair, anchor, method, route): missing, added, a changed status class, or slower.

    left, right(pair, anchor, method, url, st, dur, t); `keep` names more columns to tell of both sides.
    """
    keys = ["pair", "anchor", "method", "route"]
    shaped = [d.withColumn("route", X.route(F.col("url"))).withColumn("anchor", F.coalesce("anchor", F.lit(-1))) for d in (left, right)]
    m = fifo_match(shaped[0], shaped[1], keys, "t")
    status = F.floor(F.col("a.st") / 100) != F.floor(F.col("b.st") / 100)
    slower = F.coalesce(latency_verdict(F.col("a.dur"), F.col("b.dur")), F.lit(False))
    verdict = F.when(F.col("change") != "paired", F.col("change")).when(F.coalesce(status, F.lit(False)), "status").when(slower, "slower")
    return m.select(*keys, F.col("a.st").alias("a_st"), F.col("b.st").alias("b_st"), F.col("a.dur").alias("a_dur"), F.col("b.dur").alias("b_dur"), verdict.alias("divergence"), *_kept(keep))


def write_diff(left: DataFrame, right: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Row writes of two runs matched in order of (pair, anchor, engine, table, op). left, right(pair, anchor, engine, table, op, t)."""
    keys = ["pair", "anchor", "engine", "table", "op"]
    shaped = [d.withColumns({"engine": F.coalesce("engine", F.lit("postgres")), "op": F.coalesce("op", F.lit("insert")), "anchor": F.coalesce("anchor", F.lit(-1))}) for d in (left, right)]
    return fifo_match(shaped[0], shaped[1], keys, "t").select(*keys, "change", *_kept(keep))


#: Noise in compared values and what stands for it, most specific first.
_NOISE = (
    ("uuid", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    ("timestamp", r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(?:Z|[+-][0-9]{2}:?[0-9]{2})?", "<ts>"),
    ("epoch", r"\b1[0-9]{9}(?:[0-9]{3})?\b", "<epoch>"),
    ("hex", r"\b[0-9a-f]{16,}\b", "<hex>"),
)


def without_noise(value: Column) -> tuple[Column, Column]:
    """(value with ids and times masked, names of the rules that changed it)."""
    rules = []
    for name, pattern, put in _NOISE:
        rules.append(F.when(value.rlike(pattern), F.lit(name)))
        value = F.regexp_replace(value, pattern, put)
    return value, F.array_compact(F.array(*rules))


# ---- evidence


#: Confidence of a join by where its key comes from.
PROVENANCE = {"observed": 0.9, "derived": 0.6, "inferred": 0.3}


def evidence_edges(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """bundle, src, dst, key, confidence: neighbours in time among the items that share a join key's value.

    Consecutive items only, so a value that everything shares gives a chain and not all pairs. evidence(bundle, id, t, provenance, *keys).
    """
    long = evidence.select("bundle", "id", "t", "provenance", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("j")).select("bundle", "id", "t", "provenance", "j.*").where("value IS NOT NULL AND value <> ''")
    sure = F.lit(PROVENANCE["inferred"])
    for name, c in PROVENANCE.items():
        sure = F.when(F.col("provenance") == name, F.lit(c)).otherwise(sure)
    w = Window.partitionBy("bundle", "key", "value").orderBy("t", "id")
    e = long.withColumn("sure", sure).withColumn("next", F.lead(F.struct("id", "sure")).over(w)).where("next IS NOT NULL")
    return e.groupBy("bundle", F.col("id").alias("src"), F.col("next.id").alias("dst")).agg(F.max(F.struct(F.least("sure", "next.sure").alias("c"), F.col("key").alias("k"))).alias("b")).select("bundle", "src", "dst", F.col("b.k").alias("key"), F.col("b.c").alias("confidence"))


def islands(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Items that no edge touches."""
    touched = edges.select("bundle", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return evidence.select("bundle", "id").join(touched, ["bundle", "id"], "left_anti")


def lane_report(evidence: DataFrame, expected: list[str]) -> DataFrame:
    """bundle, present, missing: lanes with evidence against those expected."""
    g = evidence.groupBy("bundle").agg(F.array_sort(F.collect_set("lane")).alias("present"))
    return g.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, expected)), "present")))


def roles(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates of the graph as root, symptom or isolated; roots carry their symptoms in order.

    candidates(session_id, id), found(session_id, id, root, sure, ...): the nearest owned ancestors.
    """
    cause = found.select("session_id", "id", "root", "sure")
    effects = cause.groupBy("session_id", F.col("root").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("causes"))
    out = candidates.join(cause, ["session_id", "id"], "left").join(effects, ["session_id", "id"], "left")
    role = F.when(F.col("root").isNotNull(), "symptom").when(F.col("causes").isNotNull(), "root").otherwise("isolated")
    return out.select("session_id", "id", role.alias("role"), F.col("root").alias("root_cause"), "causes", "sure")


def backtest(stored: DataFrame, replayed: DataFrame, keys: list[str]) -> DataFrame:
    """Stored against replayed findings by key: newly flagged, stopped or unchanged, with counts."""
    a, b = (d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((stored, "before"), (replayed, "after")))
    j = a.join(b, keys, "full_outer")
    verdict = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "stopped").otherwise("unchanged")
    return j.select(*keys, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), verdict.alias("verdict"))


def body_references(bodies: DataFrame) -> DataFrame:
    """Repeats of a body at one URL as references to the first time it was seen. bodies(session_id, seq, t, url, body)."""
    w = Window.partitionBy("session_id", "url", F.xxhash64("body"), "body")
    return bodies.withColumn("first_t", F.min("t").over(w)).withColumn("first_seq", F.min("seq").over(w)).select("session_id", "seq", "t", "url", F.when(F.col("seq") == F.col("first_seq"), F.col("body")).alias("body"), F.when(F.col("seq") != F.col("first_seq"), F.col("first_t")).alias("same_as"))


def cookie_changes(snapshots: DataFrame) -> DataFrame:
    """Snapshots of cookies -> set, mod and del rows. snapshots(session_id, seq, t, cookies MAP): an empty one counts as such."""
    order = Window.partitionBy("session_id").orderBy("seq")
    s = snapshots.withColumn("was", F.coalesce(F.lag("cookies").over(order), F.expr("map_filter(cookies, (k, v) -> false)")))
    names = F.explode(F.array_union(F.map_keys("cookies"), F.map_keys("was")))
    rows = s.select("session_id", "seq", "t", "cookies", "was", names.alias("name")).select("session_id", "seq", "t", "name", F.col("was")[F.col("name")].alias("before"), F.col("cookies")[F.col("name")].alias("after"))
    change = F.when(F.col("before").isNull(), "set").when(F.col("after").isNull(), "del").otherwise("mod")
    return rows.where("NOT before <=> after").withColumn("change", change)
