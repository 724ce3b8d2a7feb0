"""The causal graph of sessions: nodes with stable ids, and request, interaction, symptom and temporal edges.

Everything is a window or a join keyed by session, so all sessions are built at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.joins import first_aliases
from evidentia.session import Tables

#: Event kind -> node kind.
NODE_KINDS = {
    "clk": "user.click", "inp": "user.input", "nav": "user.nav", "net.req": "net.req", "net.res": "net.res", "backend.req.start": "backend.req",
    "backend.req.end": "backend.req", "backend.req.error": "backend.error", "backend.uncaught": "backend.error", "backend.job.start": "backend.req",
    "backend.job.end": "backend.req", "backend.job.error": "backend.error", "db.diff": "db.write", "db.error": "db.error", "backend.otel.span": "otel.span",
    "backend.otel.log": "otel.log", "err": "frontend.error", "rej": "frontend.error",
}
#: Place of a node kind on the spine of a request, for ties in time.
SPINE_RANK = {"net.req": 0, "backend.req": 1, "otel.span": 1, "db.write": 2, "db.error": 2, "otel.log": 2, "backend.error": 3, "net.res": 4}
INTERACTIONS = ("user.click", "user.input")
SYMPTOMS = ("frontend.error", "console.error")
TRIGGERS = ("user.click", "user.input", "user.nav", "net.res", "net.req")
#: Reach of an edge, and the delay up to which it is sure.
WINDOW_MS, HIGH_CONFIDENCE_MS = 2000, 500


def _mapped(values: dict, c: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in values.items() for x in p])[c]


def build_nodes(events: DataFrame) -> DataFrame:
    """session_id, id, kind, t, request_id, failed, nav_epoch, seq.

    A node's id is kind:t:request or browser id or content, with #n on the n-th repeat, so it does not depend on input order.
    events(session_id, seq, t, k, id, request_id, st, msg[, level]).
    """
    level = F.col("level") if "level" in events.columns else F.lit(None).cast("string")
    kind = F.coalesce(_mapped(NODE_KINDS, F.col("k")), F.when((F.col("k") == "con") & F.lower(level).isin("error", "err"), "console.error"))
    rows = events.withColumn("kind", kind).where("kind IS NOT NULL")
    network = F.col("kind").isin("net.req", "net.res")
    alias = first_aliases(events).select(F.col("session_id").alias("__s"), F.col("id").alias("__id"), F.col("request_id").alias("__alias"))
    rows = rows.join(alias, (F.col("session_id") == F.col("__s")) & (F.col("id") == F.col("__id")), "left").drop("__s", "__id")
    mark = F.coalesce(F.concat(F.lit("r="), F.col("request_id")), F.when(network, F.concat(F.lit("b="), F.col("id").cast("string"))), F.concat(F.lit("c="), F.coalesce("msg", F.lit(""))))
    base = F.concat_ws(":", "kind", F.col("t").cast("string"), mark)
    rows = rows.withColumn("__base", base).withColumn("request_id", F.coalesce("request_id", F.when(network, F.col("__alias"))))
    # equal base ids carry the same content: any fixed order of them gives the same set of nodes
    again = F.row_number().over(Window.partitionBy("session_id", "__base").orderBy("t", "seq")) - 1
    rows = rows.withColumn("__n", again).withColumn("id", F.when(F.col("__n") > 0, F.concat(F.col("__base"), F.lit("#"), F.col("__n").cast("string"))).otherwise(F.col("__base")))
    by_time = Window.partitionBy("session_id").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    epoch = F.coalesce(F.sum(F.when(F.col("kind") == "user.nav", 1).otherwise(0)).over(by_time), F.lit(0))
    return rows.select("session_id", "id", "kind", "t", "request_id", ((F.col("k") == "net.res") & (F.coalesce("st", F.lit(0)) >= 400)).alias("failed"), epoch.alias("nav_epoch"), "seq")


def build_edges(nodes: DataFrame, window_ms: int = WINDOW_MS, high_ms: int = HIGH_CONFIDENCE_MS) -> DataFrame:
    """session_id, src, dst, kind, confidence: the four rules in order; temporal only where nothing stronger points."""
    rank = F.coalesce(_mapped(SPINE_RANK, F.col("kind")), F.lit(-1))
    spine = nodes.where(F.col("request_id").isNotNull() & (rank >= 0))
    follow = Window.partitionBy("session_id", "request_id").orderBy("t", rank, "id")
    request = spine.select("session_id", F.col("id").alias("src"), F.lead("id").over(follow).alias("dst"), F.lit("request").alias("kind"), F.lit("high").alias("confidence")).where("dst IS NOT NULL")

    order = Window.partitionBy("session_id").orderBy("t", "id")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    node = F.struct("id", "t", "nav_epoch")
    seen = nodes.select(
        "*", F.last(F.when(F.col("kind").isin(*INTERACTIONS), node), ignorenulls=True).over(back).alias("touch"), F.last(F.when(F.col("kind").isin(*TRIGGERS), node), ignorenulls=True).over(back).alias("cause"),
        F.first(F.when(F.col("kind").isin(*SYMPTOMS), node), ignorenulls=True).over(ahead).alias("symptom"))
    sure = (F.col("t") - F.col("touch.t") <= high_ms) & (F.col("nav_epoch") == F.col("touch.nav_epoch"))
    interaction = seen.where((F.col("kind") == "net.req") & (F.col("t") - F.col("touch.t") <= window_ms)).select("session_id", F.col("touch.id").alias("src"), F.col("id").alias("dst"), F.lit("interaction").alias("kind"), F.when(sure, "high").otherwise("medium").alias("confidence"))
    source = F.col("failed") | (F.col("kind") == "backend.error")
    near = F.col("symptom.t") - F.col("t")
    symptom = seen.where(source & (near <= window_ms)).select("session_id", F.col("id").alias("src"), F.col("symptom.id").alias("dst"), F.lit("symptom").alias("kind"), F.when(near <= high_ms, "high").otherwise("medium").alias("confidence"))
    strong = request.unionByName(interaction).unionByName(symptom).dropDuplicates(["session_id", "src", "dst", "kind"])
    late = seen.where(F.col("kind").isin(*SYMPTOMS) & (F.col("t") - F.col("cause.t") <= window_ms)).select("session_id", F.col("cause.id").alias("src"), F.col("id").alias("dst"), F.lit("temporal").alias("kind"), F.lit("low").alias("confidence"))
    return strong.unionByName(late.join(strong.select("session_id", "dst").distinct(), ["session_id", "dst"], "left_anti"))


def roots(nodes: DataFrame, edges: DataFrame, owned: DataFrame) -> DataFrame:
    """For each owned node its nearest owned ancestor: level by level, the first level with a hit, least id; the path is as sure as its weakest hop.

    owned(session_id, id). Levels are joins on the session's edges; a walk stops where it hits and never meets a node twice, so the frontier
    empties however long a chain is. Each level is written, so no plan grows. A step from one row change to another, and a claim that one caused
    another, is never more than low: their order is the handler's choice.
    """
    tables = Tables(edges.sparkSession, "roots")
    conf = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    writes = nodes.where("kind IN ('db.write', 'db.error')").select("session_id", "id").distinct()
    is_write = lambda name: writes.select("session_id", F.col("id").alias(name), F.lit(True).alias(f"w_{name}"))
    steps = edges.select("session_id", "src", F.col("dst").alias("at"), conf.alias("hop")).join(is_write("src"), ["session_id", "src"], "left").join(is_write("at"), ["session_id", "at"], "left")
    steps = tables.store("steps", steps.select("session_id", "src", "at", F.when(F.col("w_src") & F.col("w_at"), 1).otherwise(F.col("hop")).alias("hop")))
    mine = owned.select("session_id", F.col("id").alias("src")).withColumn("hit", F.lit(True))
    frontier = owned.select("session_id", "id", F.col("id").alias("at"), F.lit(3).alias("sure"))
    seen = frontier.select("session_id", "id", "at")
    found, level = None, 0
    while found is None or not frontier.isEmpty():
        level += 1
        moved = frontier.join(steps, ["session_id", "at"]).groupBy("session_id", "id", "src").agg(F.max(F.least("sure", "hop")).alias("sure"))
        new = moved.join(seen.withColumnRenamed("at", "src"), ["session_id", "id", "src"], "left_anti")
        reached = tables.store(f"level-{level}", new.join(mine, ["session_id", "src"], "left"))
        hits = reached.where("hit").groupBy("session_id", "id").agg(F.min(F.struct("src", "sure")).alias("h")).select("session_id", "id", F.col("h.src").alias("root"), F.col("h.sure").alias("sure"), F.lit(level).alias("hops"))
        hits = tables.store(f"hits-{level}", hits)
        found = hits if found is None else found.unionByName(hits)
        seen = seen.unionByName(reached.select("session_id", "id", F.col("src").alias("at")))
        frontier = tables.store(f"frontier-{level}", reached.join(hits.select("session_id", "id"), ["session_id", "id"], "left_anti").select("session_id", "id", F.col("src").alias("at"), "sure"))
    claims = found.join(is_write("id"), ["session_id", "id"], "left").join(is_write("root"), ["session_id", "root"], "left")
    return claims.select("session_id", "id", "root", F.when(F.col("w_id") & F.col("w_root"), 1).otherwise(F.col("sure")).alias("sure"), "hops")
