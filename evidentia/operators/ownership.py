"""Ownership of graph nodes by findings: which node a finding is about, one finding to a node.

Eligible (finding, node) pairs come from joins: by request, and by kind within two seconds. Only they go to the greedy choice, which depends on
what earlier findings of the session took and so is sequential within a session (whose findings are capped).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.joins import range_join

#: Reach in time; kinds of nodes that a detector's findings can be about; detectors that name one write; those of no node.
REACH_MS = 2000
NODE_FAMILIES = {
    "http_error": ("net.res",), "app_2xx_failure": ("net.res",), "network_error": ("net.req",), "slow_request": ("net.res", "net.req"), "pending_request": ("net.req",), "uncaught_error": ("frontend.error",),
    "unhandled_rejection": ("frontend.error",), "console_error": ("console.error",), "backend_request_error": ("backend.error",), "backend_http_error": ("backend.req",), "backend_http_client_error": ("backend.req",),
    "otel_span_error": ("otel.span",), "otel_log_error": ("otel.log",), "db_mutation": ("db.write",), "db_statement_failed": ("db.error",), "job_did_not_complete": ("backend.error", "backend.req"),
    "duplicate_write": ("db.write",), "lost_update": ("db.write",), "db_client_supplied_value": ("db.write",), "db_delta_mismatch": ("db.write",), "duplicate_charge": ("db.write",), "state_flip_flop": ("db.write",),
}
NO_NODE = ("page_probe_failure", "media_degradation", "tab_boundary_gap", "user_marker", "repeated_clicks", "transcript_complaint", "user_flag")
#: Findings that only say where a failure surfaced come after those that name it.
GENERIC = ("db_mutation", "http_error", "backend_http_error", "backend_http_client_error", "console_error")


def _family(detector: Column) -> Column:
    return F.create_map(*[x for name, kinds in NODE_FAMILIES.items() for x in (F.lit(name), F.array(*[F.lit(k) for k in kinds]))])[detector]


def _choose(pairs: pd.DataFrame) -> pd.DataFrame:
    """Findings in order of time, named failures first, take the first eligible node that is free: their request's nearest one, else the nearest in time."""
    taken: dict[str, str] = {}
    out = []
    for (_, _, ident), mine in pairs.sort_values(["ct", "generic", "id", "step", "dist", "node"]).groupby(["ct", "generic", "id"], sort=True):
        own = mine[mine["node"].notna()]
        node = held = None
        request = own[own["step"] == 1].head(1)
        if len(request) and request["node"].iloc[0] not in taken:
            node = request["node"].iloc[0]
        else:
            if len(request):
                held = taken[request["node"].iloc[0]]
            near = own[own["step"] == 2]
            free = near[~near["node"].isin(list(taken))]
            if len(free):
                node = free["node"].iloc[0]
            elif held is None and len(near):
                held = taken[near["node"].iloc[0]]
        if node is not None:
            taken[node] = ident
        cause = None if node is not None else "lost-contention" if held is not None else "no-node-family" if mine["no_family"].iloc[0] else "no-compatible-node"
        out.append((pairs["session_id"].iloc[0], ident, node, cause, held if node is None else None))
    return pd.DataFrame(out, columns=["session_id", "id", "node", "cause", "held_by"])


def own_nodes(candidates: DataFrame, nodes: DataFrame, reach_ms: int = REACH_MS) -> DataFrame:
    """candidates(session_id, id, detector, t, request_id), nodes(session_id, id, kind, t, request_id) -> session_id, id, node, cause, held_by.

    A finding without a node says why: no kind of node fits its detector, none is near, or another finding holds the one it names.
    """
    c = candidates.select("session_id", F.col("id"), "detector", F.col("t").alias("ct"), F.col("request_id").alias("rid"))
    n = nodes.select("session_id", F.col("id").alias("node"), "kind", F.col("t").alias("nt"), F.col("request_id").alias("nrid"))
    dist = F.abs(F.col("nt") - F.col("ct"))
    fits = F.array_contains(_family(F.col("detector")), F.col("kind"))
    by_request = c.where("rid IS NOT NULL").join(n.where("nrid IS NOT NULL"), (c["session_id"] == n["session_id"]) & (F.col("rid") == F.col("nrid"))).drop(n["session_id"])
    best = Window.partitionBy("session_id", "id").orderBy(dist, F.coalesce(fits, F.lit(False)).desc(), "node")
    one = by_request.withColumn("r", F.row_number().over(best)).where("r = 1").select("session_id", "id", "node", F.lit(1).alias("step"), dist.alias("dist"))
    # a finding about a write is about the write of its very moment
    exact = (F.col("kind") != "db.write") | (F.col("nt") == F.col("ct")) | (F.size(_family(F.col("detector"))) > 1)
    near = range_join(c, n, ["session_id"], "ct", "nt", reach_ms, reach_ms).where(F.coalesce(fits, _family(F.col("detector")).isNull() & ~F.col("detector").isin(*NO_NODE)) & exact)
    pairs = one.unionByName(near.select("session_id", "id", "node", F.lit(2).alias("step"), dist.alias("dist")))
    every = c.select("session_id", "id", "ct", F.col("detector").isin(*GENERIC).alias("generic"), F.col("detector").isin(*NO_NODE).alias("no_family")).join(pairs, ["session_id", "id"], "left")
    return every.groupBy("session_id").applyInPandas(_choose, f"session_id {dict(every.dtypes)['session_id']}, id string, node string, cause string, held_by string")
