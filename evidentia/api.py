"""Bounded reads over the tables of sessions: what a caller asks, each with a limit that no request can lift.

Every read is a DataFrame; rows are ordered before they are cut, so equal calls see equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import aggregates as A
from evidentia.operators import context as X
from evidentia.operators import joins as J
from evidentia.operators import locate as L
from evidentia.operators import projections as P
from evidentia.operators import views as V
from evidentia.operators import window_correlation as WC

#: Rows that a read returns if not asked otherwise, and at most; bounds of the baseline's multiple.
DEFAULT_ROWS, MOST_ROWS = 100, 500
MULTIPLES = (1, 50)


def rows(limit: int | None, default: int = DEFAULT_ROWS) -> int:
    return max(1, min(MOST_ROWS, default if limit is None else limit))


def _first(df: DataFrame, *order: str | Column, limit: int | None = None) -> DataFrame:
    return df.orderBy(*order).limit(rows(limit))


def list_sessions(sessions: DataFrame, limit: int | None = None, **scope) -> DataFrame:
    return _first(P.session_filter(sessions, **scope), F.desc("start"), F.desc("session_id"), limit=limit)


def get_events(events: DataFrame, session_id, kind: str | None = None, after: int | None = None, before: int | None = None, limit: int | None = None) -> DataFrame:
    """Events of a session in file order; both bounds are inclusive."""
    return _first(P.filter_events(events.where(F.col("session_id") == session_id), kind, after, before), "seq", limit=limit)


def get_window(events: DataFrame, session_id, start: int, end: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events of the window, a row with how many matched and how many are returned); bounds may come in either order."""
    lo, hi = min(start, end), max(start, end)
    e = events.where((F.col("session_id") == session_id) & F.col("t").between(lo, hi))
    most = rows(limit)
    return e.orderBy("t", "seq").limit(most), e.agg(F.count("*").alias("matched")).withColumn("returned", F.least("matched", F.lit(most)))


def get_error_context(events: DataFrame, session_id, window_ms: int = 2000, limit: int | None = None) -> DataFrame:
    return _first(J.error_context(events.where(F.col("session_id") == session_id), window_ms), "err_seq", "rank", limit=limit)


def get_failed_requests(events: DataFrame, session_id, limit: int | None = None) -> DataFrame:
    return _first(P.failed_responses(events.where(F.col("session_id") == session_id)), "seq", limit=limit)


def get_fix_context(candidates: DataFrame, roles: DataFrame, linked: DataFrame, planes: dict[str, DataFrame], session_id) -> dict[str, DataFrame]:
    """The chain of the top finding, the requests linked to it, and the rows of each plane in its window."""
    c, r, n = (df.where(F.col("session_id") == session_id) for df in (candidates, roles, linked))
    top = V.top_findings(c)
    out = {"chain": V.causal_chains(c, r), "requests": V.linked_requests(top, n).limit(MOST_ROWS)}
    return out | {name: V.primary_window_rows(df.where(F.col("session_id") == session_id), top, n).orderBy("t").limit(MOST_ROWS) for name, df in planes.items()}


def get_latest_issue(sessions: DataFrame) -> DataFrame:
    """The newest session with anything wrong in it."""
    return sessions.where("errors > 0").orderBy(F.desc("start"), F.desc("session_id")).limit(1)


def list_distinct_bugs(bugs: DataFrame, session_id, limit: int | None = None) -> DataFrame:
    return _first(V.rank_bugs(bugs.where(P.is_bug_record()).where(F.col("session_id") == session_id)), "place", limit=limit)


def recall_issue(scored: DataFrame, limit: int | None = None) -> DataFrame:
    return L.best_per_signature(scored, rows(limit))


def get_window_correlation(events: DataFrame, session_id, start: int, end: int, fields: dict[str, list[str]], multiple: int = 4) -> DataFrame:
    return WC.correlate_window(events.where(F.col("session_id") == session_id), start, end, fields, float(max(MULTIPLES[0], min(MULTIPLES[1], multiple))))


def get_evidence(candidates: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Findings of this id; if there is none, of this signature; if there is none, of this request."""
    ranked = [candidates.where(F.col(c) == key).withColumn("via", F.lit(place)) for place, c in enumerate(("id", "signature", "request_id"))]
    hits = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    best = hits.agg(F.min("via").alias("best"))
    return _first(hits.join(F.broadcast(best), F.col("via") == F.col("best")).drop("best", "via"), F.desc("score"), "id", limit=limit)  # one row of the best way


def resolve_signature(dictionary: DataFrame, ref: int) -> DataFrame:
    return dictionary.where(F.col("ref") == ref).limit(1)


def get_storage_changes(events: DataFrame, session_id, limit: int | None = None) -> DataFrame:
    return _first(P.storage_changes(events.where(F.col("session_id") == session_id)), "t", "seq", limit=limit)


def get_regression_context(events: DataFrame, baseline, session_id) -> dict[str, DataFrame]:
    """What a session did otherwise than its baseline: steps, calls, writes, environment, and the window around it; at most so many rows of each."""
    pair = events.sparkSession.createDataFrame([(baseline, session_id)]).toDF("left", "right").withColumn("pair", F.lit("pair"))
    return {name: df.drop("pair").limit(MOST_ROWS) for name, df in X.regression_context(events, pair).items()}


def get_linked_request_context(events: DataFrame, session_id, request_id: str, limit: int | None = None) -> dict[str, DataFrame]:
    """A request's link or gap, and what every plane knows of it."""
    asked = events.sparkSession.createDataFrame([(session_id, request_id)]).toDF("session_id", "request_id")
    found = X.linked_request_context(events.where(F.col("session_id") == session_id), asked, rows(limit))
    return {"status": found["status"], "rows": found["rows"].orderBy("plane", "place")}


def get_recurrence(bugs: DataFrame, sessions: DataFrame, signature: str) -> DataFrame:
    """Where and how often a bug was seen: one row, or none."""
    return A.recurrence(bugs.where(F.col("signature") == signature), sessions)
