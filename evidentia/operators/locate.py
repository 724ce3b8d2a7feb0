"""Scoring of stored bugs against a symptom or an issue: recall, location, and its outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X

#: Weights of the four facets, of time and release, the half life, the bars of a match.
W_TEXT, W_ROUTE, W_ERROR, W_ENV, W_TIME, W_RELEASE = 0.6, 0.2, 0.1, 0.1, 0.1, 0.1
HALF_LIFE_MS, THRESHOLD, MARGIN = 7 * 24 * 3600 * 1000, 0.5, 0.15


def score_issue(bugs: DataFrame, text: str, route: str | None = None, error: str | None = None, facets: list[str] | None = None) -> DataFrame:
    """bugs(tokens, route, error, facets) scored against one query; those with no signal are dropped. One scan, no join."""
    query = X.issue_tokens(F.lit(text))
    sim = X.jaccard(F.col("tokens"), query)
    same_route = F.lit(False) if not route else F.coalesce(F.lower(F.trim("route")) == route.strip().lower(), F.lit(False))
    same_error = F.lit(False) if not error else F.coalesce(F.col("error") == error, F.lit(False))
    env = X.jaccard(F.col("facets"), F.array(*[F.lit(f) for f in facets or []]).cast("array<string>"))
    score = W_TEXT * sim + W_ROUTE * same_route.cast("int") + W_ERROR * same_error.cast("int") + W_ENV * env
    return bugs.withColumn("score", score).where("score > 0")


def best_per_signature(scored: DataFrame, limit: int) -> DataFrame:
    """The best of each signature and all without one, by score."""
    best = Window.partitionBy("signature").orderBy(F.desc("score"), "session_id", "bug_id")
    keyed = scored.where("signature IS NOT NULL").withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    return keyed.unionByName(scored.where("signature IS NULL")).orderBy(F.desc("score"), "session_id", "bug_id").limit(limit)


def locate(scored: DataFrame, now: int, release: str | None = None, most: int = 100) -> DataFrame:
    """Confidence of each candidate: score, nearness in time, release; the best `most` ranked by confidence, newer first, ids."""
    age = F.greatest(F.lit(0), F.lit(now) - F.col("session_time"))
    time = F.when(F.col("session_time").isNull(), 0.0).otherwise(W_TIME * F.pow(F.lit(0.5), age / HALF_LIFE_MS))
    hint = F.lit(0.0) if not release else F.when(F.lower(F.trim("release")) == release.strip().lower(), W_RELEASE).otherwise(0.0)
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") + time + hint))
    order = (F.desc("confidence"), F.desc_nulls_last("session_time"), "bug_id", "session_id")
    best = scored.withColumn("confidence", confidence).orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of so few rows


def outcome(ranked: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """One row: matched, ambiguous or inconclusive, from the two best candidates."""
    top = ranked.where("rank <= 2").agg(F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("top"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("confidence"))), F.lit(0.0)).alias("second"))
    result = F.when(F.col("top").isNull() | (F.col("top") < threshold), "inconclusive").when(F.col("top") - F.col("second") >= margin, "matched").otherwise("ambiguous")
    return top.withColumn("outcome", result)


def commit_matches(evidence: DataFrame, commits: DataFrame) -> DataFrame:
    """Each evidence item's commit with most shared tokens: explode, equi join, count, best. evidence(id, text), commits(sha, text)."""
    a = evidence.select("id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    b = commits.select("sha", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    shared = a.join(b, "token").groupBy("id", "sha").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("id").orderBy(F.desc("shared"), "sha")
    return shared.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def completeness(evidence: DataFrame, gaps: DataFrame) -> DataFrame:
    """Breadth, volume and penalties of a bundle: evidence(bundle, lane), gaps(bundle, kind), hypotheses' strength 0."""
    lanes = ("network", "db", "flow", "browser", "env")
    e = evidence.groupBy("bundle").agg(F.countDistinct(F.when(F.col("lane").isin(*lanes), F.col("lane"))).alias("lanes"), F.count("*").alias("items"))
    g = gaps.groupBy("bundle").agg(F.count_if(F.col("kind") == "source-unavailable").alias("hard"), F.count_if(F.col("kind") != "source-unavailable").alias("soft"))
    j = e.join(g, "bundle", "left").fillna(0, ["hard", "soft"])
    raw = 0.4 * F.least(F.lit(1.0), F.col("lanes") / 3) + 0.25 * F.least(F.lit(1.0), F.col("items") / 5)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw - F.least(F.lit(0.5), F.col("soft") * 0.1 + F.col("hard") * 0.3)))
    return j.withColumn("score", score).withColumn("level", F.when(F.col("score") < 0.34, "low").when(F.col("score") < 0.67, "medium").otherwise("high"))


def latency_verdict(before: Column, after: Column) -> Column:
    """Slower by 250 ms and three times; division by zero counts as endless."""
    ratio = F.when(before == 0, F.lit(float("inf"))).otherwise(F.try_divide(after, before))
    return (after - before >= 250) & (ratio >= 3)
