"""Aggregations, rankings and windows of the derived views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.session import Tables


def counts_by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id", "k").agg(F.count("*").alias("n"))


def exact_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median, n: the exact median of each group (the mean of the middle two of an even number); nulls are not counted in it."""
    return rows.groupBy(*keys).agg(F.median(value).alias("median"), F.count("*").alias("n"))


def sliding_counts(events: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Every row with `n`: the rows of its key in the window that ends at it, the far end excluded."""
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(-(window_ms - 1), 0)
    return events.withColumn("n", F.count("*").over(w))


def kind_report(events: DataFrame) -> DataFrame:
    """For each session: events of indexed kinds, and how many distinct others, with the first of them."""
    known = F.col("k").isin(*X.INDEXED_KINDS)
    return events.groupBy("session_id").agg(F.count_if(known).alias("indexed"), F.countDistinct(F.when(~known, F.col("k"))).alias("unrecognized"), F.min_by(F.when(~known, F.col("k")), F.when(~known, F.col("seq"))).alias("first_unrecognized"))


def compact_runs(events: DataFrame, signature: Column) -> DataFrame:
    """One row per session and signature: its first row, and for repeats the count and the span of time."""
    g = events.withColumn("signature", signature).groupBy("session_id", "signature").agg(F.min_by(F.struct("seq", "t", "msg"), "seq").alias("first"), F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    many = F.col("n") > 1
    return g.select("session_id", "signature", F.col("first.seq").alias("seq"), F.col("first.msg").alias("msg"), F.when(many, F.col("n")).alias("count"), F.when(many, F.col("lo")).alias("first_at"), F.when(many, F.col("hi")).alias("last_at"))


#: Good and poor bounds of each metric.
VITAL_BOUNDS = {"lcp": (2500.0, 4000.0), "cls": (0.1, 0.25), "inp": (200.0, 500.0), "ttfb": (800.0, 1800.0), "fcp": (1800.0, 3000.0)}


def vitals(events: DataFrame, metric: Column, value: Column) -> DataFrame:
    """The last reading of each metric of a session, rated."""
    last = events.select("session_id", "seq", metric.alias("metric"), value.alias("value")).where(F.col("metric").isin(*VITAL_BOUNDS) & F.col("value").isNotNull() & ~F.isnan("value")).groupBy("session_id", "metric").agg(F.max_by("value", "seq").alias("value"))
    good = F.create_map(*[F.lit(x) for k, (g, _) in VITAL_BOUNDS.items() for x in (k, g)])[F.col("metric")]
    poor = F.create_map(*[F.lit(x) for k, (_, p) in VITAL_BOUNDS.items() for x in (k, p)])[F.col("metric")]
    return last.withColumn("rating", F.when(F.col("value") <= good, "good").when(F.col("value") > poor, "poor").otherwise("needs_improvement"))


def completeness(events: DataFrame, surface: Column, dropped: Column) -> DataFrame:
    """Capture gaps of each session and the grade they leave."""
    gap = F.col("k") == "capture_gap"
    g = events.groupBy("session_id").agg(
        F.count_if(gap).alias("gaps"), F.countDistinct(F.when(gap, F.coalesce(surface, F.lit("unknown")))).alias("surfaces"), F.coalesce(F.sum(F.when(gap & (dropped > 0), dropped)), F.lit(0)).alias("dropped"),
        F.coalesce(F.bool_or(F.col("k").startswith("backend.req.")), F.lit(False)).alias("backend"), F.coalesce(F.bool_or(F.col("k") == "db.diff"), F.lit(False)).alias("db"))
    return g.withColumn("grade", F.when(F.col("gaps") == 0, "complete").when(F.col("backend") & F.col("db"), "degraded").otherwise("fragmentary"))


def preceding_successes(events: DataFrame, window_ms: int = 15_000, most: int = 12) -> DataFrame:
    """Responses under status 400 within the window before a session's first error, newest first."""
    first = events.where("k IN ('err', 'rej')").groupBy("session_id").agg(F.min("t").alias("err_t"))
    ok = events.where("k = 'net.res' AND st < 400").join(first, "session_id").where((F.col("t") < F.col("err_t")) & (F.col("t") >= F.col("err_t") - window_ms))
    newest = Window.partitionBy("session_id").orderBy(F.desc("t"), F.desc("seq"))
    return ok.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= most)


def prevalence(findings: DataFrame, sessions: DataFrame, recent: int = 200, least: int = 12) -> DataFrame:
    """detector, sessions: in how many of the most recent prior sessions each detector fired; nothing under `least` sessions.

    findings(session_id, detector), sessions(session_id, start).
    """
    window = sessions.orderBy(F.desc("start"), F.desc("session_id")).limit(recent).select("session_id")
    fired = findings.join(window, "session_id").groupBy("detector").agg(F.countDistinct("session_id").alias("sessions"))
    total = window.agg(F.count("*").alias("window_sessions"))
    return fired.crossJoin(F.broadcast(total)).where(F.col("window_sessions") >= least)  # one row of totals


def element_usage(events: DataFrame, signature: Column) -> DataFrame:
    return events.where("k IN ('clk', 'inp')").groupBy(signature.alias("signature")).agg(F.count("*").alias("n"), F.min(F.struct("t", "session_id", "seq")).alias("first")).select("signature", "n", F.col("first.t").alias("first_t"))


def signature_dictionary(events: DataFrame, signature: Column, fields: list[str]) -> DataFrame:
    """signature, ref (by first sight), and of each field its value if all occurrences agree on it."""
    g = events.withColumn("signature", signature).where("signature IS NOT NULL").groupBy("signature").agg(
        F.min(F.struct("t", "session_id", "seq")).alias("first"), *[F.when((F.countDistinct(f) == 1) & (F.count(f) == F.count("*")), F.min(f)).alias(f) for f in fields])
    # numbered within ranges of first sight, then moved by the sizes of the ranges before
    ranges = Tables(events.sparkSession, "signature-dictionary").store("ranges", g.repartitionByRange("first").withColumn("__p", F.spark_partition_id()))
    sizes = ranges.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("__p").orderBy("first"))
    return ranges.withColumn("__r", within).join(offsets, "__p").withColumn("ref", (F.col("__r") + F.col("__before")).cast("int")).drop("first", "__p", "__r", "__before")


def diversity_cap(candidates: DataFrame, most: int = 200) -> DataFrame:
    """The candidate cap rationed over detectors: every detector's best before any detector's second."""
    mine = Window.partitionBy("session_id", "detector").orderBy(F.desc("score"), "t", "candidate_id")
    ranked = candidates.withColumn("turn", F.row_number().over(mine))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("turn", F.desc("score"), "t", "candidate_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= most)


#: Severity order.
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p])[c], F.lit(0))


def distinct_bugs(candidates: DataFrame) -> DataFrame:
    """Two stages: candidates by request id (else signature); then clusters of one session with equal combinations of signatures.

    candidates(session_id, candidate_id, request_id, signature, severity, score, t).
    """
    g = candidates.groupBy("session_id", F.coalesce("request_id", "signature").alias("cluster")).agg(
        F.sort_array(F.collect_set("signature")).alias("signatures"), F.sort_array(F.collect_set("request_id")).alias("request_ids"), F.count("*").alias("n"),
        F.max(severity_rank(F.col("severity"))).alias("severity_rank"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.max(F.struct("score", "candidate_id")).alias("best"))
    folded = g.groupBy("session_id", "signatures").agg(
        F.count("*").alias("occurrences"), F.sum("n").alias("candidates"), F.max("severity_rank").alias("severity_rank"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("request_ids")))).alias("request_ids"), F.max("best").alias("best"))
    return folded.withColumn("signature", F.concat(F.lit("bugsig2:"), X.fnv1a_base36(F.array_join("signatures", "|")))).withColumn("representative", F.col("best.candidate_id")).drop("best")


def recurrence(bugs: DataFrame, sessions: DataFrame) -> DataFrame:
    """signature -> sessions, occurrences, first and last sight, and the releases they span. sessions(session_id, start, release)."""
    return bugs.join(sessions, "session_id").groupBy("signature").agg(
        F.countDistinct("session_id").alias("session_count"), F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min_by("release", F.struct("start", "session_id")).alias("first_release"), F.max_by("release", F.struct("start", "session_id")).alias("last_release"))


def budget_fill(items: DataFrame, budget: int, plane: str = "plane", order: list[str] | None = None, cost: str = "cost") -> DataFrame:
    """Planes in priority order; of each the longest prefix that fits what earlier planes left. Adds `kept`.

    items(session_id, plane 1..p, ordinal, cost). A running sum gives each prefix's cost; the few planes are folded in an array per
    session, so nothing loops on the driver.
    """
    order = order or ["ordinal"]
    running = items.withColumn("upto", F.sum(cost).over(Window.partitionBy("session_id", plane).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    planes = running.groupBy("session_id", plane).agg(F.array_sort(F.collect_list("upto")).alias("sums")).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(F.col(plane).alias("p"), "sums"))).alias("planes"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<p:int,room:bigint>>").alias("rooms"))

    def step(s: Column, p: Column) -> Column:
        fit = F.coalesce(F.array_max(F.filter(p["sums"], lambda x: x <= s["left"])), F.lit(0)).cast("long")
        return F.struct((s["left"] - fit).alias("left"), F.concat(s["rooms"], F.array(F.struct(p["p"].cast("int").alias("p"), fit.alias("room")))).alias("rooms"))

    rooms = planes.select("session_id", F.explode(F.aggregate("planes", start, step, lambda s: s["rooms"])).alias("r")).select("session_id", F.col("r.p").alias(plane), F.col("r.room").alias("room"))
    return running.join(rooms, ["session_id", plane]).withColumn("kept", F.col("upto") <= F.col("room"))


def arm_metrics(runs: DataFrame) -> DataFrame:
    """arm -> runs, identified, rate, medians over identified runs, confident errors. runs(arm, bug_id, run_index, ordinal, correct, seconds, tokens, confidence)."""
    first = Window.partitionBy("arm", "bug_id", "run_index").orderBy("ordinal")
    one = runs.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    hit = F.col("correct")
    return one.groupBy("arm").agg(
        F.count("*").alias("runs"), F.count_if(hit).alias("identified"), (F.count_if(hit) / F.count("*")).alias("rate"), F.median(F.when(hit, F.col("seconds"))).alias("median_seconds"),
        F.median(F.when(hit, F.col("tokens"))).alias("median_tokens"), F.count_if(~hit & (F.coalesce("confidence", F.lit(0.0)) >= 0.8)).alias("confident_errors"))


def layout_shift(shifts: DataFrame, gap_ms: int = 1000, span_ms: int = 5000) -> DataFrame:
    """Greatest sum of a session window of shifts that ends at a gap or a span: sequential over the ordered shifts of one session."""
    ordered = shifts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "value"))).alias("xs"))
    zero = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).cast("int").alias("n"))

    def step(s: Column, x: Column) -> Column:
        new = s["start"].isNull() | (x["t"] - s["last"] > gap_ms) | (x["t"] - s["start"] > span_ms)
        total = F.when(new, F.lit(0.0)).otherwise(s["sum"]) + x["value"]
        return F.struct(F.when(new, x["t"]).otherwise(s["start"]).alias("start"), x["t"].alias("last"), total.alias("sum"), F.greatest(s["best"], total).alias("best"), (s["n"] + F.when(new, 1).otherwise(0)).cast("int").alias("n"))

    out = ordered.select("session_id", F.aggregate("xs", zero, step).alias("s"))
    return out.select("session_id", F.col("s.best").alias("score"), F.col("s.n").alias("windows"))


def interaction_latency(interactions: DataFrame) -> DataFrame:
    """The ranked pick: longest duration of each interaction, taken at rank floor(n / 50) from the top 1,000."""
    each = interactions.groupBy("session_id", "id").agg(F.max("dur").alias("dur"))
    w = Window.partitionBy("session_id")
    ranked = each.withColumn("rank", F.row_number().over(w.orderBy(F.desc("dur"), "id")) - 1).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("rank") == F.least(F.floor(F.col("n") / 50), F.least(F.col("n"), F.lit(1000)) - 1)).select("session_id", "n", F.col("dur").alias("latency"))


def emit_on_change(snapshots: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Snapshots that differ from the one before of their key."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("seq"))
    return snapshots.withColumn("before", before).where(~F.col(value).eqNullSafe(F.col("before")))


def benchmark_pairs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Matched runs of two arms: discordant counts and the exact test."""
    from evidentia.functions import stats

    one = runs.groupBy("arm", "bug_id", "run_index").agg(F.min_by("correct", "ordinal").alias("correct"))
    pair = one.where(F.col("arm") == a).select("bug_id", "run_index", F.col("correct").alias("x")).join(one.where(F.col("arm") == b).select("bug_id", "run_index", F.col("correct").alias("y")), ["bug_id", "run_index"])
    counts = pair.agg(F.count("*").alias("pairs"), F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(~F.col("x") & F.col("y")).alias("only_b"))
    return counts.withColumn("p_value", stats.mcnemar_exact(F.col("only_a"), F.col("only_b")))
