"""Derived views of finished sessions: timelines, windows of a finding, summaries, chains, hypotheses and what follows from them.

Tables come as DataFrames keyed by session (or by bundle, for evidence); every view is made for all keys at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X

#: Rows of a timeline and of its interactions, moments of a key timeline, values and labels of screen numbers.
TIMELINE_ROWS, INTERACTION_ROWS, MOMENTS = 80, 40, 40
NUMBER_VALUES, NUMBER_LABELS = 6, 40
CODE_LOCATIONS, CALLERS = 12, 4
#: Severities by weight; what each evidence lane adds to a score, and what an unknown one does.
SEVERITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1}
LANE_PRIOR = {"db": 0.2, "network": 0.2, "flow": 0.15, "deploys": 0.15, "env": 0.1, "browser": 0.1, "logs": 0.05, "memory": 0.05, "code": 0.05, "tickets": 0.05, "conversations": 0.05}
OTHER_PRIOR = 0.05


def _mapped(values: dict, c: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in values.items() for x in p])[c], F.lit(default))


def severity_rank(c: str = "severity") -> Column:
    return _mapped(SEVERITIES, F.col(c), 0)


def _top(rows: DataFrame, keys: list[str], order: list, most: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most)


# ---- timelines and orders


def key_timeline(events: DataFrame, summary: Column, most: int = MOMENTS) -> DataFrame:
    """session_id, t, k, summary, offset_ms: the events that have a summary, and the first and last event of the session whatever they are; by time."""
    by_file = Window.partitionBy("session_id").orderBy("seq")
    rows = events.withColumn("summary", summary).withColumn("first_seq", F.first("seq").over(by_file)).withColumn("last_seq", F.max("seq").over(Window.partitionBy("session_id"))).withColumn("start", F.first("t").over(by_file))
    # an edge is put in unless a moment of its time and kind is there already
    told = F.max(F.col("summary").isNotNull()).over(Window.partitionBy("session_id", "t", "k"))
    rows = rows.withColumn("edge", F.when(told, F.lit(None)).when(F.col("seq") == F.col("first_seq"), "first").when(F.col("seq") == F.col("last_seq"), "last"))
    rows = rows.withColumn("summary", F.coalesce("summary", F.when(F.col("edge").isNotNull(), F.concat("edge", F.lit(" recorded event ("), "k", F.lit(")"))))).where("summary IS NOT NULL")
    place = F.when(F.col("edge") == "first", -1).when(F.col("edge") == "last", 1).otherwise(0)
    return _top(rows.withColumn("__p", place), ["session_id"], ["t", "__p", "seq"], most).select("session_id", "t", "k", "summary", (F.col("t") - F.col("start")).alias("offset_ms"), "rank")


def bounded_timeline(entries: DataFrame, interaction: Column, most: int = TIMELINE_ROWS, most_interactions: int = INTERACTION_ROWS) -> DataFrame:
    """At most so many entries of a session, and of them so many interactions: the latest ones, in order of time."""
    w = Window.partitionBy("session_id", "touch").orderBy(F.desc("t"), F.desc("seq"))
    kept = entries.withColumn("touch", interaction).withColumn("__i", F.row_number().over(w)).where(~F.col("touch") | (F.col("__i") <= most_interactions))
    return _top(kept, ["session_id"], [F.desc("t"), F.desc("seq")], most, "__r").drop("__i", "__r", "touch")


def failures_first(rows: DataFrame, failed: Column, most: int) -> DataFrame:
    """At most so many rows of a session, failures before others, returned in order of time with their new place."""
    kept = _top(rows.withColumn("failed", failed), ["session_id"], [F.desc("failed"), "t", "seq"], most, "__r").drop("__r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("t", "seq")))


def linked_order(linked: DataFrame) -> DataFrame:
    """Linked requests by frontend time, backend start (0 if unknown), id."""
    w = Window.partitionBy("session_id").orderBy("f_t", F.coalesce("b_start", F.lit(0)), "request_id")
    return linked.withColumn("place", F.row_number().over(w))


def gap_order(gaps: DataFrame) -> DataFrame:
    """Gaps by the first time that is known of them, type, id."""
    at = F.coalesce("f_t", "b_start", "b_end", "b_error", F.lit(0))
    w = Window.partitionBy("session_id").orderBy(at, "type", F.coalesce("request_id", F.lit("")))
    return gaps.withColumn("place", F.row_number().over(w))


def rank_bugs(bugs: DataFrame) -> DataFrame:
    """Distinct bugs of a session, worst first, of those the last seen first."""
    return bugs.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(severity_rank()), F.desc("last_seen"), "bug_id")))


def strongest_bug(bugs: DataFrame) -> DataFrame:
    """The worst bug of each session, of those the first seen."""
    return _top(bugs, ["session_id"], [F.desc(severity_rank()), "first_seen", "bug_id"], 1, "__r").drop("__r")


# ---- the window of the top finding


def top_findings(candidates: DataFrame) -> DataFrame:
    return _top(candidates, ["session_id"], [F.desc("score"), "t", "id"], 1, "__r").select("session_id", F.col("id").alias("top_id"), F.col("request_id").alias("top_request"), "window_start", "window_end")


def linked_requests(top: DataFrame, linked: DataFrame) -> DataFrame:
    """Linked requests that are the top finding's, or began in the browser inside its window."""
    rows = linked.join(top, "session_id")
    return rows.where("request_id = top_request OR (f_t BETWEEN window_start AND window_end)").select(*[linked[c] for c in linked.columns])


def primary_window_rows(rows: DataFrame, top: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (session_id, t, request_id, ...) inside the top finding's window, or of its request or a request linked to it. Two semi joins, no OR across tables."""
    ids = top.select("session_id", F.col("top_request").alias("request_id")).where("request_id IS NOT NULL").unionByName(linked_requests(top, linked).select("session_id", "request_id")).distinct()
    inside = rows.join(top.select("session_id", "window_start", "window_end"), "session_id", "left").withColumn("inside", F.coalesce(F.col("t").between(F.col("window_start"), F.col("window_end")), F.lit(False)))
    marked = inside.join(ids.withColumn("named", F.lit(True)), ["session_id", "request_id"], "left")
    return marked.where("inside OR named").select(*rows.columns)


def causal_chains(candidates: DataFrame, roles: DataFrame) -> DataFrame:
    """For each session the chain of its top finding (root and its known symptoms), or why there is none.

    candidates(session_id, id, detector, score, t[, contended_by]), roles(session_id, id, role, root, causes).
    """
    c = candidates if "contended_by" in candidates.columns else candidates.withColumn("contended_by", F.lit(None).cast("string"))
    ranked = _top(c, ["session_id"], [F.desc("score"), "t", "id"], 1, "__r").select("session_id", F.col("id").alias("top"), F.col("detector").alias("top_detector"), "contended_by")
    role = roles.select("session_id", "id", "role", "root", "causes")
    head = ranked.join(role.withColumnRenamed("id", "top"), ["session_id", "top"], "left").withColumn("root_id", F.when(F.col("role") == "root", F.col("top")).when(F.col("role") == "symptom", F.col("root")))
    known = candidates.select("session_id", F.col("id").alias("root_id"), F.col("detector").alias("root_detector"))
    head = head.drop("role", "root", "causes").join(known, ["session_id", "root_id"], "left")
    head = head.join(role.where("role = 'root'").select("session_id", F.col("id").alias("root_id"), "causes"), ["session_id", "root_id"], "left")
    symptoms = head.select("session_id", F.posexplode("causes").alias("at", "id")).join(candidates.select("session_id", "id"), ["session_id", "id"]).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"]).alias("symptoms"))
    out = head.join(symptoms, "session_id", "left")
    absence = (
        F.when(F.col("causes").isNull() & F.col("root_detector").isNull() & F.col("contended_by").isNotNull(), "top_candidate_lost_contention")
        .when(F.col("root_detector").isNull() | F.col("causes").isNull() & F.col("symptoms").isNull() & (F.col("root_id").isNull()), "top_candidate_isolated").when(F.col("symptoms").isNull(), "root_attributed_no_symptoms")
    )
    return out.select("session_id", "top", F.when(absence.isNull(), F.col("root_id")).alias("root"), F.when(absence.isNull(), F.col("symptoms")).alias("symptoms"), absence.alias("absence"))


def causal_trees(candidates: DataFrame, roles: DataFrame) -> DataFrame:
    """Roots with at least one symptom that is itself a finding: session_id, root, symptoms in their order."""
    rows = roles.where("role = 'root'").select("session_id", F.col("id").alias("root"), F.posexplode("causes").alias("at", "id"))
    known = rows.join(candidates.select("session_id", "id"), ["session_id", "id"])
    return known.groupBy("session_id", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"]).alias("symptoms"))


# ---- summaries


def screen_numbers(shown: DataFrame, most_values: int = NUMBER_VALUES, most_labels: int = NUMBER_LABELS) -> DataFrame:
    """shown(session_id, seq, region, label, value) -> label, values (distinct, as first seen; the ends of a long list), n_values, regions; labels that moved first."""
    values = shown.where("label <> '' AND value IS NOT NULL").groupBy("session_id", "label", "value").agg(F.min("seq").alias("at"))
    # of a value only its place matters from here: first ones and the last one
    w = Window.partitionBy("session_id", "label").orderBy("at", "value")
    placed = values.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("session_id", "label")))
    kept = placed.where((F.col("i") < most_values) | (F.col("i") == F.col("n"))).groupBy("session_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda v: v["value"]).alias("values"), F.max("n").alias("n_values"), F.min("at").alias("at"))
    regions = shown.where("region <> ''").groupBy("session_id", "label").agg(F.array_sort(F.collect_set("region")).alias("regions"))
    joined = kept.join(regions, ["session_id", "label"], "left")
    return _top(joined, ["session_id"], [F.desc(F.size("values")), "at", "label"], most_labels, "place").drop("at")


def first_error_times(events: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Earliest of a session's errors, failed answers, transport failures and back-end errors, and of other times given as more(session_id, t)."""
    bad = events.where("k IN ('err', 'rej', 'net.err', 'backend.req.error', 'backend.uncaught') OR (k = 'net.res' AND st >= 400)").select("session_id", "t")
    return (bad if more is None else bad.unionByName(more.select("session_id", "t"))).groupBy("session_id").agg(F.min("t").alias("first_error"))


def boundary_summary(events: DataFrame, decision: Column) -> DataFrame:
    """Tab boundaries of a session: how many of each decision, and the last one."""
    rows = events.where("k = 'tab.boundary'").withColumn("decision", F.coalesce(decision, F.lit("unknown")))
    counts = rows.groupBy("session_id", "decision").agg(F.count("*").alias("n"))
    last = rows.groupBy("session_id").agg(F.max_by("decision", "seq").alias("last"))
    return counts.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("decision", "n")))).alias("decisions"), F.sum("n").alias("n")).join(last, "session_id")


def probe_summary(events: DataFrame) -> DataFrame:
    """Page probes: how many were ready and failed, and whether the last word is good."""
    rows = events.where("k IN ('probe.ready', 'probe.error')")
    return rows.groupBy("session_id").agg(F.count_if(F.col("k") == "probe.ready").alias("ready"), F.count_if(F.col("k") == "probe.error").alias("failed"), (F.max_by("k", "seq") == "probe.ready").alias("working"))


def redaction_summary(fields: DataFrame) -> DataFrame:
    """fields(session_id, action, reason, path) of redaction metadata -> counts of each action and reason, and of distinct paths."""
    return fields.groupBy("session_id", "action", "reason").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


def storage_summary(snapshots: DataFrame) -> DataFrame:
    """snapshots(session_id, seq, area, items map) -> keys of the first snapshot of each area."""
    g = snapshots.groupBy("session_id", "area").agg(F.min_by("items", "seq").alias("items"))
    return g.select("session_id", "area", F.size(F.map_keys("items")).alias("n_keys"))


def truncation_summary(rows: DataFrame, most: int = 100, samples: int = 3) -> DataFrame:
    """Row changes of one statement beyond what is kept: emitted, truncated, and the first keys of those left out."""
    w = Window.partitionBy("session_id", "request_id", "table", "op").orderBy("seq")
    placed = rows.withColumn("i", F.row_number().over(w))
    left = placed.where((F.col("i") > most) & (F.col("i") <= most + samples)).groupBy("session_id", "request_id", "table", "op").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pk"))), lambda x: x["pk"]).alias("sample_keys"))
    counts = placed.groupBy("session_id", "request_id", "table", "op").agg(F.least(F.max("i"), F.lit(most)).alias("emitted"), F.greatest(F.max("i") - most, F.lit(0)).alias("truncated"))
    return counts.where("truncated > 0").join(left, ["session_id", "request_id", "table", "op"], "left")


def session_inspection(events: DataFrame) -> DataFrame:
    """Counts and presence flags of a session, to tell what was captured."""
    has = lambda condition: F.coalesce(F.bool_or(F.expr(condition)), F.lit(False))
    return events.groupBy("session_id").agg(
        F.count("*").alias("events"), F.countDistinct("k").alias("kinds"), (F.max("t") - F.min("t")).alias("span_ms"), has("k LIKE 'net.%'").alias("has_network"), has("k LIKE 'backend.%'").alias("has_backend"),
        has("k LIKE 'db.%'").alias("has_db"), has("k IN ('clk', 'inp', 'nav')").alias("has_interactions"), has("k = 'env'").alias("has_environment"), has("k = 'capture.gap'").alias("has_gaps"))


# ---- recall


def bug_tables(bugs: DataFrame, diffs: DataFrame) -> DataFrame:
    """Database tables of each bug: of row changes of its requests, and of those that name no request. bugs(session_id, bug_id, request_ids)."""
    own = bugs.select("session_id", "bug_id", F.explode("request_ids").alias("request_id")).join(diffs.where("request_id IS NOT NULL").select("session_id", "request_id", "table").distinct(), ["session_id", "request_id"]).select("session_id", "bug_id", "table")
    free = bugs.select("session_id", "bug_id").join(diffs.where("request_id IS NULL").select("session_id", "table").distinct(), "session_id").select("session_id", "bug_id", "table")
    return own.unionByName(free).groupBy("session_id", "bug_id").agg(F.array_sort(F.collect_set("table")).alias("tables"))


def duplicates_by_signature(bugs: DataFrame, wanted: DataFrame, limit: int = 50) -> DataFrame:
    """The first bug (by session, then id) of each wanted signature: equality only, no score. bugs(session_id, bug_id, signature, ...), wanted(signature)."""
    hit = bugs.where("signature <> ''").join(wanted.where("signature <> ''").select("signature").distinct(), "signature", "left_semi")
    first = hit.groupBy("signature").agg(F.min(F.struct("session_id", "bug_id")).alias("f"), F.count("*").alias("seen"))
    return first.select("signature", "f.session_id", "f.bug_id", "seen", F.lit("signature").alias("via")).orderBy("session_id", "bug_id").limit(limit)


def best_per_signature(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The best match of each signature, and every match without one."""
    keys = keys or []
    named = scored.where("signature IS NOT NULL")
    return _top(named, [*keys, "signature"], [F.desc("score"), "session_id", "bug_id"], 1, "__r").drop("__r").unionByName(scored.where("signature IS NULL"))


def prevalence_rows(bugs: DataFrame, prevalence: DataFrame) -> DataFrame:
    """One row for each detector of a session's bugs, in the order of the bugs, with how common the detector is (0 where unknown)."""
    first = bugs.groupBy("session_id", "detector").agg(F.min("place").alias("place"))
    return first.join(prevalence.select("detector", "share"), "detector", "left").select("session_id", "detector", F.row_number().over(Window.partitionBy("session_id").orderBy("place")).alias("place"), F.coalesce("share", F.lit(0.0)).alias("share"))


def precedents(queries: DataFrame, scored: DataFrame, duplicates: DataFrame, most: int = 5) -> DataFrame:
    """Two sections for a session's strongest bug: near ones by score, and equal ones; a duplicate is no precedent again."""
    near = scored.join(duplicates.select("signature").distinct(), "signature", "left_anti") if "signature" in scored.columns else scored
    near = _top(near.join(queries.select("query_session"), "query_session", "left_semi"), ["query_session"], [F.desc("score"), "bug_id"], most).select("query_session", F.lit("precedent").alias("section"), "bug_id", "score")
    equal = duplicates.select("query_session", F.lit("duplicate").alias("section"), "bug_id", F.lit(None).cast("double").alias("score"))
    return near.unionByName(equal)


def located_evidence(outcomes: DataFrame, ranked: DataFrame, candidates: int = 3) -> DataFrame:
    """outcomes(incident, outcome, session_id), ranked(incident, session_id, confidence): a match is evidence, anything else a gap with the best candidates if several fit."""
    best = _top(ranked, ["incident"], [F.desc("confidence"), "session_id"], candidates).groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "session_id"))), lambda r: r["session_id"]).alias("candidates"))
    joined = outcomes.join(best, "incident", "left")
    matched = F.col("outcome") == "matched"
    return joined.select("incident", F.when(matched, "evidence").otherwise("gap").alias("kind"), F.when(matched, F.col("session_id")).alias("session_id"), F.when(~matched, F.col("outcome")).alias("reason"), F.when(F.col("outcome") == "ambiguous", F.col("candidates")).alias("candidates"))


# ---- code locations


def request_callsites(diffs: DataFrame, requests: DataFrame) -> DataFrame:
    """session_id, request_id, via, file, line: the first callsite of each request in the database, and in the browser. Both take (session_id, seq, request_id, file, line)."""
    first = lambda rows, via: rows.where("request_id IS NOT NULL AND file IS NOT NULL").groupBy("session_id", "request_id").agg(F.min_by(F.struct("file", "line"), "seq").alias("c")).select("session_id", "request_id", F.lit(via).alias("via"), "c.file", "c.line")
    return first(diffs, "db").unionByName(first(requests, "client"))


def code_locations(candidates: DataFrame, callsites: DataFrame, most: int = CODE_LOCATIONS) -> DataFrame:
    """Locations of the ranked findings: server before client line of each, no location twice, so many in all. candidates(session_id, id, place, request_id)."""
    rows = candidates.join(callsites, ["session_id", "request_id"]).withColumn("side", F.when(F.col("via") == "db", 0).otherwise(1))
    first = rows.groupBy("session_id", "file", "line").agg(F.min(F.struct("place", "side", "via", "id")).alias("f"))
    return _top(first.select("session_id", "file", "line", "f.*"), ["session_id"], ["place", "side", "file", "line"], most).select("session_id", "rank", "file", "line", "via", F.col("id").alias("signal_id"))


# ---- evidence bundles


def evidence_relevance(items: DataFrame, symptoms: DataFrame) -> DataFrame:
    """items(bundle, idx, lane, kind, brief, sig), symptoms(bundle, title, description, url): `score` in [0, 1] and `rank`, ties in given order; nothing is dropped."""
    said = X.tokens(F.concat_ws(" ", "title", "description"))
    told = X.tokens(F.concat_ws(" ", "brief", "kind"))
    hay = F.lower(F.concat_ws(" ", F.coalesce("sig", F.lit("")), "brief"))
    url = F.when((F.col("url") != "") & hay.contains(F.lower("url")), 0.5).otherwise(0.0)
    score = F.least(F.lit(1.0), url + 0.3 * X.jaccard(said, told) + _mapped(LANE_PRIOR, F.col("lane"), OTHER_PRIOR))
    scored = items.join(symptoms, "bundle").withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("bundle").orderBy(F.desc("score"), "idx"))).select("bundle", "idx", "lane", "score", "rank")


#: Kinds of hypotheses in the order they are made, with the lanes they rest on and how sure they are.
HYPOTHESES = ("intentional-change", "regression", "environment", "client-side", "latent", "inconclusive")


def hypotheses(bundles: DataFrame, items: DataFrame, explained: DataFrame) -> DataFrame:
    """bundles(bundle, title), items(bundle, idx, id, lane), explained(bundle, id): advisory hypotheses by confidence, with the evidence of each.

    What a deliberate commit explains is a change of its own and never counts as a regression.
    """
    marked = items.join(explained.select("bundle", "id").distinct().withColumn("why", F.lit(True)), ["bundle", "id"], "left")
    open_ = F.col("why").isNull()
    ids = lambda condition: F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("idx", "id")))), lambda x: x["id"])
    lanes = marked.groupBy("bundle").agg(
        F.count("*").alias("n"), ids(open_ & F.col("lane").isin("network", "db", "flow")).alias("regression"), ids(open_ & (F.col("lane") == "env")).alias("environment"), ids(open_ & (F.col("lane") == "browser")).alias("client"))
    all_ = bundles.join(lanes, "bundle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    none = F.array().cast("array<string>")
    rows = F.array(
        F.struct(F.lit(1).alias("place"), F.lit("regression").alias("kind"), F.least(F.lit(0.9), 0.4 + 0.1 * F.size("regression")).alias("confidence"), F.coalesce("regression", none).alias("evidence")),
        F.struct(F.lit(2).alias("place"), F.lit("environment").alias("kind"), F.lit(0.5).alias("confidence"), F.coalesce("environment", none).alias("evidence")),
        F.struct(F.lit(3).alias("place"), F.lit("client-side").alias("kind"), F.lit(0.5).alias("confidence"), F.coalesce("client", none).alias("evidence")))
    by_lane = all_.select("bundle", F.explode(rows).alias("h")).select("bundle", "h.*").where(F.size("evidence") > 0)
    meant = marked.where("why").select("bundle", F.lit(0).alias("place"), F.lit("intentional-change").alias("kind"), F.lit(0.7).alias("confidence"), F.array("id").alias("evidence"))
    latent = all_.where((F.col("n") == 0) & (F.trim("title") != "")).select("bundle", F.lit(4).alias("place"), F.lit("latent").alias("kind"), F.lit(0.3).alias("confidence"), none.alias("evidence"))
    some = meant.unionByName(by_lane).unionByName(latent)
    rest = bundles.join(some.select("bundle").distinct(), "bundle", "left_anti").select("bundle", F.lit(5).alias("place"), F.lit("inconclusive").alias("kind"), F.lit(0.2).alias("confidence"), none.alias("evidence"))
    order = Window.partitionBy("bundle").orderBy(F.desc("confidence"), "place", "evidence")
    return some.unionByName(rest).withColumn("rank", F.row_number().over(order)).drop("place")


def verifications(found: DataFrame, items: DataFrame) -> DataFrame:
    """What would show that a hypothesis is dealt with: for each piece of evidence that it cites and that names a row, a request or a signature."""
    cited = found.where("kind <> 'inconclusive'").select("bundle", "kind", F.explode("evidence").alias("id")).join(items.select("bundle", "id", "lane", "table", "pk", "request_id", "sig"), ["bundle", "id"])
    row = (F.col("lane") == "db") & F.col("table").isNotNull() & (F.coalesce("pk", F.lit("{}")) != "{}")
    how = F.when(row, "db").when(F.col("request_id").isNotNull(), "request").when(F.col("sig").isNotNull(), "session")
    return cited.withColumn("how", how).where("how IS NOT NULL").select("bundle", "kind", "id", "how")


def escalations(found: DataFrame, completeness: DataFrame) -> DataFrame:
    """A human is called where context is thin or no hypothesis stands out. completeness(bundle, level)."""
    lost = found.groupBy("bundle").agg(F.bool_and(F.col("kind") == "inconclusive").alias("lost"))
    return completeness.join(lost, "bundle", "left").select("bundle", ((F.col("level") == "low") | F.coalesce("lost", F.lit(False))).alias("recommended"))


def capsule_identity(bundles: DataFrame) -> DataFrame:
    """bundles(bundle, title, url, source, release, error_sig, located) -> signature (given, else a hash of the symptom's stable text) and canonical id."""
    known = lambda c: F.nullif(F.col(c), F.lit(""))
    signature = F.coalesce(F.nullif(F.trim("error_sig"), F.lit("")), F.concat(F.lit("sig_"), X.fnv1a_base36(F.concat_ws("|", known("title"), known("url"), known("source"), known("release")))))
    return bundles.select("bundle", signature.alias("signature"), F.coalesce(known("located"), signature).alias("canonical_id"))


def topology_fidelity(expected: DataFrame, observed: DataFrame, gaps: DataFrame, cases: DataFrame) -> DataFrame:
    """Grade of each case: full, partial, gapped, or an error where rows were lost without a word.

    expected, observed(case, row, n): multisets of row images; gaps(case, surface, reason, required); cases(case, action_t, request_t, first_row_t, complete).
    """
    both = expected.select("case", "row", F.col("n").alias("want")).join(observed.select("case", "row", F.col("n").alias("got")), ["case", "row"], "full_outer")
    exact = both.groupBy("case").agg(F.bool_and(F.coalesce("want", F.lit(0)) == F.coalesce("got", F.lit(0))).alias("exact"))
    silent = gaps.groupBy("case").agg(F.count_if("emitted").alias("emitted"), F.count_if("required").alias("required"), F.count_if(F.col("required") & ~F.col("emitted")).alias("missing"))
    c = cases.join(exact, "case", "left").join(silent, "case", "left").fillna({"exact": True, "emitted": 0, "required": 0, "missing": 0})
    joined = F.col("exact") & F.coalesce((F.col("action_t") < F.col("request_t")) & (F.coalesce("first_row_t", F.col("request_t") + 1) > F.col("request_t")), F.lit(False))
    grade = (
        F.when((F.col("missing") > 0) | ((F.col("required") > 0) & joined), "error").when(F.col("required") > 0, "gapped").when(joined & F.col("complete"), "full")
        .when(~joined & (F.col("emitted") == 0), "error").when(~joined | (F.col("emitted") > 0), "gapped").otherwise("partial")
    )
    return c.select("case", grade.alias("grade"))


# ---- correlation at the source


def resolve_correlation(requests: DataFrame) -> DataFrame:
    """requests(option_session, option_request, header_session, header_request, traceparent, generated) -> ids, their sources, a status, and the reason of a gap if there is one."""
    plain = lambda c: X.valid_correlation_id(F.col(c))
    trace, _ = X.traceparent(F.col("traceparent"))
    session = F.coalesce(plain("option_session"), plain("header_session"))
    raw = F.coalesce(plain("option_request"), plain("header_request"), trace)
    status = F.when(session.isNotNull() & raw.isNotNull(), "linked").when(session.isNotNull(), "generated-request-id").when(raw.isNotNull(), "missing-session").otherwise("missing-session-and-request-id")
    stripped = F.col("header_session").isNull() & F.col("header_request").isNull()
    return requests.select(
        "*", session.alias("session_id"), F.coalesce(raw, "generated").alias("request_id"), F.when(plain("option_session").isNotNull(), "option").when(session.isNotNull(), "header").otherwise("missing").alias("session_source"),
        F.when(plain("option_request").isNotNull(), "option").when(plain("header_request").isNotNull(), "header").when(trace.isNotNull(), "traceparent").otherwise("generated").alias("request_source"), status.alias("status"),
        F.when(trace.isNotNull() & session.isNull(), F.when(stripped, "header_stripped").otherwise("missing_session_id")).alias("gap"))


#: Longest detail of a gap.
GAP_DETAIL = 120


def gap_events(gaps: DataFrame) -> DataFrame:
    """gaps(session_id, t, surface, reason, detail, request_id, dropped, started) -> rows of kind capture.gap with bounded, redacted details and counts that are none below zero."""
    detail = F.nullif(F.substring(F.trim(F.regexp_replace(X.redact(F.col("detail")), r"\s+", " ")), 1, GAP_DETAIL), F.lit(""))
    return gaps.select(
        "session_id", F.round("t").cast("long").alias("t"), F.lit("capture.gap").alias("k"), "surface", "reason", detail.alias("detail"), X.valid_correlation_id(F.col("request_id")).alias("request_id"),
        F.when(F.col("dropped") >= 0, F.floor("dropped")).alias("dropped"), F.greatest(F.lit(0), F.round("t").cast("long") - F.col("started")).alias("offset_ms"))


def environment_deltas(snapshots: DataFrame) -> DataFrame:
    """snapshots(session_id, seq, values map) -> what each changes against all before it: key, value, change (set, changed); a delta leaves other keys as they are."""
    rows = snapshots.select("session_id", "seq", F.explode("values").alias("key", "value"))
    before = F.lag("value").over(Window.partitionBy("session_id", "key").orderBy("seq"))
    first = F.row_number().over(Window.partitionBy("session_id", "key").orderBy("seq")) == 1
    out = rows.withColumn("before", before).withColumn("change", F.when(first, "set").when(~F.col("before").eqNullSafe(F.col("value")), "changed"))
    return out.where("change IS NOT NULL").select("session_id", "seq", "key", "before", "value", "change")


def missing_classes(expected: DataFrame, results: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(classes of which no result is there, ids with fewer than `least` runs). expected(id, class), results(id, run)."""
    runs = results.groupBy("id").agg(F.countDistinct("run").alias("runs"))
    have = expected.join(runs, "id", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    seen = have.where("runs > 0").select("class").distinct()
    return expected.select("class").distinct().join(seen, "class", "left_anti"), have.where(F.col("runs") < least).select("id", "class", "runs")


def kind_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Kinds of either side, with whether each has it."""
    left, right = (x.select("k").distinct() for x in (a, b))
    return left.withColumn("a", F.lit(True)).join(right.withColumn("b", F.lit(True)), "k", "full_outer").select("k", F.coalesce("a", F.lit(False)).alias("in_a"), F.coalesce("b", F.lit(False)).alias("in_b"))
