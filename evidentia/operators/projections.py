"""Typed projections of raw events and the predicates over them.

Input everywhere: events(session_id, seq, t, k, d VARIANT) with the hot fields of `sources.telemetry.promote`; `seq` is file order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.joins import range_join

#: Phrasings of a failed fetch, its reach back in time and in failures.
NETWORK_FAILURE_MESSAGE = r"(?i)failed to fetch|networkerror|network error|load failed|network request failed|fetch failed"
REJECTION_WINDOW_MS, RECENT_FAILURES = 2000, 20
#: Known database engines, the first being what is meant where none is named.
ENGINES = ("postgres", "mysql", "mssql", "sqlite")
#: Rows of a view, longest shape.
MOST_ROWS, MOST_SHAPE = 200, 400
READS_PER_STATEMENT, READS_PER_REQUEST = 25, 100


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("d", f"$.{path}", kind)


def _first(value: Column, where: Column | None = None) -> Column:
    """First known value in file order."""
    held = value if where is None else F.when(where, value)
    return F.min_by(held, F.when(held.isNotNull(), F.col("seq")))


def _last(value: Column, where: Column) -> Column:
    held = F.when(where, value)
    return F.max_by(held, F.when(held.isNotNull(), F.col("seq")))


def _earliest(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """At most so many rows of each session, by time."""
    w = Window.partitionBy("session_id").orderBy("t", "seq")
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


# ---- failures of an answer


def _candidates(text: str) -> Iterator[str]:
    """Stretches of a text that may be JSON: the whole, its lines without a framing number, and from a line's first brace."""
    text = text.strip()
    if text[:1] in ("{", "["):
        yield text
    for line in re.split(r"\r?\n", text):
        framed = re.match(r"\d+:(.*)$", line.strip())
        chunk = (framed[1] if framed else line).strip()
        if chunk[:1] in ("{", "["):
            yield chunk
        if "{" in chunk:
            yield chunk[chunk.index("{"):]


def _failing(value) -> dict | None:
    """The first object, outermost first, that says it failed; texts within are read as JSON where they can be."""
    waiting = [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, str):
            parsed = []
            for c in dict.fromkeys(_candidates(v)):
                try:
                    parsed.append(json.loads(c))
                except ValueError:
                    continue
            waiting += reversed(parsed)
        elif isinstance(v, list):
            waiting += reversed(v)
        elif isinstance(v, dict):
            if v.get("ok") is False or v.get("status") == "failed":
                return v
            waiting += reversed(list(v.values()))
    return None


def _failure(bodies: pd.Series) -> pd.DataFrame:
    found = [_failing(json.loads(b)) if b else None for b in bodies]
    text = lambda f, key: f[key] if f and isinstance(f.get(key), str) else None
    return pd.DataFrame([(text(f, "code"), text(f, "message"), text(f, "phase"), f is not None) for f in found], columns=["code", "message", "phase", "failed"])


def application_failures(events: DataFrame) -> DataFrame:
    """Answers that report a failure in their body, at any depth: session_id, seq, t, id, st, code, message, phase. A reference to an earlier body says nothing."""
    body = F.when(F.coalesce(get("body.dedup", "boolean"), F.lit(False)), F.lit(None)).otherwise(F.to_json(get("body", "variant")))
    # texts that could hold either sign; all others need no parse
    may = body.rlike(r'(?s)ok\\*"\s*:\s*false') | body.rlike(r'(?s)status\\*"\s*:\s*\\*"failed')
    rows = events.where("k = 'net.res'").withColumn("body", body).where(may).withColumn("f", F.pandas_udf(_failure, "code string, message string, phase string, failed boolean")("body")).where("f.failed")
    return rows.select("session_id", "seq", "t", "id", "st", "f.code", "f.message", "f.phase")


def failed_responses(events: DataFrame) -> DataFrame:
    """Answers with a failing status or a failing body: session_id, seq, t, id, st, url, by_body."""
    failing = application_failures(events).select("session_id", "seq", F.lit(True).alias("by_body"))
    rows = events.where("k = 'net.res'").select("session_id", "seq", "t", "id", "st", "url").join(failing, ["session_id", "seq"], "left")
    return rows.where("st >= 400 OR by_body").withColumn("by_body", F.coalesce("by_body", F.lit(False)))


def causal_failed(k: str = "k") -> Column:
    """The looser test of the causal graph: a failing status, or a body that says ok = false or names an error or a code."""
    text = get("body", "variant")
    parsed = F.coalesce(F.try_parse_json(F.try_variant_get(text, "$", "string")), text)
    named = [F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == "STRING" for name in ("error", "code")]
    bad_body = F.coalesce(F.try_variant_get(parsed, "$.ok", "boolean") == F.lit(False), F.lit(False)) | F.coalesce(named[0], F.lit(False)) | F.coalesce(named[1], F.lit(False))
    return (F.col(k) == "net.res") & (F.coalesce(F.col("st") >= 400, F.lit(False)) | bad_body)


def countable_network_failure() -> Column:
    """A transport failure that is no routine cancellation and comes from a trusted place."""
    unlike = lambda path, value: F.coalesce(get(path), F.lit("")) != value
    return (F.col("k") == "net.err") & unlike("name", "AbortError") & unlike("source", "page-probe") & unlike("evidenceTrust", "page-world-untrusted")


def http_status_of_span() -> Column:
    return F.coalesce(get("attributes['http.response.status_code']", "double"), get("attributes['http.status_code']", "double"))


def high_severity() -> Column:
    """Events that alone are worth an immediate look."""
    k, st = F.col("k"), F.col("st")
    body = F.to_json(get("body", "variant"))
    marker = body.rlike(r'(?s)ok\\*"\s*:\s*false') | body.rlike(r'(?s)status\\*"\s*:\s*\\*"failed')
    code = F.coalesce(get("statusCode", "double"), get("error.statusCode", "double"), F.lit(0.0))
    level = F.upper(F.coalesce(get("severityText"), F.lit("")))
    return (
        k.isin("err", "rej", "net.err", "backend.req.error", "backend.uncaught")
        | ((k == "net.res") & F.coalesce((st >= 500) | (st.between(200, 299) & marker), F.lit(False)))
        | ((k == "backend.req.end") & (code >= 500))
        | ((k == "backend.otel.span") & ((F.coalesce(get("statusCode"), F.lit("")) == "ERROR") | (F.coalesce(http_status_of_span(), F.lit(0.0)) >= 500)))
        | ((k == "backend.otel.log") & ((F.coalesce(get("severityNumber", "double"), F.lit(0.0)) >= 17) | level.isin("ERROR", "FATAL")))
    )


def rejection_causes(events: DataFrame) -> DataFrame:
    """Rejections and errors that name no URL and read like a failed fetch, with the newest transport failure within reach before them.

    session_id, seq, t, cause_seq, cause_t, url, wait_ms. Only the last failures of the session count.
    """
    order = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.where("k IN ('net.err', 'err', 'rej')").withColumn("failure", countable_network_failure()).withColumn("n", F.count_if("failure").over(order))
    effects = rows.where(F.col("k").isin("err", "rej") & get("url").isNull() & F.coalesce("msg", F.lit("")).rlike(NETWORK_FAILURE_MESSAGE)).select("session_id", "seq", "t", "n")
    causes = rows.where("failure").select("session_id", F.col("seq").alias("cause_seq"), F.col("t").alias("cause_t"), F.col("n").alias("cause_n"), "url")
    met = range_join(effects, causes, ["session_id"], "t", "cause_t", REJECTION_WINDOW_MS, 0).where(F.expr(f"cause_seq < seq AND cause_n > n - {RECENT_FAILURES}"))
    newest = met.groupBy("session_id", "seq", "t").agg(F.max(F.struct("cause_seq", "cause_t", "url")).alias("c"))
    return newest.select("session_id", "seq", "t", "c.*", (F.col("t") - F.col("c.cause_t")).alias("wait_ms"))


# ---- back end


def backend_requests(events: DataFrame) -> DataFrame:
    """One row a request: the first known value of each field in file order; an end's status and duration replace others."""
    e = events.where(F.col("k").isin("backend.req.start", "backend.req.end", "backend.req.error", "backend.uncaught", "backend.otel.span"))
    e = e.withColumn("rid", F.coalesce("request_id", get("traceId"))).where("rid IS NOT NULL")
    span, end = F.col("k") == "backend.otel.span", F.col("k") == "backend.req.end"
    status = F.coalesce(get("statusCode", "int"), http_status_of_span().cast("int"))
    took = F.when(get("durationMs", "double") >= 0, get("durationMs", "double"))
    failing = F.col("k").isin("backend.req.error", "backend.uncaught") | (span & (F.coalesce(get("statusCode"), F.lit("")) == "ERROR"))
    message = F.when(span, F.coalesce(get("statusMessage"), get("name"))).otherwise(F.coalesce(get("error.message"), get("error.name")))
    return e.groupBy("session_id", F.col("rid").alias("request_id")).agg(
        F.upper(_first(get("method"))).alias("method"), _first(F.col("url")).alias("url"), _first(get("pathname")).alias("pathname"), _first(F.coalesce(get("route"), F.when(span, get("name")))).alias("route"),
        F.coalesce(_last(status, end), _first(status, ~end)).alias("status"), F.coalesce(_last(took, end), _first(took, ~end)).alias("duration_ms"),
        _first(F.coalesce(get("correlation.requestIdSource"), F.when(span, F.lit("otlp-trace-id")))).alias("request_id_source"),
        _first(F.col("t"), F.col("k").isin("backend.req.start", "backend.otel.span")).alias("start_t"), _first(F.col("t"), end).alias("end_t"), _first(F.col("t"), failing).alias("error_t"), _first(message, failing).alias("error"))


def graphql_identity(body: Column) -> Column:
    """struct<op, name, batch> of a GraphQL request body, null for other bodies. A persisted document's operation is unknown, not guessed."""
    parsed = F.try_parse_json(body)
    batch = F.size(F.try_variant_get(parsed, "$", "array<variant>"))

    def one(v: Column) -> Column:
        at = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
        textual = lambda path: F.schema_of_variant(at(path, "variant")) == "STRING"
        name = F.when(textual("operationName") & (F.length(at("operationName")) > 0), F.substring(at("operationName"), 1, 120))
        document = F.when(textual("query"), at("query")).when(textual("operationName") & at("extensions", "variant").isNotNull(), F.lit(""))
        bare = F.regexp_replace(document, r"^(?:\s|,|﻿|#[^\n]*(?:\n|$))+", "")
        op = F.regexp_extract(bare, r"^(query|mutation|subscription)\b\s*([_A-Za-z][_0-9A-Za-z]*)?", 1)
        said = F.nullif(F.regexp_extract(bare, r"^(query|mutation|subscription)\b\s*([_A-Za-z][_0-9A-Za-z]*)?", 2), F.lit(""))
        kind = F.when(op != "", op).when(bare.startswith("{"), "query").when((document == "") & name.isNotNull(), "unknown")
        return F.when(kind.isNotNull(), F.struct(kind.alias("op"), F.coalesce(name, F.when(op != "", F.substring(said, 1, 120))).alias("name")))

    entries = F.transform(F.try_variant_get(parsed, "$", "array<variant>"), one)
    first = F.try_element_at(F.filter(entries, lambda x: x.isNotNull()), F.lit(1))
    single = one(parsed)
    found = F.when(batch >= 0, first).otherwise(single)
    return F.when(found.isNotNull(), F.struct(found["op"].alias("op"), found["name"].alias("name"), F.when(batch >= 0, batch).alias("batch")))


# ---- what two sessions are compared by


def network_calls(events: DataFrame) -> DataFrame:
    """session_id, seq, t (of the request, if known), method, route, st, dur, request_id of every answer."""
    from evidentia.functions.text import route

    before = Window.partitionBy("session_id", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    req = F.last(F.when(F.col("k") == "net.req", F.struct("t", F.coalesce("method", get("m")).alias("method"), "url", "request_id")), ignorenulls=True).over(before)
    rows = events.where("k IN ('net.req', 'net.res')").withColumn("r", req).where("k = 'net.res'")
    return rows.select(
        "session_id", "seq", F.coalesce("r.t", "t").alias("t"), F.upper(F.coalesce("r.method", F.lit("GET"))).alias("method"), route(F.coalesce("r.url", F.lit(""))).alias("route"),
        F.coalesce("st", get("status", "int"), get("statusCode", "int"), F.lit(0)).alias("st"), F.when(F.col("dur") >= 0, F.col("dur")).alias("dur"), F.coalesce("r.request_id", "request_id").alias("request_id"))


def engine() -> Column:
    return F.when(get("engine").isin(*ENGINES), get("engine")).otherwise(ENGINES[0])


def db_writes(events: DataFrame) -> DataFrame:
    return events.where("k = 'db.diff'").select(
        "session_id", "seq", "t", engine().alias("engine"), F.when(F.col("op").isin("update", "delete"), F.col("op")).otherwise("insert").alias("op"), F.coalesce("table", F.lit("unknown")).alias("table"),
        F.to_json(get("pk", "variant")).alias("pk"), F.to_json(get("before", "variant")).alias("before"), F.to_json(get("after", "variant")).alias("after"), F.coalesce("request_id", F.lit("")).alias("request_id"))


def environment(events: DataFrame) -> DataFrame:
    """session_id, key, value (JSON): the last value of every key in file order; the members of `flags` and `config` are keys of their own."""
    rows = events.where("k = 'env'").select("session_id", "seq", F.to_json("d").alias("j"))
    top = rows.select("session_id", "seq", F.explode(F.from_json("j", "map<string,string>")).alias("key", "value")).where("key NOT IN ('kind', 'redaction')")
    nested = F.col("key").isin("flags", "config")
    inner = top.where(nested).select("session_id", "seq", F.col("key").alias("of"), F.explode(F.from_json("value", "map<string,string>")).alias("name", "value")).select("session_id", "seq", F.concat_ws(".", "of", "name").alias("key"), "value")
    every = top.where(~nested).unionByName(inner)
    return every.groupBy("session_id", "key").agg(F.max_by("value", "seq").alias("value"))


#: Other names of a release and a build, in order of trust.
RELEASE_KEYS, BUILD_KEYS = ("release", "releaseId", "version"), ("build", "buildId", "commit", "sha")


def release_and_build(env: DataFrame) -> DataFrame:
    """session_id, release, build: the first name of each that the environment knows."""
    named = lambda keys: F.coalesce(*[F.max(F.when(F.col("key") == key, F.col("value"))) for key in keys])
    return env.groupBy("session_id").agg(named(RELEASE_KEYS).alias("release"), named(BUILD_KEYS).alias("build"))


#: Plane of a divergence -> lane of the evidence it is.
PLANE_LANES = {"flow": "ui", "network": "network", "db": "db", "env": "env"}


def divergences_to_evidence(divergences: DataFrame, lanes: dict[str, str] | None = None) -> DataFrame:
    """idx, plane, kind, brief, sig, request_id, table -> id, lane, kind, brief and the reference."""
    lane = F.create_map(*[F.lit(x) for p in (lanes or PLANE_LANES).items() for x in p])[F.col("plane")]
    about = F.coalesce("sig", "request_id", "table", F.col("idx").cast("string"))
    ident = F.concat(F.concat_ws(":", "plane", "kind", about), F.lit("#"), F.col("idx").cast("string"))
    return divergences.select(ident.alias("id"), lane.alias("lane"), "kind", "brief", "sig", "request_id", "table")


def comparison_confidence(divergences: DataFrame) -> DataFrame:
    """pair -> high where rows, flow or environment differ or nothing does, medium where a status does, else low. pairs(pair) come with a null plane if nothing differs."""
    strong = F.col("plane").isin("db", "flow", "env")
    g = divergences.groupBy("pair").agg(F.count("plane").alias("n"), F.count_if(strong).alias("strong"), F.count_if(F.col("kind") == "net.status").alias("status"))
    return g.select("pair", F.when((F.col("n") == 0) | (F.col("strong") > 0), "high").when(F.col("status") > 0, "medium").otherwise("low").alias("confidence"))


# ---- database and other planes


def _shape() -> Column:
    return F.nullif(F.substring(F.trim(get("shape")), 1, MOST_SHAPE), F.lit(""))


def db_reads(events: DataFrame) -> DataFrame:
    row = get("row", "variant")
    rows = events.where("k = 'db.read' AND table <> ''").where(row.isNotNull())
    return _earliest(rows.select("session_id", "seq", "t", engine().alias("engine"), "table", F.to_json(get("pk", "variant")).alias("pk"), F.to_json(row).alias("row"), _shape().alias("shape"), "request_id"))


def db_statements(events: DataFrame) -> DataFrame:
    rows = events.where("k = 'db.statement'").withColumn("shape", _shape()).where("shape IS NOT NULL")
    return _earliest(rows.select("session_id", "seq", "t", engine().alias("engine"), F.coalesce("op", F.lit("other")).alias("op"), "table", "shape", get("rowCount", "long").alias("row_count"), "request_id"))


def db_errors(events: DataFrame) -> DataFrame:
    rows = events.where("k = 'db.error'").withColumn("shape", _shape()).where("shape IS NOT NULL")
    return _earliest(rows.select("session_id", "seq", "t", engine().alias("engine"), F.coalesce("op", F.lit("other")).alias("op"), "table", "shape", get("code").alias("code"), F.coalesce(get("errorName"), F.lit("UnknownError")).alias("error_name"), "request_id"))


def db_activity(events: DataFrame) -> DataFrame:
    """Spans that name a data store, an operation on it or a statement."""
    either = lambda a, b: F.coalesce(get(f"attributes['{a}']"), get(f"attributes['{b}']"))
    rows = events.where("k = 'backend.otel.span'").select(
        "session_id", "seq", "t", either("db.system", "db.name").alias("system"), either("db.operation", "db.operation.name").alias("operation"), either("db.statement", "db.query.text").alias("statement"),
        get("name").alias("span_name"), get("serviceName").alias("service"), F.coalesce(get("traceId"), "request_id").alias("request_id"))
    return _earliest(rows.where("system IS NOT NULL OR operation IS NOT NULL OR statement IS NOT NULL"))


#: Fields of an outbound call that have columns of their own or only carry it.
TRANSPORT_FIELDS = ("service", "operation", "method", "url", "status", "durationMs", "error", "requestId", "sessionId", "kind")


def outbound_calls(events: DataFrame) -> DataFrame:
    detail = F.map_filter(F.from_json(F.to_json("d"), "map<string,string>"), lambda k, v: ~k.isin(*TRANSPORT_FIELDS))
    return events.where("k = 'backend.http'").select(
        "session_id", "seq", "t", get("service").alias("service"), get("operation").alias("operation"), "method", "url", get("status", "int").alias("status"), get("durationMs", "double").alias("duration_ms"),
        get("error").alias("error"), "request_id", F.when(F.size(detail) > 0, F.to_json(detail)).alias("detail"))


def storage_changes(events: DataFrame) -> DataFrame:
    from evidentia.functions.text import redact

    rows = events.where("k = 'stor'")
    return _earliest(rows.select("session_id", "seq", "t", get("type").alias("area"), get("op").alias("op"), F.substring(get("key"), 1, 200).alias("key"), redact(get("oldVal")).alias("old_value"), redact(get("newVal")).alias("new_value")))


def flag_changes(events: DataFrame) -> DataFrame:
    """One row for each flag that an environment event says has changed; a side is a bare value or {value, variant}."""
    each = F.from_json(F.to_json(get("flagChanges", "variant")), "map<string,struct<`from`:string,`to`:string>>")
    rows = events.where("k = 'env'").select("session_id", "seq", "t", F.explode(each).alias("flag", "c"))
    value = lambda side: F.coalesce(F.get_json_object(side, "$.value"), side)
    out = rows.select("session_id", "seq", "t", "flag", value(F.col("c.from")).alias("before"), value(F.col("c.to")).alias("after"), F.get_json_object("c.to", "$.variant").alias("variant"))
    w = Window.partitionBy("session_id").orderBy("t", "seq", "flag")
    return out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= MOST_ROWS).drop("__r")


def statement_ordinals(events: DataFrame) -> DataFrame:
    """Reads with the number of their statement within the request, in file order of the statements' first rows."""
    reads = events.where("k = 'db.read' AND request_id IS NOT NULL").withColumn("statement", F.coalesce(get("stmt"), _shape()))
    first = F.min("seq").over(Window.partitionBy("session_id", "request_id", "statement"))
    return reads.withColumn("first", first).withColumn("ordinal", F.dense_rank().over(Window.partitionBy("session_id", "request_id").orderBy("first")))


def capped_reads(events: DataFrame, per_statement: int = READS_PER_STATEMENT, per_request: int = READS_PER_REQUEST) -> DataFrame:
    """The first rows of each statement, and of those the first of each request."""
    rows = statement_ordinals(events)
    kept = rows.withColumn("__s", F.row_number().over(Window.partitionBy("session_id", "request_id", "ordinal").orderBy("seq"))).where(F.col("__s") <= per_statement)
    return kept.withColumn("__q", F.row_number().over(Window.partitionBy("session_id", "request_id").orderBy("seq"))).where(F.col("__q") <= per_request).drop("__s", "__q", "first")


# ---- scopes and guards


def filter_events(events: DataFrame, kind: str | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    """Events of a kind within bounds, both inclusive; what is not asked is not filtered."""
    for condition, given in ((F.col("k") == kind, kind), (F.col("t") >= after, after), (F.col("t") <= before, before)):
        if given is not None:
            events = events.where(condition)
    return events


def error_class() -> Column:
    """An event of an error or of an answer that failed."""
    return (F.col("k") == "err") | ((F.col("k") == "net.res") & (F.coalesce("st", F.lit(0)) >= 400))


def error_class_sessions(events: DataFrame) -> DataFrame:
    """session_id of every session with such an event."""
    return events.where(error_class()).select("session_id").distinct()


def session_summaries(events: DataFrame) -> DataFrame:
    """session_id, severity, title (the first error, or else the first failed answer), start, end, n."""
    err = F.col("k") == "err"
    failed = error_class() & ~err
    first = lambda value, where: F.min_by(F.when(where, value), F.when(where, F.col("seq")))
    severity = F.when(F.count_if(err) > 0, "high").when(F.count_if(failed) > 0, "medium").otherwise("low")
    title = F.coalesce(first(F.col("msg"), err), first(F.col("url"), failed), F.lit("session"))
    return events.groupBy("session_id").agg(severity.alias("severity"), title.alias("title"), F.min_by("t", "seq").alias("start"), F.max_by("t", "seq").alias("end"), F.count("*").alias("n"))


def session_filter(sessions: DataFrame, app: str | None = None, after: int | None = None, before: int | None = None, release: str | None = None, build: str | None = None) -> DataFrame:
    """Sessions of an app that overlap a time range, of a release and build; a filter that is not given lets all pass."""
    for condition, given in ((F.col("app") == app, app), (F.col("end") >= after, after), (F.col("start") <= before, before), (F.col("release") == release, release), (F.col("build") == build, build)):
        if given is not None:
            sessions = sessions.where(condition)
    return sessions


def in_scope(tenant_id: str | None, project_id: str | None = None, tenant: str = "tenant", app: str = "app") -> Column:
    """An unknown tenant or app passes; a known one must be the scope's."""
    plain = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    same = lambda name, value: F.coalesce(plain(F.col(name)) == plain(F.lit(value)), plain(F.col(name)).isNull())
    mine = F.lit(True) if tenant_id is None else same(tenant, tenant_id)
    return mine if project_id is None else mine & same(app, project_id)


def is_bug_record(columns: tuple[str, ...] = ("bug_id", "severity", "first_seen", "last_seen")) -> Column:
    """The row has what a distinct bug needs."""
    known = F.lit(True)
    for c in columns:
        known &= F.col(c).isNotNull()
    return known & (F.col("last_seen") >= F.col("first_seen"))


def admitted(rate: float, session_id: str = "session_id") -> Column:
    """The session is in the sample: the same answer for all its rows, wherever they are read."""
    return F.pmod(F.xxhash64(session_id), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))
