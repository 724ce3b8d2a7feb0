"""Sources: session logs, OTLP batches, dictionaries, and the shared tables seen as telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X


def read_sessions_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """session_id, seq, t, k, d (VARIANT) of session logs: one file per session, one JSON event to a line.

    `seq` is the line's place in its file. Files are split into tasks as any text: a line's place follows from the start of its split and its
    order there, so it holds however they are split. Blank and malformed lines, and those without a numeric t and a kind, are dropped.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("block", "row")) - 1
    files = lines.withColumn("seq", place)
    parsed = files.select(F.regexp_extract("file", r"([^/]+?)(?:\.[^/.]*)?$", 1).alias("session_id"), F.col("seq").cast("long").alias("seq"), F.try_parse_json("line").alias("e"))
    rows = parsed.where("e IS NOT NULL").select(
        "session_id", "seq", F.try_variant_get("e", "$.t", "long").alias("t"), X.canonical_kind(F.try_variant_get("e", "$.k", "string")).alias("k"),
        F.try_variant_get("e", "$.d", "variant").alias("d"), F.try_variant_get("e", "$.offsetMs", "long").alias("offset_ms"),
    )
    return rows.where("t IS NOT NULL AND k <> ''")


#: Hot payload fields: name -> type, and where a payload has it.
_HOT = {"id": ("string", ("id",)), "request_id": ("string", ("requestId",)), "st": ("int", ("st",)), "dur": ("double", ("dur",)), "url": ("string", ("url",)), "method": ("string", ("m", "method")),
        "msg": ("string", ("msg",)), "table": ("string", ("table",)), "op": ("string", ("op",)), "wire_session_id": ("string", ("sessionId",))}


def promote(events: DataFrame, known: dict[str, Column] | None = None) -> DataFrame:
    """Hot payload fields as columns beside the open payload.

    A source that makes the payloads passes the ones it sets as `known` (the others are null): a filter on them then comes before payloads are made.
    """
    if known is None:
        hot = {name: F.coalesce(*[F.try_variant_get("d", f"$.{path}", kind) for path in paths]) for name, (kind, paths) in _HOT.items()}
    else:
        hot = {name: known.get(name, F.lit(None)).cast(kind) for name, (kind, _) in _HOT.items()}
    return events.select("*", *[c.alias(name) for name, c in hot.items()])


def hot_expression(name: str, fields: dict[str, str]) -> str:
    """A hot field of a payload that is made of these fields (name -> SQL), as SQL."""
    kind, paths = _HOT[name]
    own = [fields[path] for path in paths if path in fields]
    return f"CAST({own[0]} AS {kind})" if own else "NULL"


#: An OTLP attribute value as JSON: one field of a union is set.
_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
SPAN_SCHEMA = (
    f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,"
    f"parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:{_ATTRIBUTES},"
    f"events:array<struct<name:string,timeUnixNano:string>>>>>>>>>"
)
LOG_SCHEMA = (
    f"struct<resourceLogs:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,"
    f"observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_VALUE},traceId:string,spanId:string,attributes:{_ATTRIBUTES}>>>>>>>"
)


def attribute_map(column: str):
    """Attribute list -> map of strings; the last of equal keys wins."""
    text = "coalesce(x.value.stringValue, x.value.intValue, CAST(x.value.doubleValue AS STRING), CAST(x.value.boolValue AS STRING))"
    distinct = f"filter({column}, (x, i) -> x.key IS NOT NULL AND NOT exists(slice({column}, i + 2, size({column})), y -> y.key = x.key))"
    return F.expr(f"map_from_entries(transform({distinct}, x -> struct(x.key, {text})))")


def read_otlp_spans(batches: DataFrame, column: str = "body") -> DataFrame:
    """OTLP trace JSON bodies -> one event per span, at most 32 span events each; the trace id is the request id."""
    spans = (
        batches.select(F.from_json(column, SPAN_SCHEMA).alias("b")).select(F.explode("b.resourceSpans").alias("r"))
        .select("r.resource", F.explode("r.scopeSpans").alias("s")).select("resource", F.explode("s.spans").alias("span"))
    )
    start, end = F.col("span.startTimeUnixNano").cast("decimal(20,0)") / 1000000, F.col("span.endTimeUnixNano").cast("decimal(20,0)") / 1000000
    return spans.select(
        start.cast("long").alias("t"), F.lit("backend.otel.span").alias("k"), F.col("span.traceId").alias("request_id"), F.col("span.spanId").alias("span_id"),
        F.col("span.parentSpanId").alias("parent_span_id"), F.col("span.name").alias("name"), F.col("span.status.code").alias("status"),
        (end - start).cast("double").alias("dur"), attribute_map("span.attributes").alias("attributes"), attribute_map("resource.attributes").alias("resource"),
        F.expr("slice(span.events, 1, 32)").alias("span_events"),
    )


def read_otlp_logs(batches: DataFrame, column: str = "body") -> DataFrame:
    """OTLP log JSON bodies -> one event per record; its time falls back to the observed one."""
    logs = (
        batches.select(F.from_json(column, LOG_SCHEMA).alias("b")).select(F.explode("b.resourceLogs").alias("r"))
        .select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", F.explode("s.logRecords").alias("log"))
    )
    nanos = F.coalesce(F.nullif(F.col("log.timeUnixNano").cast("decimal(20,0)"), F.lit(0)), F.col("log.observedTimeUnixNano").cast("decimal(20,0)"))
    return logs.select(
        (nanos / 1000000).cast("long").alias("t"), F.lit("backend.otel.log").alias("k"), F.col("log.traceId").alias("request_id"), F.col("log.spanId").alias("span_id"),
        F.col("log.severityNumber").alias("severity_number"), F.col("log.severityText").alias("severity"), F.col("log.body.stringValue").alias("msg"),
        attribute_map("log.attributes").alias("attributes"), attribute_map("resource.attributes").alias("resource"),
    )


def rehydrate(events: DataFrame, dictionary: DataFrame, ref: str, fields: list[str]) -> DataFrame:
    """Dictionary fields put back by reference; what the row itself holds wins. The join side is left to the optimizer's size check."""
    named = dictionary.select(F.col("ref").alias("__ref"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = events.join(named, F.col(ref) == F.col("__ref"), "left")
    return joined.withColumns({f: F.coalesce(f, f"__{f}") for f in fields}).drop("__ref", *[f"__{f}" for f in fields])


def list_sessions(sessions: DataFrame, limit: int = 100, app: str | None = None, after: str | None = None) -> DataFrame:
    """Most recent sessions first, pruned by partition columns before the ordered limit."""
    kept = sessions
    if app is not None:
        kept = kept.where(F.col("app") == app)
    if after is not None:
        kept = kept.where(F.col("date") >= after)
    return kept.orderBy(F.desc("date"), F.desc("session_id")).limit(max(1, min(500, limit)))


def millis(column: str):
    """Epoch milliseconds of a timestamp without zone, read as UTC whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events_as_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared `events` table as telemetry of one session per user: session_id, seq, t, k, id, request_id, st, dur, url, msg.

    error -> err, click -> clk, view -> net.req, signup -> nav, purchase -> net.res; a response's status is 500 for every seventh event.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("id"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.create_map(*[F.lit(x) for pair in {"error": "err", "click": "clk", "view": "net.req", "signup": "nav", "purchase": "net.res"}.items() for x in pair])
    return e.select(
        F.col("user_id").alias("session_id"), F.row_number().over(order).cast("long").alias("seq"), millis("ts").alias("t"), kind[F.col("event_type")].alias("k"),
        "id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"),
        F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 7 == 0, 500).otherwise(200)).alias("st"),
        F.col("value").alias("dur"), F.concat(F.lit("https://app.example/u/"), F.col("id").cast("string"), F.lit("/item?x="), F.col("event_id").cast("string")).alias("url"),
        F.concat(F.lit("Failed "), F.col("event_type"), F.lit(" of item "), F.col("id").cast("string")).alias("msg"),
    )


#: The same view for DuckDB.
TELEMETRY_SQL = """tel AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq, (epoch_us(ts) // 1000)::BIGINT AS t,
    CASE event_type WHEN 'error' THEN 'err' WHEN 'click' THEN 'clk' WHEN 'view' THEN 'net.req' WHEN 'signup' THEN 'nav' WHEN 'purchase' THEN 'net.res' END AS k,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, 'r' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS request_id,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 7 = 0 THEN 500 ELSE 200 END END AS st, value AS dur,
    'https://app.example/u/' || json_extract_string(props, '$.k') || '/item?x=' || event_id AS url,
    'Failed ' || event_type || ' of item ' || json_extract_string(props, '$.k') AS msg
  FROM events)"""
