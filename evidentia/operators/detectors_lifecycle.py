"""Detectors of things that happened in the wrong order: patterns as data over one table of lifecycle symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.detectors import detector, field, found, shared
from evidentia.operators.detectors_business import _map, exchanges
from evidentia.operators.patterns import Pattern, Step, match_patterns
from evidentia.operators.row_versions import row_changes

#: A retry moved by whole hours: so much off the whole hour is its backoff, and more hours than zones differ by are a schedule of its own.
BACKOFF_MS, MOST_HOURS, HOUR_MS = 120_000, 14, 3_600_000

#: What fires: pattern, severity, score, message.
LIFECYCLES: tuple[tuple[Pattern, str, int, str], ...] = (
    (Pattern("notification_lifecycle_order_inverted", (Step(("cancelled",)), Step(("confirmed",))), forbidden=("reopened",)), "high", 78, "a confirmation was sent after the cancellation"),
    (Pattern("job_drain_left_work_deferred", (Step(("drain_left_work",)),)), "medium", 70, "a drain succeeded with work deferred and remaining"),
    (Pattern("retry_schedule_clock_shift", (Step(("retry_moved_by_hours",)),)), "high", 80, "a failed attempt was rescheduled by whole hours"),
    (Pattern("inflight_request_invalidated_by_session_rotation", (Step(("request_start",)), Step(("session_deleted",), of_session=True), Step(("request_401",)))), "high", 82, "the session was deleted while the request was under way, which then got 401"),
    (Pattern("cached_empty_result_after_data_arrived", (Step(("empty_report", "empty_report_cached")), Step(("data_arrived",), of_session=True), Step(("empty_report_cached",)))), "high", 80, "an empty result came from the cache after rows had arrived"),
)


def _marked(rows: DataFrame, entity: Column, symbol: Column) -> DataFrame:
    return rows.select("session_id", entity.cast("string").alias("entity"), F.col("t").cast("long").alias("t"), F.col("seq").cast("long").alias("seq"), F.col("request_id").cast("string").alias("request_id"), symbol.alias("symbol")).where("symbol IS NOT NULL")


def _notifications(events: DataFrame) -> DataFrame:
    rows = events.where("k IN ('db.read', 'db.diff')").where(F.lower("table").rlike("notification|message|email"))
    image = F.from_json(F.to_json(F.coalesce(field("row", "variant"), field("after", "variant"))), "map<string,string>")
    about = F.coalesce(*[F.col("row")[c] for c in ("order_id", "booking_id", "subscription_id", "appointment_id", "reference")])
    kind, sent = F.lower(F.col("row")["type"]), F.lower(F.coalesce(F.col("row")["status"], F.lit("sent"))).isin("sent", "delivered")
    symbol = F.when(sent & kind.rlike("cancel|void"), "cancelled").when(sent & kind.rlike("confirm|placed|accepted"), "confirmed").when(kind.rlike("reopen|reinstat|restor|rebook"), "reopened")
    return _marked(rows.withColumn("row", image), F.concat(F.lower("table"), F.lit(" "), about), symbol).where("entity IS NOT NULL")


def _drains(events: DataFrame) -> DataFrame:
    rows = exchanges(events).where("method = 'POST' AND st BETWEEN 200 AND 299 AND told LIKE '{%'").where(F.col("path").rlike("(?i)/(drain|flush|run|process)$")).withColumn("m", _map(F.col("told")))
    count = lambda name: F.coalesce(F.col("m")[name].try_cast("long"), F.lit(0))
    left = (count("deferred") > 0) & (F.greatest(count("remaining"), count("pending")) > 0)
    return _marked(rows.withColumn("seq", F.col("t")), F.concat_ws(" ", "path", F.coalesce("request_id", "id")), F.when(left, F.lit("drain_left_work")))


def _retries(events: DataFrame) -> DataFrame:
    """Updates that count an attempt up and set the next run to the hour, give or take a backoff."""
    rows = row_changes(events).where("op = 'update'").where(F.col("table").rlike("job|queue|task|retr|outbox|deliver"))
    after = lambda *names: F.coalesce(*[F.col("after")[n] for n in names])
    tries = after("attempts", "attempt", "retries", "retry_count").try_cast("long") > F.coalesce(F.coalesce(*[F.col("before")[n] for n in ("attempts", "attempt", "retries", "retry_count")]).try_cast("long"), F.lit(0))
    next_run = F.unix_millis(after("run_at", "next_run_at", "next_attempt_at", "retry_at", "scheduled_at").try_cast("timestamp"))
    late = next_run - F.col("t")
    hours = F.round(late / HOUR_MS)
    moved = tries & after("last_error", "error").isNotNull() & hours.between(1, MOST_HOURS) & (F.abs(late - hours * HOUR_MS) <= BACKOFF_MS)
    return _marked(rows, F.concat_ws(" ", "table", "pk"), F.when(moved, F.lit("retry_moved_by_hours")))


def _requests(events: DataFrame) -> DataFrame:
    rows = events.where("k IN ('backend.req.start', 'backend.req.end') AND request_id IS NOT NULL")
    symbol = F.when(F.col("k") == "backend.req.start", "request_start").when(field("statusCode", "int") == 401, "request_401")
    gone = events.where("k = 'db.diff' AND lower(op) = 'delete'").where(F.lower("table").rlike("(^|_)sessions?$"))
    return _marked(rows, F.concat(F.lit("request "), F.col("request_id")), symbol).unionByName(_marked(gone, F.lit(None).cast("string"), F.lit("session_deleted")))


def _reports(events: DataFrame) -> DataFrame:
    rows = row_changes(events).where("op = 'insert'")
    report = F.col("table").rlike("report|dashboard|cache|snapshot|audit|log")
    n = F.coalesce(F.col("after")["rows_returned"], F.col("after")["row_count"], F.col("after")["rows"]).try_cast("long")
    cached = F.coalesce(F.lower(F.col("after")["note"]), F.lit("")).rlike(r"cache[=: ]*hit") | (F.lower(F.coalesce(F.col("after")["cache"], F.lit(""))) == "hit")
    empty = F.when(report & (n == 0), F.when(cached, "empty_report_cached").otherwise("empty_report"))
    kind = F.concat_ws(" ", "table", F.coalesce(F.col("after")["kind"], F.col("after")["name"], F.lit("")))
    return _marked(rows, kind, empty).unionByName(_marked(rows.where(~report), F.lit(None).cast("string"), F.lit("data_arrived")))


def lifecycle_symbols(events: DataFrame) -> DataFrame:
    """session_id, entity, t, seq, request_id, symbol: what the patterns read, of all kinds in one table."""
    return shared(events, "lifecycle_symbols", lambda e: _notifications(e).unionByName(_drains(e)).unionByName(_retries(e)).unionByName(_requests(e)).unionByName(_reports(e)))


def _lifecycle(pattern: Pattern, severity: str, score: int, message: str) -> None:
    wanted = {s for step in pattern.steps for s in step.symbols} | set(pattern.forbidden)

    def run(events: DataFrame) -> DataFrame:
        rows = lifecycle_symbols(events).where(F.col("symbol").isin(*sorted(wanted)))
        done = match_patterns(rows, [pattern]).join(rows.where("entity IS NOT NULL").select("session_id", "entity", "t", "seq", "request_id").distinct(), ["session_id", "entity", "t", "seq"])
        once = done.groupBy("session_id", "entity").agg(F.min(F.struct("t", "seq", "request_id")).alias("f")).select("session_id", "entity", "f.*")
        return found(once, pattern.name, severity, score, F.col("entity"), F.lit(message))

    run.__name__ = pattern.name
    detector(run)


for _row in LIFECYCLES:
    _lifecycle(*_row)
