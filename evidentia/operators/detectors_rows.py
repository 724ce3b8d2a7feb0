"""Detectors of broken relations between stored rows, all fed by the rows' history (`row_versions`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.detectors import CLOCK_COLUMNS, detector, found, row_fed, shared
from evidentia.operators.detectors_business import MONEY, _map, exchanges
from evidentia.operators.joins import as_of
from evidentia.operators.row_versions import column_versions, references, row_changes, singular, snake

STATE_COLUMNS = r"(?i)(^|_)(status|state|stage|phase)$"
#: Rows of one table that a request changes before their audit is missed.
AUDITED_ROWS = 2
#: A source that a note names: order=1, order #1, order:1.
_NOTED = r"(?i)\b([a-z][a-z_]*?)(?:_?id)?\s*[=:#]\s*#?([A-Za-z0-9-]+)"


def _references(events: DataFrame) -> DataFrame:
    return shared(events, "references", references)


@row_fed
def existing_children_reparented_to_new_row(events: DataFrame) -> DataFrame:
    """Rows that a request moved from another parent to one that it inserted itself."""
    refs = _references(events)
    pointing = row_changes(events).join(F.broadcast(refs.select("table").distinct()), "table", "left_semi")  # one row a table
    moved = column_versions(events, pointing).where("op = 'update' AND was IS NOT NULL AND value IS NOT NULL AND request_id IS NOT NULL").where(F.col("col").rlike("(?i)_id$|[a-z]Id$"))
    made = row_changes(events).where("op = 'insert' AND request_id IS NOT NULL AND pk IS NOT NULL").select("session_id", "request_id", F.col("table").alias("parent"), F.col("pk").alias("value"))
    made = made.join(F.broadcast(refs.select("parent").distinct()), "parent", "left_semi").distinct()  # one row a table
    hit = moved.join(refs, ["table", "col"]).join(made, ["session_id", "request_id", "parent", "value"])
    g = hit.groupBy("session_id", "request_id", "table", "col", "parent", "value").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.min("was").alias("was"))
    return found(g, "existing_children_reparented_to_new_row", "high", 86, F.concat_ws(" ", "request_id", "table", "col", "value"), F.format_string("%d %s rows moved from %s %s to the new %s", "n", "table", "col", "was", "value"))


@row_fed
def stale_value_writeback(events: DataFrame) -> DataFrame:
    """A request that writes back the very value that another request had just replaced. States, clocks and switches go back and forth by nature."""
    line = Window.partitionBy("session_id", "table", "pk", "col").orderBy(F.col("begins").asc_nulls_first())
    rows = row_changes(events)
    updated = rows.where("op = 'update'").select("table").distinct()  # one row a table
    v = column_versions(events, rows.join(F.broadcast(updated), "table", "left_semi")).where(~F.col("col").rlike(CLOCK_COLUMNS) & ~F.col("col").rlike(STATE_COLUMNS))
    v = v.withColumn("maker", F.lag("request_id").over(line)).withColumn("replaced", F.lag("was").over(line)).withColumn("by", F.lag("op").over(line))
    hit = v.where("op = 'update' AND by = 'update' AND value = replaced AND value IS NOT NULL AND request_id <> maker").where(~F.lower("value").isin("true", "false"))
    return found(hit, "stale_value_writeback", "high", 80, F.concat_ws(" ", "table", "pk", "col"), F.format_string("%s.%s went back to %s, which request %s had replaced by %s", "table", "col", "value", "maker", "was"))


@detector
def request_target_row_mismatch(events: DataFrame) -> DataFrame:
    """An accepted request that names a row of a table and updates only other rows of it."""
    asked = exchanges(events).where("asked LIKE '{%' AND coalesce(st, 200) < 400 AND coalesce(request_id, id) IS NOT NULL").select("session_id", F.coalesce("request_id", "id").alias("request_id"), F.explode(_map(F.col("asked"))).alias("name", "wanted"))
    asked = asked.where(F.col("name").rlike("(?i)[a-z]_?id$") & F.col("wanted").rlike("^[A-Za-z0-9-]+$")).withColumn("stem", F.regexp_replace(snake(F.col("name")), "_?id$", ""))
    wrote = row_changes(events).where("op = 'update' AND request_id IS NOT NULL AND pk IS NOT NULL").groupBy("session_id", "request_id", "table").agg(F.collect_set("pk").alias("pks"), F.min("t").alias("t"))
    of = singular(F.col("table"))
    names = wrote.withColumn("stem", F.explode(F.array_distinct(F.array(of, F.substring_index(of, "_", -1)))))
    hit = names.join(asked, ["session_id", "request_id", "stem"]).where(~F.array_contains("pks", F.col("wanted")))
    return found(hit, "request_target_row_mismatch", "high", 86, F.concat_ws(" ", "request_id", "table", "wanted"), F.format_string("asked for %s %s, wrote %s %s", "name", "wanted", "table", F.array_join(F.array_sort("pks"), ", ")))


@row_fed
def mutations_missing_entity_audit(events: DataFrame) -> DataFrame:
    """A request that changed several rows of a table and wrote audit rows, none of them about that table."""
    rows = row_changes(events).where("request_id IS NOT NULL")
    is_audit = F.col("table").rlike(r"(^|_)(audits?|audit_(log|trail|events?)s?|activity_logs?|history)$")
    entity = F.lower(F.coalesce(F.col("after")["entity"], F.col("after")["entity_type"], F.col("after")["table_name"], F.col("after")["resource"]))
    # an array of one, as in row_versions._row_changes: singular() names its argument many times
    audits = rows.where(is_audit & (F.col("op") == "insert")).select("session_id", "request_id", F.explode(F.array(F.regexp_replace(entity, "^.*[.]", ""))).alias("about"))
    audits = audits.where("about IS NOT NULL").withColumn("about", singular(F.col("about")))
    told = audits.groupBy("session_id", "request_id").agg(F.collect_set("about").alias("about"))
    changed = rows.where(~is_audit & (F.col("op") == "update")).groupBy("session_id", "request_id", "table").agg(F.countDistinct("pk").alias("n"), F.min("t").alias("t")).where(F.col("n") >= AUDITED_ROWS)
    hit = changed.join(told, ["session_id", "request_id"]).where(~F.array_contains("about", singular(F.col("table"))))
    return found(hit, "mutations_missing_entity_audit", "medium", 68, F.concat_ws(" ", "request_id", "table"), F.format_string("%d %s rows changed; the audit speaks of %s only", "n", "table", F.array_join(F.array_sort("about"), ", ")))


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), c.try_cast("double"))


@row_fed
def batch_applied_count_exceeds_staged_rows(events: DataFrame) -> DataFrame:
    """A batch that says it applied more rows than were staged for it by then."""
    staged = row_changes(events).where("op = 'insert' AND table RLIKE '(^|_)(stage|staged|staging|stagings)($|_)'").select("session_id", "seq", "table", F.explode(F.map_filter("after", lambda k, v: k.rlike("_id$") & v.isNotNull())).alias("col", "pk"))
    refs = _references(events)
    keyed = staged.join(refs, ["table", "col"]).select("session_id", "seq", F.col("parent").alias("table"), "pk")
    upto = Window.partitionBy("session_id", "table", "pk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counts = keyed.withColumn("staged", F.count("*").over(upto))
    said = column_versions(events).where("op IN ('insert', 'update')").where(F.col("col").rlike(r"(?i)(^|_)(applied|imported|processed)$|^applied_")).withColumn("n", _number(F.col("value"))).where("n IS NOT NULL").withColumn("seq", F.col("begins"))
    hit = as_of(said, counts, ["session_id", "table", "pk"], "seq").where("match.staged < n")
    return found(hit, "batch_applied_count_exceeds_staged_rows", "high", 84, F.concat_ws(" ", "table", "pk", "col"), F.format_string("%.0f applied, %d staged", "n", "match.staged"))


def _report_sums(events: DataFrame) -> DataFrame:
    """session_id, seq, t, request_id, report (its table), stem and pk (of the row that it names), col, said: the money that reports tell."""
    reports = row_changes(events).where("op = 'insert' AND table RLIKE '(^|_)(report|summary|summarie|statement|export)s?$'")
    note = F.coalesce(F.col("after")["note"], F.col("after")["source"], F.col("after")["ref"], F.col("after")["reference"])
    sums = reports.withColumn("stem", snake(F.regexp_extract(note, _NOTED, 1))).withColumn("pk", F.regexp_extract(note, _NOTED, 2)).where("stem <> ''")
    sums = sums.select("session_id", "seq", "t", "request_id", F.col("table").alias("report"), "stem", "pk", F.explode("after").alias("col", "v"))
    return sums.where(F.col("col").rlike(MONEY)).withColumn("said", _number(F.col("v"))).where("said IS NOT NULL").drop("v")


@row_fed
def report_total_contradicts_source_row(events: DataFrame) -> DataFrame:
    """A report's money that is not what the row it names held when the report was written."""
    sums = shared(events, "report_sums", _report_sums)
    tables = row_changes(events).select("table").distinct().withColumn("stem", singular(F.col("table")))
    named = F.broadcast(sums.select("stem").distinct().join(tables, "stem"))  # one row a table
    told = row_changes(events).join(named, "table", "left_semi")
    held = column_versions(events, told).where(F.col("col").rlike(MONEY)).join(named, "table").select("session_id", "stem", "pk", "col", F.coalesce("begins", F.lit(-1)).alias("seq"), _number(F.col("value")).alias("held"))
    hit = as_of(sums, held, ["session_id", "stem", "pk", "col"], "seq").where("match.held <> said")
    return found(hit, "report_total_contradicts_source_row", "high", 82, F.concat_ws(" ", "report", "stem", "pk", "col"), F.format_string("%s reports %.2f for %s %s, which held %.2f", "report", "said", "stem", "pk", "match.held"))
