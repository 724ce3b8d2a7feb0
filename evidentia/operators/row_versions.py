"""The history of stored rows, rebuilt from the images of their changes.

`column_versions` is one row for each value that a column of a stored row held, with the change that made it and the stretch of the log in which it
held; the value before the first seen change comes from its before image. Partial images are no matter, as every column has its own history.
`references` infers which column points to which table. Everything is keyed by session, table and row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.detectors import field, held, row_image, shared

#: Distinct values from which on a column whose name says nothing is taken to point to the one table that has all of them as keys.
INCLUSION_VALUES = 3


def singular(table: Column) -> Column:
    """orders -> order, batches -> batch, categories -> category, addresses -> address; status stays."""
    return F.when(table.rlike("ies$"), F.regexp_replace(table, "ies$", "y")).when(table.rlike("(ch|sh|ss|x|z)es$"), F.regexp_replace(table, "es$", "")).when(table.rlike("[^us]s$"), F.regexp_replace(table, "s$", "")).otherwise(table)


def snake(name: Column) -> Column:
    """orderItemId -> order_item_id."""
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


def row_changes(events: DataFrame) -> DataFrame:
    """session_id, seq, t, request_id, op, table, pk (the key's value, or all of its values), before, after: every row change.

    Of a stored scan they are written by table: a reader's filter on tables is held against folders, not against rows.
    """
    if held(events) is None:
        return _row_changes(events)
    # the letter keeps a table without a name apart from changes that name none: a folder can't
    rows = shared(events, "row_changes", lambda e: _row_changes(e).withColumn("folder", F.concat(F.lit("t"), F.col("table"))).drop("table"), "folder")
    return rows.select("session_id", "seq", "t", "request_id", "op", F.expr("substring(folder, 2)").alias("table"), "pk", "before", "after")


def _row_changes(events: DataFrame) -> DataFrame:
    # each payload is taken apart once: without the array, a reader's filters would take it apart again for each use of a part
    parts = F.struct(F.try_variant_get("d", "$", "struct<pk:map<string,string>,before:map<string,string>,after:map<string,string>>").alias("of"), field("pk", "string").alias("key"))
    own = [F.col(c) for c in ("session_id", "seq")] + [F.col("t").cast("long").alias("t"), F.col("request_id"), F.lower("op").alias("op"), F.lower("table").alias("table")]
    rows = events.where("k = 'db.diff'").select(*own, F.explode(F.array(parts)).alias("x"))
    keys = F.map_values("x.of.pk")
    pk = F.coalesce(F.when(F.size(keys) > 0, F.array_join(keys, " ")), F.col("x.key"), F.col("x.of.after")["id"], F.col("x.of.before")["id"])
    return rows.select("session_id", "seq", "t", "request_id", "op", "table", pk.alias("pk"), "x.of.before", "x.of.after")


def after_images(events: DataFrame) -> DataFrame:
    """session_id, table, after: what the changes that are no deletes left. Of a stored scan from its row changes; else nothing but this image is read of a payload."""
    if held(events) is not None:
        return row_changes(events).where("op <> 'delete'").select("session_id", "table", "after")
    # an array of one, as in _row_changes
    return events.where("k = 'db.diff' AND lower(op) <> 'delete'").select("session_id", F.lower("table").alias("table"), F.explode(F.array(row_image("after"))).alias("after"))


def column_versions(events: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """session_id, table, pk, col, value, was, op, request_id, t, begins, ends: `value` held from change `begins` (null: before the log) to `ends` (null: still).

    `was` is what the change replaced, and `op` is null for a value from before the log. A delete ends a row's values with nulls.
    A change that leaves a column as it was makes no version of it.

    It is made in one pass and one shuffle, and is not stored: a reader's filter on tables and columns reaches the changes. A reader of some tables only
    may pass all `changes` of those.
    """
    rows = (row_changes(events) if changes is None else changes).where("pk IS NOT NULL")
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("before", none), F.when(F.col("op") == "delete", none).otherwise(F.coalesce("after", none))
    # a delete ends every column that its image names; any other change the columns of its after image
    names = F.map_keys(F.when(F.col("op") == "delete", old).otherwise(new))
    cells = rows.withColumn("old", old).withColumn("new", new).select("session_id", "table", "pk", "seq", "t", "request_id", "op", "old", "new", F.explode(names).alias("col"))
    key = ["session_id", "table", "pk", "col"]
    order = Window.partitionBy(*key).orderBy("seq")
    cells = cells.select(*key, "seq", "t", "request_id", "op", F.map_contains_key("old", F.col("col")).alias("told"), F.col("old")[F.col("col")].alias("told_was"), F.col("new")[F.col("col")].alias("value"))
    cells = cells.withColumn("n", F.row_number().over(order)).withColumn("was", F.when(F.col("told"), F.col("told_was")).otherwise(F.lag("value").over(order)))
    before = F.struct(F.lit(None).cast("long").alias("begins"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("was"), F.col("told_was").alias("value"))
    change = F.struct(F.col("seq").alias("begins"), "t", "request_id", "op", "was", "value")
    # an insert has no value before it; a null that stays null is no version
    moved = (F.col("op") == "insert") | ~F.col("was").eqNullSafe(F.col("value"))
    made = F.filter(F.array(F.when((F.col("n") == 1) & F.col("told"), before), F.when(moved, change)), lambda v: v.isNotNull())
    both = cells.select(*key, F.explode(made).alias("v")).select(*key, "v.*")
    return both.withColumn("ends", F.lead("begins").over(Window.partitionBy(*key).orderBy(F.col("begins").asc_nulls_first())))


def _pointing_columns(events: DataFrame) -> DataFrame:
    """table, col: the columns that are named as keys and hold a value. Rows are brought down to the few sets of names that they have before a name is looked at."""
    names = F.map_keys(F.map_filter(F.coalesce("after", "before"), lambda k, v: v.isNotNull()))
    sets = row_changes(events).select("table", names.alias("names")).distinct()
    return sets.select("table", F.explode("names").alias("col")).where(F.col("col").rlike("(?i)_id$|[a-z]Id$")).distinct()


def references(events: DataFrame) -> DataFrame:
    """table, col, parent: which table a column of keys points to.

    By name, if the column is the singular of a table (or its last word) and `_id`; else by inclusion: each of the column's values is the key of a row
    of one and the same table in the session where it is written, for `INCLUSION_VALUES` distinct ones or more, and no other table has them all.
    """
    rows = row_changes(events)
    columns = shared(events, "pointing_columns", _pointing_columns)
    pointing = rows.select("session_id", "table", F.explode(F.map_filter(F.coalesce("after", "before"), lambda k, v: k.rlike("(?i)_id$|[a-z]Id$") & v.isNotNull())).alias("col", "value"))
    tables = rows.select(F.col("table").alias("parent")).distinct()
    stem = F.regexp_replace(snake(F.col("col")), "_id$", "")
    of = singular(F.col("parent"))
    columns = columns.withColumn("stem", stem)
    # a table is known by its whole name and by its last word; the whole name is the better match
    names = tables.select("parent", F.explode(F.array_distinct(F.array(of, F.substring_index(of, "_", -1)))).alias("stem")).withColumn("whole", F.col("stem") == of)
    best = Window.partitionBy("table", "col").orderBy(F.desc("whole"), "parent")
    named = columns.join(names, "stem").where("parent <> table").withColumn("n", F.row_number().over(best)).where("n = 1").select("table", "col", "parent")
    if columns.join(named, ["table", "col"], "left_anti").isEmpty():
        return named  # names tell all columns: no value is looked up
    open_ = pointing.distinct().join(named.select("table", "col"), ["table", "col"], "left_anti")
    keys = rows.where("pk IS NOT NULL").select("session_id", F.col("table").alias("parent"), F.col("pk").alias("value")).distinct()
    total = open_.groupBy("table", "col").agg(F.count("*").alias("all"), F.countDistinct("value").alias("values")).where(F.col("values") >= INCLUSION_VALUES)
    held = open_.join(keys, ["session_id", "value"]).where("parent <> table").groupBy("table", "col", "parent").agg(F.count("*").alias("n"))
    whole = held.join(total, ["table", "col"]).where(F.col("n") == F.col("all"))
    only = whole.withColumn("rivals", F.count("*").over(Window.partitionBy("table", "col"))).where("rivals = 1").select("table", "col", "parent")
    return named.unionByName(only)
