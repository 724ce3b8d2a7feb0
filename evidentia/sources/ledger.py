"""The shared line items as changes of stored rows: one session a supplier, one request an order, in the order of their keys.

Each line reports a product's total and then changes that product, and moves an order item to an order or elsewhere. The first line of a
supplier's order inserts the order and an audit row. A product's column names its value by the line's quantity, so values recur by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.sources.telemetry import promote

#: What a line writes, as SQL that both engines read: the stock, the total in cents, and the order that the item is moved to.
_STOCK, _TOTAL, _MOVED = "CAST(l_quantity AS BIGINT) % 3", "CAST(l_quantity AS BIGINT) % 5 * 100", "CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey ELSE l_partkey END"
_AUDITED = "CASE WHEN l_orderkey % 2 = 0 THEN 'products' ELSE 'batches' END"
#: Values of a product before its first change.
STOCK_BEFORE, TOTAL_BEFORE = 9, 900
#: Place of an event in its line -> op, table, key, after image, before image. Those of a supplier's order come once, with its first line.
_OF_ORDER = (
    (0, "insert", "orders", "l_orderkey", "named_struct('id', l_orderkey)", None),
    (4, "insert", "audit_log", "l_orderkey", "named_struct('entity', audited)", None),
)
_OF_LINE = (
    (1, "insert", "ops_reports", "concat('r', l_orderkey, '-', l_linenumber)", "named_struct('total_cents', total, 'note', concat('product=', l_partkey))", None),
    (2, "update", "products", "l_partkey", "named_struct('inventory', stock, 'total_cents', total)", "named_struct('inventory', stock_before, 'total_cents', total_before)"),
    (3, "update", "order_items", "concat(l_orderkey, '-', l_linenumber)", "named_struct('order_id', moved)", "named_struct('order_id', l_partkey + 1)"),
)


def _changes(lines: DataFrame, events: tuple) -> DataFrame:
    """Each line's events. The payload is made last, so that a filter on table or op comes before it."""
    request = "concat('q', l_orderkey)"
    body = {j: f"named_struct('requestId', {request}, 'op', '{op}', 'table', '{table}', 'pk', named_struct('id', {pk}), 'after', {after}" + (f", 'before', {before}" if before else "") + ")" for j, op, table, pk, after, before in events}
    by = lambda of: F.expr("CASE j " + " ".join(f"WHEN {e[0]} THEN {of(e)}" for e in events) + " END")
    rows = lines.withColumn("j", F.explode(F.array(*[F.lit(e[0]).cast("long") for e in events])))
    seq = F.col("place") * 8 + F.col("j")
    # JSON text leaves fields without a value out; where all have one, the payload is made without it, byte for byte the same
    whole = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in lines.columns))
    payload = F.when(whole, by(lambda e: f"to_variant_object({body[e[0]]})")).otherwise(F.parse_json(by(lambda e: f"to_json({body[e[0]]})")))
    rows = rows.select("*", F.col("l_suppkey").alias("session_id"), seq.alias("seq"), seq.alias("t"), F.lit("db.diff").alias("k"), payload.alias("d"))
    known = {"request_id": F.expr(request), "op": by(lambda e: f"'{e[1]}'"), "table": by(lambda e: f"'{e[2]}'")}
    return promote(rows, known).drop(*lines.columns, "j")


def ledger_as_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, t, k, d (VARIANT) and the hot fields."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = lines.withColumn("place", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    orders = lines.groupBy("l_suppkey", "l_orderkey").agg(F.min("place").alias("place")).withColumn("audited", F.expr(_AUDITED))
    lines = lines.select("*", F.expr(_STOCK).alias("stock"), F.expr(_TOTAL).alias("total"), F.expr(_MOVED).alias("moved"))
    row = Window.partitionBy("l_suppkey", "l_partkey").orderBy("place")
    lines = lines.withColumn("stock_before", F.coalesce(F.lag("stock").over(row), F.lit(STOCK_BEFORE))).withColumn("total_before", F.coalesce(F.lag("total").over(row), F.lit(TOTAL_BEFORE)))
    return _changes(lines, _OF_LINE).unionByName(_changes(orders, _OF_ORDER))


#: For DuckDB: the lines with what they write.
LEDGER_SQL = f"""li AS (SELECT l_suppkey AS s, l_orderkey, l_linenumber, l_partkey, (l_orderkey * 8 + l_linenumber)::BIGINT AS place, {_STOCK} AS stock, {_TOTAL} AS total, {_MOVED} AS moved, {_AUDITED} AS audited FROM lineitem)
, li2 AS (SELECT *, coalesce(lag(stock) OVER r, {STOCK_BEFORE}) AS stock_before, coalesce(lag(total) OVER r, {TOTAL_BEFORE}) AS total_before FROM li WINDOW r AS (PARTITION BY s, l_partkey ORDER BY place))"""
