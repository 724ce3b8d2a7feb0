"""The shared orders as the account page of each customer: one session a customer, one response and one screen an order.

The response tells the balance (the order's price) and a credit (what is left of the price under the customer's account balance) in cents. The
screen shows the balance of this order, or by turns that of the order before, the credit, or the balance and a cent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.sources.telemetry import millis, promote

#: Cents of the credit, and what is shown, as SQL that both engines read: price, before (the price of the order before) and k (order key).
_CREDIT = "CAST(round(acctbal * 100) AS BIGINT) + CAST(round(price) AS BIGINT) % 1000"
_SHOWN = "CASE k % 4 WHEN 0 THEN coalesce(before, price) WHEN 1 THEN credit / CAST(100 AS DOUBLE) WHEN 2 THEN price + CAST(0.01 AS DOUBLE) ELSE price END"


def accounts_as_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, t, k, d (VARIANT) and the hot fields."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("s"), F.col("o_totalprice").cast("double").alias("price"), (millis("o_orderdate") + F.col("o_orderkey")).alias("t"))
    bal = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("s"), F.col("c_acctbal").cast("double").alias("acctbal"))
    rows = orders.join(bal, "s").withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("t"))).withColumn("before", F.lag("price").over(Window.partitionBy("s").orderBy("t")))
    rows = rows.withColumn("credit", F.expr(_CREDIT)).withColumn("shown", F.expr(_SHOWN))
    body = "to_json(named_struct('account', named_struct('code', concat('C', s), 'balanceCents', CAST(round(price * 100) AS BIGINT), 'creditCents', credit, 'orders', n)))"
    events = rows.withColumn("e", F.explode(F.expr(
        f"array(named_struct('j', 0L, 'dt', 0L, 'k', 'net.res', 'd', to_json(named_struct('id', concat('a', k), 'st', 200, 'body', {body}))), "
        "named_struct('j', 1L, 'dt', 500L, 'k', 'ui.num', 'd', to_json(named_struct('region', 'account', 'items', array(named_struct('label', 'Balance', 'value', shown))))))")))
    rows = events.select(F.col("s").alias("session_id"), (F.col("n") * 2 + F.col("e.j")).cast("long").alias("seq"), (F.col("t") + F.col("e.dt")).alias("t"), F.col("e.k").alias("k"), F.expr("parse_json(e.d)").alias("d"), F.when(F.col("e.j") == 0, F.concat(F.lit("a"), F.col("k").cast("string"))).alias("own"), F.when(F.col("e.j") == 0, 200).alias("status"))
    return promote(rows, {"id": F.col("own"), "st": F.col("status")}).drop("own", "status")


#: For DuckDB: one row an order, session_id, t, code, balance, credit (cents), n and shown.
ACCOUNTS_SQL = f"""o AS (SELECT o_orderkey AS k, o_custkey AS s, o_totalprice::DOUBLE AS price, (epoch_us(o_orderdate) // 1000)::BIGINT + o_orderkey AS t, c_acctbal::DOUBLE AS acctbal FROM orders JOIN customer ON c_custkey = o_custkey)
, b AS (SELECT *, row_number() OVER w AS n, lag(price) OVER w AS before, {_CREDIT} AS credit FROM o WINDOW w AS (PARTITION BY s ORDER BY t))
, acc AS (SELECT s AS session_id, t, 'C' || s AS code, CAST(round(price * 100) AS BIGINT) AS balance, credit, n, {_SHOWN} AS shown FROM b)"""


def limits_as_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of a customer as an exchange about the customer's credit limit: every third sets it, the others read it. The limit is the order's price by thousands, of five."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("s"), (F.floor(F.col("o_totalprice").cast("double") / 1000) % 5).cast("long").alias("v"), (millis("o_orderdate") + F.col("o_orderkey")).alias("t"))
    sets = F.col("k") % 3 == 0
    state = F.to_json(F.struct(F.col("s").alias("accountId"), F.col("v").alias("creditLimit")))
    ask = F.to_json(F.struct(F.col("k").cast("string").alias("id"), F.when(sets, "PUT").otherwise("GET").alias("method"), F.concat(F.lit("https://bank.example/api/limits/"), F.col("s").cast("string")).alias("url"), F.when(sets, state).alias("body")))
    answer = F.to_json(F.struct(F.col("k").cast("string").alias("id"), F.lit(200).alias("st"), F.when(sets, F.lit('{"ok":true}')).otherwise(F.concat(F.lit('{"limits":['), state, F.lit("]}"))).alias("body")))
    both = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("j"), F.lit("net.req").alias("k"), ask.alias("d")), F.struct(F.lit(1).cast("long").alias("j"), F.lit("net.res").alias("k"), answer.alias("d"))))
    rows = o.select("s", F.col("k").alias("order"), "t", both.alias("e"))
    return promote(rows.select(F.col("s").alias("session_id"), (F.col("order") * 2 + F.col("e.j")).alias("seq"), (F.col("t") + F.col("e.j")).alias("t"), F.col("e.k").alias("k"), F.expr("parse_json(e.d)").alias("d")))
