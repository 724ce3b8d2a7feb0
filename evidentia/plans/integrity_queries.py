"""Queries of the integrity detectors over telemetry that Spark derives from the shared tables, and brute-force statements of them in DuckDB.

What is found follows from the tables' own values (prices that move, dates in another order than planned), not from planted keys.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.functions import source_maps as M
from evidentia.operators import detectors as D
from evidentia.operators import detectors_values as W
from evidentia.operators import patterns as P
from evidentia.operators import row_versions as V
from evidentia.plans.queries import HOUR, _read, _tel_sql, query
from evidentia.sources.accounts import ACCOUNTS_SQL, accounts_as_telemetry, limits_as_exchanges
from evidentia.sources.commerce import ORDERS_SQL, orders_as_telemetry
from evidentia.sources.ledger import LEDGER_SQL, STOCK_BEFORE, ledger_as_telemetry
from evidentia.sources.telemetry import events_as_telemetry

#: One amount in two units, as the detectors have it.
_SAME = "(abs({a} - {b}) <= 0.01 + 1e-9 OR (greatest(abs({a}), abs({b})) = floor(greatest(abs({a}), abs({b}))) AND abs(greatest(abs({a}), abs({b})) - 100 * least(abs({a}), abs({b}))) <= 1e-6 * greatest(abs({a}), abs({b}), 1) AND sign({a}) = sign({b})))"
_OFF = f"NOT {_SAME.format(a='v', b='f.amount')} AND NOT {_SAME.format(a='v', b='f.value')}"


@query(f"""
WITH {ACCOUNTS_SQL}
, f AS (SELECT session_id, t, code, unnest(['balance', 'credit', 'orders']) AS words, unnest([balance / 100.0::DOUBLE, credit / 100.0::DOUBLE, n::DOUBLE]) AS amount, unnest([balance::DOUBLE, credit::DOUBLE, n::DOUBLE]) AS value, unnest([true, true, false]) AS minor FROM acc)
, lab AS (SELECT session_id, t + 500 AS t, 'balance' AS words, shown AS v FROM acc)
, cur AS (SELECT lab.*, f.amount, f.value, f.code, f.t AS at FROM lab JOIN f ON f.session_id = lab.session_id AND f.words = lab.words AND f.t <= lab.t QUALIFY row_number() OVER (PARTITION BY lab.session_id, lab.t ORDER BY f.t DESC) = 1)
, off AS (SELECT f.* FROM cur AS f WHERE {_OFF})
, runs AS (SELECT session_id, code, words, amount, lead(amount) OVER w AS nxt, lead(t) OVER w AS until FROM f WINDOW w AS (PARTITION BY session_id, code, words ORDER BY t))
, stale AS (SELECT DISTINCT o.session_id, o.v FROM off o JOIN runs r ON r.session_id = o.session_id AND r.code = o.code AND r.words = o.words AND r.until <= o.t AND abs(r.nxt - r.amount) > 0.01 + 1e-9 AND abs(o.v - r.amount) <= 0.01 + 1e-9 * greatest(abs(o.v), 1))
, other AS (SELECT DISTINCT o.session_id, o.v FROM off o JOIN f ON f.session_id = o.session_id AND f.t = o.at AND f.words <> o.words AND (abs(o.v - f.amount) <= 0.01 + 1e-9 * greatest(abs(o.v), 1) OR (NOT f.minor AND abs(o.v - f.value / 100) <= 0.01 + 1e-9 * greatest(abs(o.v), 1))))
, spread AS (SELECT lab.session_id, lab.t, max(f.amount) - min(f.amount) AS d FROM lab JOIN f ON f.session_id = lab.session_id AND f.words = lab.words AND f.t <= lab.t GROUP BY ALL)
, apart AS (SELECT DISTINCT o.session_id FROM off o JOIN spread s USING (session_id, t) WHERE s.d <= 0.01 + 1e-9)
SELECT session_id, detector, count(*)::BIGINT AS n FROM (SELECT session_id, 'stale_value_rendered' AS detector FROM stale UNION ALL SELECT session_id, 'displayed_field_mismatch' FROM other UNION ALL SELECT session_id, 'ui_api_divergence' FROM apart) GROUP BY ALL""")
def screen_findings(spark, sf_dir):
    """What accounts showed against what their responses said."""
    found = D.run_detectors(accounts_as_telemetry(spark, sf_dir), ["stale_value_rendered", "displayed_field_mismatch", "ui_api_divergence"], scans=1)
    return found.groupBy("session_id", "detector").agg(F.count("*").alias("n"))


@query(f"""
WITH {LEDGER_SQL}
, w AS (SELECT s, l_partkey, stock, stock_before, place * 8 + 2 AS seq FROM li2 WHERE stock <> stock_before)
, f AS (SELECT DISTINCT s, l_partkey FROM li)
, v AS (SELECT s, l_partkey, seq, stock AS value, 'update' AS op FROM w UNION ALL SELECT s, l_partkey, NULL, {STOCK_BEFORE}, NULL FROM f)
SELECT s AS session_id, l_partkey::VARCHAR AS pk, value::VARCHAR AS value, op, seq AS begins, lead(seq) OVER (PARTITION BY s, l_partkey ORDER BY seq NULLS FIRST) AS ends FROM v""")
def stock_history(spark, sf_dir):
    """Every value that a product's stock held, and when."""
    return V.column_versions(ledger_as_telemetry(spark, sf_dir)).where("table = 'products' AND col = 'inventory'").select("session_id", "pk", "value", "op", "begins", "ends")


@query(f"""
WITH {LEDGER_SQL}
, cols AS (SELECT s, l_partkey, place, l_orderkey, unnest(['inventory', 'total_cents']) AS col, unnest([stock, total]) AS v, unnest([stock_before, total_before]) AS was FROM li2)
, ch AS (SELECT *, lag(was) OVER w AS replaced, lag(l_orderkey) OVER w AS maker FROM cols WHERE v <> was WINDOW w AS (PARTITION BY s, l_partkey, col ORDER BY place))
, stale AS (SELECT s FROM ch WHERE v = replaced AND l_orderkey <> maker)
, moved AS (SELECT DISTINCT a.s, a.l_orderkey, a.moved FROM li a WHERE a.moved <> a.l_partkey + 1 AND a.moved = a.l_orderkey)
, rep AS (SELECT s FROM li2 WHERE total <> total_before)
, upd AS (SELECT s, l_orderkey, audited, 'products' AS tab, l_partkey::VARCHAR AS pk FROM li UNION ALL SELECT s, l_orderkey, audited, 'order_items', l_orderkey || '-' || l_linenumber FROM li)
, aud AS (SELECT s FROM upd WHERE audited <> tab GROUP BY s, l_orderkey, tab HAVING count(DISTINCT pk) >= 2)
SELECT s AS session_id, detector, count(*)::BIGINT AS n FROM (
  SELECT s, 'stale_value_writeback' AS detector FROM stale UNION ALL SELECT s, 'existing_children_reparented_to_new_row' FROM moved
  UNION ALL SELECT s, 'report_total_contradicts_source_row' FROM rep UNION ALL SELECT s, 'mutations_missing_entity_audit' FROM aud) GROUP BY ALL""")
def relational_findings(spark, sf_dir):
    """Broken relations between the rows of the ledger, all from one table of versions."""
    names = ["stale_value_writeback", "existing_children_reparented_to_new_row", "report_total_contradicts_source_row", "mutations_missing_entity_audit"]
    found = D.run_detectors(ledger_as_telemetry(spark, sf_dir), names, scans=1)
    return found.groupBy("session_id", "detector").agg(F.count("*").alias("n"))


#: Orders of what a user did to the items of one shelf: a request, a click and an answer in time; a request answered without a click between;
#: and a click, an error anywhere in the session, and an answer.
SHELF_PATTERNS = [
    P.Pattern("asked_clicked_answered", (P.Step(("net.req",)), P.Step(("clk",), within_ms=96 * HOUR), P.Step(("net.res",), within_ms=48 * HOUR))),
    P.Pattern("answered_unclicked", (P.Step(("net.req",)), P.Step(("net.res",))), forbidden=("clk",)),
    P.Pattern("clicked_error_answered", (P.Step(("clk",)), P.Step(("err",), of_session=True), P.Step(("net.res",), within_ms=72 * HOUR))),
]


@query(_tel_sql(f"""
, r AS (SELECT session_id AS s, id % 5 AS e, t, seq, k FROM tel), x AS (SELECT s, t, seq FROM r WHERE k = 'err')
, ab AS (SELECT b.* FROM r b WHERE k = 'clk' AND EXISTS (SELECT 1 FROM r a WHERE a.s = b.s AND a.e = b.e AND a.k = 'net.req' AND (a.t, a.seq) < (b.t, b.seq) AND b.t - a.t <= 96 * {HOUR}))
, p1 AS (SELECT c.* FROM r c WHERE k = 'net.res' AND EXISTS (SELECT 1 FROM ab b WHERE b.s = c.s AND b.e = c.e AND (b.t, b.seq) < (c.t, c.seq) AND c.t - b.t <= 48 * {HOUR}))
, p2 AS (SELECT DISTINCT b.* FROM r a JOIN r b ON a.s = b.s AND a.e = b.e AND a.k = 'net.req' AND b.k = 'net.res' AND (a.t, a.seq) < (b.t, b.seq)
   WHERE NOT EXISTS (SELECT 1 FROM r c WHERE c.s = a.s AND c.e = a.e AND c.k = 'clk' AND (c.t, c.seq) > (a.t, a.seq) AND (c.t, c.seq) < (b.t, b.seq)))
, p3 AS (SELECT DISTINCT b.* FROM r a JOIN r b ON a.s = b.s AND a.e = b.e AND a.k = 'clk' AND b.k = 'net.res' AND (a.t, a.seq) < (b.t, b.seq) AND b.t - a.t <= 72 * {HOUR}
   WHERE EXISTS (SELECT 1 FROM x WHERE x.s = a.s AND (x.t, x.seq) > (a.t, a.seq) AND (x.t, x.seq) < (b.t, b.seq)))
SELECT s AS session_id, e AS entity, pattern, t, seq FROM (SELECT 'asked_clicked_answered' AS pattern, s, e, t, seq FROM p1 UNION ALL SELECT 'answered_unclicked', s, e, t, seq FROM p2 UNION ALL SELECT 'clicked_error_answered', s, e, t, seq FROM p3)"""))
def shelf_patterns(spark, sf_dir):
    """Ordered patterns over what each user did to the items of a shelf."""
    rows = events_as_telemetry(spark, sf_dir).select("session_id", (F.col("id") % 5).alias("entity"), "t", "seq", F.col("k").alias("symbol"))
    return P.match_patterns(rows, SHELF_PATTERNS).drop("first_t")


@query("""
WITH o AS (SELECT o_custkey AS s, o_orderkey AS k, o_orderkey % 3 = 0 AS sets, floor(o_totalprice::DOUBLE / 1000)::BIGINT % 5 AS v, (epoch_us(o_orderdate) // 1000)::BIGINT + o_orderkey AS t FROM orders)
SELECT a.s AS session_id, b.t + 1 AS t, b.k::VARCHAR AS request_id, a.v AS was_set, b.v AS was_read FROM o a JOIN o b ON a.s = b.s AND a.sets AND NOT b.sets AND a.t < b.t AND a.v <> b.v
WHERE NOT EXISTS (SELECT 1 FROM o c WHERE c.s = a.s AND c.t > a.t AND c.t < b.t)""")
def contradicted_limits(spark, sf_dir):
    """Reads of a credit limit that tell another value than was set just before."""
    found = W.acknowledged_state_contradicted_by_read(limits_as_exchanges(spark, sf_dir))
    said = lambda pattern: F.regexp_extract("message", pattern, 1).cast("long")
    return found.select("session_id", "t", "request_id", said("was set to ([0-9]+)").alias("was_set"), said("read as ([0-9]+)").alias("was_read"))


@query(f"""
WITH {ORDERS_SQL}
, w AS (SELECT s, 'orders' AS "table", unnest(['id', 'user_id', 'total', 'total_cents', 'status']) AS col FROM o UNION ALL SELECT s, 'order_items', unnest(['order_id', 'part_id', 'quantity', 'price']) FROM lineitem JOIN o ON l_orderkey = k)
, r AS (SELECT s, 'orders' AS "table", unnest(['id', 'user_id']) AS col FROM o WHERE k % 3 = 0)
, u AS (SELECT *, 1 AS w FROM w UNION ALL SELECT *, 0 FROM r)
SELECT s AS session_id, "table", col, sum(w)::BIGINT AS written, 0::BIGINT AS written_empty, (count(*) - sum(w))::BIGINT AS read, 0::BIGINT AS read_empty FROM u GROUP BY ALL""")
def column_usage(spark, sf_dir):
    """How often each session wrote and read each column of its orders."""
    return W.column_ledger(orders_as_telemetry(spark, sf_dir)).where("table IN ('orders', 'order_items')")


def _map_of(table: pa.Table) -> pa.Table:
    """One file's segments as a source map."""
    rows = np.column_stack([table[c].to_numpy().astype(np.int64, casting="safe") for c in ("line", "column", "source", "source_line", "source_column")])
    text = json.dumps({"version": 3, "sources": ["webpack://shop/./src/a.ts", "src/b.ts", "./c.ts"], "names": [], "mappings": M.encode_array(rows[np.lexsort(rows.T[::-1])])})
    return pa.table({"file": [f"f{table['file'][0].as_py()}.js"], "map": [text]})


@query("""
WITH s AS (SELECT l_suppkey AS f, l_linenumber AS line, l_partkey % 900 + 1 AS col, min(l_orderkey) AS o FROM lineitem GROUP BY ALL)
, fr AS (SELECT o_orderkey AS k, o_custkey % 120 AS f, (o_orderkey % 8 + 1)::INT AS line, (o_orderkey % 1000 + 1)::INT AS col FROM orders)
SELECT fr.k AS frame, 'f' || fr.f || '.js' AS file, ['src/a.ts', 'src/b.ts', 'c.ts'][(s.o % 3 + 1)::INT] AS source, (s.o % 500 + 1)::INT AS source_line, (s.o % 70 + 1)::INT AS source_column
FROM fr ASOF LEFT JOIN s ON fr.f = s.f AND fr.line = s.line AND fr.col >= s.col""")
def placed_frames(spark, sf_dir):
    """Frames made of the orders, placed in source maps made of the line items, one map a supplier."""
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file"), (F.col("l_linenumber") - 1).alias("line"), (F.col("l_partkey") % 900).alias("column")).agg(F.min("l_orderkey").alias("o"))
    lines = lines.select("file", "line", "column", (F.col("o") % 3).alias("source"), (F.col("o") % 500).alias("source_line"), (F.col("o") % 70).alias("source_column"))
    mapped = M.segments(lines.groupBy("file").applyInArrow(_map_of, "file string, map string"))
    k = F.col("o_orderkey")
    frames = _read(spark, sf_dir, "orders").select(k.alias("frame"), F.concat(F.lit("f"), (F.col("o_custkey") % 120).cast("string"), F.lit(".js")).alias("file"), (k % 8 + 1).alias("line"), (k % 1000 + 1).alias("column"))
    return M.place_frames(frames, mapped).select("frame", "file", "source", "source_line", "source_column")
