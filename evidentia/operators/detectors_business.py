"""Detectors of broken invariants: payments, checkout, carts, inputs, lists, batches, downloads, screen numbers, identities.

They register beside those of `detectors` and follow the same contract. Names of tables and columns are read by what they mean (money, identity,
clock, state), since every application has its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators.detectors import CLOCK_COLUMNS, _marks, answered, detector, field, found, row_image, steady

#: Column names that mean money, and the ending that says whole cents; states of a settled payment.
MONEY = r"(?i)(^|_)(amount|total|subtotal|price|balance|fee|charge)(_|$)|_cents$"
CENTS = r"(?i)_cents$"
SETTLED = ("succeeded", "captured", "paid", "settled", "issued", "completed")
#: Reach of a decline before an order, of a programmatic overwrite, of a reset after an error; candidates of one screen rule.
DECLINE_MS, REVERT_MS, RESET_MS, SCREEN_CAP = 5000, 10_000, 3000, 3
#: Of a reconnect storm: requests of one URL with less than the spacing between them. Of a data call after going back: its delay.
RECONNECTS, RECONNECT_MS, REACT_MS = 6, 1000, 2000
_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
_DOCUMENT = r"(?i)(csv|spreadsheetml|ms-excel|pdf|zip|octet-stream)"


def _num(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def _diffs(events: DataFrame, op: str | None = None) -> DataFrame:
    rows = events.where("k = 'db.diff'") if op is None else events.where((F.col("k") == "db.diff") & (F.col("op") == op))
    return rows.select("session_id", "seq", "t", "request_id", "op", F.lower("table").alias("table"), F.to_json(field("pk", "variant")).alias("pk"), row_image("before").alias("before"), row_image("after").alias("after"))


def _reads(events: DataFrame) -> DataFrame:
    return events.where("k = 'db.read'").select("session_id", "seq", "t", "request_id", F.lower("table").alias("table"), F.to_json(field("pk", "variant")).alias("pk"), row_image("row").alias("row"))


def _json(text: Column) -> Column:
    """A body as JSON text, whether it was kept as an object or as a text."""
    inner = F.get_json_object(F.concat(F.lit('{"b":'), text, F.lit("}")), "$.b")
    return F.when(text.startswith('"'), inner).otherwise(text)


def exchanges(events: DataFrame) -> DataFrame:
    """answered() with `asked` and `told`: the bodies as JSON text; `path`; and the content type and length that the answer declares."""
    heads = events.where("k = 'net.res'").groupBy("session_id", "id").agg(F.max(F.lower(field("hdrs['content-type']"))).alias("type"), F.max(field("hdrs['content-length']", "long")).alias("length"))
    rows = answered(events).join(heads, ["session_id", "id"], "left")
    return rows.withColumn("asked", _json(F.col("body"))).withColumn("told", _json(F.col("answer"))).withColumn("path", X.url_path(F.coalesce("url", F.lit("")))).withColumn("method", F.upper(F.coalesce("method", F.lit("GET"))))


def _map(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def _items(json: Column) -> Column:
    """The members of a list, or of the one list that an object holds."""
    lists = F.filter(F.map_values(_map(json)), lambda v: v.startswith("["))
    text = F.when(json.startswith("["), json).when(F.size(lists) == 1, F.element_at(lists, 1))
    return F.from_json(text, "array<string>")


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


# ---- payments


@detector
def duplicate_charge(events: DataFrame) -> DataFrame:
    rows = _diffs(events, "insert").where(F.col("table").rlike("payment|charge|transaction|settlement")).where(F.lower(F.col("after")["status"]).isin(*SETTLED))
    ref = F.coalesce(F.col("after")["order_id"], F.col("after")["order_ref"], F.col("after")["invoice_id"], F.col("after")["reference"])
    amount = F.coalesce(F.col("after")["amount_cents"], F.col("after")["amount"], F.col("after")["total_cents"])
    g = rows.withColumn("ref", ref).withColumn("amount", amount).where("ref IS NOT NULL AND amount IS NOT NULL").groupBy("session_id", "table", "ref", "amount").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.min("request_id").alias("request_id"))
    return found(g.where("n > 1"), "duplicate_charge", "high", 90, F.concat_ws(" ", "table", "ref", "amount"), F.format_string("%d settled %s rows for %s of %s", "n", "table", "ref", "amount"))


@detector
def money_scale_shift(events: DataFrame) -> DataFrame:
    w = _diffs(events, "update").select("session_id", "t", "request_id", "table", "before", F.explode("after").alias("col", "v")).where(F.col("col").rlike(MONEY))
    a, b = _num(F.col("before")[F.col("col")]), _num(F.col("v"))
    shift = F.greatest(F.abs(a), F.abs(b)) / F.nullif(F.least(F.abs(a), F.abs(b)), F.lit(0.0))
    return found(w.withColumn("x", shift).where("x IN (100.0, 10000.0)"), "money_scale_shift", "high", 84, F.concat_ws(".", "table", "col"), F.format_string("%s moved by exactly %dx to %s", "col", F.col("x").cast("long"), "v"))


@detector
def refund_total_exceeded(events: DataFrame) -> DataFrame:
    totals = _reads(events).where("table RLIKE '^orders?$'").select("session_id", F.col("row")["id"].alias("order_id"), _num(F.col("row")["total_cents"]).alias("total"))
    made = _diffs(events, "insert").where("table RLIKE '^orders?$'").select("session_id", F.col("after")["id"].alias("order_id"), _num(F.col("after")["total_cents"]).alias("total"))
    total = totals.unionByName(made).groupBy("session_id", "order_id").agg(F.max("total").alias("total"))
    refunds = _diffs(events, "insert").where("table RLIKE 'refund'").where(F.lower(F.coalesce(F.col("after")["status"], F.lit("issued"))).isin(*SETTLED))
    order = Window.partitionBy("session_id", "order_id").orderBy("seq")
    upto = refunds.withColumn("order_id", F.col("after")["order_id"]).withColumn("amount", _num(F.col("after")["amount_cents"])).withColumn("refunded", F.sum("amount").over(order))
    return found(upto.join(total, ["session_id", "order_id"]).where("refunded > total"), "refund_total_exceeded", "high", 88, F.concat(F.lit("order "), F.col("order_id")), F.format_string("refunds of %.0f exceed the total of %.0f", "refunded", "total"))


@detector
def duplicate_restock(events: DataFrame) -> DataFrame:
    """One order item put back on the shelf by two requests."""
    items = _reads(events).where("table RLIKE 'order_?(item|line)s?'").select("session_id", "request_id", F.col("row")["order_id"].alias("order_id"), F.col("row")["product_id"].alias("product_id"), _num(F.coalesce(F.col("row")["qty"], F.col("row")["quantity"])).alias("qty")).distinct()
    stock = lambda image: _num(F.coalesce(F.col(image)["inventory"], F.col(image)["stock"], F.col(image)["stock_count"]))
    up = _diffs(events, "update").select("session_id", "t", "request_id", F.col("after")["id"].alias("product_id"), (stock("after") - stock("before")).alias("delta")).where("delta > 0")
    back = up.join(items, ["session_id", "request_id", "product_id"]).where("delta = qty")
    g = back.groupBy("session_id", "order_id", "product_id").agg(F.countDistinct("request_id").alias("n"), F.max("t").alias("t"), F.max("request_id").alias("request_id"))
    return found(g.where("n > 1"), "duplicate_restock", "high", 86, F.concat_ws(" ", "order_id", "product_id"), F.format_string("restocked by %d requests", "n"))


def _calls(events: DataFrame, service: str) -> DataFrame:
    """Calls to a service, told by the back end that made them or by the gateway that they went through."""
    return events.where("k IN ('backend.http', 'gateway.http')").where(F.lower(field("service")).rlike(service)).select("session_id", "seq", "t", "request_id", field("status", "int").alias("status"), F.coalesce(field("errorKind"), F.lit("")).alias("error"), field("totalCents", "double").alias("total"), F.lower(F.coalesce(field("chargeStatus"), F.lit(""))).alias("charge"), F.coalesce(field("orderId"), field("order_id")).alias("of"))


def _orders(events: DataFrame) -> DataFrame:
    return _diffs(events, "insert").where("table RLIKE '^orders?$'").select("session_id", F.col("seq").alias("order_seq"), F.col("t").alias("order_t"), "request_id", _num(F.col("after")["total_cents"]).alias("order_total"), F.coalesce(F.col("after")["id"], F.lit("")).alias("order_id"))


@detector
def declined_payment_ordered(events: DataFrame) -> DataFrame:
    """An order written soon after its charge was declined: the last charge that names the order, or else the session's last that names none."""
    order = Window.partitionBy("session_id").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("session_id", "order_id").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    calls = _calls(events, "payment|charge|gateway").select("session_id", "seq", "t", F.col("charge").isin("declined", "failed", "rejected").alias("declined"), F.lit(None).cast("string").alias("request_id"), F.coalesce("of", F.lit("")).alias("order_id"))
    both = calls.unionByName(_orders(events).select("session_id", F.col("order_seq").alias("seq"), F.col("order_t").alias("t"), F.lit(None).cast("boolean").alias("declined"), "request_id", "order_id"))
    charge = F.when(F.col("declined").isNotNull(), F.struct("declined", "t"))
    last = both.withColumn("own", F.last(charge, ignorenulls=True).over(own)).withColumn("any", F.last(F.when(F.col("order_id") == "", charge), ignorenulls=True).over(order)).withColumn("last", F.coalesce("own", "any"))
    bad = last.where(F.col("declined").isNull() & F.col("last.declined") & (F.col("t") - F.col("last.t") <= DECLINE_MS))
    return found(bad, "declined_payment_ordered", "high", 88, F.concat(F.lit("order "), F.col("order_id")), F.lit("an order was written after its charge was declined"))


@detector
def pricing_total_ignored_by_checkout(events: DataFrame) -> DataFrame:
    m = _calls(events, "pricing").where("status BETWEEN 200 AND 299 AND total IS NOT NULL").join(_orders(events), ["session_id", "request_id"]).where("order_t >= t AND order_total <> total")
    return found(m.withColumn("t", F.col("order_t")), "pricing_total_ignored_by_checkout", "high", 88, F.concat(F.lit("order "), F.col("order_id")), F.format_string("ordered at %.0f, priced at %.0f", "order_total", "total"))


@detector
def checkout_committed_after_pricing_timeout(events: DataFrame) -> DataFrame:
    m = _calls(events, "pricing").where("error = 'timeout'").join(_orders(events), ["session_id", "request_id"]).where("order_t >= t")
    return found(m.withColumn("t", F.col("order_t")), "checkout_committed_after_pricing_timeout", "high", 86, F.concat(F.lit("order "), F.col("order_id")), F.lit("committed without a price"))


@detector
def downstream_succeeded_after_timeout(events: DataFrame) -> DataFrame:
    """A call that the caller gave up on, and a later span or call of the same request that succeeded."""
    out = events.where("k = 'backend.http'").select("session_id", F.col("seq").alias("s0"), "request_id", field("service").alias("service"), field("errorKind").alias("error")).where("error = 'timeout' AND request_id IS NOT NULL")
    good = events.where("k IN ('backend.otel.span', 'backend.http')").select("session_id", "seq", "t", F.coalesce("request_id", field("traceId")).alias("request_id"), F.coalesce(field("serviceName"), field("service")).alias("service"), F.coalesce(field("statusCode"), F.lit("")).alias("code"), field("status", "int").alias("status"))
    m = out.join(good.where("code = 'OK' OR status BETWEEN 200 AND 299"), ["session_id", "request_id", "service"]).where("seq > s0")
    return found(m, "downstream_succeeded_after_timeout", "high", 80, F.concat_ws(" ", "request_id", "service"), F.lit("it went through after the caller gave up"))


@detector
def order_committed_with_negative_inventory(events: DataFrame) -> DataFrame:
    level = _num(F.coalesce(F.col("after")["inventory"], F.col("after")["stock"], F.col("after")["stock_count"]))
    low = _diffs(events, "update").where(level < 0).select("session_id", "request_id", F.col("table").alias("of")).distinct()
    m = _orders(events).join(low, ["session_id", "request_id"]).withColumn("t", F.col("order_t"))
    return found(m, "order_committed_with_negative_inventory", "high", 88, F.concat(F.lit("order "), F.col("order_id")), F.concat(F.lit("stock below zero in "), F.col("of")))


# ---- carts and sessions


def _carts(events: DataFrame) -> DataFrame:
    r = exchanges(events).where(F.col("path").rlike("(?i)/cart$") & (F.col("method") == "GET") & (F.col("st") < 400))
    return r.select("session_id", "t", "request_id", _items(F.col("told")).alias("items")).where("items IS NOT NULL")


@detector
def cart_lost_after_session_expiry(events: DataFrame) -> DataFrame:
    """A cart that was filled before a session row was deleted in a request, and empty after."""
    ends = _diffs(events, "delete").where("table RLIKE '(^|_)sessions?$'").select("session_id", "t", F.lit(1).alias("gone"), "request_id", F.lit(None).cast("array<string>").alias("items"))
    rows = ends.unionByName(_carts(events).select("session_id", "t", F.lit(0).alias("gone"), "request_id", "items"))
    back = Window.partitionBy("session_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("gone_t", F.max(F.when(F.col("gone") == 1, F.col("t"))).over(back)).withColumn("was", F.last(F.when(F.col("gone") == 0, F.struct("t", F.size("items").alias("n"))), ignorenulls=True).over(back))
    bad = seen.where("gone = 0 AND size(items) = 0 AND was.n > 0 AND gone_t > was.t")
    return found(bad, "cart_lost_after_session_expiry", "high", 84, F.lit("cart"), F.format_string("%d lines before the session ended, none after", "was.n"))


@detector
def cart_remerged_on_login(events: DataFrame) -> DataFrame:
    """A second login that merged lines and left the cart with more than before it."""
    logins = exchanges(events).where(F.col("path").rlike("(?i)login") & (_num(_map(F.col("told"))["mergedLines"]) > 0)).select("session_id", "t", F.lit(1).alias("login"), "request_id", F.lit(0).alias("n"))
    rows = logins.unionByName(_carts(events).select("session_id", "t", F.lit(0).alias("login"), "request_id", F.size("items").alias("n")))
    back = Window.partitionBy("session_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("logins", F.sum("login").over(back)).withColumn("last_login", F.max(F.when(F.col("login") == 1, F.col("t"))).over(back)).withColumn("was", F.last(F.when(F.col("login") == 0, F.struct("t", "n")), ignorenulls=True).over(back))
    return found(seen.where("login = 0 AND logins >= 2 AND was.t < last_login AND n > was.n AND was.n > 0"), "cart_remerged_on_login", "high", 80, F.lit("cart"), F.format_string("%d lines grew to %d by logging in again", "was.n", "n"))


# ---- rows


@detector
def duplicate_readback(events: DataFrame) -> DataFrame:
    told = lambda m: F.map_filter(m, lambda k, v: ~k.rlike(r"^(id|uuid|.*_at|.*_on|created|updated)$"))
    anchor = F.map_filter("row", lambda k, v: k.rlike(r".+_(id|ref)$") & v.isNotNull())
    rows = _reads(events).where(F.size(anchor) > 0).withColumn("body", F.to_json(F.array_sort(F.map_entries(told(F.col("row"))))))
    g = rows.groupBy("session_id", "table", "body").agg(F.countDistinct(F.coalesce(F.col("row")["id"], F.col("pk"))).alias("n"), F.min("t").alias("t"), F.min("request_id").alias("request_id"))
    return found(g.where("n > 1"), "duplicate_readback", "medium", 66, F.concat_ws(" ", "table", "body"), F.format_string("%d %s rows are identical on every business column", "n", "table"))


@detector
def orphaned_reference(events: DataFrame) -> DataFrame:
    """A reference written null before its parent was inserted."""
    ins = _diffs(events, "insert")
    null = ins.select("session_id", "seq", "t", "request_id", "table", F.explode("after").alias("col", "v")).where(F.col("v").isNull() & F.col("col").rlike("_id$"))
    null = null.withColumn("parent", F.regexp_replace(F.col("col"), "_id$", ""))
    parents = ins.select("session_id", F.regexp_replace("table", "(es|s)$", "").alias("parent"), F.col("seq").alias("pseq"), F.col("t").alias("pt"))
    m = null.join(parents, ["session_id", "parent"]).groupBy("session_id", "seq", "t", "request_id", "table", "col").agg(F.min("pseq").alias("first"), F.min("pt").alias("pt")).where("first > seq")
    return found(m, "orphaned_reference", "medium", 68, F.concat_ws(".", "table", "col"), F.format_string("the parent was written %d ms AFTER", F.col("pt") - F.col("t")))


@detector
def counter_contradiction(events: DataFrame) -> DataFrame:
    """A finished row whose expected, claimed or total count exceeds what it says was written or returned."""
    rows = _diffs(events).where("op <> 'delete'").where(~F.lower(F.coalesce(F.col("after")["status"], F.lit("done"))).isin("pending", "running", "queued", "processing", "started"))
    counts = rows.withColumn("c", F.map_filter("after", lambda k, v: ~k.rlike(MONEY.replace("|total", "")) & v.rlike(r"^[0-9]+$")))
    pick = lambda pattern: F.array_max(F.transform(F.map_values(F.map_filter("c", lambda k, v: k.rlike(pattern))), lambda v: v.try_cast("long")))
    m = counts.withColumn("want", pick(r"(?i)(_expected|_claimed|rows_total|_planned)$")).withColumn("got", pick(r"(?i)(_written|_returned|_applied|_processed)$")).where("want > got")
    return found(m, "counter_contradiction", "medium", 64, F.concat_ws(" ", "table", "pk", F.col("after")["id"]), F.format_string("%s of %d expected, %d done", F.concat_ws(", ", F.map_keys("c")), "want", "got"))


@detector
def derived_count_below_observed_inserts(events: DataFrame) -> DataFrame:
    """A cached count below the rows that this session inserted for the same parent."""
    ins = _diffs(events, "insert").select("session_id", "seq", F.explode(F.map_filter("after", lambda k, v: k.rlike(".+_id$") & v.isNotNull())).alias("col", "v"))
    cache = _diffs(events, "update").select("session_id", F.col("seq").alias("cseq"), "t", "request_id", "table", "after", F.explode("after").alias("count_col", "n")).where(F.col("count_col").rlike("_count$") & F.col("n").rlike(r"^[0-9]+$"))
    keyed = cache.select("session_id", "cseq", "t", "request_id", "table", "count_col", F.col("n").try_cast("long").alias("n"), F.explode(F.map_filter("after", lambda k, v: k.rlike(".+_id$") & v.isNotNull())).alias("col", "v"))
    m = keyed.join(ins, ["session_id", "col", "v"]).where("seq < cseq").groupBy("session_id", "cseq", "t", "request_id", "table", "count_col", "n", "col", "v").agg(F.count("*").alias("seen")).where("seen > n")
    return found(m, "derived_count_below_observed_inserts", "medium", 66, F.concat_ws(" ", "table", "count_col", "v"), F.format_string("%d counted, %d inserted", "n", "seen"))


@detector
def order_totals_diverge(events: DataFrame) -> DataFrame:
    """Rows of one request that disagree: a payment that does not cover its order."""
    pay = _diffs(events, "insert").where("table RLIKE 'payment|charge'").select("session_id", "request_id", F.col("after")["order_id"].alias("order_id"), _num(F.coalesce(F.col("after")["amount_cents"], F.col("after")["amount"])).alias("paid"))
    m = _orders(events).join(pay, ["session_id", "request_id", "order_id"]).where("paid <> order_total").withColumn("t", F.col("order_t"))
    return found(m, "db_field_divergence", "high", 90, F.concat(F.lit("order "), F.col("order_id")), F.format_string("ordered for %.0f, paid %.0f", "order_total", "paid"))


@detector
def same_request_row_rewritten(events: DataFrame) -> DataFrame:
    """One row written twice in a request that carried several, each write from what the one before left."""
    by = Window.partitionBy("session_id", "request_id", "table", "pk").orderBy("seq")
    body = exchanges(events).where(F.col("asked").contains("\\n") | F.col("asked").contains("\n")).select("session_id", "request_id").distinct()
    w = _diffs(events, "update").join(body, ["session_id", "request_id"]).withColumn("n", F.row_number().over(by)).where("n = 2")
    return found(w, "same_request_row_rewritten", "high", 82, F.concat_ws(" ", "table", "pk", "request_id"), F.lit("rows of one upload met in one row"))


# ---- requests against rows


def _money_asked(events: DataFrame) -> DataFrame:
    """Numbers that a request's body names as money: session_id, request_id, name, asked."""
    return exchanges(events).where("request_id IS NOT NULL AND asked LIKE '{%'").select("session_id", "request_id", F.explode(_map(F.col("asked"))).alias("name", "v")).where(F.col("name").rlike(MONEY)).select("session_id", "request_id", "name", _num(F.col("v")).alias("asked")).where("asked IS NOT NULL")


def _money_written(events: DataFrame) -> DataFrame:
    return _diffs(events).where("op <> 'delete'").select("session_id", "t", "request_id", "table", F.explode("after").alias("col", "v")).where(F.col("col").rlike(MONEY)).withColumn("wrote", _num(F.col("v"))).where("wrote IS NOT NULL")


@detector
def db_client_supplied_value(events: DataFrame) -> DataFrame:
    m = _money_written(events).join(_money_asked(events), ["session_id", "request_id"]).where("wrote = asked AND abs(asked) >= 100")
    return found(m, "db_client_supplied_value", "high", 84, F.concat_ws(".", "table", "col"), F.format_string("%s.%s took %s=%s from the request", "table", "col", "name", "v"))


@detector
def fractional_cent_rounding(events: DataFrame) -> DataFrame:
    m = _money_written(events).where(F.col("col").rlike(CENTS)).join(_money_asked(events), ["session_id", "request_id"]).where("asked <> floor(asked) AND wrote = floor(wrote) AND abs(wrote - asked) < 1")
    return found(m, "fractional_cent_rounding", "high", 80, F.concat_ws(".", "table", "col"), F.format_string("%s=%s became %s.%s=%s", "name", F.col("asked").cast("string"), "table", "col", "v"))


@detector
def db_unrequested_clear(events: DataFrame) -> DataFrame:
    """A partial update that emptied a column its request never named, while it changed one that was."""
    w = _diffs(events, "update").select("session_id", "seq", "t", "request_id", "table", "before", F.explode("after").alias("col", "v")).where(~F.col("col").rlike(CLOCK_COLUMNS))
    w = w.withColumn("was", F.col("before")[F.col("col")]).where("NOT (was <=> v)")
    named = exchanges(events).where("request_id IS NOT NULL AND asked LIKE '{%'").select("session_id", "request_id", F.transform(F.map_keys(_map(F.col("asked"))), _plain).alias("names"))
    m = w.join(named, ["session_id", "request_id"]).withColumn("mine", F.expr("array_contains(names, regexp_replace(lower(col), '[^a-z0-9]', ''))"))
    told = m.groupBy("session_id", "seq").agg(F.concat_ws(", ", F.collect_set(F.when(F.col("mine"), F.col("col")))).alias("changed")).where("changed <> ''")
    bad = m.where("NOT mine AND (v IS NULL OR v = '') AND was <> ''").join(told, ["session_id", "seq"])
    return found(bad, "db_unrequested_clear", "high", 82, F.concat_ws(".", "table", "col"), F.concat(F.lit("emptied by a request that set "), F.col("changed")))


@detector
def response_count_mismatch(events: DataFrame) -> DataFrame:
    named = F.map_filter(_map(F.col("told")), lambda k, v: k.rlike(r"(?i)^(updated|inserted|deleted|created|changed|affected)(_?(count|rows))?$") & v.rlike(r"^[0-9]+$"))
    r = exchanges(events).where("st < 400 AND request_id IS NOT NULL AND told LIKE '{%'").withColumn("c", named).where(F.size("c") == 1).select("session_id", "t", "request_id", F.element_at(F.map_keys("c"), 1).alias("name"), F.element_at(F.map_values("c"), 1).try_cast("long").alias("said"))
    op = F.when(F.col("name").rlike("(?i)^(inserted|created)"), "insert").when(F.col("name").rlike("(?i)^deleted"), "delete").otherwise("update")
    rows = _diffs(events).groupBy("session_id", "request_id", "op").agg(F.countDistinct("table", "pk").alias("rows"))
    m = r.withColumn("op", op).join(rows, ["session_id", "request_id", "op"]).where("said > rows")
    return found(m, "response_count_mismatch", "high", 80, F.concat_ws(" ", "request_id", "name"), F.format_string("said %s=%d, %d rows changed", "name", "said", "rows"))


@detector
def db_delta_mismatch(events: DataFrame) -> DataFrame:
    """A request's quantity for one product, and the row of it that moved by another amount in its one numeric column."""
    asked = exchanges(events).where("request_id IS NOT NULL AND asked IS NOT NULL")
    lines = asked.select("session_id", "request_id", F.explode(F.coalesce(_items(F.col("asked")), F.array(F.col("asked")))).alias("line")).select("session_id", "request_id", _map(F.col("line")).alias("m"))
    lines = lines.select("session_id", "request_id", F.coalesce(F.col("m")["productId"], F.col("m")["product_id"], F.col("m")["itemId"]).alias("id"), _num(F.coalesce(F.col("m")["qty"], F.col("m")["quantity"])).alias("qty")).where("id IS NOT NULL AND qty IS NOT NULL")
    want = lines.groupBy("session_id", "request_id", "id").agg(F.sum("qty").alias("qty"))
    moved = F.map_filter(steady(F.col("after")), lambda k, v: v.rlike(_NUMBER) & F.col("before")[k].rlike(_NUMBER) & (F.col("before")[k] != v))
    w = _diffs(events, "update").withColumn("moved", moved).where(F.size("moved") == 1).select("session_id", "t", "request_id", "table", F.coalesce(F.get_json_object("pk", "$.id"), F.col("after")["id"]).alias("id"), F.element_at(F.map_keys("moved"), 1).alias("col"), "before", "after")
    delta = F.abs(_num(F.col("after")[F.col("col")]) - _num(F.col("before")[F.col("col")]))
    m = w.withColumn("delta", delta).groupBy("session_id", "request_id", "table", "id", "col").agg(F.sum("delta").alias("delta"), F.min("t").alias("t")).join(want, ["session_id", "request_id", "id"]).where("delta <> qty")
    return found(m, "db_delta_mismatch", "medium", 72, F.concat_ws(" ", "table", "id", "col"), F.format_string("asked for %.0f, moved by %.0f", "qty", "delta"))


@detector
def accepted_text_was_truncated(events: DataFrame) -> DataFrame:
    """A text that a successful request sent and the row keeps only the beginning of."""
    sent = exchanges(events).where("st < 400 AND request_id IS NOT NULL AND asked LIKE '{%'").select("session_id", "request_id", F.explode(_map(F.col("asked"))).alias("name", "full")).withColumn("key", _plain(F.col("name")))
    kept = _diffs(events).where("op <> 'delete'").select("session_id", "t", "request_id", "table", F.explode("after").alias("col", "v")).withColumn("key", _plain(F.col("col")))
    m = sent.join(kept, ["session_id", "request_id", "key"]).where(F.col("v").isNotNull() & (F.length("v") >= 8) & (F.length("full") > F.length("v")) & F.col("full").startswith(F.col("v")))
    return found(m, "accepted_text_was_truncated", "high", 78, F.concat_ws(".", "table", "col"), F.format_string("%d characters sent, %d kept", F.length("full"), F.length("v")))


# ---- lists and filters


@detector
def result_row_loss(events: DataFrame) -> DataFrame:
    """Rows of one table that a reading request read and its answer's one list does not hold."""
    lists = exchanges(events).where("method = 'GET' AND st < 400 AND request_id IS NOT NULL").select("session_id", "t", "request_id", _items(F.col("told")).alias("items")).where("items IS NOT NULL")
    read = _reads(events).groupBy("session_id", "request_id").agg(F.countDistinct("table").alias("tables"), F.max("table").alias("table"), F.countDistinct("pk").alias("rows")).where("tables = 1 AND rows > 1")
    m = lists.join(read, ["session_id", "request_id"]).where("size(items) < rows AND size(items) > 0")
    return found(m, "result_row_loss", "high", 78, F.concat_ws(" ", "request_id", "table"), F.format_string("%d of %d rows read from %s are missing", F.col("rows") - F.size("items"), "rows", "table"))


@detector
def response_exceeded_requested_limit(events: DataFrame) -> DataFrame:
    limit = F.regexp_extract("url", r"[?&](?:limit|per_?page|page_?size)=([0-9]+)", 1)
    lists = exchanges(events).where("method = 'GET' AND st < 400").withColumn("limit", limit).where("limit <> ''").select("session_id", "t", "request_id", "path", F.col("limit").try_cast("int").alias("limit"), _items(F.col("told")).alias("items"))
    return found(lists.where("size(items) > limit AND limit > 0"), "response_exceeded_requested_limit", "medium", 66, F.col("path"), F.format_string("%d asked for, %d returned", "limit", F.size("items")))


@detector
def filter_contradiction(events: DataFrame) -> DataFrame:
    """A row read for a request that defies one of its equality filters."""
    query = F.str_to_map(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&"), F.lit("="))
    asked = exchanges(events).where("method = 'GET' AND request_id IS NOT NULL AND url LIKE '%?%'").select("session_id", "request_id", F.explode(query).alias("name", "value"))
    asked = asked.where(~F.lower("name").rlike(r"^(q|query|search|term|sort|order|orderby|dir|page|per_?page|limit|offset|cursor|after|before|skip|fields|include|view)$|(_?(min|max|from|to|gte?|lte?|since|until))$|^(min|max|from|to)") & ~F.col("value").rlike(r"REDACTED|%5B|^$"))
    asked = asked.groupBy("session_id", "request_id", "name").agg(F.flatten(F.collect_list(F.split(F.lower("value"), ","))).alias("values"))
    rows = _reads(events).select("session_id", "t", "request_id", "table", F.explode("row").alias("col", "v")).where("v IS NOT NULL")
    equal = rows.join(asked.withColumn("key", _plain(F.col("name"))), ["session_id", "request_id"]).where(F.expr("key = regexp_replace(lower(col), '[^a-z0-9]', '') AND NOT array_contains(values, lower(v))"))
    stock = rows.where(F.col("col").rlike("(?i)^(inventory|stock|stock_count)$") & (_num(F.col("v")) <= 0)).join(asked.where(F.lower("name").isin("instock", "in_stock", "available") & F.array_contains("values", "true")), ["session_id", "request_id"]).withColumn("key", F.lower("name"))
    return found(equal.unionByName(stock.select(equal.columns)), "filter_contradiction", "high", 76, F.concat_ws(" ", "request_id", "name"), F.format_string("%s is %s", "col", "v"))


def _root(path: Column) -> Column:
    return F.regexp_extract(path, r"^(/(?:api/)?[^/?]+)", 1)


@detector
def shared_state_bleed(events: DataFrame) -> DataFrame:
    """Two reads of one URL that disagree in their items, no write of this session between, in an area that it wrote to before."""
    x = exchanges(events).where("st < 400 AND t IS NOT NULL").withColumn("root", _root(F.col("path")))
    reads = x.where("method = 'GET'").select("session_id", "t", "request_id", "root", "url", F.array_sort(_items(F.col("told"))).alias("items")).where("items IS NOT NULL")
    pair = Window.partitionBy("session_id", "url").orderBy("t")
    two = reads.withColumn("was", F.lag(F.struct("t", "items")).over(pair)).where("was IS NOT NULL AND was.items <> items")
    writes = x.where("method NOT IN ('GET', 'HEAD')").select("session_id", "root", F.col("t").alias("w"))
    m = two.join(writes, ["session_id", "root"]).groupBy("session_id", "root", "url", "t", "request_id", "was", "items").agg(F.count_if(F.col("w") <= F.col("was.t")).alias("before"), F.count_if((F.col("w") > F.col("was.t")) & (F.col("w") <= F.col("t"))).alias("between"))
    return found(m.where("before > 0 AND between = 0"), "shared_state_bleed", "high", 74, F.col("url"), F.format_string("returned %d then %d items", F.size("was.items"), F.size("items")))


@detector
def acknowledged_write_lost(events: DataFrame) -> DataFrame:
    """Equal adds that were acknowledged, and a later read of the collection that holds fewer than they add up to."""
    x = exchanges(events).where("st < 400 AND t IS NOT NULL AND asked IS NULL OR st < 400 AND t IS NOT NULL")
    qty = lambda m: _num(F.coalesce(m["qty"], m["quantity"]))
    total = lambda items: F.aggregate(items, F.lit(0.0), lambda a, i: a + F.coalesce(qty(_map(i)), F.lit(1.0)))
    reads = x.where("method = 'GET'").withColumn("items", _items(F.col("told"))).where("items IS NOT NULL").select("session_id", "path", "t", "request_id", total(F.col("items")).alias("held"), F.lit(0.0).alias("added"), F.lit("").alias("body"))
    adds = x.where("method = 'POST' AND asked LIKE '{%'").select("session_id", "path", "t", "request_id", F.lit(None).cast("double").alias("held"), F.coalesce(qty(_map(F.col("asked"))), F.lit(1.0)).alias("added"), F.col("asked").alias("body"))
    order = Window.partitionBy("session_id", "path").orderBy("t")
    rows = reads.unionByName(adds).withColumn("read_no", F.sum(F.when(F.col("held").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    block = rows.withColumn("read_no", F.coalesce("read_no", F.lit(0))).groupBy("session_id", "path", "read_no").agg(F.count_if(F.col("held").isNull()).alias("acks"), F.countDistinct(F.when(F.col("held").isNull(), F.col("body"))).alias("kinds"), F.sum("added").alias("added"), F.max("held").alias("held"), F.max("t").alias("t"), F.max("request_id").alias("request_id"))
    was = F.lag("held").over(Window.partitionBy("session_id", "path").orderBy("read_no"))
    m = block.withColumn("was", was).where("acks >= 2 AND kinds = 1 AND held IS NOT NULL AND was IS NOT NULL AND held < was + added AND held >= was")
    return found(m, "acknowledged_write_lost", "high", 82, F.col("path"), F.format_string("%d POSTs were acknowledged, the collection shows %.0f", "acks", "held"))


# ---- batches and files


@detector
def acknowledged_batch_rows_missing(events: DataFrame) -> DataFrame:
    """A success answer that claims more applied rows than it describes."""
    m = _map(F.col("told"))
    r = exchanges(events).where("st < 400 AND told LIKE '{%'").withColumn("applied", _num(m["applied"])).withColumn("rows", F.from_json(m["rows"], "array<string>")).withColumn("errors", F.from_json(m["errors"], "array<string>"))
    bad = r.where("applied IS NOT NULL AND rows IS NOT NULL AND size(rows) < applied")
    return found(bad, "acknowledged_batch_rows_missing", "high", 78, F.col("path"), F.format_string("%.0f applied, %d described", "applied", F.size("rows")))


@detector
def download_empty_body(events: DataFrame) -> DataFrame:
    bad = exchanges(events).where(F.col("type").rlike(_DOCUMENT) & (F.col("length") == 0) & F.col("st").between(200, 299) & (F.col("st") != 204) & (F.col("method") != "HEAD"))
    return found(bad, "download_empty_body", "high", 76, F.col("path"), F.concat(F.col("type"), F.lit(" with nothing in it")))


@detector
def content_type_body_mismatch(events: DataFrame) -> DataFrame:
    bad = exchanges(events).where(F.col("type").rlike(_DOCUMENT) & (F.col("st") < 300) & F.col("told").rlike(r"^[\[{]") & ~F.col("told").contains("[REDACTED]"))
    return found(bad, "content_type_body_mismatch", "high", 74, F.col("path"), F.concat(F.lit("JSON served as "), F.col("type")))


@detector
def api_route_returned_document(events: DataFrame) -> DataFrame:
    bad = exchanges(events).where(F.col("path").rlike("(?i)(^|/)api/") & F.col("type").startswith("text/html") & (F.col("st") < 300))
    return found(bad, "api_route_returned_document", "medium", 66, F.col("path"), F.lit("a data route answered with a page"))


# ---- inputs and screen


def _inputs(events: DataFrame) -> DataFrame:
    return events.where("k = 'inp'").select("session_id", "seq", "t", "request_id", F.coalesce(field("el.name"), field("el.path")).alias("name"), field("trusted", "boolean").alias("trusted"), F.coalesce(field("valSummary.originalLength", "int"), F.length(field("val"))).alias("n"), field("val").alias("val"), F.coalesce(field("ev"), F.lit("input")).alias("ev"))


@detector
def input_reverted(events: DataFrame) -> DataFrame:
    """What the user typed, cleared, shortened or replaced by the page within ten seconds."""
    w = Window.partitionBy("session_id", "name").orderBy("t", "seq")
    m = _inputs(events).where("name IS NOT NULL AND trusted IS NOT NULL AND ev NOT IN ('submit', 'state')").withColumn("was", F.lag(F.struct("t", "n", "val", "trusted")).over(w))
    shorter = (F.col("n") < F.col("was.n")) | ((F.col("n") == F.col("was.n")) & (F.col("val") != F.col("was.val")))
    bad = m.where(~F.col("trusted") & F.col("was.trusted") & (F.col("was.n") > 0) & shorter & (F.col("t") - F.col("was.t") <= REVERT_MS))
    return found(bad, "input_reverted", "high", 72, F.col("name"), F.format_string("%s after %d ms", F.when(F.col("n") == 0, "cleared the field").otherwise("took the value back"), F.col("t") - F.col("was.t")))


@detector
def form_reset_after_error(events: DataFrame) -> DataFrame:
    """Several fields emptied by the page soon after a failed answer to a submit."""
    marks = events.where("(k = 'net.res' AND st >= 400) OR k = 'inp'").withColumn("e", F.when(F.col("k") == "net.res", "fail").when(field("ev") == "submit", "submit"))
    back = Window.partitionBy("session_id").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumn("submit_t", F.max(F.when(F.col("e") == "submit", F.col("t"))).over(back)).withColumn("fail_t", F.max(F.when(F.col("e") == "fail", F.col("t"))).over(back)).select("session_id", "seq", "submit_t", "fail_t")
    cleared = _inputs(events).where("ev = 'state' AND NOT trusted AND n = 0").join(seen, ["session_id", "seq"]).where(f"fail_t > submit_t AND t - fail_t <= {RESET_MS}")
    g = cleared.groupBy("session_id", "fail_t").agg(F.countDistinct("name").alias("n"), F.min("t").alias("t"), F.max("request_id").alias("request_id")).where("n > 1")
    return found(g, "form_reset_after_error", "medium", 66, F.concat(F.lit("form "), F.col("fail_t").cast("string")), F.format_string("%d fields were emptied after an error", "n"))


@detector
def click_target_intercepted(events: DataFrame) -> DataFrame:
    covered = F.to_json(field("covered", "variant"))
    bad = events.where("k = 'clk'").withColumn("covered", covered).where("covered IS NOT NULL AND covered <> '[]'")
    pct = F.coalesce(field("box.viewportPct", "int"), F.lit(0))
    return found(bad, "click_target_intercepted", "medium", F.when(pct >= 50, 68).otherwise(60), F.coalesce(field("el.path"), F.lit("")), F.format_string("received a click meant for what it covers, %d%% of the viewport", pct))


def _numbers(events: DataFrame) -> DataFrame:
    items = F.from_json(F.to_json(field("items", "variant")), "array<struct<label:string,value:double,unit:string>>")
    return events.where("k = 'ui.num'").select("session_id", "seq", "t", "request_id", field("region").alias("region"), field("lang").alias("lang"), items.alias("items"))


@detector
def ui_arithmetic_mismatch(events: DataFrame) -> DataFrame:
    """A total on the screen that its parts do not make, by more than a cent for each part. Screens with two totals or subtotals say nothing."""
    is_ = lambda i, pattern: F.lower(i["label"]).rlike(pattern)
    total = F.filter("items", lambda i: is_(i, r"^(grand |order )?total\b|^amount due"))
    base = F.filter("items", lambda i: is_(i, r"^sub-?total"))
    plus = F.filter("items", lambda i: is_(i, r"^(tax|vat|shipping|delivery|fee|service|tip)\b"))
    minus = F.filter("items", lambda i: is_(i, r"discount|coupon|promo|credit"))
    sums = lambda c: F.aggregate(c, F.lit(0.0), lambda a, i: a + F.abs(i["value"]))
    m = _numbers(events).withColumn("total", total).withColumn("base", base).where("size(total) = 1 AND size(base) = 1").withColumn("parts", sums(F.col("base")) + sums(plus) - sums(minus)).withColumn("n", F.size("base") + F.size(plus) + F.size(minus))
    bad = m.where("n > 1").where(F.abs(F.col("total")[0]["value"] - F.col("parts")) > 0.01 * F.col("n") + 1e-6)
    said = F.concat_ws(", ", F.transform("items", lambda i: F.concat(i["label"], F.lit(":"), F.regexp_replace(i["value"].cast("string"), r"\.0$", ""))))
    return found(bad, "ui_arithmetic_mismatch", "medium", 60, F.coalesce("region", F.lit("screen")), said)


#: Currency that a page's language leads one to expect.
LOCALE_CURRENCY = {"de": "€", "fr": "€", "it": "€", "es": "€", "nl": "€", "en-gb": "£", "en-us": "$", "ja": "¥", "hi": "₹"}


@detector
def currency_locale_mismatch(events: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("lang", F.lit("")))
    table = F.create_map(*[F.lit(x) for p in LOCALE_CURRENCY.items() for x in p])
    want = F.coalesce(table[low], table[F.regexp_extract(low, "^([a-z]+)", 1)])
    each = _numbers(events).withColumn("want", want).where("want IS NOT NULL").select("session_id", "seq", "t", "request_id", "lang", "want", F.explode("items").alias("i")).where(F.col("i.unit").isin("$", "€", "£", "¥", "₹"))
    g = each.where("i.unit <> want").groupBy("session_id", "lang", "want", F.col("i.unit").alias("unit")).agg(F.count("*").alias("n"), F.min("t").alias("t"), F.min("request_id").alias("request_id"))
    return found(g.where("n > 1"), "currency_locale_mismatch", "medium", 48, F.concat_ws(" ", "lang", "unit"), F.format_string("%d amounts in %s on a page of lang %s (a heuristic)", "n", "unit", "lang"))


@detector
def stale_view_after_pop(events: DataFrame) -> DataFrame:
    """Going back to other parameters of a page that refetched on parameters before, with no data call after."""
    to = F.coalesce(field("to"), "url", F.lit(""))
    navs = events.where("k = 'nav'").withColumn("page", X.url_path(to)).withColumn("query", F.regexp_extract(to, r"\?([^#]*)", 1)).withColumn("how", F.coalesce(field("type"), field("how"), F.lit("")))
    calls = events.where("k = 'net.req'").where(X.url_path(F.coalesce("url", F.lit(""))).rlike("(?i)/api/"))
    rows = navs.select("session_id", "seq", "t", "request_id", "page", "query", "how").unionByName(calls.select("session_id", "seq", "t", "request_id", F.lit(None).cast("string").alias("page"), F.lit(None).cast("string").alias("query"), F.lit("call").alias("how")))
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    seen = rows.withColumn("was", F.last(F.when(F.col("how") != "call", F.struct("page", "query")), ignorenulls=True).over(before)).withColumn("call_t", F.first(F.when(F.col("how") == "call", F.col("t")), ignorenulls=True).over(after))
    moved = seen.where("how <> 'call' AND was.page = page AND was.query <> query").withColumn("reacts", F.coalesce(F.col("call_t") - F.col("t") <= REACT_MS, F.lit(False)))
    proved = moved.withColumn("proved", F.max(F.col("reacts")).over(Window.partitionBy("session_id", "page").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)))
    return found(proved.where("how = 'pop' AND NOT reacts AND proved"), "stale_view_after_pop", "high", 70, F.col("page"), F.lit("no API request followed; the URL and the screen disagree"))


@detector
def ineffective_submit(events: DataFrame) -> DataFrame:
    """A submit after which the session sent no request and went nowhere."""
    rows = events.where("k IN ('inp', 'net.req', 'nav')").withColumn("submit", (F.col("k") == "inp") & (F.coalesce(field("ev"), F.lit("")) == "submit"))
    after = Window.partitionBy("session_id").orderBy("t", "seq").rowsBetween(1, Window.unboundedFollowing)
    bad = rows.withColumn("next", F.min(F.when(F.col("k") != "inp", F.col("t"))).over(after)).where(F.col("submit") & (F.col("next").isNull() | (F.col("next") - F.col("t") > REACT_MS)))
    return found(bad, "ineffective_submit", "medium", 58, F.coalesce(field("el.name"), field("el.path"), F.lit("form")), F.lit("nothing followed the submit"))


# ---- identities, connections, builds


@detector
def casefold_duplicate_identity_accepted(events: DataFrame) -> DataFrame:
    """Accounts made under names that are one but for case: equal folded hashes of redacted values, or equal lower-case texts."""
    made = _diffs(events, "insert").where("table RLIKE '^(users?|accounts?|members?)$'").select("session_id", "request_id").distinct()
    sent = exchanges(events).where("st < 400 AND request_id IS NOT NULL AND asked LIKE '{%'").select("session_id", "t", "request_id", F.explode(_map(F.col("asked"))).alias("name", "v")).where(F.lower("name").isin("email", "username", "login"))
    fold, raw = F.coalesce(F.get_json_object("v", "$.casefoldHash8"), F.get_json_object("v", "$.hash8"), F.lower("v")), F.coalesce(F.get_json_object("v", "$.hash8"), F.col("v"))
    g = sent.join(made, ["session_id", "request_id"]).groupBy("session_id", "name", fold.alias("fold")).agg(F.countDistinct(raw).alias("n"), F.max("t").alias("t"), F.max("request_id").alias("request_id"))
    return found(g.where("n > 1"), "casefold_duplicate_identity_accepted", "high", 82, F.concat_ws(" ", "name", "fold"), F.lit("accepted twice in other case"))


@detector
def request_reconnect_storm(events: DataFrame) -> DataFrame:
    r = events.where("k = 'net.req' AND upper(coalesce(method, 'GET')) = 'GET' AND url IS NOT NULL")
    w = Window.partitionBy("session_id", "url").orderBy("t", "seq")
    runs = r.withColumn("new", (F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(10**9)) > RECONNECT_MS).cast("int")).withColumn("run", F.sum("new").over(w))
    g = runs.groupBy("session_id", "url", "run").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.min("request_id").alias("request_id"))
    return found(g.where(F.col("n") >= RECONNECTS), "request_reconnect_storm", "medium", 64, F.col("url"), F.format_string("%d requests without a pause", "n"))


@detector
def stale_client_build(events: DataFrame) -> DataFrame:
    """A client that reports another build than the server it talks to."""
    client = events.where("k = 'env'").groupBy("session_id").agg(F.max_by(F.coalesce(field("build"), field("release")), "seq").alias("mine"))
    server = events.where("k = 'net.res'").select("session_id", "t", "request_id", F.coalesce(field("hdrs['x-build']"), field("hdrs['x-app-version']"), field("hdrs['x-release']")).alias("theirs")).where("theirs IS NOT NULL")
    g = server.join(client.where("mine IS NOT NULL"), "session_id").where("mine <> theirs").groupBy("session_id", "mine", "theirs").agg(F.min("t").alias("t"), F.min("request_id").alias("request_id"))
    return found(g, "stale_client_build", "medium", 60, F.concat_ws(" ", "mine", "theirs"), F.format_string("client %s, server %s", "mine", "theirs"))


@detector
def otel_db_activity(events: DataFrame) -> DataFrame:
    """Spans on a data store close to an error of the session."""
    error = F.col("k").isin("err", "rej", "net.err", "backend.req.error")
    store = (F.col("k") == "backend.otel.span") & F.coalesce(field("attributes['db.system']"), field("attributes['db.statement']")).isNotNull()
    reach = Window.partitionBy("session_id").orderBy("t").rangeBetween(-2000, 2000)
    near = events.where(error | store).withColumn("near", F.max(error).over(reach)).where(store & F.col("near"))
    return found(near, "otel_db_activity", "low", 45, F.concat_ws(" ", field("traceId"), field("spanId")), F.coalesce(field("name"), F.lit("database span")))


for _m in (("media_degradation", "media.degraded", "low", 40), ("tab_boundary_gap", "tab.gap", "low", 35), ("transcript_complaint", "media.complaint", "medium", 55)):
    _marks(*_m)


# ---- ranking


#: Hosts of trackers; what a demoted finding may score; boost of a finding for each severe symptom, and the most it may gain.
TRACKER_HOSTS = r"(?i)://([a-z0-9-]+\.)*(google-analytics\.com|googletagmanager\.com|doubleclick\.net|segment\.(io|com)|mixpanel\.com|hotjar\.com|sentry\.io|facebook\.net)(/|$|:)"
HANDLED_SCORE, TRACKER_SCORE, BOOST_EACH, MOST_BOOST = 30, 15, 3, 12
#: Ranking points that a thread loses if all of its evidence is older than the user's last action, and those it gains for being caused by it, halved with each hop.
STALE_THREAD, CAUSED_BY_ACTION = 15, 8


def demote(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Findings that only look bad: refusals that the application answered in its own words, and noise of trackers. They sink, they do not go."""
    refused = exchanges(events).where("st IN (400, 401, 403, 404, 409, 422)").where(_map(F.col("told"))["error"].isNotNull() | _map(F.col("told"))["errors"].isNotNull())
    handled = refused.select("session_id", F.concat_ws(" ", X.endpoint_key("method", F.coalesce("url", F.lit(""))), F.col("st").cast("string")).alias("subject")).distinct().withColumn("handled", F.lit(True))
    beacon = events.where("k = 'net.err'").where(F.coalesce("url", F.lit("")).rlike(TRACKER_HOSTS)).select("session_id", "t").distinct().withColumn("tracker", F.lit(True))
    rows = candidates.join(handled, ["session_id", "subject"], "left").join(beacon, ["session_id", "t"], "left")
    sinks_h = (F.col("detector") == "http_error") & F.coalesce("handled", F.lit(False))
    sinks_t = F.col("detector").isin("network_error", "unhandled_rejection", "uncaught_error") & F.coalesce("tracker", F.lit(False))
    score = F.when(sinks_t, F.least("score", F.lit(TRACKER_SCORE))).when(sinks_h, F.least("score", F.lit(HANDLED_SCORE))).otherwise(F.col("score"))
    return rows.withColumn("score", score.cast("int")).withColumn("severity", F.when(sinks_h | sinks_t, "low").otherwise(F.col("severity"))).drop("handled", "tracker")


def last_actions(events: DataFrame) -> DataFrame:
    """session_id, action_t, action_seq: the last thing that the user did. A session without one has no row."""
    trusted = F.coalesce(field("trusted", "boolean"), F.lit(True))
    done = events.where(F.col("k").isin("clk", "key") | ((F.col("k") == "inp") & trusted))
    return done.groupBy("session_id").agg(F.max(F.struct(F.col("t").cast("long").alias("t"), F.col("seq").cast("long").alias("seq"))).alias("a")).select("session_id", F.col("a.t").alias("action_t"), F.col("a.seq").alias("action_seq"))


def reached_by(nodes: DataFrame, edges: DataFrame, action: DataFrame, owned: DataFrame) -> DataFrame:
    """session_id, id, hops: owned nodes whose causes lead back to the session's action node, and over how many hops.

    action(session_id, id) and owned(session_id, id) are nodes of the causal graph; the walk back ends at another finding, which carries the thread on.
    """
    from evidentia.operators.graph import roots

    ends = owned.select("session_id", "id").unionByName(action.select("session_id", "id")).distinct()
    hit = roots(nodes, edges, ends).join(action.select("session_id", F.col("id").alias("root")), ["session_id", "root"], "left_semi")
    return hit.groupBy("session_id", "id").agg(F.min("hops").alias("hops"))


def rank_candidates(candidates: DataFrame, links: DataFrame, actions: DataFrame | None = None, reach: DataFrame | None = None) -> DataFrame:
    """Order of the findings; the stored score stays. links(session_id, id, root, sure): symptoms with their roots.

    A root gains a little for every severe symptom. A symptom that is surely its root's joins its chain, which stands together where its
    strongest member would; an unsure link binds nothing. A chain whose last evidence is older than the user's last action (of `last_actions`) sinks, as it
    is more likely the application's ordinary state; one that the action caused (of `reached_by`) rises. Without an action neither happens.
    """
    c = candidates.withColumnRenamed("candidate_id", "id")
    bound = links.where("sure >= 2").select("session_id", "id", "root")
    boost = bound.join(c.where("severity IN ('high', 'critical')").select("session_id", "id"), ["session_id", "id"]).groupBy("session_id", F.col("root").alias("id")).agg(F.least(F.lit(MOST_BOOST), F.count("*") * BOOST_EACH).alias("boost"))
    w = c.join(boost, ["session_id", "id"], "left").join(bound, ["session_id", "id"], "left").withColumn("weight", F.col("score") + F.coalesce("boost", F.lit(0))).withColumn("chain", F.coalesce("root", "id"))
    thread = Window.partitionBy("session_id", "chain")
    gain = F.lit(0.0)
    if actions is not None:
        w = w.join(actions.select("session_id", "action_t"), "session_id", "left").withColumn("fresh", F.coalesce(F.max("t").over(thread) >= F.col("action_t"), F.lit(True)))
        gain -= F.when(F.col("fresh"), 0.0).otherwise(float(STALE_THREAD))
    if reach is not None:
        w = w.join(reach.select("session_id", "id", "hops"), ["session_id", "id"], "left").withColumn("caused", F.coalesce(F.max(CAUSED_BY_ACTION / F.pow(F.lit(2.0), F.col("hops") - 1)).over(thread), F.lit(0.0)))
        gain += F.col("caused")
    chained = w.withColumn("lead", F.max("weight").over(thread) + gain).withColumn("chain_t", F.min("t").over(thread))
    order = Window.partitionBy("session_id").orderBy(F.desc("lead"), "chain_t", "chain", F.col("root").isNotNull(), F.desc("weight"), "t", "id")
    return chained.withColumn("rank", F.row_number().over(order)).drop("lead", "chain_t", "root", "boost", "action_t", "fresh", "hops", "caused")
