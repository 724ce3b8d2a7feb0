"""Detectors that hold values against each other: columns written against columns read, acknowledged state against the next read, inputs against their
effects, uploads against the rows they wrote, and values of one locale read in another."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators.detectors import detector, field, found, row_image, shared
from evidentia.operators.detectors_business import SCREEN_CAP, _json, _map, exchanges
from evidentia.operators.row_versions import after_images, row_changes, snake

#: Reads of a table from which on a column that none of them has is one that nothing reads.
LEAST_READS = 3
#: Rows of an upload that must have taken the next row's value: one may be chance.
SHIFTED_ROWS = 2
_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
#: Fields that are never quoted, input names with a response field that shows their effect, and words of an action that commits.
SENSITIVE = r"(?i)pass|token|secret|auth|card|cvv|cvc|pin$|ssn|otp|key$"
EFFECTS = {"coupon": ("discount", "savings"), "promo": ("discount", "savings"), "voucher": ("discount", "savings"), "discount": ("discount", "savings"), "gift": ("gift",), "referral": ("referral", "credit"), "note": ("note",), "message": ("message",)}
COMMIT_WORDS = r"(?i)\b(checkout|confirm|purchase|pay|place|submit|book|reserve|order|buy)"
#: Countries whose postal codes are five digits, and languages that write a comma before the fraction.
FIVE_DIGITS = ("us", "usa", "united states")


def _empty(v: Column) -> Column:
    return v.isNull() | v.isin("", "null", "[]", "{}")


# ---- columns


def column_ledger(events: DataFrame) -> DataFrame:
    """session_id, table, col, written, written_empty, read, read_empty: how often each column was written and read, and how often with nothing in it."""
    w = after_images(events).select("session_id", "table", F.explode("after").alias("col", "v"))
    r = events.where("k = 'db.read'").select("session_id", F.lower("table").alias("table"), F.explode(F.array(row_image("row"))).alias("row")).select("session_id", "table", F.explode("row").alias("col", "v"))
    both = w.withColumn("reads", F.lit(False)).unionByName(r.withColumn("reads", F.lit(True)))
    own = F.col("reads")
    return both.groupBy("session_id", "table", "col").agg(F.count_if(~own).alias("written"), F.count_if(~own & _empty(F.col("v"))).alias("written_empty"), F.count_if(own).alias("read"), F.count_if(own & _empty(F.col("v"))).alias("read_empty"))


@detector
def db_write_read_column_split(events: DataFrame) -> DataFrame:
    """A value written to a column that no read names, while the column of the like name that the reads do name was left empty by the write and is
    empty in every one of several reads."""
    led = shared(events, "column_ledger", column_ledger)
    reads = events.where("k = 'db.read'").groupBy("session_id", F.lower("table").alias("table")).agg(F.count("*").alias("reads")).where(F.col("reads") >= LEAST_READS)
    rows = row_changes(events).where("op <> 'delete'").join(reads, ["session_id", "table"])
    full = F.map_filter("after", lambda k, v: ~_empty(v))
    bare = F.map_keys(F.map_filter("after", lambda k, v: _empty(v)))
    pairs = rows.select("session_id", "table", "t", "seq", "request_id", F.explode(F.map_keys(full)).alias("col"), bare.alias("bare"))
    like = F.filter("bare", lambda b: F.col("col").startswith(F.concat(b, F.lit("_"))) | b.startswith(F.concat(F.col("col"), F.lit("_"))))
    pairs = pairs.withColumn("sibling", F.explode(like))
    hit = pairs.join(led.where("read = 0").select("session_id", "table", "col"), ["session_id", "table", "col"])
    hit = hit.join(led.where("read > 0 AND read = read_empty").select("session_id", "table", F.col("col").alias("sibling"), "read"), ["session_id", "table", "sibling"]).where(F.col("read") >= LEAST_READS)
    g = hit.groupBy("session_id", "table", "col", "sibling").agg(F.min(F.struct("t", "seq", "request_id")).alias("f"), F.max("read").alias("n")).select("session_id", "table", "col", "sibling", "n", "f.*")
    return found(g, "db_write_read_column_split", "high", 82, F.concat_ws(".", "table", "col"), F.format_string("%s.%s is written and never read; %d reads select %s.%s, which is always empty", "table", "col", "n", "table", "sibling"))


# ---- acknowledged state


def records_of(body: str | None) -> Iterator[tuple[str, str, str, str]]:
    """(name of the key, key, field, value) of every plain field of every record of a JSON text that has a key: id, or a name that ends in Id or _id.

    A record with several keys has its facts under each. Values are texts; marks that stand for redacted values are no values.
    """
    try:
        root = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += reversed(node)
        elif isinstance(node, dict) and "$redacted" not in node:
            todo += [v for v in reversed(node.values()) if isinstance(v, list | dict)]
            plain = {k: v for k, v in node.items() if isinstance(v, str | int | float | bool)}
            keys = [k for k, v in plain.items() if (k in ("id", "uuid") or k.endswith(("Id", "_id"))) and not isinstance(v, bool)]
            for key in keys:
                for k, v in plain.items():
                    if k not in keys:
                        yield key, str(plain[key]), k, json.dumps(v)


def _record_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, cells = [], []
        for i, body in enumerate(batch.column("told").to_pylist()):
            for cell in records_of(body):
                rows.append(i)
                cells.append(cell)
        kept = batch.drop_columns(["told"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array([c[n] for c in cells], pa.string()) for n in range(4)]], names=[*kept.schema.names, "key_name", "key", "field", "value"])


def acknowledged_facts(events: DataFrame) -> DataFrame:
    """session_id, t, seq, root, request_id, writes, nth, key_name, key, field, value: what accepted mutations said about a record and what reads under the same
    API root told of it. `nth` counts the root's accepted mutations so far, this one included."""
    rows = exchanges(events).where("t IS NOT NULL AND coalesce(st, 200) BETWEEN 200 AND 299").withColumn("writes", ~F.col("method").isin("GET", "HEAD"))
    rows = rows.withColumn("root", F.regexp_extract("path", r"^((?:/api(?:/v\d+)?)?/[^/]+)", 1)).where("root <> ''").withColumn("place", F.when(F.col("writes"), F.coalesce("sent", "t")).otherwise(F.col("t")).cast("long"))
    upto = Window.partitionBy("session_id", "root").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.count_if("writes").over(upto)).withColumn("any", F.max("writes").over(Window.partitionBy("session_id", "root"))).where("any")
    bodies = rows.select("session_id", F.col("place").alias("t"), "root", F.coalesce("request_id", "id").alias("request_id"), "writes", "nth", F.when(F.col("writes"), F.col("asked")).otherwise(F.col("told")).alias("told")).where("told IS NOT NULL")
    kind = bodies.schema["session_id"].dataType.simpleString()
    return bodies.mapInArrow(_record_task, f"session_id {kind}, t long, root string, request_id string, writes boolean, nth long, key_name string, key string, field string, value string")


@detector
def acknowledged_state_contradicted_by_read(events: DataFrame) -> DataFrame:
    """A read that tells another value than the accepted mutation before it set. Any accepted mutation of the API root in between cancels, as its effects are not known."""
    order = Window.partitionBy("session_id", "root", "key_name", "key", "field").orderBy("t", "writes", "request_id")
    f = acknowledged_facts(events).withColumn("before", F.lag(F.struct("writes", "nth", "value", "request_id")).over(order))
    same = (F.col("before.value") == F.col("value")) | F.coalesce(F.col("before.value").try_cast("double") == F.col("value").try_cast("double"), F.lit(False))
    hit = f.where(~F.col("writes") & F.col("before.writes") & (F.col("before.nth") == F.col("nth")) & ~same)
    return found(hit, "acknowledged_state_contradicted_by_read", "high", 84, F.concat_ws(" ", "root", "key_name", "key", "field"), F.format_string("%s of %s %s was set to %s by %s and read as %s", "field", "key_name", "key", "before.value", "before.request_id", "value"))


# ---- inputs


@detector
def ineffective_input(events: DataFrame) -> DataFrame:
    """An accepted input with nothing to show for it: the response's field of its effect is zero or missing, and no row of a table of its name was
    written. A hint: the first of each field, and the first few of a session."""
    x = exchanges(events).where("method <> 'GET' AND st BETWEEN 200 AND 299 AND asked LIKE '{%' AND told LIKE '{%'").withColumn("request_id", F.coalesce("request_id", "id"))
    x = x.select("session_id", "request_id", "st", F.coalesce("sent", "t").cast("long").alias("t"), F.map_filter(_map(F.col("told")), lambda k, v: v.isNotNull()).alias("told"), F.explode(_map(F.col("asked"))).alias("name", "v"))
    plain = (F.length(F.trim("v")) > 0) & ~F.col("v").rlike(r"^[\[{]|^(true|false|null)$") & ~F.col("v").contains("[REDACTED]") & ~F.col("v").rlike(_NUMBER)
    x = x.where(plain & ~F.col("name").rlike(SENSITIVE)).withColumn("words", F.split(snake(F.col("name")), "_"))
    names = F.create_map(*[y for k, v in EFFECTS.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    x = x.withColumn("stem", F.get(F.filter("words", lambda w: names[w].isNotNull()), F.lit(0))).where("stem IS NOT NULL").withColumn("effects", names[F.col("stem")])
    shown = F.exists(F.map_entries("told"), lambda e: F.exists("effects", lambda w: F.lower(e["key"]).contains(w)) & ~e["value"].isin("0", "0.0", "0.00", "", "null", "false", "[]", "{}"))
    tables = row_changes(events).where("request_id IS NOT NULL").groupBy("session_id", "request_id").agg(F.collect_set("table").alias("tables"))
    hit = x.where(~shown).join(tables, ["session_id", "request_id"], "left").where(~F.coalesce(F.exists("tables", lambda t: t.contains(F.col("stem"))), F.lit(False)))
    once = hit.groupBy("session_id", "name").agg(F.min(F.struct("t", "request_id", "stem", "st")).alias("f")).select("session_id", "name", "f.*")
    few = once.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("t", "name"))).where(F.col("n") <= SCREEN_CAP)
    return found(few, "ineffective_input", "medium", 55, F.col("name"), F.format_string("%s was accepted (%d), but nothing shows an effect of the %s", "name", "st", "stem"))


@detector
def batch_value_shift(events: DataFrame) -> DataFrame:
    """An upload whose rows were written with the values of the rows that follow them, several of them and none with its own."""
    body = exchanges(events).where("method <> 'GET'").withColumn("request_id", F.coalesce("request_id", "id"))
    text = F.coalesce(F.get_json_object("asked", "$.csv"), F.get_json_object("asked", "$.data"), F.when(~F.col("asked").rlike(r"^\s*[\[{]"), _json(F.col("asked"))))
    lines = body.withColumn("csv", text).where(F.col("csv").contains("\n") & F.col("csv").contains(",")).select("session_id", "request_id", F.split("csv", r"\r?\n").alias("lines"))
    heads = F.transform(F.split(F.col("lines")[0], ","), lambda c: F.lower(F.trim(c)))
    rows = lines.withColumn("heads", heads).select("session_id", "request_id", "heads", F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("at", "line")).where(F.length(F.trim("line")) > 0)
    cells = rows.withColumn("cells", F.transform(F.split("line", ","), lambda c: F.trim(c))).select("session_id", "request_id", "at", F.col("cells")[0].alias("name"), F.explode(F.arrays_zip("heads", "cells")).alias("c"))
    cells = cells.select("session_id", "request_id", "at", "name", F.col("c.heads").alias("col"), F.col("c.cells").alias("own"))
    cells = cells.withColumn("next", F.lead("own").over(Window.partitionBy("session_id", "request_id", "col").orderBy("at"))).where("own <> name")
    # the row that a line is about is found by the line's first value
    w = row_changes(events).where("op = 'update' AND request_id IS NOT NULL").select("session_id", "request_id", "t", "table", "after", F.explode("after").alias("col", "value"))
    w = w.select("session_id", "request_id", "t", "table", F.lower("col").alias("col"), "value", F.explode(F.array_distinct(F.map_values("after"))).alias("name"))
    m = w.join(cells, ["session_id", "request_id", "name", "col"]).where(F.col("own") != F.coalesce("next", F.lit("")))
    g = m.groupBy("session_id", "request_id", "table", "col").agg(F.count_if(F.col("value") == F.col("next")).alias("moved"), F.count_if(F.col("value") == F.col("own")).alias("right"), F.min("t").alias("t"))
    return found(g.where((F.col("moved") >= SHIFTED_ROWS) & (F.col("right") == 0)), "batch_value_shift", "high", 86, F.concat_ws(" ", "request_id", "table", "col"), F.format_string("%d rows were written with the next row's %s", "moved", "col"))


@detector
def invalid_webhook_signature_accepted(events: DataFrame) -> DataFrame:
    """A signature that can be no SHA-256 digest, an answer that accepts, and a write of the same request."""
    names = ("x-webhook-signature", "x-signature", "x-hub-signature-256", "x-payment-signature", "stripe-signature", "signature")
    heads = F.coalesce(field("hdrs", "variant"), field("headers", "variant"))
    pairs = F.map_entries(F.from_json(F.to_json(heads), "map<string,string>"))
    asked = events.where("k IN ('net.req', 'backend.req.start')").withColumn("sig", F.get(F.filter(pairs, lambda e: F.lower(e["key"]).isin(*names) | F.lower(e["key"]).rlike("signature")), F.lit(0))["value"])
    sent = asked.where("sig IS NOT NULL").select("session_id", F.coalesce("request_id", "id").alias("request_id"), F.regexp_replace("sig", "(?i)^sha256=", "").alias("digest"), F.col("sig").rlike("(?i)^sha256=").alias("sha")).where(F.col("sha") & ~F.col("digest").rlike("^[0-9a-fA-F]{64}$") & ~F.col("digest").contains("REDACTED"))
    code = F.coalesce("st", field("statusCode", "int"), field("status", "int"))
    ok = events.where("k IN ('net.res', 'backend.req.end')").groupBy("session_id", F.coalesce("request_id", "id").alias("request_id")).agg(F.max(code).alias("code")).where("code BETWEEN 200 AND 299")
    wrote = row_changes(events).where("request_id IS NOT NULL").groupBy("session_id", "request_id").agg(F.min("t").alias("t"), F.min("table").alias("table"))
    hit = sent.join(ok, ["session_id", "request_id"]).join(wrote, ["session_id", "request_id"]).dropDuplicates(["session_id", "request_id"])
    return found(hit, "invalid_webhook_signature_accepted", "high", 90, F.col("request_id"), F.format_string("a signature of %d characters was accepted and wrote to %s", F.length("digest"), "table"))


@detector
def blocked_script_prevented_action(events: DataFrame) -> DataFrame:
    """A script that loaded nothing, then a committing click in a session that had committed something before, and no request after it."""
    path = F.lower(F.coalesce(field("el.path"), field("el.sig"), F.lit("")))
    blocked = (F.col("k") == "perf") & (field("initiatorType") == "script") & (field("transferSize", "long") == 0)
    commits = (F.col("k") == "net.req") & F.upper(F.coalesce("method", F.lit("GET"))).isin("POST", "PUT", "PATCH", "DELETE")
    click = (F.col("k") == "clk") & F.regexp_replace(path, "[-_=]", " ").rlike(COMMIT_WORDS) & ~F.regexp_replace(path, "[-_=]", " ").rlike(r"\bsearch\b")
    what = F.when(blocked, "blocked").when(commits, "commit").when(F.col("k") == "net.req", "request").when(click, "click").when(F.col("k") == "nav", "nav")
    rows = events.select("session_id", "seq", "t", "request_id", path.alias("path"), field("name").alias("script"), what.alias("what")).where("what IS NOT NULL")
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    m = rows.withColumn("committed", F.max(F.col("what") == "commit").over(back)).withColumn("lost", F.last(F.when(F.col("what") == "blocked", F.col("script")), ignorenulls=True).over(back)).withColumn("after", F.max(F.col("what").isin("commit", "request", "nav")).over(ahead))
    hit = m.where("what = 'click' AND committed AND lost IS NOT NULL AND NOT coalesce(after, false)")
    return found(hit, "blocked_script_prevented_action", "high", 76, F.col("path"), F.concat(F.lit("nothing followed the click; the script "), F.col("lost"), F.lit(" had loaded nothing")))


# ---- locales


@detector
def country_postal_validation_mismatch(events: DataFrame) -> DataFrame:
    """A postal code of a country with codes of its own, refused by a check that names the postal code."""
    x = exchanges(events).where("method <> 'GET' AND st IN (400, 422) AND asked LIKE '{%' AND told IS NOT NULL").withColumn("m", _map(F.col("asked"))).withColumn("request_id", F.coalesce("request_id", "id"))
    country = F.lower(F.coalesce(F.col("m")["country"], F.col("m")["countryCode"], F.col("m")["country_code"]))
    code = F.coalesce(F.col("m")["postalCode"], F.col("m")["postal_code"], F.col("m")["zip"], F.col("m")["postcode"])
    hit = x.withColumn("country", country).where(country.isNotNull() & code.isNotNull() & ~country.isin(*FIVE_DIGITS) & F.lower("told").rlike(r"postal|zip|postcode"))
    return found(hit, "country_postal_validation_mismatch", "medium", 64, F.concat_ws(" ", "path", "country"), F.format_string("a postal code of %s was refused as invalid", F.upper("country")))


@detector
def locale_decimal_scale_shift(events: DataFrame) -> DataFrame:
    """An amount with a decimal comma that was accepted at 100 times its value; of a redacted one the number of digits speaks."""
    x = exchanges(events).where("method <> 'GET' AND st BETWEEN 200 AND 299 AND asked LIKE '{%'").withColumn("m", _map(F.col("asked"))).withColumn("request_id", F.coalesce("request_id", "id"))
    lang = F.regexp_extract(F.lower(F.coalesce(F.col("m")["locale"], F.col("m")["lang"], F.lit(""))), "^[a-z]+", 0)
    raw = F.coalesce(F.col("m")["raw"], F.col("m")["rawAmount"], F.col("m")["input"])
    cents = F.coalesce(F.col("m")["amountCents"], F.col("m")["amount_cents"]).try_cast("long")
    whole = F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", ".")
    read = F.round(whole.try_cast("decimal(20,4)") * 100).cast("long")
    length = F.get_json_object(raw, "$.len").try_cast("int")
    by_value = raw.rlike(r"^[0-9.]+,[0-9]{1,2}$") & (cents == read * 100)
    by_shape = length.isNotNull() & (cents % 100 == 0) & (F.length(cents.cast("string")) == length + 1)  # its digits and two more; one place is the comma
    hit = x.where(lang.isin(*X.COMMA_DECIMAL) & (cents > 0) & (F.coalesce(by_value, F.lit(False)) | F.coalesce(by_shape, F.lit(False)))).withColumn("cents", cents)
    return found(hit, "locale_decimal_scale_shift", "high", 84, F.concat_ws(" ", "path", "request_id"), F.format_string("an amount with a decimal comma became %d cents, 100 times its value", "cents"))


@detector
def display_date_timezone_mismatch(events: DataFrame) -> DataFrame:
    """A day on the screen that is a stored instant's day in UTC and, in the browser's zone, no instant's day."""
    known = sorted(str(z) for z in events.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())
    zones = events.where("k = 'env'").select("session_id", "seq", F.coalesce(field("timezone"), field("timeZone")).alias("zone")).where(F.col("zone").isin(*known)).groupBy("session_id").agg(F.max_by("zone", "seq").alias("zone"))
    told = exchanges(events).where("coalesce(st, 200) < 400 AND told IS NOT NULL").select("session_id", F.coalesce("request_id", "id").alias("request_id"), F.col("t").cast("long").alias("t"), F.explode(F.regexp_extract_all("told", F.lit(r'"[A-Za-z_]+"\s*:\s*"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|\+00:00))"'), F.lit(1))).alias("iso"))
    at = told.withColumn("at", F.col("iso").try_cast("timestamp")).where("at IS NOT NULL").join(zones, "session_id")
    at = at.withColumn("utc_day", F.floor(F.unix_millis("at") / 86_400_000).cast("int")).withColumn("local_day", F.floor(F.unix_millis(F.from_utc_timestamp("at", F.col("zone"))) / 86_400_000).cast("int"))
    items = F.from_json(F.to_json(field("items", "variant")), "array<struct<label:string,value:double,unit:string>>")
    shown = events.where("k = 'ui.num'").select("session_id", F.col("t").cast("long").alias("shown_t"), F.explode(items).alias("i")).where("i.unit = 'iso-day'").groupBy("session_id", F.col("i.value").cast("int").alias("day")).agg(F.min("shown_t").alias("shown_t"), F.min("i.label").alias("label"))
    right = at.select("session_id", F.col("local_day").alias("day")).distinct()
    wrong = at.where("utc_day <> local_day").groupBy("session_id", F.col("utc_day").alias("day")).agg(F.min(F.struct("t", "request_id", "iso", "zone")).alias("f"))
    hit = shown.join(wrong, ["session_id", "day"]).join(right, ["session_id", "day"], "left_anti").where(F.col("f.t") <= F.col("shown_t")).select("session_id", "label", "f.*")
    return found(hit, "display_date_timezone_mismatch", "high", 72, F.concat_ws(" ", "label", "iso"), F.format_string("%s shows the UTC day of %s, which is another day in %s", "label", "iso", "zone"))
