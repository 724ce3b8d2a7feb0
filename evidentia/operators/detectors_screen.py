"""Numbers on the screen against the numbers that the responses carried.

`response_numbers` is the one reading of response bodies: every number with the record that holds it. Three detectors compare labelled screen
numbers with it. Whatever pairs up does so by equal keys: a label meets the fields of its own words in one ordered window (the state as of the
moment it was shown), and a shown value meets earlier or neighbouring values by buckets of a cent (`joins.near_join`), so no session's
labels are held against all of its fields.

Money has two units. A field whose name says minor units (cents) is divided by 100; where the name says nothing, a whole number that is
100 times the other number is the same amount.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators.detectors import answered, detector, found, shared, spread
from evidentia.operators.detectors_business import SCREEN_CAP, _json, _numbers
from evidentia.operators.joins import near_join

#: Two amounts of at most a cent between them are one.
CENT = 0.01
#: Fields that name a record, words that end a field in minor units, and words that end a count.
RECORD_NAMES = ("id", "uuid", "code", "key", "ref", "reference", "number", "sku", "slug", "name")
MINOR_UNITS = ("cents", "pence", "minor")
COUNT_WORDS = ("items", "item", "count", "counts", "qty", "quantity", "number", "num", "pages", "page", "rows", "lines", "size", "limit", "results", "records", "units")


def numbers_of(body: str | None) -> Iterator[tuple[int, str, str, float]]:
    """(place of the record in the body, the record's name or path, field, value) of every number in a JSON text; of other texts none.

    A list's bare numbers are fields of the list's name in the record around it. Marks that stand for redacted values hold no numbers.
    """
    try:
        root = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return
    place = 0
    todo = [(root, "", "", 0, "")]
    while todo:
        node, name, record, at, path = todo.pop()
        if isinstance(node, dict):
            if "$redacted" in node:
                continue
            place += 1
            own = next((node[k] for k in RECORD_NAMES if isinstance(node.get(k), str | int) and not isinstance(node.get(k), bool)), None)
            label = path if own is None else f"{path}#{own}"
            todo += [(v, k, label, place, f"{path}.{k}") for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(v, name, record, at, f"{path}[]") for v in reversed(node)]
        elif isinstance(node, int | float) and not isinstance(node, bool):
            try:
                yield at, record, name, float(node)
            except OverflowError:
                continue


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, places, records, names, values = [], [], [], [], []
        for i, body in enumerate(batch.column("told").to_pylist()):
            for place, record, name, value in numbers_of(body):
                rows.append(i)
                places.append(place)
                records.append(record)
                names.append(name)
                values.append(value)
        kept = batch.drop_columns(["told"]).take(pa.array(rows, pa.int64()))
        more = [pa.array(places, pa.int32()), pa.array(records, pa.string()), pa.array(names, pa.string()), pa.array(values, pa.float64())]
        yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, "place", "record", "name", "value"])


def spaced_words(name: Column) -> Column:
    """A field or label as lower-case words: balanceCents, balance_cents and "Balance (cents)" are all "balance cents"."""
    apart = F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " ")))


def _last_word(words: Column) -> Column:
    return F.substring_index(words, " ", -1)


def response_numbers(events: DataFrame) -> DataFrame:
    """session_id, request_id, t, path, place, record, name, value, words, amount: every number of the successful responses of sessions that show numbers.

    `words` are the field's without its minor unit, `amount` its value in major units. The bodies are read in Python, as a body may nest to any depth.
    """
    return shared(events, "response_numbers", _response_numbers)


def _response_numbers(events: DataFrame) -> DataFrame:
    shown = events.where("k = 'ui.num'").select("session_id").distinct()
    told = answered(events).where("t IS NOT NULL AND answer IS NOT NULL AND coalesce(st, 200) < 400").join(shown, "session_id", "left_semi")
    rows = told.select("session_id", F.coalesce("request_id", "id").alias("request_id"), F.col("t").cast("long").alias("t"), X.url_path(F.coalesce("url", F.lit(""))).alias("path"), _json(F.col("answer")).alias("told"))
    kind = rows.schema["session_id"].dataType.simpleString()
    flat = rows.mapInArrow(_flatten, f"session_id {kind}, request_id string, t long, path string, place int, record string, name string, value double")
    words = spaced_words(F.col("name"))
    minor = _last_word(words).isin(*MINOR_UNITS) & words.contains(" ")
    return flat.withColumn("words", F.when(minor, F.regexp_replace(words, r" [^ ]+$", "")).otherwise(words)).withColumn("minor", minor).withColumn("amount", F.when(minor, F.col("value") / 100).otherwise(F.col("value")))


def screen_labels(events: DataFrame) -> DataFrame:
    """session_id, t, seq, i, label, words, shown: every labelled number of the screen; redacted labels say nothing."""
    rows = _numbers(events).select("session_id", F.col("t").cast("long").alias("t"), "seq", F.posexplode("items").alias("i", "item"))
    rows = rows.select("session_id", "t", "seq", "i", F.col("item.label").alias("label"), spaced_words(F.col("item.label")).alias("words"), F.col("item.value").alias("shown"))
    return rows.where("shown IS NOT NULL AND words <> '' AND NOT contains(label, '[REDACTED]')")


def same_amount(a: Column, b: Column) -> Column:
    """Within a cent of each other, or the larger one whole and 100 times the smaller one."""
    large, small = F.greatest(F.abs(a), F.abs(b)), F.least(F.abs(a), F.abs(b))
    return (F.abs(a - b) <= CENT + 1e-9) | ((large == F.floor(large)) & (F.abs(large - small * 100) <= 1e-6 * F.greatest(large, F.lit(1.0))) & (F.signum(a) == F.signum(b)))


def _plain_number(c: Column) -> Column:
    return F.regexp_replace(c.cast("decimal(28,4)").cast("string"), r"\.?0+$", "")


def _states(fields: DataFrame, labels: DataFrame, told: tuple[str, ...]) -> DataFrame:
    """Fields (order 0), with what is `told` of them in `field`, and labels (order 1) as rows of one table."""
    f = fields.select("session_id", "words", "t", F.lit(0).alias("order"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("label"),
                      F.lit(None).cast("double").alias("shown"), F.struct(*told).alias("field"))
    lab = labels.select("session_id", "words", "t", F.lit(1).alias("order"), F.col("seq").cast("long").alias("seq"), "i", "label", "shown", F.lit(None).cast(f.schema["field"].dataType).alias("field"))
    return f.unionByName(lab)


def _as_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """Labels with what the fields of their key held when they were shown: `last`, `low` and `high` of exact names, and the same of longer names."""
    # ordered by plain columns and made at once: a field of a struct is another expression in each window, and every window then sorts the rows again
    rows = rows.withColumns({"__id": F.col("field.request_id"), "__place": F.col("field.place")})
    w = Window.partitionBy(*by, "key").orderBy("t", "order", "__id", "__place", "seq", "i").rowsBetween(Window.unboundedPreceding, 0)
    made = {}
    for prefix, of in (("", F.col("exact")), ("longer_", ~F.col("exact"))):
        amount = F.when(of, F.col("field.amount"))
        made |= {f"{prefix}low": F.min(amount).over(w), f"{prefix}high": F.max(amount).over(w), f"{prefix}last": F.last(F.when(of, F.col("field")), ignorenulls=True).over(w)}
    return rows.withColumns(made).where("order = 1").drop("order", "field", "exact", "__id", "__place")


def _since_navigation(events: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with the page they belong to: what arrives at the instant of a navigation belongs to the page before."""
    navs = events.where("k = 'nav'").select("session_id", F.col("t").cast("long").alias("t")).distinct()
    turns = navs.select("session_id", "t", *[F.lit(2 if c == "order" else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("session_id", "t")])
    before = Window.partitionBy("session_id").orderBy("t", "order").rowsBetween(Window.unboundedPreceding, 0)
    return spread(events, rows.unionByName(turns), response_numbers(events), "session_id").withColumn("page", F.count_if(F.col("order") == 2).over(before)).where("order < 2")


@detector
def ui_api_divergence(events: DataFrame) -> DataFrame:
    """A labelled number that is not what the page's own responses said: fields of exactly the label's words decide, else those that begin with
    them and are no counts; where they disagree nothing is said. The first label of each name, and the first few of a session."""
    told = ("request_id", "place", "name", "value", "amount")
    rows = _since_navigation(events, _states(response_numbers(events), screen_labels(events), told))
    parts = F.split("words", " ")
    shorter = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), " ").alias("key"), F.lit(False).alias("exact")))
    own = F.array(F.struct(F.col("words").alias("key"), F.lit(True).alias("exact")))
    longer = (F.col("order") == 0) & F.col("words").contains(" ") & ~_last_word(F.col("words")).isin(*COUNT_WORDS)
    keyed = rows.withColumn("x", F.explode(F.when(longer, F.concat(own, shorter)).otherwise(own))).where("x.key <> ''")
    m = _as_of(keyed.select(*[c for c in rows.columns if c != "words"], "x.*"), ["session_id", "page"])
    exact = F.col("last").isNotNull()
    m = m.select("session_id", "key", "t", "seq", "i", "label", "shown", F.when(exact, F.col("last")).otherwise(F.col("longer_last")).alias("f"), F.when(exact, F.col("high") - F.col("low")).otherwise(F.col("longer_high") - F.col("longer_low")).alias("spread"))
    apart = m.where((F.col("spread") <= CENT + 1e-9) & ~same_amount(F.col("shown"), F.col("f.amount")) & ~same_amount(F.col("shown"), F.col("f.value")))
    first = Window.partitionBy("session_id", "key").orderBy("t", "seq", "i")
    once = apart.withColumn("n", F.row_number().over(first)).where("n = 1")
    few = once.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("t", "seq", "i"))).where(F.col("n") <= SCREEN_CAP).withColumn("request_id", F.col("f.request_id"))
    return found(few, "ui_api_divergence", "medium", 55, F.col("key"), F.format_string("%s shows %s, but %s of the response is %s", "label", _plain_number(F.col("shown")), F.col("f.name"), _plain_number(F.col("f.value"))))


def _shown_otherwise(events: DataFrame) -> DataFrame:
    """Labels that differ from the latest field of their name, with that field as `f`."""
    return shared(events, "shown_otherwise", _labels_apart)


def _labels_apart(events: DataFrame) -> DataFrame:
    fields = response_numbers(events)
    rows = _states(fields, screen_labels(events), ("t", "request_id", "place", "path", "record", "name", "value", "amount")).withColumnRenamed("words", "key").where("key <> ''")
    m = _as_of(spread(events, rows, fields, "session_id", "key").withColumn("exact", F.lit(True)), ["session_id"]).where("last IS NOT NULL").withColumn("f", F.col("last"))
    return m.where(~same_amount(F.col("shown"), F.col("f.amount")) & ~same_amount(F.col("shown"), F.col("f.value"))).select("session_id", "key", "t", "seq", "i", "label", "shown", "f")


def _units(rows: DataFrame) -> DataFrame:
    """Each number once in every unit that it may be in, as `cash`."""
    whole = (F.col("value") == F.floor("value")) & ~F.col("minor")
    return rows.withColumn("cash", F.explode(F.when(whole, F.array("amount", F.col("value") / 100)).otherwise(F.array("amount"))))


@detector
def stale_value_rendered(events: DataFrame) -> DataFrame:
    """A label that shows what its field held before the value changed. A field is a name in one record of one URL; one that never changed can't be stale."""
    fields, m = response_numbers(events), _shown_otherwise(events)
    line = ["session_id", "path", "record", "name"]
    order = Window.partitionBy(*line).orderBy("t", "request_id", "place")
    moves = spread(events, fields, fields, *line).withColumn("to", F.lead("amount").over(order)).withColumn("until", F.lead("t").over(order)).where(F.abs(F.col("to") - F.col("amount")) > CENT + 1e-9)
    gone = _units(moves).groupBy(*line, "cash").agg(F.min("until").alias("until"))
    keyed = m.select("*", *[F.col(f"f.{c}").alias(c) for c in line[1:]])
    hit = near_join(keyed, gone, line, "shown", "cash", CENT).where(F.col("until") <= F.col("t"))
    once = hit.groupBy("session_id", "key", "shown").agg(F.min(F.struct("t", "seq", "i", "label", "f")).alias("b")).select("session_id", "key", "shown", F.col("b.t").alias("t"), F.col("b.label").alias("label"), F.col("b.f").alias("f"))
    return found(once.withColumn("request_id", F.col("f.request_id")), "stale_value_rendered", "high", 80, F.concat_ws(" ", "key", _plain_number(F.col("shown"))),
                 F.format_string("%s still shows %s; the server last sent %s = %s", "label", _plain_number(F.col("shown")), F.col("f.name"), _plain_number(F.col("f.value"))))


@detector
def displayed_field_mismatch(events: DataFrame) -> DataFrame:
    """A label that shows another field of the very record that holds the field it names."""
    fields, m = response_numbers(events), _shown_otherwise(events)
    keyed = m.select("*", F.col("f.request_id").alias("request_id"), F.col("f.place").alias("place"), F.col("f.t").alias("at"))
    siblings = _units(fields).groupBy("session_id", "request_id", F.col("t").alias("at"), "place", "cash").agg(F.min(F.struct("words", "name")).alias("other"))
    hit = near_join(keyed, siblings, ["session_id", "request_id", "at", "place"], "shown", "cash", CENT).where(F.col("other.words") != F.col("key"))
    once = hit.groupBy("session_id", "key", "shown").agg(F.min(F.struct("t", "seq", "i", "label", "f", "other", "request_id")).alias("b")).select("session_id", "key", "shown", "b.t", "b.label", "b.f", "b.other", "b.request_id")
    return found(once, "displayed_field_mismatch", "high", 78, F.concat_ws(" ", "key", F.col("other.words")),
                 F.format_string("%s shows %s, which is %s and not %s of record %s", "label", _plain_number(F.col("shown")), F.col("other.name"), F.col("f.name"), F.regexp_replace("f.record", "^.*#", "")))
