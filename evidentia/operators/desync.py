"""Streams that dropped and came back without a replay: the resource behind them, before and after.

`stream_marks` is what both twins read: a connection's opens, drops and reopenings, and what requests under its API root showed of the resource (a JSON
body, or a stored row that the back end read for them), each as a digest. `reconnects` is the batch twin of `streaming.ordered.Desync`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators.detectors import detector, field, found
from evidentia.operators.detectors_business import exchanges

#: A change seen later than this after the reopening is not charged to it.
VERIFY_MS = 30_000
#: Last parts of a path that name a stream and not the resource.
STREAM_PARTS = r"(?i)/(stream|streams|events|live|feed|ws|socket|sse|subscribe|subscription|updates|changes)/?$"


def stream_marks(events: DataFrame) -> DataFrame:
    """session_id, key (API root), t, seq, what (open, drop, reopen, seen), detail ("resource digest")."""
    conns = events.where("k IN ('net.sse', 'net.ws')").withColumn("path", X.url_path(F.regexp_replace(F.coalesce("url", F.lit("")), "^ws", "http")))
    op = field("op")
    what = F.when(op.isin("error", "close"), "drop").when((op == "open") & F.coalesce(field("reopen", "boolean"), F.lit(False)), "reopen").when(op == "open", "open")
    conns = conns.select("session_id", F.regexp_replace("path", STREAM_PARTS, "").alias("key"), F.col("t").cast("long").alias("t"), F.col("seq").cast("long").alias("seq"), what.alias("what"), F.lit(None).cast("string").alias("detail")).where("what IS NOT NULL AND key <> ''")
    roots = conns.select("session_id", "key").distinct()
    gets = exchanges(events).where("method = 'GET' AND st BETWEEN 200 AND 399").withColumn("request_id", F.coalesce("request_id", "id"))
    seqs = events.where("k = 'net.res'").groupBy("session_id", F.coalesce("id", "request_id").alias("id")).agg(F.min("seq").alias("seq"))
    bodies = gets.where(F.col("told").rlike(r"^\s*[\[{]")).join(seqs, ["session_id", "id"]).select("session_id", "path", F.col("t").cast("long").alias("t"), "seq", F.concat_ws(" ", F.lit("response"), F.coalesce("url", F.lit(""))).alias("resource"), F.md5("told").alias("digest"))
    reads = events.where("k = 'db.read' AND request_id IS NOT NULL").select("session_id", "request_id", F.col("t").cast("long").alias("t"), "seq", F.concat_ws(" ", F.lit("row"), "table", F.to_json(field("pk", "variant"))).alias("resource"), F.md5(F.to_json(field("row", "variant"))).alias("digest"))
    rows = reads.join(gets.select("session_id", "request_id", "path").distinct(), ["session_id", "request_id"]).select("session_id", "path", "t", "seq", "resource", "digest")
    parts = F.split("path", "/")
    under = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    seen = bodies.unionByName(rows).where(F.col("digest").isNotNull() & F.col("path").contains("/")).withColumn("key", F.explode(under)).join(roots, ["session_id", "key"])
    return conns.unionByName(seen.select("session_id", "key", "t", F.col("seq").cast("long").alias("seq"), F.lit("seen").alias("what"), F.concat_ws(" ", "resource", "digest").alias("detail")))


def reconnects(marks: DataFrame, verify_ms: int = VERIFY_MS) -> DataFrame:
    """session_id, key, t (of the reopening), what (changed or unverified), detail (the first resource seen to have changed).

    A change is charged to the last reopening before it was seen. Ordered windows only: no connection's marks are gathered.
    """
    place = F.struct("t", "seq")
    line = Window.partitionBy("session_id", "key").orderBy("t", "seq")
    m = marks.withColumn("was", F.last(F.when(F.col("what") != "seen", F.col("what")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    back = (F.col("what") == "reopen") & (F.col("was") == "drop")
    m = m.withColumn("back", F.when(back, place)).withColumn("since", F.last("back", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    seen = m.where("what = 'seen'").withColumn("resource", F.regexp_extract("detail", r"^(.*) [^ ]*$", 1)).withColumn("digest", F.substring_index("detail", " ", -1))
    before = F.lag(F.struct("t", "seq", "digest")).over(Window.partitionBy("session_id", "key", "resource").orderBy("t", "seq"))
    moved = seen.withColumn("before", before).where((F.col("before.digest") != F.col("digest")) & (F.struct("before.t", "before.seq") < F.col("since")) & (F.col("t") - F.col("since.t") <= verify_ms))
    first = moved.groupBy("session_id", "key", F.col("since.t").alias("at"), F.col("since.seq").alias("at_seq")).agg(F.min(F.struct("t", "seq", "resource")).alias("f"))
    opened = m.where("back IS NOT NULL").select("session_id", "key", F.col("t").alias("at"), F.col("seq").alias("at_seq"))
    j = opened.join(first, ["session_id", "key", "at", "at_seq"], "left")
    return j.select("session_id", "key", F.col("at").alias("t"), F.when(F.col("f").isNull(), "unverified").otherwise("changed").alias("what"), F.coalesce("f.resource", F.lit("")).alias("detail"))


@detector
def stream_desync(events: DataFrame) -> DataFrame:
    """Every reconnect without a replay: medium if the resource had changed meanwhile, low if that could not be verified."""
    r = reconnects(stream_marks(events)).withColumn("request_id", F.lit(None).cast("string"))
    changed = F.col("what") == "changed"
    return found(r, "stream_desync", F.when(changed, "medium").otherwise("low"), F.when(changed, 62).otherwise(42), F.concat_ws(" ", "key", F.col("t").cast("string")),
                 F.when(changed, F.concat(F.col("detail"), F.lit(" changed while the stream was down; the change was never delivered"))).otherwise("the stream came back without a replay; whether it missed a change could not be verified"))
