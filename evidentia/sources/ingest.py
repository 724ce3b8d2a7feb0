"""Taking events in: validated batches and streams, comparison scans, commits between two refs, and evidence from outside sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.sources.telemetry import rehydrate

#: The version and the platforms that an event may name.
SCHEMA_VERSION = 1
PLATFORMS = ("web", "ios", "android", "react-native", "flutter", "server")


def validate(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines -> session_id, t, k, d and `error`: null for an event that is one, else what is wrong with the first field that is. Works on tables and streams."""
    e = F.try_parse_json(line)
    at = lambda path, kind: F.try_variant_get(e, f"$.{path}", kind)
    kind_of = lambda path: F.schema_of_variant(at(path, "variant"))
    numeric = F.coalesce(kind_of("t").rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    error = (
        F.when(e.isNull() | ~F.schema_of_variant(e).startswith("OBJECT"), "must be an object").when(~numeric, "t must be a finite number")
        .when((F.coalesce(kind_of("k"), F.lit("")) != "STRING") | (F.trim(at("k", "string")) == ""), "k must be a non-empty string").when(~F.coalesce(kind_of("d").startswith("OBJECT"), F.lit(False)), "d must be an object")
        .when(at("schemaVersion", "int") != SCHEMA_VERSION, f"schemaVersion must be {SCHEMA_VERSION}").when(~F.coalesce(at("platform", "string"), F.lit("web")).isin(*PLATFORMS), "platform is unknown"))
    return lines.select(at("sessionId", "string").alias("session_id"), at("t", "double").cast("long").alias("t"), X.canonical_kind(at("k", "string")).alias("k"), at("d", "variant").alias("d"), error.alias("error"), F.col(line).alias("line"))


def unrecognised(events: DataFrame) -> DataFrame:
    """Kinds that no index knows, with their number of events: reported, not refused."""
    return events.where(~F.col("k").isin(*X.INDEXED_KINDS)).groupBy("k").agg(F.count("*").alias("n"))


def ingest_stream(spark: SparkSession, source: str, good: str, refused: str, state: str):
    """Event lines that arrive in a folder, validated as they come: events go to one table, refused lines with their reason to another."""
    stream = validate(spark.readStream.text(source))

    def write(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        kept.where("error IS NULL").withColumn("d", F.to_json("d")).drop("error", "line").write.mode("append").parquet(good)
        kept.where("error IS NOT NULL").select("line", "error").write.mode("append").parquet(refused)
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def comparison_scan(events: DataFrame, dictionary: DataFrame, stubs: DataFrame, ref: str, fields: list[str]) -> DataFrame:
    """Events of sessions to compare, with what their signature references stand for; a session without events has its stubs."""
    full = rehydrate(events, dictionary, ref, fields)
    missing = stubs.join(events.select("session_id").distinct(), "session_id", "left_anti")
    return full.unionByName(missing, allowMissingColumns=True)


def commits_between(commits: DataFrame, good: str, bad: str) -> DataFrame:
    """commits(branch, position, sha, message, ...): those of a branch after one ref up to another, newest first, as a table with `rank`."""
    ends = commits.where(F.col("sha").isin(good, bad)).groupBy("branch").agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count("*").alias("n")).where("n = 2")
    inside = commits.join(F.broadcast(ends), "branch").where("position > lo AND position <= hi")  # a row for each branch that has both
    return inside.withColumn("rank", F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("position")))).drop("lo", "hi", "n")


EVIDENCE = ("bundle", "id", "lane", "kind", "brief", "request_id", "sig", "t")
SOURCES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}


def evidence_source(name: str, lane: str) -> Callable:
    """Register a source of evidence: a function of symptoms(bundle, ...) that returns bundle, id, kind, brief, and any of request_id, sig, t."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        SOURCES[name] = (lane, f)
        return f

    return add


def gather_evidence(symptoms: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Evidence of all sources (or of the named ones) in one schema; a source that fails fails the job, none is silently left out."""
    parts = []
    for name in names or sorted(SOURCES):
        lane, f = SOURCES[name]
        rows = f(symptoms)
        known: list[Column] = [F.lit(lane).alias(c) if c == "lane" else (F.col(c) if c in rows.columns else F.lit(None).cast("long" if c == "t" else "string").alias(c)) for c in EVIDENCE]
        parts.append(rows.select(*known))
    return reduce(DataFrame.unionByName, parts)
