"""The stages of corpus_pipeline.py: operators whose decisions change the corpus.

Decisions are about rows, never about ids: rows that share an id, and rows without one, are documents of their own.

Cases, for every stage: null ids are documents like others; null texts fail the quality rules and are gone after the first stage, and
where a later stage meets them they have no shingles, leak nothing, and take no part in the mix; repeated rows are near duplicates
of each other, of which one stays; very long texts are read whole; an empty table passes through every stage; columns beyond those of
documents pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, jaccard_join, mixing, quality_rules, token_ids
from evidentia.session import Tables, delete_path, job, made, modified

#: Rows to take out, if counted to be so many at most, are broadcast (8 bytes each); more are taken out by a shuffle join.
MOST_BROADCAST_ROWS = 500_000


def _packed(docs: DataFrame, *more) -> DataFrame:
    """Each row as one value, `row`, so that no name of its columns can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`") for c in columns])


#: Folders of tables that the results of stages read, by the pipeline's input and the stage.
_LEFT: dict[str, dict[str, list[str]]] = {}


def _stage(run: Callable) -> Callable:
    """A stage. Its tables serve until its rows are written: they go when another stage starts on an input that was written after them and does not read them."""

    @wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left, files = _LEFT.setdefault(sf_dir, {}), docs.inputFiles()
        written = modified(spark, files[0]) if files else 0
        for name in [n for n in left if n != run.__name__]:
            if all(modified(spark, f) < written and not any(f.rsplit("/", 1)[1] in x for x in files) for f in left[name]):
                for folder in left.pop(name):
                    delete_path(spark, folder)
        with made() as own:
            out = run(spark, docs, sf_dir)
        left.setdefault(run.__name__, []).extend(own)
        return out

    return stage


@_stage
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects: the ledger is written with its rows, and the policy applied to what is read back."""
    judged = quality_rules.ledger(_packed(docs, F.col("text")), id_col="row")
    ledger = Tables(spark, "quality-rules").store("ledger", judged)
    return _unpacked(quality_rules.apply_policy(ledger).where("kept").withColumnRenamed("doc_id", "row"), docs.columns)


@_stage
def jaccard_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the least id (null last), of those the first written; rows without shingles stay too."""
    tables = Tables(spark, "jaccard-dedup")
    rows = tables.store("rows", _packed(docs, F.monotonically_increasing_id().alias("key")))
    joined = jaccard_join.jaccard_join(rows.select("key", "row.text"), id_col="key").where("n_shingles > 0")
    named = joined.join(rows.select("key", "row.doc_id"), F.col("id") == F.col("key")).select("key", "component", "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    stays = named.groupBy("component").agg(first["key"].alias("stays"), F.count("*").alias("n")).where("n > 1")
    gone = tables.store("gone", named.join(stays, "component").where("key <> stays").select("key"))
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST_ROWS else gone
    return _unpacked(rows.join(gone, "key", "left_anti"), docs.columns)


@_stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix_sources_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its quota takes it whole, and once more with the words of the taken blocks if it is taken in part."""
    tables = Tables(spark, "mix-sources")
    stored = tables.store("rows", _packed(docs, F.monotonically_increasing_id().alias("key")))
    plan = mixing.plan(stored.select("key", F.col("row").alias("doc_id"), "row.source", "row.text"), key="key").withColumn("taken", mixing.taken_words()).where("taken > 0")
    # the texts are joined once with what is taken of them; no window carries them
    places = tables.store("places", plan.select(F.col("doc_id").alias("key"), "size", "shard", "offset", "shard_size", "m", "quota", "taken"))
    rows = stored.join(places, "key")
    # when the quota takes whole passes, the rest of the words are those of the partial pass
    rows = rows.withColumn("whole", F.expr("CAST(taken DIV size AS INT)")).withColumn("part", F.col("taken") % F.col("size"))
    rows = rows.withColumn("copy", F.explode(F.expr("concat(array_repeat(true, whole), CASE WHEN part > 0 THEN array(false) ELSE array() END)")))
    text = F.when(F.col("copy"), F.col("row.text")).otherwise(mixing.taken_text(F.col("row.text")))
    rows = rows.select("row", text.alias("text"))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(kinds.get("n_chars", "long"))}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@_stage
def token_ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mixed documents as token ids, and returns for each what the files hold."""
    folder = token_ids.output_folder(spark, "pipeline-ids")
    token_ids.write_ids(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_ids.read_documents(spark, folder)


def run_stages(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Callable]]) -> DataFrame:
    """Every stage's rows are written before the next reads them; the tables that made them, and the rows of the stage before, are then deleted.

    The last stage's result is read by the caller: its tables, and the rows it came from, stay until they are dropped.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in stages[:-1]:
        rows = Tables(spark, f"stage-{name}")
        with job(spark):
            docs = rows.store("docs", stage(spark, docs, sf_dir))
        if before is not None:
            before.close()
        before = rows
    return stages[-1][1](spark, docs, sf_dir)
