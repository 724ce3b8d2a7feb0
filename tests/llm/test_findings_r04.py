"""Findings of round 4: what op12's tables hold in one row, and its results over lists of several rows."""

import random

from pyspark.sql import functions as F

from evidentia.llm import importance
from tests.llm.test_counts_resampling_codes import brute_resample, got_resample


def test_no_row_of_the_inverted_lists_grows_with_its_block(spark):
    """Spark's readers and writers hold a hundred rows and more at once: a row with the lists of a whole block fills an executor."""
    words = " ".join(f"w{i}" for i in range(50))
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit(words).alias("text"))
    rows = importance._inverted(texts, "doc_id", "text", 1000, 1).select(F.length(F.to_json(F.struct("*"))).alias("n"))
    assert rows.agg(F.max("n")).first()[0] < 5_000


def test_lists_of_several_rows_are_summed_once(spark):
    r = random.Random(12)
    words = ["every"] * 30 + [f"w{i}" for i in range(40)]
    docs = [(i % 1500, " ".join(["every", *(r.choice(words) for _ in range(r.randrange(0, 40)))])) for i in range(1600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("every w1 w2",), ("w3 w3",)], "text string")
    assert got_resample(importance.resample(df, bench, buckets=97)) == brute_resample(docs, ["every w1 w2", "w3 w3"], 97, 1, 20, 10)


def test_a_cell_has_a_bounded_number_of_documents(spark, monkeypatch):
    """The sums that a task holds are those of its cells' documents, not of all documents."""
    monkeypatch.setattr(importance, "LEAST_CELLS", 1)
    monkeypatch.setattr(importance, "CELL_DOCS", 100)
    texts = spark.range(0, 2000, 1, 40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.lit(f"w{i}") for i in range(30))).alias("text"))
    dealt, cells = importance._dealt(importance._inverted(texts, "doc_id", "text", 1000, 1))
    held = dealt.select("cell", "block", F.explode("docs").alias("doc")).distinct().groupBy("cell").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    assert cells == 20 and held["n"] > cells and held["most"] <= 500
