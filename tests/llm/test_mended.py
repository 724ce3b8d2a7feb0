"""Words with equal polynomials, fits on repeated rows, broken markup in linear time, and jobs that leave others' tables alone."""

import time

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import html_extract, jaccard_join, language_model, mixing, pu_quality, toxicity
from evidentia.llm import text as T
from evidentia.llm.token_ids import Encoder
from evidentia.session import Tables, checkpoint_dir, drop_tables

PATH = public_tokenizers.path("byte_bpe_50k.json")


def mirrors(letters=1024):
    """Two words whose polynomials modulo 2^64 are equal for every odd base: each letter by the parity of its place's bits."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(letters))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("letters", [1024, 2048])
def test_mirror_words_are_two_words(letters):
    a, b = mirrors(letters)
    w = next(T.words(pa.array([f"{a} {b} {a}"])))
    assert w.hashes[0] != w.hashes[1] and w.hashes[0] == w.hashes[2]
    enc = Encoder(PATH)
    got = [ids.tolist() for ids in enc.encode(pa.array([f"{a} {b}", b, a]))]
    assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in (f"{a} {b}", b, a)]


def test_mirror_words_make_different_sets_and_n_grams(spark):
    a, b = mirrors()
    docs = spark.createDataFrame([(1, f"{a} x y z w"), (2, f"{b} x y z w"), (3, f"{a} x y z w")], "doc_id long, text string")
    got = {r["id"]: r["component"] for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    model, vocabulary = language_model.train(spark.createDataFrame([(f"{a} x",)], "text string"))
    rows = {r["id"]: r["n_known"] for r in language_model.score(spark.createDataFrame([(1, a), (2, b)], "id long, text string"), model, vocabulary).collect()}
    assert rows == {1: 2, 2: 1}  # the word and the end, or the end only


def test_shingles_of_any_length_read_all_their_words():
    words = [f"w{i}" for i in range(70)]
    other = words[:66] + ["else"] + words[67:]
    for size in (70, 100):
        sets = [s.tolist() for w in T.words(pa.array([" ".join(words), " ".join(other)])) for _, s in T.shingle_sets(w, size)]
        assert sets[0] != sets[1]


def test_word_hashes_are_those_of_the_words_alone():
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdXYZé.")) for _ in range(r.integers(1, 12))) for _ in range(400)]
    whole = np.concatenate([w.hashes for w in T.words(pa.array([" ".join(words), "\n".join(words)]), most=1000)])
    alone = np.array([next(T.words(pa.array([w]))).hashes[0] for w in words])
    assert (whole == np.concatenate([alone, alone])).all()
    assert len(set(alone.tolist())) == len({w.translate(str.maketrans("XYZ", "xyz")) for w in words})


def test_fits_see_one_row_of_an_id(spark, monkeypatch):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("id"), F.concat(F.lit("text "), (F.col("id") % 3).cast("string")).alias("text"))
    docs = rows.unionByName(spark.createDataFrame([(i, f"good plain words number {i}") for i in range(50)], "id long, text string"))
    seen = []
    monkeypatch.setattr(pu_quality, "fit", lambda p, u: seen.append((len(p), len(u))))
    pu_quality.train(docs, spark.createDataFrame([(7,), (1,)], "id long"), 100, 30)
    assert seen == [(2, 30)]
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append(len(texts)))
    toxicity.train(docs, spark.createDataFrame([(7, 1), (1, 0), (2, 0)], "id long, label int"), 100)
    assert seen[1] == 3


@pytest.mark.parametrize("piece", ["<svg ", "<a ", '<p "', "<a \"'", "<", "<!", '<p a="x" ', "</svg", "<div><span>", "<b '>", '"<p '])
def test_broken_markup_is_read_in_linear_time(piece):
    start = time.perf_counter()
    html_extract.blocks(piece * 100_000)
    assert time.perf_counter() - start < 10


def test_tokens_of_odd_markup():
    got = [(k, t, x) for k, _, t, x in html_extract.tokens("a< b<p class='x>y'>t</p><!-- > --><svg a=\">\"><p>no</svg >1 < 2<i")]
    assert got == [("text", "", "a"), ("text", "", "<"), ("text", "", " b"), ("tag", "p", " class='x>y'"), ("text", "", "t"), ("tag", "p", ""), ("raw", "svg", ""), ("text", "", "1 "), ("text", "", "<"), ("text", "", " 2")]
    assert [x for k, _, _, x in html_extract.tokens("<p 'x>") if k == "text"] == ["<", "p 'x>"]


def test_results_outlive_a_pipeline_run_and_its_tables_go(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed, joined = mixing.mix_sources(docs), jaccard_join.jaccard_join(docs)
    n = docs.count()
    hadoop, folder = spark._jvm.org.apache.hadoop.fs, checkpoint_dir(spark)
    listed = lambda: {f.getPath().getName() for f in hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop.Path(folder))}
    before = listed()
    result = corpus_pipeline.run(spark, sf)
    assert mixed.count() == n and joined.count() == n and result.count() > 0
    left = {name.rsplit("-", 1)[0] for name in listed() - before if not name.startswith("rdd")}
    assert not left & {"quality-rules", "jaccard-dedup", "jaccard-join", "mixing", "stage-quality_rules", "stage-jaccard_dedup", "stage-decontaminate"}
    drop_tables(spark)
    again = Tables(spark, "mine")
    assert again.store("t", spark.range(2)).count() == 2
