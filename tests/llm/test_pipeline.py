"""The pipeline's stages, each against plain Python on fixtures with null and shared ids, repeated rows and clashing column names."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import mixing
from tests.llm.test_arrow_operators import brute_components, words_of
from tests.llm.test_text_rules_chat_mix import rules_of

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row int, key string, taken long, copy boolean, component long"
STAGES = dict(corpus_pipeline.STAGES)
VOCABULARY = [f"w{k}" for k in range(500)]


def frame(spark, rows):
    """(doc_id, text, source) -> documents with columns whose names the stages use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), k, "key", 5, True, 9) for k, (i, t, s) in enumerate(rows)], SCHEMA)


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def fixture(seed=1):
    r = random.Random(seed)
    base, item = prose(r, 60), prose(r, 20)
    rows = [(k, prose(r, r.randint(25, 90)), f"s{k % 3}") for k in range(40)]
    rows += [(None, prose(r, 50), "s0"), (None, prose(r, 50), None), (3, prose(r, 40), "s1"), (3, prose(r, 40), "s1")]
    rows += [(100, base, "s0"), (101, base, "s1"), (101, base, "s1"), (None, base + " tail", "s2"), (99, base.upper(), "s2"), (3, base + " more of it", "s0")]
    rows += [(200, prose(r, 30) + " " + item + " " + prose(r, 30), "s0"), (3, item.upper() + " " + prose(r, 12), "s1"), (None, prose(r, 9) + " " + item, "s1")]
    rows += [(300, None, "s0"), (301, "", "s1"), (302, "too short", "s2"), (303, "same words over and over again now ok " * 9, "s2"), (304, "# % & " * 30, "s0"), (305, prose(r, 9000), "s0")]
    return rows, item


def texts_of(df):
    return Counter((x["doc_id"], x["text"]) for x in df.collect())


def passes(text):
    n, chars, symbols, dup, repeat = rules_of(text)
    lines = len([x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")])
    upper = len(re.findall("[A-Z]", text or ""))
    return not (n < 20 or 100 * repeat > 30 * n or 2 * symbols > n or (2 * dup > lines and lines >= 4) or 10 * upper > 6 * chars or chars > 40 * n)


def columns_pass(docs, out):
    assert out.columns == docs.columns and out.limit(0).count() == 0
    assert {(x["key"], x["component"], x["copy"]) for x in out.collect()} <= {("key", 9, True)}


def test_quality_stage(spark, tmp_path):
    rows, _ = fixture()
    docs = frame(spark, rows)
    out = STAGES["quality_rules"](spark, docs, str(tmp_path))
    columns_pass(docs, out)
    assert texts_of(out) == Counter((i, t) for i, t, _ in rows if passes(t))
    assert STAGES["quality_rules"](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_dedup_stage(spark, tmp_path):
    rows, _ = fixture()
    docs = frame(spark, rows).repartition(3)
    out = STAGES["jaccard_dedup"](spark, docs, str(tmp_path))
    columns_pass(docs, out)
    texts = [t for _, t, _ in rows]
    groups = {}
    for k, n, c in brute_components(range(len(rows)), texts):
        groups.setdefault(c if n else f"none {k}", []).append(k)
    left = [x["row"] for x in out.collect()]
    assert len(left) == len(set(left)) == len(groups)
    for members in groups.values():
        stays = [k for k in members if k in set(left)]
        assert len(stays) == 1
        known = [rows[k][0] for k in members if rows[k][0] is not None]
        assert rows[stays[0]][0] == (min(known) if known else None)
    four = frame(spark, [(7, "a b c d e f", "s"), (7, "g h i j k l", "s"), (8, "m n o p q r", "s"), (None, "s t u v w x", "s")])
    assert STAGES["jaccard_dedup"](spark, four, str(tmp_path)).count() == 4
    assert STAGES["jaccard_dedup"](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_decontaminate_stage(spark, tmp_path):
    rows, item = fixture()
    docs = frame(spark, rows)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = STAGES["decontaminate"](spark, docs, str(tmp_path))
    columns_pass(docs, out)
    leaks = lambda t: " ".join(words_of(item)) in " ".join(words_of(t))
    assert texts_of(out) == Counter((i, t) for i, t, _ in rows if not leaks(t))
    assert STAGES["decontaminate"](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_mix_stage(spark, tmp_path):
    rows, _ = fixture()
    rows += [(None, prose(random.Random(k), 60), "s1") for k in range(4)] + [(1, "twice  the \n same", "s2")] * 2
    docs = frame(spark, rows)
    out = STAGES["mix_sources"](spark, docs, str(tmp_path))
    columns_pass(docs, out)
    plan = mixing.mix_sources(docs.selectExpr("struct(*) AS doc_id", "source", "text")).collect()
    took, made = Counter(), Counter()
    for x in plan:
        took[x["doc_id"]["row"]] += x["taken"]
    for x in out.collect():
        own = WORDS(x["text"])
        made[x["row"]] += len(own)
        assert x["n_chars"] == len(x["text"])
        full = WORDS(rows[x["row"]][1])
        assert x["text"] == rows[x["row"]][1] or Counter(own) <= Counter(full)
    assert made == +took
    assert STAGES["mix_sources"](spark, docs.limit(0), str(tmp_path)).count() == 0


def WORDS(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_whole_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, item = fixture(5)
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    plain, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    mixed = [(x["doc_id"], x["text"]) for x in docs.collect()]
    for i, t in mixed:
        own = [*plain.encode(t, add_special_tokens=False).ids, 2]
        want.append((str(i), len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(x["doc_id"]), x["n_tokens"], x["ids_crc32"]) for x in got) == sorted(want)
    for x in sorted(got, key=lambda x: x["start"]):
        assert x["start"] == start
        start += x["n_tokens"]
    by_id = [x["doc_id"] for x in sorted(got, key=lambda x: x["start"])]
    assert by_id == sorted(by_id, key=lambda i: (i is not None, i or 0))
