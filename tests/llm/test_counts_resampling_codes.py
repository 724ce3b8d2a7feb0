"""Token counts, importance resampling and vector codes against the library and brute-force restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import importance, token_counts, vector_codes
from evidentia.llm import queries as Q

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


# --- operator 11 -------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(), st.sampled_from(" \n\t's1a!\x1c\x85 é中"))))
def test_any_text_counts_as_the_library_counts_it(text):
    text = text.encode("utf-8", "ignore").decode()
    assert token_counts.counter(PATH).count([text])[0] == library_count(text)


def test_letters_younger_than_the_library_are_cut_as_it_cuts_them():
    young = [c for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.isprintable()][::7]
    texts = [f"a{c}1{c}!{c} {c}{c}" for c in [*young, "՘", "࢏", "౜", "꟎", "\U000107bb", "\U00010940", "\x00", "\u0085", " "]]
    assert token_counts.counter(PATH).count(texts).tolist() == [library_count(t) for t in texts]


def test_added_tokens_in_texts_are_one_token_each():
    texts = ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|><|endoftext|> c", "<|endoftext|", " <|endoftext|> \n"]
    assert token_counts.counter(PATH).count(texts).tolist() == [library_count(t) for t in texts]


def test_long_pre_tokens_and_long_texts():
    r = random.Random(3)
    texts = ["a" * 9_001, "ab" * 5_000, "".join(r.choice("abcdefghij") for _ in range(40_000)), "中文字" * 3_000, "=" * 4_097,
             " ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(1, 12))) for _ in range(60_000)), "x" + " " * 70_000 + "y", " \n" * 50_000]
    assert token_counts.counter(PATH).count(texts).tolist() == [library_count(t) for t in texts]


def one_by_one(table, piece):
    """Merges a pre-token pair by pair: lowest rank first, leftmost first."""
    sym = [int(table.bytes[b]) for b in piece]
    while len(sym) > 1:
        ranks = [int(table.ranks(np.array([a]), np.array([b]))[0]) for a, b in zip(sym, sym[1:], strict=False)]
        k = min(range(len(ranks)), key=lambda i: (ranks[i], i))
        if ranks[k] == token_counts.NONE:
            break
        sym[k : k + 2] = [int(table.made[ranks[k]])]
    return len(sym)


def test_merges_that_make_a_symbol_of_a_lower_rank_go_one_by_one(monkeypatch):
    letters = token_counts._byte_letters()
    r = random.Random(5)
    singles = 0
    for _ in range(40):
        words, merges = list("abc"), []
        for _ in range(14):
            a, b = r.choice(words), r.choice(words)
            if len(a + b) <= 6 and [a, b] not in merges:
                merges.append([a, b])
                words.append(a + b)
        r.shuffle(merges)  # ranks in no order, so that symbols exist before the pairs that need them
        vocab = {w: i for i, w in enumerate(dict.fromkeys([*letters, *words]))}
        table = token_counts.MergeTable(vocab, merges)
        singles += int(table.single.sum())
        pieces = ["".join(r.choice("abc") for _ in range(r.randrange(1, 30))).encode() for _ in range(60)]
        want = [one_by_one(table, p) for p in pieces]
        assert table.counts(pieces).tolist() == want
        with monkeypatch.context() as m:
            m.setattr(token_counts, "LONG_PIECE", 1)
            assert table.counts(pieces).tolist() == want
    assert singles > 0


def test_files_of_another_kind_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_of_odd_tables(spark):
    rows = [(1, "one two three", "x", 7), (1, "one two three", "y", 8), (None, None, None, None), (2, "", "z", 9), (3, "word " * 1100, "w", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_tokens int")
    got = sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=repr)
    want = sorted([(d, len((t or "").encode()), library_count(t), library_count(t) > 1024) for d, t, *_ in rows], key=repr)
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_op11_over_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in Q.op11_token_counts(spark, sf).collect()}
    assert got == {d: (len((t or "").encode()), library_count(t), library_count(t) > 1024) for d, t in texts}


# --- operator 12 -------------------------------------------------------------------------------------------------


def brute_resample(docs, target, buckets, n_words, least, percent):
    cut = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        low = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
        words = cut.findall(low)
        return words, Counter(zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, n_words + 1) for i in range(len(words) - n + 1))

    read = [(d, *features(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in read:
        s.update(c)
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for d, words, c in read:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in c.items())
        out.append((d, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = len(fit) * percent // 100
    return sorted([(*r[:4], i + 1 if i < k else None) for i, r in enumerate(fit)] + [(*r[:4], None) for r in out if r[4] < least], key=repr)


def got_resample(df):
    return sorted(map(tuple, df.select("id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("n_words", [1, 2, 3])
def test_resampling_is_the_brute_force_one(spark, monkeypatch, n_words):
    r = random.Random(n_words)
    words = ["The", "the", "cat", "naïve", "Ünder", "x1", "中文", "42"] + [f"w{i}" for i in range(60)]
    docs = [(i if i % 17 else None, " ".join(r.choice(words) if r.random() < 0.6 else "the" for _ in range(r.randrange(0, 60))) + r.choice(["", ".", "--"])) for i in range(150)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (7, None), (8, ""), (9, "... !!"), (None, None), (10, "tail " * 400)]
    target = ["cat w1 w2 the naïve", None, "", "W1 w1 w1"]
    monkeypatch.setattr(importance, "STRETCH_BYTES", 64)  # not seen by workers; the driver-side check follows
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, bucket string, key int")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = got_resample(importance.resample(df, bench, buckets=97, most_words=n_words, percent=30))
    assert got == brute_resample(docs, target, 97, n_words, 20, 30)
    table = importance._spaced()
    text = (" ".join(t or "" for _, t in docs)).encode().translate(table)
    in_stretches = importance._text_buckets(text, 97, n_words)
    monkeypatch.setattr(importance, "STRETCH_BYTES", 1 << 30)
    whole = importance._text_buckets(text, 97, n_words)
    assert in_stretches[0] == whole[0] and all((a == b).all() for a, b in zip(in_stretches[1:], whole[1:], strict=True))


def test_resampling_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = got_resample(importance.resample(docs, none, buckets=10))
    assert got == brute_resample([(1, "a b"), (None, None)], [], 10, 1, 20, 10)
    assert importance.resample(docs.limit(0), none).collect() == []


def test_ranks_are_one_to_k_over_several_ranges(spark):
    scored = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("score"), F.lit(1).alias("n_features"), F.lit(0).alias("block"), F.col("id").alias("doc"))
    from evidentia.session import Tables

    rows = importance._ranked(scored, Tables(spark, "t")).select("score", "id", "rank").collect()
    want = sorted(((-(i % 7), i) for i in range(5000)))
    assert [(r["score"], r["id"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(-s, i) for s, i in want]
    assert sorted(r["rank"] for r in rows) == list(range(1, 5001))


# --- operator 13 -------------------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale=1024):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    step = len(kept[0][2]) // parts
    cut = [[r[2][p * step : (p + 1) * step] for r in kept] for p in range(parts)]
    books = [[list(v) for v in cut[p][:entries]] for p in range(parts)]

    def assign():
        out = []
        for p in range(parts):
            out.append([min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p])) for v in cut[p]])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v for v, (_, e) in zip(cut[p], found[p], strict=True) if e == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    rows = [(r[0], r[1], "".join(f"{found[p][n][1]:02x}" for p in range(parts)), sum(found[p][n][0] for p in range(parts))) for n, r in enumerate(kept)]
    label = Counter()
    for _, lab, _, e in rows:
        label[lab] += e
    return sorted([(*r, label[r[1]]) for r in rows], key=repr), books


def vectors_with_ties(n, width, seed):
    r = random.Random(seed)
    rows = [(i * 3, [r.choice([-0.5, -0.1, 0.0, 0.1, 0.25, r.uniform(-1, 1)]) for _ in range(width)], r.choice([0, 1, 2, None])) for i in range(n)]
    rows += [rows[4], rows[4], (1, None, 0), (2, [None] * width, 1), (4, [float("nan")] * width, 1), (5, [float("inf")] + [0.0] * (width - 1), 1), (6, [], 2), (None, rows[5][1], None)]
    return rows


@pytest.mark.parametrize("entries,broadcast", [(7, 10**6), (40, 0), (256, 10**6)])
def test_codes_are_the_brute_force_ones(spark, monkeypatch, entries, broadcast):
    monkeypatch.setattr(vector_codes, "MOST_BROADCAST_LABELS", broadcast)
    rows = vectors_with_ties(150, 8, entries)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    codes = vector_codes.compress(df, entries=entries)
    got = sorted(map(tuple, vector_codes.with_label_error(codes.rows).collect()), key=repr)
    want, books = brute_codes(rows, 4, entries, 4)
    assert codes.codebooks == books
    assert got == want


def test_the_tree_finds_the_nearest_entry_with_the_lowest_index():
    r = np.random.default_rng(1)
    for width, top in ((1, 4), (3, 3), (16, 400), (16, 1 << 24)):
        entries = r.integers(-top, top + 1, (200, width))
        entries[50:60] = entries[3]
        points = np.concatenate([r.integers(-top, top + 1, (500, width)), entries])
        far = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        who, best = vector_codes.nearest(vector_codes.build_tree(entries), points)
        assert (who == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_the_tree_skips_entries(monkeypatch):
    r = np.random.default_rng(2)
    entries = np.concatenate([r.normal(c, 5, (32, 16)) for c in (-900, -300, 300, 900)]).astype(np.int64)
    points = entries[r.integers(0, 128, 400)] + 1
    looked = []
    plain = vector_codes._squared
    monkeypatch.setattr(vector_codes, "_squared", lambda a, b: looked.append(len(a)) or plain(a, b))
    tree = vector_codes.build_tree(entries)
    looked.clear()
    vector_codes.nearest(tree, points)
    assert sum(looked) < 128 * 400 / 2


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    empty = vector_codes.compress(spark.createDataFrame([], schema))
    assert vector_codes.with_label_error(empty.rows).collect() == [] and empty.sha256() == hashlib.sha256(b"").hexdigest()
    for bad in ([(1, [1.0, 2.0, 3.0], 0)], [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)]):
        with pytest.raises(ValueError, match="one length"):
            vector_codes.compress(spark.createDataFrame(bad, schema))
    with pytest.raises(Exception, match="no exact code"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 0)], schema))


# --- queries -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_importance", "op13_vector_codes"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    want = con.execute(Q.ORACLES[name]).df()
    got = Q.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    key = list(want.columns)
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)
