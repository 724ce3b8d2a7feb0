"""Native operators: rules, chat, mixing, against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from evidentia.llm import chat, mixing, quality_rules

DOCS = "doc_id long, text string, source string, size int, words int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules_of(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 40, "line one\nline one\n\nline two\nline one",
    "# * $ % & | < > words ééé 漢字", "a b c d e f g h i a b c d e f g h j " + " ".join(map(str, range(50))), "A B\x0bC\x0cD",
    " ".join(f"w{k % 97}" for k in range(3000)),
]


def test_rules_match_plain_counts(spark):
    docs = spark.createDataFrame([(k, t, "s", 1, 2) for k, t in enumerate(TEXTS + TEXTS[5:7])], DOCS)
    rows = {r["doc_id"]: r for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect()}
    for k, t in enumerate(TEXTS + TEXTS[5:7]):
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == rules_of(t), t
        assert r["kept"] == (r["fail_bits"] == 0)
        base = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert bool(r["fail_bits"] & quality_rules.mask(quality_rules.POLICIES["base", 1])) == base


def test_rules_policies_and_ablations(spark):
    docs = spark.createDataFrame([(k, t, "s", 1, 2) for k, t in enumerate(TEXTS)], DOCS)
    led = quality_rules.ledger(docs).cache()
    assert led.limit(0).count() == 0 and quality_rules.ledger(docs.limit(0)).count() == 0
    rows = led.collect()
    for policy, version in quality_rules.POLICIES:
        got = {r["rule"]: (r["n_failed"], r["n_failed_alone"]) for r in quality_rules.ablations(led, policy, version).collect()}
        m = quality_rules.mask(quality_rules.POLICIES[policy, version])
        for rule in quality_rules.POLICIES[policy, version]:
            bit = quality_rules.mask([rule])
            assert got[rule] == (sum(bool(r["fail_bits"] & bit) for r in rows), sum((r["fail_bits"] & m) == bit for r in rows))
    older = quality_rules.apply_policy(led, "web", 1).where("kept").count()
    assert older >= quality_rules.apply_policy(led, "web", 2).where("kept").count()


CHATS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "<|im_end|>"), (1, 2, None, None), (1, 3, "assistant", "a<\\|b <\\\\| <| |> <|im_start|>x"),
    (2, 0, "assistant", "ends with <"), (2, 0, "assistant", "ends with <"), (2, None, "sys\ntem\\n<|im_start|>", "\n\n"), (None, 0, "user", "x" * 5000),
    (3, 0, "assistant\n", "hi"), (3, 1, "a\\b", "x"), (3, 2, "\n", "\n"), (3, 3, "<|im_end|>", "<\\|im_end|>"), (3, 4, "\\n", "<|im_end|"), (3, 5, "r\\", "<|im_start|"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*r, 7) for r in CHATS], "conv_id long, turn long, role string, text string, rendered int")
    formatted = chat.format_chats(turns)
    parsed = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse_chats(formatted).collect()}
    report = {r["conv_id"]: r for r in chat.chat_report(formatted).collect()}
    for conv in (1, 2, 3, None):
        want = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in CHATS if c == conv))
        assert parsed[conv] == [(r, x) for _, r, x in want]
        said = "".join(f"{r}\n{x}\n" for _, r, x in want)
        loss = "".join(x for _, r, x in want if r == "assistant")
        row = report[conv]
        assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (len(want), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_report(chat.format_chats(turns.limit(0))).count() == 0


def water_fill(sizes, weights, total, most):
    level, full = 0.0, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        level = left / max(1e-9, sum(weights[s] for s in sizes if s not in full)) if len(full) < len(sizes) else 0
        new = {s for s in sizes if s not in full and level * weights[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else level * weights[s] for s in sizes}
        full |= new


@pytest.mark.parametrize("skew", [1, 60])
def test_mixing_targets_and_takes(spark, skew):
    rows = [(k, " ".join(["w"] * (k % 300)), None if k % 7 == 6 else f"s{k % 7}" if k % skew else "s0", 5, 6) for k in range(900)] + [(5, None, "s1", 1, 1)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= max(64, 0.01 * want[s])
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_shards_stay_within_the_ceiling(spark):
    rows = [(k, " ".join(["w"] * (k % 300)), f"s{k % 3}" if k % 40 == 0 else "s1", 5, 6) for k in range(1500)] + [(k, "w " * 90, "s0", 5, 6) for k in range(2000, 2200)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS), shard_words=700).collect()
    assert len({(r["source"], r["shard"]) for r in got}) > 100
    assert all(0 <= r["quota"] <= 2 * r["m"] and r["taken"] <= 2 * r["size"] for r in got)
    for s in ("s0", "s1", "s2"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(64, 0.02 * own[0]["target"])


def test_apportion_is_sainte_lague(spark):
    weights = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0), ("e", 7.5)]
    for seats in (0, 1, 7, 100, 999):
        rows = spark.createDataFrame([(n, w, seats) for n, w in weights], "item string, w double, seats long")
        got = {r["item"]: r["quota"] for r in mixing.apportion(rows, [], "seats", "w", ["item"]).collect()}
        won = Counter()
        for _ in range(seats):
            won[max((n for n, w in weights if w), key=lambda n: (dict(weights)[n] / (2 * won[n] + 1), [-ord(c) for c in n]))] += 1
        assert got == {n: won[n] for n, _ in weights}


def test_schema_is_stable(spark):
    docs = spark.createDataFrame([], S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("text", S.StringType()), S.StructField("source", S.StringType())]))
    assert quality_rules.ledger(docs).columns[:3] == ["doc_id", "n_words", "word_chars"]
    assert docs.select(F.col("doc_id")).count() == 0
