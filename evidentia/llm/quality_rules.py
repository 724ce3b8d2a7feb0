"""Rule bitmask ledger: every quality rule is evaluated once, its failure bit and measurement are stored,
and policies are applied to the stored bits later.

Native: DataFrame functions only, one narrow pass over the texts, no shuffle.

Cases: a null or empty text has no words, measures 0 and fails `few_words`; repeated rows and ties are
independent rows; an empty table gives an empty ledger; columns of the input other than the id and the
text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Rules in the order of their bits. A rule fails where its condition on the measurements holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "2 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines AND n_lines >= 4",
    "shouting": "10 * n_upper > 6 * word_chars AND n_words >= 20",
    "long_words": "word_chars > 40 * n_words",
}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_words"),
    ("web", 1): ("few_words", "repeated_words", "many_symbols"),
    ("web", 2): ("few_words", "repeated_words", "many_symbols", "duplicate_lines", "shouting", "long_words"),
}


def mask(rules: Sequence[str]) -> int:
    """The bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def split_words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def _repeated_words(hashes: str, n_words: str) -> Column:
    """Words that lie in an 8-word window found twice or more; the windows' hashes are an array column.

    Only texts with a repeated window pay for the sort: their windows are ordered by (hash, place), those
    equal to a neighbour are kept, and the union of [place, place + 8) is counted from ascending places.
    """
    ordered = f"array_sort(transform({hashes}, (x, i) -> struct(x AS h, i AS p)))"
    places = (
        f"transform(array({ordered}), s -> array_sort(transform(filter(s, (e, i) -> "
        f"(i > 0 AND e.h = s[greatest(i - 1, 0)].h) OR (i < size(s) - 1 AND e.h = s[least(i + 1, size(s) - 1)].h)), e -> e.p)))[0]"
    )
    covered = (
        f"transform(array({places}), p -> aggregate(transform(p, (x, i) -> "
        f"CASE WHEN i < size(p) - 1 THEN least({WINDOW}, p[least(i + 1, size(p) - 1)] - x) ELSE {WINDOW} END), 0L, (a, x) -> a + x))[0]"
    )
    return F.expr(f"CASE WHEN {n_words} <= {WINDOW} OR size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE {covered} END")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and every measurement that the rules use."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("__t"))
    words = base.withColumn("__w", split_words(F.col("__t")))
    counted = words.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("__t", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.expr(r"filter(split(__t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("__l"),
        F.expr(
            f"CASE WHEN size(__w) <= {WINDOW} THEN array() ELSE "
            f"transform(array(transform(__w, x -> xxhash64(x))), g -> "
            f"transform(sequence(1, greatest(size(__w) - {WINDOW - 1}, 1)), i -> xxhash64(slice(g, i, {WINDOW}))))[0] END"
        ).cast("array<bigint>").alias("__h"),
    )
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_upper",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeated_words("__h", "n_words").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() and `fail_bits`: bit k is set where rule k fails."""
    bits = " | ".join(f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END" for k, rule in enumerate(RULES.values()))
    return measure(docs, id_col, text_col).withColumn("fail_bits", F.expr(bits))


def apply_policy(ledger_df: DataFrame, policy: str = "web", version: int = 2) -> DataFrame:
    """The ledger and `kept`: no rule of the policy fails."""
    return ledger_df.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy, version]))) == 0)


def ablations(ledger_df: DataFrame, policy: str = "web", version: int = 2) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that it alone rejects.

    One aggregation over the failure patterns (at most 2^rules rows), with no second look at the texts.
    """
    m = mask(POLICIES[policy, version])
    patterns = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[policy, version]]))
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        )
    )
