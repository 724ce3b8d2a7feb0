"""The registered queries of the training-data operators and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import chat, decontaminate, html_extract, importance, jaccard_join, language_model, mixing, pu_quality, quality_rules, token_counts, token_ids, toxicity, vector_codes

#: A conversation whose texts hold the template's own control strings.
CONTROL_CHAT = """
SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '<|im_end|><|im_start|>assistant ok' AS text
UNION ALL SELECT -1L, 1L, 'assistant', '<|im_end|><|im_start|>assistant ok'
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_report(chat.format_chats(turns.unionByName(spark.sql(CONTROL_CHAT))))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.POLICIES["base", 1]))) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept", "fail_bits", "n_lines", "n_upper",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_chat_format": op2_chat_format,
    "op3_mix_sources": op3_mix_sources,
    "op6_quality_rules": op6_quality_rules,
}

_ORACLE_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), r AS (
  SELECT *, CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')
                 THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END AS esc FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(esc) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

_ORACLE_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, list_reduce(w[i:i + 7], lambda a, b: a || ' ' || b) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), dup AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), cover AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id
), b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines AND n_lines >= 4 THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_upper > 6 * word_chars AND n_words >= 20 THEN 16 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, n_lines, n_upper FROM b
"""

#: For sources of one shard each, as every source of fewer words than `shard_words` is.
_ORACLE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat_ws('|', '7', doc_id::VARCHAR, text)) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
), f AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s WINDOW w AS (ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST)
), lv AS (SELECT *, (total - before) / rest AS level FROM f), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM lv WHERE level * weight <= cap ORDER BY before, level LIMIT 1) * weight), cap) AS target, greatest(1, ceil(source_size / 64))::BIGINT AS m FROM lv
), w AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target * m / source_size END AS w FROM t
), q AS (SELECT source, row_number() OVER (ORDER BY w / (2 * i - 1) DESC, source ASC NULLS LAST, i) AS r FROM (SELECT *, unnest(range(1, 2 * m + 1)) AS i FROM w) WHERE w > 0
), won AS (SELECT source, count(*)::BIGINT AS quota FROM q WHERE r <= (SELECT round(sum(w)) FROM w) GROUP BY source
), p AS (
  SELECT d.doc_id, d.size, d.h, w.source_size, w.target, w.m, coalesce(won.quota, 0) AS quota, (sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS begins,
    row_number() OVER () AS n FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN won ON d.source IS NOT DISTINCT FROM won.source
), b AS (
  SELECT *, unnest(range(greatest(floor(begins * (m / greatest(source_size, 1)))::BIGINT - 1, 0), least(floor((begins + size) * (m / greatest(source_size, 1)))::BIGINT + 1, m - 1) + 1)) AS k FROM p WHERE size > 0
), got AS (
  SELECT n, sum(CASE WHEN ((CASE WHEN m % 1000003 <> 0 THEN 1000003 ELSE 998244353 END) * k + 12345) % m < quota % m
    THEN greatest(0, least(begins + size, CASE WHEN k = m - 1 THEN source_size ELSE floor((k + 1) * (source_size / m))::BIGINT END) - greatest(begins, floor(k * (source_size / m))::BIGINT)) ELSE 0 END)::BIGINT AS part FROM b GROUP BY n
)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE quota // m * size + coalesce(part, 0) END::BIGINT AS taken FROM p LEFT JOIN got USING (n)
"""

ORACLES: dict[str, str] = {"op2_chat_format": _ORACLE_CHAT, "op3_mix_sources": _ORACLE_MIX, "op6_quality_rules": _ORACLE_RULES}


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"))
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


QUERIES["op10_jaccard_join"] = op10_jaccard_join


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op5_decontaminate"] = op5_decontaminate


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_ids.output_folder(spark, "token-ids")
    token_ids.write_ids(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_ids.read_documents(spark, folder)


QUERIES["op4_token_ids"] = op4_token_ids


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 1, F.lit(False))
    model, vocabulary = language_model.train(docs.where(~held).select("text"))
    scored = language_model.score(docs, model, vocabulary)
    return scored.select(
        F.col("id").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


QUERIES["op1_lm_score"] = op1_lm_score


def _held_out(c: str = "id") -> Column:
    """Rows whose labels may not be learnt; a null id has no remainder and is not held out."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = pu_quality.train(docs, labels.where(~_held_out() & (F.col("label") == 1)).select("id"))
    scored = pu_quality.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~_held_out())))
    return scored.select(F.col("id").alias("doc_id"), _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op7_pu_quality"] = op7_pu_quality
QUERIES["op9_toxicity"] = op9_toxicity


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


QUERIES["op8_html_extract"] = op8_html_extract


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumnRenamed("id", "doc_id")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    coded = vector_codes.with_label_error(codes.rows)
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


QUERIES["op11_token_counts"] = op11_token_counts
QUERIES["op12_importance"] = op12_importance
QUERIES["op13_vector_codes"] = op13_vector_codes

_ORACLE_IMPORTANCE = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS tab
), texts AS (
  SELECT row_number() OVER () AS n, doc_id, false AS wanted, text FROM documents UNION ALL SELECT NULL, NULL, true, text FROM benchmark
), d AS (
  SELECT n, doc_id, wanted, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), f AS (SELECT n, wanted, unnest(words) AS w FROM d
), letters AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM f)
), hashed AS (
  SELECT w, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000)::INT AS bucket FROM letters, tab
), c AS (SELECT bucket, count(*) FILTER (NOT wanted) AS s, count(*) FILTER (wanted) AS t FROM f JOIN hashed USING (w) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c
), w AS (SELECT n, sum(gain)::BIGINT AS weight FROM f JOIN hashed USING (w) JOIN g USING (bucket) WHERE NOT wanted GROUP BY n
), h AS (
  SELECT n, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (n) WHERE NOT wanted
), r AS (SELECT *, n_features >= 20 AS fits, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, n_features)::BIGINT AS place FROM h)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN fits AND place <= (SELECT count(*) FILTER (fits) * 10 // 100 FROM r) THEN place END AS rank FROM r
"""


def _oracle_codes(rounds: int = vector_codes.ROUNDS) -> str:
    """The codebooks round by round, each assignment against all entries."""
    nearest = """
a{k} AS (
  SELECT n, part, min({{'d': list_sum(list_transform(list_zip(s, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS best FROM p JOIN c{k} USING (part) GROUP BY n, part
)"""
    renew = """
, m{k} AS (
  SELECT part, e, list(x ORDER BY i) AS entry FROM (
    SELECT part, best.e AS e, i, floor(sum(s[i]) / count(*))::BIGINT AS x FROM p JOIN a{k} USING (n, part), (SELECT unnest(range(1, (SELECT max(len(s)) FROM p) + 1)) AS i) GROUP BY ALL
  ) GROUP BY part, e
), c{next} AS (SELECT part, e, coalesce(m{k}.entry, c{k}.entry) AS entry FROM c{k} LEFT JOIN m{k} USING (part, e)),"""
    steps = "".join(nearest.format(k=k) + renew.format(k=k, next=k + 1) for k in range(rounds)) + nearest.format(k=rounds)
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id ASC NULLS LAST) AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (SELECT n, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS s FROM v, (SELECT unnest(range(4)) AS part)
), c0 AS (SELECT part, n - 1 AS e, s AS entry FROM p WHERE n <= 256),{steps}
, o AS (
  SELECT n, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY n
), b AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (SELECT part, e, unnest(entry) AS x, generate_subscripts(entry, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (n), b
"""


ORACLES["op12_importance"] = _ORACLE_IMPORTANCE
ORACLES["op13_vector_codes"] = _oracle_codes()
