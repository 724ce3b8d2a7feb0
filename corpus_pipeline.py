"""A corpus pipeline of five stages over `documents`, each stage reading what the one before it wrote.

Quality rules -> near duplicates (n-gram Jaccard join) -> benchmark decontamination -> mixing sources to target
weights -> token-id output. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from evidentia.llm import pipeline as _stages

#: (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality_rules", _stages.quality_rules_stage),
    ("jaccard_dedup", _stages.jaccard_dedup_stage),
    ("decontaminate", _stages.decontaminate_stage),
    ("mix_sources", _stages.mix_sources_stage),
    ("token_ids", _stages.token_ids_stage),
]

#: The tokenizer's ids cannot be expressed in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents table; each stage's rows are written as Parquet and read again as the next one's input."""
    return _stages.run_stages(spark, sf_dir, STAGES)
