"""What the pipeline's stages leave on disk, and what they move."""

import pytest

from evidentia.session import Tables, path_exists
from tests.llm.test_pipeline import STAGES, fixture, frame

pytest.importorskip("public_tokenizers")


def test_tables_of_a_stage_go_when_the_next_one_starts_on_its_written_rows(spark, tmp_path, monkeypatch):
    made, init = [], Tables.__init__
    monkeypatch.setattr(Tables, "__init__", lambda self, *a: init(self, *a) or made.append(self.folder))
    rows, _ = fixture()
    sf = str(tmp_path)
    frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = STAGES["quality_rules"](spark, docs, sf)
    first = list(made)
    # neither an input that reads them nor one from before them lets them go
    assert STAGES["mix_sources"](spark, kept, sf).count() > 0 and STAGES["mix_sources"](spark, docs, sf).count() > 0
    assert first and all(path_exists(spark, f) for f in first)
    kept.write.parquet(f"{sf}/kept")
    out = STAGES["jaccard_dedup"](spark, spark.read.parquet(f"{sf}/kept"), sf)
    assert not any(path_exists(spark, f) for f in first) and out.count() > 0


def test_the_mix_stores_the_rows_once(spark, tmp_path, monkeypatch):
    stored, store = {}, Tables.store
    monkeypatch.setattr(Tables, "store", lambda self, name, df, *more: stored.update({name: df.schema.simpleString()}) or store(self, name, df, *more))
    rows, _ = fixture()
    assert STAGES["mix_sources"](spark, frame(spark, rows), str(tmp_path)).count() > 0
    assert [name for name, schema in stored.items() if "text" in schema] == ["rows"]
