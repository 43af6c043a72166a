"""The pipeline's stages against their operators, one after the other."""

import os

import pytest

import corpus_pipeline
from ordina.llm import exact_dedup, minhash, packing, quality_rules

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, verdicts = docs.columns, [quality_rules.judge, exact_dedup.exact_groups, minhash.near_groups]
    for (_, stage), verdict in zip(corpus_pipeline.STAGES[:3], verdicts, strict=True):
        kept = stage(spark, docs, DIR).cache()
        ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
        assert kept.columns == columns and ids(kept) == ids(verdict(docs).filter("kept"))
        docs = kept
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, DIR).cache()
    assert mixed.columns == columns and 0 < mixed.count() <= docs.count()
    made = corpus_pipeline.run(spark, DIR)
    assert {r.doc_id for r in made.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.select("doc_id").collect()}
    total = packing.pack(mixed).groupBy().sum("length").first()[0]
    assert made.groupBy().sum("length").first()[0] == total
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]


def test_odd_documents(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows and columns of other names go through all stages."""
    text = " ".join(f"word{i}" for i in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, k string"
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (None, text + " one", "en", "s"), (None, text + " one", "en", "s"), (2, text.upper(), None, None), (3, None, "en", "s"), (4, "", "en", "s"), (5, text + " more words", "en", "s")]
    for name, table in (("some", rows), ("none", [])):
        docs = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in table], schema)
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        stage = docs
        for _, function in corpus_pipeline.STAGES[:-1]:
            stage = function(spark, stage, str(tmp_path / name))
            assert stage.columns == docs.columns
            assert all((r.row, r.kept, r.k) == ("x", "y", "z") for r in stage.collect())
        made = corpus_pipeline.run(spark, str(tmp_path / name))
        ids = [r.doc_id for r in made.select("doc_id").collect()]
        assert (ids.count(1), ids.count(3)) == ((1, 0) if table else (0, 0)) and None in ids or not table
