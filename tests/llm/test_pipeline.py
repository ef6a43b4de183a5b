"""The corpus pipeline on the smallest tables: each stage judged on its own input."""

import duckdb
import pytest

from quarrymill.llm import eb_classifier, icws_dedup, llr_rules
from quarrymill.operators.tables import written

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept, columns = docs, docs.columns
    keys = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    seen = [keys(kept)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, written(stage(spark, kept, SF), name)
        assert kept.columns == columns
        want = {
            "quality_rules": lambda: llr_rules.judge_documents(before, llr_rules.trusted_keys(labels)).filter("kept").select("row.doc_id"),  # noqa: B023
            "quality_classifier": lambda: eb_classifier.classify(before, labels).filter("kept"),  # noqa: B023
            "near_dedup": lambda: icws_dedup.near_duplicates(before).filter("doc_id = class_id"),  # noqa: B023
        }[name]()
        assert keys(kept) == keys(want)
        seen.append(keys(kept))
    assert all(set(b) <= set(a) for a, b in zip(seen, seen[1:], strict=False))
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(packed["doc_id"].unique()) == seen[-1]
    assert (packed.groupby("doc_id")["length"].sum() == packed.groupby("doc_id")["doc_tokens"].first()).all()
    clean = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1 AND toxic = 0").fetchall()}
    base = {k for k in clean if k in seen[1]}
    assert len(base & set(seen[2])) > 0.97 * len(base)
