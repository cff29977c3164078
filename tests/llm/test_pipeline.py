"""The pipeline's stages against plain rules on the smallest tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import ngram_join, pii
from tallyframe.llm.store import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), "out")
        if name != "packing":
            assert out.columns == columns
        seen.append((docs, out))
        docs = out
    before = {r["doc_id"]: r["text"] for r in seen[1][0].collect()}
    best = {}
    for k, t in before.items():
        best[t] = max(k, best.get(t, k))
    assert {r["doc_id"] for r in seen[1][1].collect()} == set(best.values())
    groups = ngram_join.near_duplicates(seen[2][0], ngram_join.Threshold(5, 80)).collect()
    assert {r["doc_id"] for r in seen[2][1].collect()} == {r["component_id"] for r in groups}
    was = {r["doc_id"]: r["text"] for r in seen[3][0].collect()}
    now = {r["doc_id"]: r["text"] for r in seen[3][1].collect()}
    assert now.keys() == was.keys() and all((now[k] == t) == (not pii.detect(t)) for k, t in was.items())
    assert {r["doc_id"] for r in seen[4][1].collect()} == now.keys()
    assert seen[0][1].count() > 0.7 * seen[0][0].count()


ROWS = [(5, "only here"), (5, "text x of six words once"), (3, "text x of six words once"), (None, "no id"), (None, "no id"), (7, None), (7, ""), (8, ""), (9, "text x of six words once"), (9, "text x of six words once")]


def _docs(spark):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def test_copies_by_row_and_not_by_id(spark):
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in corpus_pipeline.exact_copies(spark, _docs(spark), SF).collect())
    assert kept == [(-1, "no id"), (5, "only here"), (8, ""), (9, "text x of six words once")]
    near = sorted((r["doc_id"] or -1, r["text"] or "") for r in corpus_pipeline.near_copies(spark, _docs(spark), SF).collect())
    assert near == [(-1, "no id"), (-1, "no id"), (3, "text x of six words once"), (5, "only here"), (7, ""), (7, ""), (8, "")]


def test_stages_on_odd_and_on_no_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        odd = _docs(spark).withColumn("kept", F.lit(1)).withColumn("score", F.lit(2))
        out = materialise(stage(spark, odd, SF), "odd")
        if name != "packing":
            assert out.columns == odd.columns
        assert stage(spark, odd.limit(0), SF).count() == 0
