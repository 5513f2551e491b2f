"""The five stages against plain rebuilds of their decisions."""

from __future__ import annotations

from fixtures import documents, prose, with_clashing_columns
from test_jaccard import brute as classes
from test_packing import check
from test_suffix_dedup import kept_text, masked

import corpus_pipeline
from granary.llm import language, pii
from pyspark.sql import functions as F


def test_stages_follow_each_other(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r for r in docs.collect()}
    languages, probabilities = language.train(docs)
    keep = {}
    for i, r in texts.items():
        share = language.proportions(probabilities, r["text"])
        if share is not None and share.max() >= corpus_pipeline.LEAST_SHARE:
            keep[i] = r["text"]
    keep = {i: keep[i] for i, c, _ in classes(list(keep.items())) if i == c}
    current = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        current = stage(spark, current, small)
        assert current.columns == docs.columns
        rows = {r["doc_id"]: r for r in current.collect()}
        if k == 1:
            assert {i: r["text"] for i, r in rows.items()} == keep
        if k == 2:
            want = {i: kept_text(b, go) for i, b, go in masked(list(keep.items()))}
            assert {i: (r["text"], r["n_chars"]) for i, r in rows.items()} == {i: (t, len(t)) for i, t in want.items()}
            before = {i: r["text"] for i, r in rows.items()}
        if k == 3:
            weights = pii.train()
            for i, r in rows.items():
                assert r["text"] == pii.redacted(before[i], sum(pii.found_spans(before[i], weights), []))
    check(corpus_pipeline.STAGES[4][1](spark, current, small).collect(), [(i, r["text"]) for i, r in rows.items()])


def test_stages_keep_rows_of_any_shape(spark, small):
    rows = [(1, None), (2, ""), (None, prose(80, 1)), (3, prose(80, 2)), (3, prose(80, 2)), (4, prose(20_000, 3)), (5, "1 2 3")]
    for docs in (with_clashing_columns(documents(spark, rows)), with_clashing_columns(documents(spark, []))):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[4][1](spark, docs, small).count() >= docs.where("false").count()


def test_rows_that_share_an_id(spark, small):
    """Rows of one id with other texts are documents of their own; equal rows are one."""
    a, b = prose(80, 5), prose(80, 6)
    docs = with_clashing_columns(documents(spark, [(1, a), (1, b), (2, a), (3, b + " word"), (4, prose(80, 7)), (4, prose(80, 7))]))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, small)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (4, prose(80, 7))])


def test_unlabelled_documents_stay(spark):
    docs = documents(spark, [(1, "Plain words."), (2, "Été"), (3, "1 2 3"), (4, ""), (5, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()) == [1, 2]


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
