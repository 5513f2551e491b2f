"""Rollups by signed changes."""

from __future__ import annotations

import uuid

import pytest
from fixtures import rows_of

from granary.llm import registry, token_counts
from granary.sources.tables import shared_dir

CHANGES = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def store(spark) -> str:
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


def test_insert_delete_revise_and_replay(spark):
    at = store(spark)
    one = spark.createDataFrame([("insert", "a", "en", "t", 10, None), ("insert", "a", "en", "t", 5, None), ("insert", None, None, "t", None, None), ("insert", "b", "en", "t", 7, None)], CHANGES)
    two = spark.createDataFrame([("revise", "a", "en", "t", 12, 10), ("delete", "b", "en", "t", 7, None)], CHANGES)
    token_counts.commit(one, at, 1)
    token_counts.commit(two, at, 2)
    expected = [("a", "en", "t", 2, 17), (None, None, "t", 1, 0)]
    assert rows_of(token_counts.totals(spark, at)) == expected
    assert not token_counts.commit(two, at, 2) and not token_counts.commit(one, at, 1)
    assert rows_of(token_counts.totals(spark, at)) == expected
    token_counts.compact(spark, at, 3)
    assert rows_of(token_counts.totals(spark, at)) == expected
    assert not token_counts.commit(one, at, 1)
    three = spark.createDataFrame([("insert", "c", "en", "t", 4, None)] * 2, CHANGES)
    assert token_counts.commit(three, at, 4)
    assert rows_of(token_counts.totals(spark, at)) == sorted([*expected, ("c", "en", "t", 2, 8)], key=repr)
    with pytest.raises(ValueError, match="committed already"):
        token_counts.compact(spark, at, 4)


def test_other_content_under_a_known_id_is_refused(spark):
    at = store(spark)
    token_counts.commit(spark.createDataFrame([("insert", "a", "en", "t", 10, None)], CHANGES), at, 7)
    with pytest.raises(ValueError, match="other content"):
        token_counts.commit(spark.createDataFrame([("insert", "a", "en", "t", 11, None)], CHANGES), at, 7)
    assert rows_of(token_counts.totals(spark, at)) == [("a", "en", "t", 1, 10)]


def test_crash_between_rows_and_note(spark, monkeypatch):
    at = store(spark)
    batch = spark.createDataFrame([("insert", "a", "en", "t", 10, None)], CHANGES)
    with monkeypatch.context() as m:
        m.setattr(token_counts, "digest_of", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            token_counts.commit(batch, at, 1)
    assert token_counts.totals(spark, at).count() == 0
    assert token_counts.commit(batch, at, 1) and not token_counts.commit(batch, at, 1)
    assert rows_of(token_counts.totals(spark, at)) == [("a", "en", "t", 1, 10)]


def test_clashing_columns(spark):
    at = store(spark)
    batch = spark.createDataFrame([("insert", "a", "en", "t", 10, None)], CHANGES).selectExpr("*", "'x' as n_docs", "'y' as digest", "'z' as `a.b`", "1 as folder")
    token_counts.commit(batch, at, 1)
    assert rows_of(token_counts.totals(spark, at)) == [("a", "en", "t", 1, 10)]


def test_empty_batch_and_unknown_op(spark):
    at = store(spark)
    assert token_counts.totals(spark, at).count() == 0
    token_counts.commit(spark.createDataFrame([], CHANGES), at, 1)
    assert token_counts.totals(spark, at).count() == 0
    with pytest.raises(Exception, match="unknown op"):
        token_counts.commit(spark.createDataFrame([("upsert", "a", "en", "t", 1, 0)], CHANGES), at, 2)
    assert token_counts.committed(spark, at) == {1}


def test_query_equals_plain_sums(spark, small):
    import base64

    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    first: dict[str, int] = {}
    for d in docs:
        first[d["text"] or ""] = min(d["doc_id"], first.get(d["text"] or "", d["doc_id"]))
    totals: dict[tuple, list[int]] = {}
    for name, path in (("byte_bpe_50k", registry.BPE_RANKS), ("byte_bpe_multi_50k", registry.BPE_MULTI)):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for d in docs:
            if first[d["text"] or ""] == d["doc_id"]:
                group = totals.setdefault((d["source"], d["lang"], name), [0, 0])
                group[0] += 1
                group[1] += len(encoding.encode_ordinary(d["text"] or "")) + (name == "byte_bpe_50k")
    assert rows_of(registry.op4_token_counts(spark, small)) == sorted(((*k, *v) for k, v in totals.items()), key=repr)
