"""Byte-level BPE: equal to the library, exact round trip."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from fixtures import documents, prose, with_clashing_columns
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import bpe, registry


def library() -> tiktoken.Encoding:
    with open(registry.BPE_MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODING = library()


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = registry.op9_byte_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ENCODING.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab1 \n\t'sé.,!  日²")), st.characters(exclude_categories=("Cs",))), max_size=120), st.integers(1, 20))
def test_pieces_change_no_id(text, size):
    pieces = list(bpe.safe_pieces(text, size))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in ENCODING.encode_ordinary(p)] == ENCODING.encode_ordinary(text)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, prose(60_000, 1)), (5, "a" * 120_000), (6, "x"), (6, "x")]
    docs = with_clashing_columns(documents(spark, rows))
    ids = docs.select("doc_id", "text", bpe.encode(docs, registry.BPE_MULTI, public_tokenizers.PATTERN))
    for r in ids.withColumn("back", bpe.decode(ids["token_ids"], registry.BPE_MULTI, public_tokenizers.PATTERN)).collect():
        assert bytes(r["back"]).decode() == (r["text"] or "")
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ENCODING.encode_ordinary(r["text"] or "")
    none = documents(spark, [])
    assert none.select(bpe.encode(none, registry.BPE_MULTI, public_tokenizers.PATTERN)).count() == 0
