"""Packing: every id once, windows filled, little padding."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import documents, prose, with_clashing_columns
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import packing, registry

WINDOW = 2048


def check(rows, docs: list[tuple[int, str | None]]) -> float:
    tokenizer = Tokenizer.from_file(registry.BPE_FILE)
    tokenizer.encode_special_tokens = True
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        ids = want[i][0]
        assert all((x == ids).all() for x in want[i])
        assert sum(r["length"] for r in own) == sum(map(len, want[i]))
        for r in own:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        if len(want[i]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= WINDOW
    total = sum(r["length"] for r in rows)
    return 1 - total / (WINDOW * len(sequences)) if sequences else 0.0


def test_query(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert check(registry.op5_packing(spark, small).collect(), docs) < 0.05


def test_edges(spark):
    long = prose(9000, 1)
    rows = [(1, None), (2, ""), (3, "a"), (4, long), (5, long), (6, long), (7, "<|endoftext|> x"), (8, "日本語 text 123"), (9, " \n\n \t" * 50), (9, " \n\n \t" * 50)] + [(100 + i, prose(150, i)) for i in range(60)]
    docs = with_clashing_columns(documents(spark, rows))
    check(packing.pack(docs, registry.BPE_FILE, registry.BPE_RANKS, public_tokenizers.PATTERN).collect(), rows)
    assert packing.pack(documents(spark, []), registry.BPE_FILE, registry.BPE_RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_tail_once(seed):
    draw = np.random.default_rng(seed)
    histogram = np.zeros(64, np.int64)
    for length in draw.integers(1, 64, 400 * seed + 3):
        histogram[length] += 1
    runs, stream, first_free = packing.plan(histogram, 64)
    used, filled = np.zeros(64, np.int64), defaultdict(int)
    for length, first, end, sequence, offset in sorted(runs, key=lambda r: (r[3], r[4])):
        assert first == used[length]
        used[length] += end - first
        for k in range(end - first):
            assert filled[sequence + k] == offset
            filled[sequence + k] += length
    assert all(v == 64 for v in filled.values()) and all(s < first_free for s in filled)
    for length, (first, _) in stream.items():
        assert first == used[length]
        used[length] = histogram[length]
    assert (used == histogram).all()


def test_least_squares_fits_a_solvable_histogram():
    combos = np.array([[40, 24, 0], [30, 20, 14], [32, 32, 0]])
    histogram = np.zeros(65)
    for times, combo in zip((50, 20, 10), combos, strict=True):
        for v in combo[combo > 0]:
            histogram[v] += times
    assert np.allclose(packing.nonnegative_least_squares(combos, histogram), (50, 20, 10), atol=0.5)


def test_ranks_of_one_hot_length(spark):
    tails = spark.range(5000).select(F.col("id").alias("row_key"), F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 40 + 1).cast("int").alias("tail_length"))
    lengths = [r["tail_length"] for r in tails.collect()]
    ranks = defaultdict(list)
    for r in packing.ranked(tails, np.bincount(lengths, minlength=WINDOW), bucket_rows=100).collect():
        ranks[r["tail_length"]].append(r["tail_rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values()) and sum(map(len, ranks.values())) == 5000


def test_null_id(spark):
    rows = packing.pack(documents(spark, [(None, prose(30, 1)), (1, "a")]), registry.BPE_FILE, registry.BPE_RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] is None, r["start"]) for r in rows) == [(False, 0), (True, 0)]
