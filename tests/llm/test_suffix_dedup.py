"""Suffix-array dedup against a dictionary of all 50-byte strings."""

from __future__ import annotations

import hashlib

from fixtures import documents, prose, with_clashing_columns

from granary.llm import registry, suffix_dedup


def masked(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, bytes, bytearray]]:
    """(doc_id, bytes, which of them go) of each row."""
    first: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - 49 if i is not None else 0):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, b in texts:
        go = bytearray(len(b))
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                go[k : k + 50] = b"\1" * 50
        out.append((i, b, go))
    return out


def kept_text(b: bytes, go: bytearray) -> str:
    """What is left, run by run, without characters that lost some of their bytes."""
    out, run = "", b""
    for x, g in zip(b, go, strict=True):
        if g:
            out, run = out + run.decode(errors="ignore"), b""
        else:
            run += bytes([x])
    return out + run.decode(errors="ignore")


def brute(rows: list[tuple[int | None, str | None]]) -> dict[tuple, int]:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) and how often each comes."""
    out: dict[tuple, int] = {}
    for i, b, go in masked(rows):
        spans = sum(g and (k == 0 or not go[k - 1]) for k, g in enumerate(go))
        row = (i, len(b), sum(go), spans, hashlib.sha256(bytes(x for x, g in zip(b, go, strict=True) if not g)).hexdigest())
        out[row] = out.get(row, 0) + 1
    return out


def found(df) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes").collect():
        row = (r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest())
        out[row] = out.get(row, 0) + 1
    return out


def test_query_equals_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r): 1 for r in registry.op1_suffix_dedup(spark, small).collect()}
    assert got == brute([tuple(r) for r in table])


def test_edges(spark):
    a, b, shared = prose(60, 1), prose(60, 2), prose(12, 3)
    assert len(shared) > 50
    rows = [
        (1, a + shared + b), (2, prose(30, 4) + shared[:49]), (3, prose(30, 5) + shared[:50] + prose(30, 6)), (4, a + shared + b), (5, None), (6, ""), (7, "x" * 200),
        (8, "x" * 49), (9, "y" + "x" * 60), (10, "é" * 30 + shared), (10, "é" * 30 + shared), (11, "ü" * 40), (12, "ü" * 26), (None, a + shared + b), (13, shared + shared[5:] + " " + shared),
    ]
    assert found(suffix_dedup.without_repeats(with_clashing_columns(documents(spark, rows)))) == brute(rows)


def test_texts_that_share_an_id(spark):
    a, b, c = prose(60, 21), prose(60, 22), prose(60, 23)
    rows = [(5, prose(9, 31) + a), (5, a + b), (6, b + prose(9, 32)), (6, a[:60] + c), (7, c), (7, c), (7, prose(9, 33) + c[:80]), (8, c)]
    assert found(suffix_dedup.without_repeats(documents(spark, rows))) == brute(rows)


def test_documents_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEAST_BYTES", 1 << 10)
    long = prose(2_000, 41)
    rows = [(i, prose(20, 200 + i) + long[300 * i : 300 * i + 700]) for i in range(1, 9)] + [(20, long), (20, long[:5_000] + prose(40, 42)), (21, long[1_000:4_000]), (30, long + long)] + [(40 + i, long[: 900 + i]) for i in range(12)]
    assert found(suffix_dedup.without_repeats(documents(spark, rows))) == brute(rows)


def test_pieces_hold_each_string_once():
    import numpy as np

    data = prose(400, 5).encode()
    starts, lengths = np.array([0, 700, 760]), np.array([600, 55, len(data) - 655])
    for size in (10, 64, 300, 5_000):
        got = []
        for _, _, s, n, piece in suffix_dedup.pieces((1, b"k", starts, lengths, memoryview(data)), size):
            assert sum(n) == len(piece) and len(piece) <= max(size, 50) + 49
            at = 0
            for begin, length in zip(s.tolist(), n.tolist(), strict=True):
                got += [(begin + k, bytes(piece[at + k : at + k + 50])) for k in range(length - 49)]
                at += length
        want, at = [], 0
        for begin, length in zip(starts.tolist(), lengths.tolist(), strict=True):
            want += [(begin + k, data[at + k : at + k + 50]) for k in range(length - 49)]
            at += length
        assert got == want


def test_long_text_and_many_copies(spark):
    long = prose(40_000, 9)
    rows = [(i, prose(20, 100 + i) + long[5_000 * i : 5_000 * i + 6_000]) for i in range(1, 8)] + [(50, long), (51, long), (52, long[:-1])] + [(100 + i, long[:500]) for i in range(40)]
    assert found(suffix_dedup.without_repeats(documents(spark, rows))) == brute(rows)


def test_empty_table_keeps_columns(spark):
    out = suffix_dedup.without_repeats(with_clashing_columns(documents(spark, [])))
    assert out.count() == 0 and {"a.b", "rep", "kept_text"} <= set(out.columns)


def test_cut_characters_leave_valid_text(spark):
    tail = "é" * 40
    rows = [(1, "a" + tail), (2, "b" * 3 + tail[:30])]
    kept = {r["doc_id"]: (r["kept_text"], bytes(r["kept_bytes"])) for r in suffix_dedup.without_repeats(documents(spark, rows)).collect()}
    assert kept[2][0] == kept[2][1].decode(errors="ignore")
