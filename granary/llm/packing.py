"""Packing documents into sequences of a fixed window by non-negative least squares.

1. Every document becomes its token ids plus an end id.  Whole windows are cut
   off its front and are sequences by themselves; what is left is its tail.
2. The tails' lengths give a histogram with one bin per length below the window,
   the only thing that reaches the driver.
3. Shallow combinations (two or three lengths that fill the window exactly) are
   the columns of a non-negative least squares problem against the histogram;
   its solution, rounded down, says how often each combination is used.
4. The lengths left over are packed greedily, one after the other, and cut where
   a window is full, so that only the very last sequence can need padding.

A tail's place follows from its rank among the tails of its length, which is
found per (length, hash bucket) with running totals over buckets; a length has as
many buckets as its count asks for, so that no task sees a whole length class.  Tail ids are moved once, keyed by row.

Defined results: a null text is an empty text, which is one end id.  Repeated
rows are documents of their own; a null doc_id is kept as it is.  An empty table gives no pieces.  Texts may be
of any length.  Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.bpe import encode_text, rank_file_encoding
from granary.sources.tables import dropped, stored, text_batches

#: Sequence ids of whole windows start here, those of packed tails at 0.
WHOLE_BASE = 1 << 60
#: Tails of one length that are ranked in a task, about.
BUCKET_ROWS = 20_000
#: Combinations are enumerated over this many of the most frequent lengths for three parts; pairs cover all lengths.
TRIPLE_LENGTHS = 96
#: Characters on which every version of Unicode agrees about letters, numbers and white space.
PLAIN = re.compile("[\t\n\r -~¡-ɏ‐-‧€]*")

_TOKENIZERS: dict[str, object] = {}


def tokenizer_file(path: str):
    """A tokenizers.Tokenizer; strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def document_ids(text: str | None, tokenizer_path: str, ranks_path: str, pattern: str, end_id: int) -> np.ndarray:
    """Ids of a text as the tokenizer file gives them, then the end id.

    The rank file holds the same vocabulary and gives the same ids several
    times faster.  The libraries could differ only in characters that their
    Unicode tables class differently, so texts with any character beyond PLAIN
    go to the tokenizer file itself.
    """
    if not text:
        return np.array([end_id], "<u4")
    if PLAIN.fullmatch(text):
        ids = encode_text(rank_file_encoding(ranks_path, pattern), text)
    else:
        ids = np.array(tokenizer_file(tokenizer_path).encode(text, add_special_tokens=False).ids, "<u4")
    return np.append(ids, np.array([end_id], "<u4"))


def cut_documents(docs: DataFrame, window: int, tokenizer_path: str, ranks_path: str, pattern: str, end_id: int) -> DataFrame:
    """Per document: row key, whole windows' checksums and ids, and the tail's ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 33
        whole = WHOLE_BASE + key
        for batch in batches:
            keys, counts, crcs, firsts, tails, lengths = [], [], [], [], [], []
            for text in batch.column(1):
                ids = document_ids(text.as_py(), tokenizer_path, ranks_path, pattern, end_id)
                full = len(ids) // window
                raw = memoryview(ids.tobytes())
                keys.append(key)
                counts.append(len(ids))
                crcs.append([zlib.crc32(raw[4 * window * i : 4 * window * (i + 1)]) for i in range(full)])
                firsts.append(whole)
                tails.append(raw[4 * window * full :].tobytes())
                lengths.append(len(ids) - window * full)
                key += 1
                whole += full
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(firsts, pa.int64()), pa.array(tails, pa.binary()), pa.array(lengths, pa.int32())],
                names=["row_key", "doc_id", "doc_tokens", "window_crcs", "first_window", "tail_ids", "tail_length"],
            )

    schema = "row_key long, doc_id long, doc_tokens long, window_crcs array<long>, first_window long, tail_ids binary, tail_length int"
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(cut, schema)


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: unused) that fill the window: all pairs, and triples of frequent lengths with any third."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    pairs = [(a, window - a, 0) for a in lengths[lengths * 2 <= window] if have[window - a]]
    common = np.sort(lengths[np.argsort(-counts, kind="stable")[:TRIPLE_LENGTHS]])
    triples = {tuple(sorted((int(a), int(b), int(window - a - b)), reverse=True)) for i, a in enumerate(common) for b in common[i:] if window - a - b > 0 and have[window - a - b]}
    return np.array([(int(max(p)), int(min(p[:2])), 0) for p in pairs] + sorted(triples), np.int64).reshape(-1, 3)


def nonnegative_least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by multiplicative updates.

    Column j of A holds how often combination j uses each length.  Updates keep
    x non-negative and never raise the error (Lee and Seung, 2001).
    """
    x = np.ones(len(combos))
    used = combos > 0
    weight = used.astype(float)
    target = (histogram[combos] * weight).sum(1)
    for _ in range(rounds):
        fitted = np.bincount(combos.ravel(), (x[:, None] * weight).ravel(), minlength=len(histogram))
        x *= target / np.maximum((fitted[combos] * weight).sum(1), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int]], dict[int, tuple[int, int]], int]:
    """Places for tails of each length.

    Returns runs (length, first rank, end rank, first sequence, offset), where
    the ranks from first on take one place each in successive sequences; and for
    the ranks beyond all runs of a length, its (first rank, first position) in
    the greedy stream; and the sequence at which that stream begins.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    lengths = np.flatnonzero(left)
    runs: list[tuple[int, int, int, int, int]] = []
    taken = np.zeros(len(left), np.int64)
    sequence = 0
    if len(lengths) and len(combos := combinations(lengths, left[lengths], window)):
        times = np.floor(nonnegative_least_squares(combos, left.astype(float)) + 1e-6).astype(np.int64)
        for j in np.argsort(-times, kind="stable"):
            parts = [int(v) for v in combos[j] if v]
            need = {v: parts.count(v) for v in parts}
            n = min([int(times[j]), *(int(left[v]) // k for v, k in need.items())])
            if n <= 0:
                continue
            offset = 0
            for v in parts:
                runs.append((v, int(taken[v]), int(taken[v]) + n, sequence, offset))
                taken[v] += n
                left[v] -= n
                offset += v
            sequence += n
    stream, position = {}, 0
    for v in np.flatnonzero(left)[::-1]:
        stream[int(v)] = (int(taken[v]), position)
        position += int(left[v]) * int(v)
    return runs, stream, sequence


def ranked(tails: DataFrame, histogram: np.ndarray, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(row_key, tail_length, tail_rank): ranks 0.. within a length, without gathering a length anywhere.

    ``histogram`` counts the lengths; the table of buckets per length has a row per length below the window.
    """
    spark = tails.sparkSession
    buckets = spark.createDataFrame([(int(n), int(-(-histogram[n] // bucket_rows))) for n in np.flatnonzero(histogram)], "tail_length int, buckets int")
    keyed = tails.select("row_key", "tail_length").join(F.broadcast(buckets), "tail_length").select("row_key", "tail_length", F.pmod(F.xxhash64("row_key"), F.col("buckets")).alias("bucket"))
    before = Window.partitionBy("tail_length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("tail_length", "bucket").agg(F.count("*").alias("n")).select("tail_length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("tail_length", "bucket").orderBy("row_key")) - 1)
    return within.join(starts, ["tail_length", "bucket"]).select("row_key", "tail_length", (F.col("first") + F.col("nth")).alias("tail_rank"))


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), as a stored table."""
    with text_batches(docs.sparkSession):
        cut = stored(cut_documents(docs, window, tokenizer_path, ranks_path, pattern, end_id), "packing_cut")
    whole = cut.select("doc_id", "doc_tokens", "first_window", F.posexplode("window_crcs").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first_window") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    tails = cut.where("tail_length > 0")
    histogram = np.zeros(window, np.int64)
    for length, n in tails.groupBy("tail_length").count().collect():
        histogram[length] = n
    runs, stream, first_free = plan(histogram, window)
    by_length: dict[int, tuple[np.ndarray, list[tuple[int, int, int]]]] = {}
    for length in {r[0] for r in runs}:
        own = [r for r in runs if r[0] == length]
        by_length[length] = (np.array([r[2] for r in own]), [(r[1], r[3], r[4]) for r in own])
    names = whole.columns
    places = docs.sparkSession.sparkContext.broadcast((by_length, stream, first_free))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length, stream, first_free = places.value
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for doc_id, doc_tokens, ids, length, rank in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                start = doc_tokens - length
                ends, own = by_length.get(length, (np.empty(0), []))
                at = int(np.searchsorted(ends, rank, side="right"))
                if at < len(own):
                    first, sequence, offset = own[at]
                    cuts = [(0, length, sequence + rank - first, offset)]
                else:
                    first, base = stream[length]
                    position, cuts, done = base + (rank - first) * length, [], 0
                    while done < length:
                        room = min(length - done, window - (position + done) % window)
                        cuts.append((done, room, first_free + (position + done) // window, (position + done) % window))
                        done += room
                out += [(doc_id, start + a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]), doc_tokens, sequence, offset) for a, n, sequence, offset in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 7)], names=names)

    moved = tails.select("row_key", "doc_id", "doc_tokens", "tail_ids").join(ranked(tails, histogram), "row_key").select("doc_id", "doc_tokens", "tail_ids", "tail_length", "tail_rank")
    placed = moved.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    with text_batches(docs.sparkSession):
        result = stored(whole.unionByName(placed), "packing_pieces")
    dropped(cut)
    return result
