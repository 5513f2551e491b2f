"""Removal of repeated word windows with difference-cover anchors.

A word goes if a window of LENGTH consecutive words that covers it also starts in
a document with a smaller id.

A difference cover of a period is a set of remainders such that any two positions
come to lie on covered positions after one common shift of less than the period.
So where two documents hold the same window, the same ANCHOR words of it (ANCHOR =
LENGTH - period + 1) begin at a covered position in both: it is enough to hash
ANCHOR words at covered positions, three of seven for windows of 13 words.

1. Documents are dealt into blocks of a few MB, which are stored.
2. Anchors: each block sends its distinct anchor hashes to buckets (ranges of the
   hash) and is told which of them another block has too.
3. Extension: around each anchor that two documents share, all windows that hold it
   are hashed as wholes (96 bits).  Each block sends its distinct windows with the
   smallest id that has them, and is told which a smaller id elsewhere has.
4. Each block cuts its documents.

A block sends a key once, however many of its documents hold it, so a passage of a
third of all documents costs a row of a packed array per block, and no pair of
documents is ever made.  Blocks and buckets are bounded; nothing but the number of
bytes reaches the driver.  Each exchange has at most one row per block and bucket;
blocks grow with the square root of the data up to MOST_BYTES to keep these few.

Windows are compared by hashes only, of 64-bit hashes of their words: for 10**13
windows the chance that any two different ones agree is about one in a thousand.

Defined results: words are runs of bytes other than space and 0x09 to 0x0D; a null
text has none.  Texts are judged as they come in.  Rows that repeat an id don't
remove each other, with equal or other texts.  A null id is larger than none: its
row stays whole and removes nothing.  An empty table gives no rows.  Extra columns
are kept; those named like an added one are replaced.  A single text has to fit in
a worker.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from granary.llm.suffix_dedup import expand, expand_sorted, squeeze, squeeze_sorted
from granary.sources.tables import dropped, stored, text_batches

LENGTH = 13
#: Perfect difference sets, each remainder once as a difference.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
#: Least and most bytes of text in a block (a longer text is a block of its own), bytes of a block for each row that it sends, and blocks for each bucket.
LEAST_BYTES, MOST_BYTES, BYTES_PER_ROW, BLOCKS_PER_BUCKET = 4 << 20, 16 << 20, 4096, 2
#: Words longer than this are hashed one by one.
LONG_WORD = 64
ANCHOR_SEED, HIGH_SEED, LOW_SEED = 1, 2, 3
ADDED = ("n_words", "n_removed", "kept_text")
SENT = "bucket long, block long, high binary, low binary, ids binary"
TOLD = "step int, bucket long, block long, bits binary"
U64 = np.uint64
MIX = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))


def cover_of(length: int) -> tuple[int, tuple[int, ...]]:
    """(period, remainders) of the largest known cover that leaves half of a window's words for the anchor."""
    period = max(p for p in COVERS if p <= (length + 1) // 2)
    return period, COVERS[period]


def mixed(values: np.ndarray) -> np.ndarray:
    values ^= values >> U64(32)
    values *= MIX[1]
    values ^= values >> U64(29)
    return values


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of some bytes."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time for all words together."""
    import xxhash

    size = ends - starts
    hashes = mixed(size.astype(U64) * MIX[0])
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    live = np.flatnonzero(size <= LONG_WORD)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    at, left = starts[live], size[live]
    while len(live):
        piece = np.ascontiguousarray(eights[at]).view("<u8").ravel() & mask[np.minimum(left, 8)]
        hashes[live] = mixed((hashes[live] ^ piece) * MIX[0])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return hashes


def window_hashes(words: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit hashes of ``length`` words from each place on."""
    hashes = np.full(len(at), seed, U64)
    for k in range(length):
        hashes = mixed((hashes ^ words[at + k]) * MIX[0])
    return hashes


def parts_by_bucket(sorted_keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds) of sorted 64-bit keys: bucket buckets[i] has those from bounds[i] to bounds[i + 1]."""
    bucket = ((sorted_keys >> U64(32)) * U64(n_buckets)) >> U64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=U64(n_buckets)))
    return bucket[first], np.append(first, len(bucket))


class Block:
    """The documents of a block, as arrays over all their words."""

    def __init__(self, rows: bytes | pa.Buffer, id_at: int, text_at: int, length: int) -> None:
        with pa.ipc.open_stream(rows) as reader:
            self.batch = reader.read_next_batch()
        ids = self.batch.column(id_at).cast(pa.int64())
        self.raw = [x or b"" for x in self.batch.column(text_at).cast(pa.binary()).to_pylist()]
        data = np.frombuffer(b"\n".join([*self.raw, b""]), np.uint8)
        starts, ends = word_bounds(data)
        self.words = word_hashes(data, starts, ends)
        begin = np.cumsum([0] + [len(x) + 1 for x in self.raw])
        first = np.searchsorted(starts, begin)
        self.counts = np.diff(first)
        doc = np.repeat(np.arange(len(self.raw)), self.counts)
        self.place = np.arange(len(doc)) - first[:-1][doc]
        known = np.asarray(ids.is_valid())
        #: Words from a place to the end of its document; none for documents that take no part.
        self.rest = np.where(known[doc], self.counts[doc] - self.place, 0) * (self.counts[doc] >= length)
        self.ids = np.asarray(ids.fill_null(0))[doc]
        self.length = length
        self.period, self.cover = cover_of(length)
        self.anchor = length - self.period + 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of anchors, their distinct hashes, and which of those each is."""
        covered = np.isin(np.arange(self.period), self.cover)
        at = np.flatnonzero(covered[self.place % self.period] & (self.rest >= self.anchor))
        distinct, which = np.unique(window_hashes(self.words, at, self.anchor, ANCHOR_SEED), return_inverse=True)
        return at, distinct, which

    def candidates(self, bits_of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
        """Windows with an anchor that two documents share: their places in order of their hashes, where a new hash begins, and the distinct hashes' parts and smallest ids."""
        at, distinct, which = self.anchors()
        shared = bits_of(distinct)
        if len(at):
            least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
            np.minimum.at(least, which, self.ids[at])
            np.maximum.at(most, which, self.ids[at])
            shared |= least < most
        held = at[shared[which]]
        marked = np.zeros(len(self.words), bool)
        for shift in range(self.period):
            fits = held[self.place[held] >= shift] - shift
            marked[fits[self.rest[fits] >= self.length]] = True
        places = np.flatnonzero(marked)
        high = window_hashes(self.words, places, self.length, HIGH_SEED)
        low = (window_hashes(self.words, places, self.length, LOW_SEED) >> U64(32)).astype(np.uint32)
        order = np.lexsort((low, high))
        places, high, low = places[order], high[order], low[order]
        new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])[: len(high)])
        smallest = np.minimum.reduceat(self.ids[places], new) if len(new) else np.empty(0, np.int64)
        return places, new, high[new], low[new], smallest

    def removed(self, places: np.ndarray, new: np.ndarray, smallest: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """Which words go."""
        times = np.diff(np.append(new, len(places)))
        go = places[(self.ids[places] > np.repeat(smallest, times)) | np.repeat(elsewhere, times)]
        edges = np.zeros(len(self.words) + 1, np.int32)
        edges[go] += 1  # a window starts once at a place
        np.subtract.at(edges, go + self.length, 1)
        return np.cumsum(edges[:-1]) > 0

    def rows(self, gone: np.ndarray, kept: list[int]) -> pa.Table:
        """The input columns in ``kept`` and the added ones."""
        texts, n_removed, start = [], [], 0
        for raw, n in zip(self.raw, self.counts.tolist(), strict=True):
            words, lost = raw.split(), gone[start : start + n]
            n_removed.append(int(lost.sum()))
            texts.append(b" ".join(compress(words, (~lost).tolist()) if n_removed[-1] else words))
            start += n
        added = [pa.array(self.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
        columns = [self.batch.column(i) for i in kept] + added
        return pa.Table.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def block_bytes(total: int) -> int:
    return min(MOST_BYTES, max(LEAST_BYTES, math.isqrt(total * BYTES_PER_ROW)))


def blocks(numbered: DataFrame, text_at: int, size: int) -> DataFrame:
    """(block, rows): rows of consecutive documents, compressed."""

    def packed(held: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        sink, one = pa.BufferOutputStream(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(one)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
            start = 0
            for i, length in enumerate(lengths):
                if n and n + length > size:
                    held.append(batch.slice(start, i - start))
                    yield packed([x for x in held if x.num_rows], block)
                    block, held, n, start = block + 1, [], 0, i
                n += length + 1
            held.append(batch.slice(start))
        if n:
            yield packed([x for x in held if x.num_rows], block)

    return numbered.mapInArrow(deal, "block long, rows binary")


def sent_rows(block: int, high: np.ndarray, low: np.ndarray | None, ids: np.ndarray | None, n_buckets: int) -> pa.RecordBatch:
    """A row for each bucket that gets something from a block."""
    rows, (buckets, bounds) = [], parts_by_bucket(high, n_buckets)
    for bucket, a, b in zip(buckets.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rows.append((bucket, block, squeeze_sorted(high[a:b]), b"" if low is None else squeeze(low[a:b]), b"" if ids is None else squeeze(ids[a:b])))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "block", "high", "low", "ids"])


def told_bits(told: pa.Table, step: int, n_buckets: int) -> Callable[[np.ndarray], np.ndarray]:
    """Looks up what the buckets said, by sorted keys; a bucket that said nothing said no."""
    said = {r["bucket"]: r["bits"] for r in told.to_pylist() if r["step"] == step}

    def look(keys: np.ndarray) -> np.ndarray:
        bits, (buckets, bounds) = np.zeros(len(keys), bool), parts_by_bucket(keys, n_buckets)
        for bucket, a, b in zip(buckets.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if bucket in said:
                bits[a:b] = np.unpackbits(np.frombuffer(said[bucket], np.uint8), count=b - a)
        return bits

    return look


def answers(sent: DataFrame, step: int) -> DataFrame:
    """What a bucket says to each block: for step 1 which keys another block has, for step 2 which a smaller id has."""

    def judge(table: pa.Table) -> pa.Table:
        bucket, block = table["bucket"][0].as_py(), table["block"].to_pylist()
        parts = [expand_sorted(x.as_buffer(), U64) for x in table["high"]]
        high = np.concatenate(parts)
        if step == 1:
            order = np.argsort(high)
            differs = high[order][1:] != high[order][:-1]
        else:
            low, ids = np.concatenate([expand(x.as_buffer(), np.uint32) for x in table["low"]]), np.concatenate([expand(x.as_buffer(), np.int64) for x in table["ids"]])
            order = np.lexsort((low, high))
            differs = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        new = np.flatnonzero(np.concatenate([[True], differs]))
        times, yes = np.diff(np.append(new, len(high))), np.empty(len(high), bool)
        yes[order] = np.repeat(times > 1, times) if step == 1 else ids[order] > np.repeat(np.minimum.reduceat(ids[order], new), times)
        rows = [(b, x) for b, x in zip(block, np.split(yes, np.cumsum([len(p) for p in parts])[:-1]), strict=True) if x.any()]
        columns = [pa.array([step] * len(rows), pa.int32()), pa.array([bucket] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int64()), pa.array([np.packbits(x).tobytes() for _, x in rows], pa.binary())]
        return pa.Table.from_arrays(columns, names=["step", "bucket", "block", "bits"])

    return sent.groupBy("bucket").applyInArrow(judge, TOLD)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Input columns with n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    names = [c.lower() for c in docs.columns]
    id_at, text_at = names.index("doc_id"), names.index("text")
    kept = [i for i, c in enumerate(names) if c not in ADDED]
    kinds = [docs.schema[i].dataType for i in kept] + [LongType(), LongType(), StringType()]
    schema = StructType([StructField(f"c{i}", kind) for i, kind in enumerate(kinds)])
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    total = numbered.agg(F.sum(F.octet_length(f"c{text_at}"))).first()[0] or 0
    size = block_bytes(total)
    n_buckets = max(1, math.ceil(total / (BLOCKS_PER_BUCKET * size)))

    def anchors_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch["block"].to_pylist(), batch["rows"], strict=True):
                yield sent_rows(block, Block(rows.as_buffer(), id_at, text_at, length).anchors()[1], None, None, n_buckets)

    def windows_sent(rows: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(rows["rows"][0].as_buffer(), id_at, text_at, length)
        _, _, high, low, ids = block.candidates(told_bits(told, 1, n_buckets))
        return pa.Table.from_batches([sent_rows(rows["block"][0].as_py(), high, low, ids, n_buckets)])

    def cut(rows: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(rows["rows"][0].as_buffer(), id_at, text_at, length)
        places, new, high, _, ids = block.candidates(told_bits(told, 1, n_buckets))
        return block.rows(block.removed(places, new, ids, told_bits(told, 2, n_buckets)(high)), kept)

    with text_batches(spark):
        base = stored(blocks(numbered, text_at, size), "blocks")
    met = lambda told: base.groupBy("block").cogroup(told.groupBy("block"))
    first = stored(answers(base.mapInArrow(anchors_sent, SENT), 1), "anchors_told")
    second = stored(answers(met(first).applyInArrow(windows_sent, SENT), 2), "windows_told")
    out = stored(met(first.unionByName(second)).applyInArrow(cut, schema).toDF(*(docs.columns[i] for i in kept), *ADDED), "cut")
    dropped(base, first, second)
    return out


#: DuckDB SQL for the rows of op13_anchor_dedup: all windows of all documents, without anchors.
SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
placed as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from docs),
windows as (select doc_id, unnest(range(1, len(words) - 11)) as place, words from docs where len(words) >= 13),
hashed as (select doc_id, place, sha256(array_to_string(words[place:place + 12], ' ')) as hash from windows),
least as (select hash, min(doc_id) as first_id from hashed group by hash),
flagged as (select h.doc_id, h.place, h.doc_id > l.first_id as goes from hashed h join least l using (hash)),
judged as (
  select p.doc_id, p.place, p.word, coalesce(max(f.goes::int) over (partition by p.doc_id order by p.place rows between 12 preceding and current row), 0) = 1 as gone
  from placed p left join flagged f on f.doc_id = p.doc_id and f.place = p.place),
totals as (
  select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by place) filter (where not gone), '') as kept
  from judged group by doc_id)
select d.doc_id, coalesce(t.n_words, 0) as n_words, coalesce(t.n_removed, 0) as n_removed, sha256(coalesce(t.kept, '')) as kept_sha256
from documents d left join totals t on t.doc_id = d.doc_id
"""
