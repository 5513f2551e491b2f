"""Removal of repeated passages with a distributed difference-cover suffix sort.

A byte goes if a LENGTH-byte string that covers it also starts in a document with
a smaller id.  Suffixes need to be sorted by their first LENGTH = 50 bytes only.

1. Candidates.  Every 50-byte string holds a minimizer: the smallest hash of its
   24-byte strings.  Minimizers are compared across texts, once per text and per
   task; only stretches around those that two different texts share can repeat,
   so the suffix sort gets these stretches and nothing that could match is lost.
   Identical texts enter once, with their smallest id.
2. Stretches are dealt into blocks by ranges of document ids; a document larger
   than a block has blocks of its own.  Sampled positions are those that are 1 or
   2 modulo 3 (a difference cover: any two positions become sampled ones after
   the same shift of 0, 1 or 2).
3. Sampled triples of bytes are sorted by counting and get their rank as name.
   Then recursion on names: triples of names (9 bytes), triples of those (27
   bytes), and two of those that overlap (48 bytes) are sorted and named in turn.
   A string that occurs once gets no name, and what holds it drops out.
4. The remaining suffixes are merged: a pair of positions is compared by the 0, 1
   or 2 bytes of their common shift, the 48-byte rank behind, and the rest of the
   50 bytes.  In this order equal prefixes are adjacent; each but the first (in
   document order) is one to remove.

Sorting is distributed by key range.  A block sends its distinct keys, sorted,
and gets back ranks (or one bit per key in the last step) in the same order, so
neither positions nor documents travel, and a passage that a third of all
documents hold is sent once per block.  Every step ends in a table in the shared
folder; tables are deleted once the next one is written.

Scale.  An exchange has a row per block and key range.  Blocks and ranges grow
with the square root of the data (``unit_bytes``), so these rows grow in
proportion to it, up to the MOST_BYTES that a Python worker can hold (it takes
some 60 bytes per byte of a block); beyond that rows hold fewer keys each.  What
reaches the driver or is broadcast: a 2 MB bitmap of byte triples, and per range
a sample of SAMPLE_KEYS keys, a limit and a count (under 200 bytes a range).

Defined results: a null or short text loses nothing.  Texts are judged as they
come in, not by what is left.  Equal texts: all but those with the smallest id go
as a whole if they have 50 bytes.  Rows that repeat an id, with equal or other
texts, don't remove each other and are each judged by themselves.  A null doc_id
is larger than none: its row is kept whole and removes nothing.  Extra columns
are kept.  A single text has to fit in a worker, its stretches needn't.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.rows import text_key, whole
from granary.sources.tables import dropped, small_batches, stored, text_batches

LENGTH = 50
#: Bytes of a minimizer's string; a 50-byte string holds LENGTH - GRAM + 1 of them.
GRAM = 24
WINDOW = LENGTH - GRAM + 1
#: Least and most bytes of candidate text in a block; a range gets about as many keys.
LEAST_BYTES, MOST_BYTES = 1 << 20, 32 << 20
#: Bytes of a block for each exchange row that it sends, on average, once blocks are larger than the least.
BYTES_PER_ROW = 512
#: Text bytes hashed at a time, and per bucket of minimizers, in units of the least size of a block.
CHUNK_UNITS, BUCKET_UNITS = 4, 8
#: Blocks, or key ranges, that a task takes one after the other.
PER_TASK = 4
#: Range limits are taken from so many keys a range, of at least so many blocks; they steer balance only.
SAMPLE_KEYS, SAMPLE_BLOCKS = 16, 16
#: Text bytes whose minimizers are found at a time, so that the arrays stay in a processor's cache.
CACHE_BYTES = 1 << 17
U64 = np.uint64
TOP = np.uint32(0xFFFFFFFF)


# ---- small helpers


def unit_bytes(total: int) -> int:
    """Bytes of a block (or hashed chunk) for so much text: total / unit squared rows stay in proportion to the total."""
    return min(MOST_BYTES, max(LEAST_BYTES, math.isqrt(total * BYTES_PER_ROW)))


def squeeze(values: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T) if len(values) else np.empty(0, np.uint8)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(packed: bytes | pa.Buffer, kind: type) -> np.ndarray:
    view = memoryview(packed)
    n, size = int.from_bytes(view[:8], "little"), np.dtype(kind).itemsize
    if n == 0:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(pa.py_buffer(view[8:]), decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def expand_sorted(packed: bytes | pa.Buffer, kind: type) -> np.ndarray:
    return np.cumsum(expand(packed, kind), dtype=kind)


def ordered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): a permutation that sorts rows of one or two columns, and where a new value begins in it.

    The second column must be below 2**32: the first is replaced by its dense rank, and both are sorted as one.
    """
    key = columns[0]
    for column in columns[1:]:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(len(key), U64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])[: len(s)]).astype(U64)
        key = (rank << U64(32)) | column
    order = np.argsort(key)
    s = key[order]
    return order, np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]


def distinct_sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct rows of one or two columns in order, and which of them occur more than once."""
    if len(columns) == 1:
        s = np.sort(columns[0])
        new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
        distinct = [s[new]]
    else:
        order, new = ordered(columns)
        distinct = [c[order[new]] for c in columns]
    return [*distinct, np.diff(np.flatnonzero(np.append(new, True))) > 1]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal key, which follow each other."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and current != keys[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                current = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield pa.Table.from_batches(held)


def rows_of(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    """One row after the other; binary values are views, not copies."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        columns = [c if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns]
        for i in range(batch.num_rows):
            yield {name: c[i].as_buffer() if isinstance(c, pa.Array) else c[i] for name, c in zip(batch.schema.names, columns, strict=True)}


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from rows_of(batch)


def joined_intervals(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals that are sorted by start."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    cut = np.flatnonzero(starts[1:] > reach[:-1]) + 1
    return starts[np.concatenate([[0], cut])], reach[np.concatenate([cut - 1, [len(ends) - 1]])]


# ---- 1. candidates


def slide(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick over every ``width`` values in a row."""
    size, out = 1, values
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def minimizers(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the minimizers of texts that lie one after the other; limits are their bounds."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, U64)
    with np.errstate(over="ignore"):
        h, factor = data.astype(U64) + U64(1), U64(0x9E3779B97F4A7C15)
        parts, factors, size = {}, {}, 1
        if GRAM % 2:
            parts[1], factors[1] = h, factor
        while size * 2 <= GRAM:
            h = h[:-size] * factor + h[size:]
            size *= 2
            factor = factor * factor
            if GRAM & size:
                parts[size], factors[size] = h, factor
        done = 0
        for size in sorted(parts, reverse=True):
            if done + size <= GRAM:
                n = len(data) - done - size + 1
                h = parts[size] if not done else h[:n] * factors[size] + parts[size][done : done + n]
                done += size
        h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
    order = np.minimum((h >> U64(32)).astype(np.uint32), TOP - np.uint32(1))  # half of each hash decides; ties are all taken
    for end in limits[1:-1]:
        order[max(0, end - GRAM + 1) : end] = TOP
    least = slide(order, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint32)
    at = np.flatnonzero((slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == order) & (order != TOP))
    return at, h[at]


def anchors(keyed: DataFrame, buckets: int, chunk_bytes: int) -> DataFrame:
    """Minimizers of all texts, packed per bucket of hashes; kind 1 rows are known to be shared already."""
    schema = "bucket int, kind int, keys binary, hashes binary, owners binary, places binary, shared binary"

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(texts: dict[bytes, bytes]) -> pa.RecordBatch:
            keys, data = list(texts), list(texts.values())
            limits = np.concatenate([[0], np.cumsum([len(d) for d in data])])
            cuts = np.unique(np.append(np.searchsorted(limits, np.arange(0, limits[-1], CACHE_BYTES)), len(data)))
            parts = [minimizers(np.frombuffer(b"".join(data[a:b]), np.uint8), limits[a : b + 1] - limits[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            at = np.concatenate([x[0] + limits[a] for x, a in zip(parts, cuts, strict=False)])
            hashes = np.concatenate([x[1] for x in parts])
            owner = np.searchsorted(limits, at, side="right") - 1
            place = at - limits[owner]
            order, new = ordered([hashes])
            owner, place, hashes = owner[order], place[order], hashes[order]
            group = np.cumsum(new) - 1
            first = owner[new]
            shared = np.zeros(len(first), bool)
            shared[group[owner != first[group]]] = True
            mine = shared[group]
            rows = []
            # what is shared here is sent once, to tell the others
            send = ~mine | new
            into = (hashes >> U64(8)) % U64(buckets)
            known = (np.frombuffer(b"".join(k[:4] for k in keys), "<u4") % buckets).astype(np.int64)[owner]
            for kind, use, target in ((0, send, into.astype(np.int64)), (1, mine, known)):
                index = np.flatnonzero(use)
                index = index[np.argsort(target[index], kind="stable")]
                cuts = np.searchsorted(target[index], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    part = index[cuts[b] : cuts[b + 1]]
                    used, local = np.unique(owner[part], return_inverse=True)
                    rows.append((int(b), kind, b"".join(keys[u] for u in used), squeeze_sorted(hashes[part]) if kind == 0 else b"", squeeze(local.astype(np.uint32)), squeeze(place[part].astype(np.uint32)), np.packbits(mine[part]).tobytes()))
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "kind", "keys", "hashes", "owners", "places", "shared"])

        held: dict[bytes, bytes] = {}
        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = key.as_py(), text.as_buffer().to_pybytes()
                if len(text) >= LENGTH and key not in held:
                    held[key] = text
                    size += len(text)
                    if size >= chunk_bytes:
                        yield chunk(held)
                        held, size = {}, 0
        if held:
            yield chunk(held)

    return keyed.select("text_key", F.col("text").cast("binary").alias("text")).mapInArrow(collect, schema)


def shared_places(found: DataFrame, buckets: int) -> DataFrame:
    """(text_key, places): minimizers of each text that another text holds too."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "bucket"):
            keys, hashes, owners, places, shared = [], [], [], [], []
            rows, bucket, n = [], table["bucket"][0].as_py(), 0
            for r in rows_of(table):
                if r["kind"] == 1:
                    rows.append((bucket, r["keys"].to_pybytes(), r["owners"].to_pybytes(), r["places"].to_pybytes()))
                    continue
                own, place = expand(r["owners"], np.uint32), expand(r["places"], np.uint32)
                keys.append(r["keys"].to_pybytes())
                hashes.append(expand_sorted(r["hashes"], U64))
                owners.append(own + np.uint32(n))
                places.append(place)
                shared.append(np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=len(own)).astype(bool))
                n += r["keys"].size // 16
            if hashes:
                names = np.frombuffer(b"".join(keys), np.dtype("V16"))
                _, text = np.unique(np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2) @ np.array([1, 0x9E3779B97F4A7C15], U64), return_inverse=True)
                h, own, place, told = (np.concatenate(x) for x in (hashes, owners, places, shared))
                order, new = ordered([h])
                own, place, told = own[order], place[order], told[order]
                group, who = np.cumsum(new) - 1, text[own]
                many = np.zeros(group[-1] + 1, bool)
                many[group[(who != who[new][group]) | told]] = True
                hit = np.flatnonzero(many[group] & ~told)
                target = (np.frombuffer(names.tobytes(), "<u4")[::4] % buckets)[own[hit]]
                hit = hit[np.argsort(target, kind="stable")]
                cuts = np.searchsorted(np.sort(target), np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    part = hit[cuts[b] : cuts[b + 1]]
                    used, local = np.unique(own[part], return_inverse=True)
                    rows.append((int(b), names[used].tobytes(), squeeze(local.astype(np.uint32)), squeeze(place[part])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32(), pa.binary(), pa.binary(), pa.binary()])], names=["target", "keys", "owners", "places"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "target"):
            by_text: dict[bytes, list[np.ndarray]] = {}
            for r in rows_of(table):
                own, place, keys = expand(r["owners"], np.uint32), expand(r["places"], np.uint32), r["keys"].to_pybytes()
                order = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[order], np.arange(len(keys) // 16 + 1))
                for i in range(len(cuts) - 1):
                    by_text.setdefault(keys[16 * i : 16 * i + 16], []).append(place[order[cuts[i] : cuts[i + 1]]])
            yield pa.RecordBatch.from_arrays([pa.array(list(by_text), pa.binary()), pa.array([squeeze_sorted(np.unique(np.concatenate(v))) for v in by_text.values()], pa.binary())], names=["text_key", "places"])

    matched = found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(match, "target int, keys binary, owners binary, places binary")
    return matched.repartition(buckets, "target").sortWithinPartitions("target").mapInArrow(gather, "text_key binary, places binary")


def stretches(texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, starts, lengths, data): the parts of each text around its shared minimizers.

    Equal rows that follow each other are taken once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = []
            for doc, key, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if key == last:
                    continue
                last = key
                data = text.as_buffer()
                at = expand_sorted(places.as_buffer(), np.uint32).astype(np.int64)
                starts, ends = joined_intervals(np.maximum(0, at - (LENGTH - GRAM)), np.minimum(len(data), at + LENGTH))
                raw = memoryview(data)
                rows.append((doc, key, squeeze(starts), squeeze(ends - starts), b"".join(raw[s:e] for s, e in zip(starts, ends, strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), *[pa.binary()] * 4])], names=["doc_id", "text_key", "starts", "lengths", "data"])

    return texts.mapInArrow(cut, "doc_id long, text_key binary, starts binary, lengths binary, data binary")


# ---- 2. blocks

BLOCK_SCHEMA = "block long, turn long, keys binary, owners binary, docs binary, starts binary, lengths binary, data binary, names1 binary, names2 binary"
BLOCK_COLUMNS = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]


def block_row(values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(values)], names=BLOCK_COLUMNS)


Part = tuple[int, bytes, np.ndarray, np.ndarray, memoryview]


def pieces(part: Part, size: int) -> Iterator[Part]:
    """A document's stretches in parts of at most ``size`` bytes; a stretch that is cut goes on LENGTH - 1 bytes earlier, so each string is in one part."""
    doc, key, starts, lengths, data = part
    if len(data) <= size:
        yield part
        return
    own_starts: list[int] = []
    own_lengths: list[int] = []
    held, offset, begin = 0, 0, 0
    for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
        done = 0
        while True:
            n = min(length - done, max(LENGTH, size - held))
            own_starts.append(start + done)
            own_lengths.append(n)
            held += n
            whole = done + n == length
            if held >= size or not whole:
                yield doc, key, np.array(own_starts), np.array(own_lengths), data[begin : begin + held]
                begin += held if whole else held - LENGTH + 1
                own_starts, own_lengths, held = [], [], 0
            if whole:
                break
            done += n - LENGTH + 1
        offset += length
    if held:
        yield doc, key, np.array(own_starts), np.array(own_lengths), data[begin : begin + held]


def blocks(parts: DataFrame, ranges: int, size: int) -> DataFrame:
    """Stretches in document order, about ``size`` bytes a row.

    ``turn`` grows with the documents' ids.  A document id with more than ``size``
    bytes has several blocks of one turn, which hold nothing else.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = turn = TaskContext.get().partitionId() << 24
        ready: list[Part] = []  # of ids that are complete
        own: list[Part] = []  # of the id at hand
        ready_bytes = own_bytes = 0
        split, last = False, None  # whether the id at hand has blocks already, and that id

        def close(rows: list[Part]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            keys = list(dict.fromkeys(r[1] for r in rows))
            place = {k: i for i, k in enumerate(keys)}
            times = [len(r[3]) for r in rows]
            owners, docs = np.repeat(np.array([place[r[1]] for r in rows], np.uint32), times), np.repeat(np.array([r[0] for r in rows], np.int64), times)
            return block_row([number, turn, b"".join(keys), squeeze(owners), squeeze(docs), squeeze(np.concatenate([r[2] for r in rows])), squeeze(np.concatenate([r[3] for r in rows])), b"".join(r[4] for r in rows), b"", b""])

        def ended() -> Iterator[pa.RecordBatch]:
            """The id at hand is complete."""
            nonlocal ready, own, ready_bytes, own_bytes, split, turn
            if split:
                if own:
                    yield close(own)
                turn += 1
            else:
                ready += own
                ready_bytes += own_bytes
            own, own_bytes, split = [], 0, False
            if ready_bytes >= size:
                yield close(ready)
                ready, ready_bytes, turn = [], 0, turn + 1

        for row in single_rows(batches):
            if row["doc_id"] != last:
                yield from ended()
            last = row["doc_id"]
            part = (last, row["text_key"].to_pybytes(), expand(row["starts"], np.int64), expand(row["lengths"], np.int64), memoryview(row["data"]))
            for piece in pieces(part, size):
                own.append(piece)
                own_bytes += len(piece[4])
                if own_bytes >= size:
                    if ready:
                        yield close(ready)
                        ready, ready_bytes, turn = [], 0, turn + 1
                    yield close(own)
                    own, own_bytes, split = [], 0, True
        yield from ended()
        if ready:
            yield close(ready)

    return parts.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text_key").mapInArrow(pack, BLOCK_SCHEMA)


class Block:
    """A block's bytes, documents and names of sampled positions, ready for key building."""

    def __init__(self, row: dict):
        self.block, self.turn = row["block"], row["turn"]
        self.keys, self.owners = row["keys"], expand(row["owners"], np.uint32)
        self.docs, self.starts, self.lengths = (expand(row[c], np.int64) for c in ("docs", "starts", "lengths"))
        self.data = np.frombuffer(row["data"], np.uint8)
        ends = np.cumsum(self.lengths)
        self.room = np.repeat(ends.astype(np.int32), self.lengths)
        self.room -= np.arange(len(self.data), dtype=np.int32)
        self.names = {c: expand(row[f"names{c}"], np.uint32) if row[f"names{c}"].size else None for c in (1, 2)}

    def part(self) -> np.ndarray:
        """The stretch that each byte is in."""
        return np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def sampled(self, c: int, width: int) -> np.ndarray:
        """Which positions c, c + 3, ... have ``width`` bytes before their stretch ends."""
        return self.room[c::3] >= width

    def byte_triples(self, c: int) -> np.ndarray:
        b = np.concatenate([self.data, np.zeros(2, np.uint8)]).astype(np.uint32)
        return ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:])[c::3]

    def shifted(self, c: int, by: int) -> np.ndarray:
        """Names of the sampled positions ``by`` places on in class c; 0 past the end."""
        names = self.names[c]
        return np.concatenate([names[by:], np.zeros(min(by, len(names)), np.uint32)])


# ---- 3. names


class TripleRanks:
    """Ranks of the byte triples in a bitmap, 1 for the smallest, from bits and their running counts (3 MB)."""

    def __init__(self, bitmap: bytes):
        self.words = np.frombuffer(bitmap, "<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.cumsum(counts, dtype=np.uint32) - counts
        self.size = int(counts.sum())

    def __getitem__(self, triples: np.ndarray) -> np.ndarray:
        word = triples >> np.uint32(6)
        upto = (U64(2) << (triples & np.uint32(63)).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)


def triple_bitmap(stored_blocks: DataFrame) -> bytes:
    """Which byte triples there are: sorting by counting.  What reaches the driver is a bitmap of 2 MB at most."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(1 << 24, bool)
        for row in single_rows(batches):
            block = Block(row)
            for c in (1, 2):
                have[block.byte_triples(c)[block.sampled(c, 3)]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(have).astype(np.int64) + 1)], names=["triple"])  # bitmap functions count from 1

    found = stored_blocks.mapInArrow(seen, "triple long")
    maps = found.groupBy(F.bitmap_bucket_number("triple").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("triple")).alias("bits")).collect()
    present = np.zeros(1 << 24, bool)
    for m in maps:
        bits = np.unpackbits(np.frombuffer(m["bits"], np.uint8), bitorder="little")
        first = (m["bucket"] - 1) * len(bits)
        present[first : first + len(bits)] = bits[: max(0, len(present) - first)]
    return np.packbits(present, bitorder="little").tobytes()


#: Levels: what each names, from which names, and how many bytes it spans.
def level_keys(block: Block, level: int, ranks: TripleRanks | None) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """Per class of sampled positions: indexes of those that take part, and their key columns."""
    out = {}
    for c in (1, 2):
        if level == 9:
            first = ranks[block.byte_triples(c)]
            at = np.flatnonzero(block.sampled(c, 9))
            parts = [first[at + k].astype(U64) for k in range(3)]
        else:
            by = (0, 3, 6) if level == 27 else (0, 7)
            parts = [block.shifted(c, k) for k in by]
            alive = block.sampled(c, level)
            for p in parts:
                alive = alive & (p > 0)
            at = np.flatnonzero(alive)
            parts = [p[at].astype(U64) for p in parts]
        if level == 9:  # byte triples have at most 2**24 names
            columns = [(parts[0] << U64(24)) | parts[1], parts[2]]
            if ranks.size < 1 << 21:
                columns = [(parts[0] << U64(42)) | (parts[1] << U64(21)) | parts[2]]
        elif level == 27:
            columns = [(parts[0] << U64(32)) | parts[1], parts[2]]
        else:
            columns = [(parts[0] << U64(32)) | parts[1]]
        out[c] = (at, columns)
    return out


def last_keys(block: Block, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the 50-byte strings that can be compared by this common shift.

    A key is the shift, the 48-byte rank behind it and the two bytes that the rank leaves out.
    """
    n, data = len(block.data), block.data
    at, keys = [], []
    for kind in ((1, 2), (0, 1), (0, 2))[shift]:
        c = (kind + shift) % 3
        room = block.room[kind::3]
        rank = block.names[c][(kind + shift - c) // 3 :][: len(room)]
        k = np.flatnonzero((room[: len(rank)] >= LENGTH) & (rank > 0))
        i = k * 3 + kind
        before = data[i] if shift else data[i + 48]
        other = data[i + 49] if shift < 2 else data[i + 1]
        key = rank[k].astype(U64) << U64(16)
        key |= (before.astype(np.uint16) << np.uint16(8)) | other
        key |= U64(shift) << U64(62)
        at.append(i.astype(np.int32))
        keys.append(key)
    return np.concatenate(at), np.concatenate(keys)


def all_keys(block: Block, level: int, ranks: TripleRanks | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions (class 2 behind class 1 for names) and key columns of a level."""
    own = level_keys(block, level, ranks)
    return np.concatenate([own[1][0], own[2][0] + len(block.data)]), [np.concatenate(x) for x in zip(own[1][1], own[2][1], strict=True)]


def ranks_of(bitmap: bytes | None) -> TripleRanks | None:
    return TripleRanks(bitmap) if bitmap else None


def limits(stored_blocks: DataFrame, level: int, shared, n_blocks: int, n_ranges: int) -> np.ndarray:
    """First keys of each range but the lowest, from SAMPLE_KEYS keys a range of some of the blocks."""
    used = min(n_blocks, max(SAMPLE_BLOCKS, math.ceil(n_ranges / 256)))
    from_each = math.ceil(max(SAMPLE_KEYS * n_ranges, 20_000) / max(1, used))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(shared.value[0])
        for row in single_rows(batches):
            block = Block(row)
            keys = np.concatenate([last_keys(block, k)[1] for k in range(3)]) if level == LENGTH else all_keys(block, level, ranks)[1][0]
            yield pa.RecordBatch.from_arrays([pa.array(keys[:: max(1, len(keys) // from_each)].view(np.int64))], names=["key"])

    some = stored_blocks.where(F.pmod(F.xxhash64("block"), F.lit(max(1, n_blocks // max(1, used)))) == 0)
    keys = np.sort(some.mapInArrow(sample, "key long").toArrow()["key"].to_numpy().view(U64))
    return np.unique(keys[np.linspace(0, len(keys), n_ranges + 1).astype(np.int64)[1:-1]]) if len(keys) else keys


def requests(stored_blocks: DataFrame, level: int, shared) -> DataFrame:
    """Distinct sorted keys of each block, by key range; ``often`` marks those that occur twice in the block."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cuts = ranks_of(shared.value[0]), shared.value[1]
        for row in single_rows(batches):
            block = Block(row)
            if level == LENGTH:  # keys of different shifts differ, and sort by shift
                distinct, often = [np.concatenate(x) for x in zip(*(distinct_sorted([last_keys(block, k)[1]]) for k in range(3)), strict=True)]
                distinct = [distinct]
            else:
                *distinct, often = distinct_sorted(all_keys(block, level, ranks)[1])
            bounds = np.concatenate([[0], np.searchsorted(distinct[0], cuts), [len(distinct[0])]])
            rows = []
            for b in np.flatnonzero(np.diff(bounds)):
                s = slice(bounds[b], bounds[b + 1])
                rows.append((int(b), block.block, block.turn, squeeze_sorted(distinct[0][s]), squeeze(distinct[1][s].astype(np.uint32)) if len(distinct) > 1 else b"", np.packbits(often[s]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])], names=["range", "block", "turn", "high", "low", "often"])

    return stored_blocks.mapInArrow(ask, "range int, block long, turn long, high binary, low binary, often binary")


def answers(asked: DataFrame, n_ranges: int, last: bool) -> DataFrame:
    """Per block and range: ranks of the keys that occur more than once (0: once), or which keys a block of an earlier turn has."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "range"):
            asked_rows = [{k: r[k] for k in ("range", "block", "turn", "often")} for r in rows_of(table)]
            high = [expand_sorted(r["high"], U64) for r in rows_of(table)]
            ends = np.cumsum([len(h) for h in high])
            columns = [np.concatenate(high)]
            if next(rows_of(table))["low"].size:
                columns.append(np.concatenate([expand(r["low"], np.uint32) for r in rows_of(table)]).astype(U64))
            sizes = [len(h) for h in high]
            del high
            order, new = ordered(columns)
            del columns
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(order)))
            rows = []
            if last:
                _, turn = np.unique([r["turn"] for r in asked_rows], return_inverse=True)
                turn = np.repeat(turn.astype(np.uint32), sizes)[order]
                value = np.empty(len(order), bool)
                value[order] = turn > np.repeat(np.minimum.reduceat(turn, starts), times)
            else:
                often = np.concatenate([np.unpackbits(np.frombuffer(r["often"], np.uint8), count=n) for r, n in zip(asked_rows, sizes, strict=True)]).astype(bool)
                alive = (times > 1) | np.logical_or.reduceat(often[order], starts)
                names = np.cumsum(alive, dtype=np.uint32)
                names *= alive
                value = np.empty(len(order), np.uint32)
                value[order] = np.repeat(names, times)
                rows.append((-1, asked_rows[0]["range"], b"", b"", int(alive.sum())))
            for r, hi, size in zip(asked_rows, ends, sizes, strict=True):
                v = value[hi - size : hi]
                rows.append((r["block"], r["range"], np.packbits(v > 0).tobytes(), b"" if last else squeeze_sorted(v[v > 0]), size))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()])], names=["block", "range", "alive", "ranks", "n"])

    return asked.repartition(math.ceil(n_ranges / PER_TASK), "range").sortWithinPartitions("range").mapInArrow(answer, "block long, range int, alive binary, ranks binary, n long")


def met(stored_blocks: DataFrame, replies: DataFrame, n_parts: int) -> DataFrame:
    """Blocks with their replies, sorted so that a block's row comes first."""
    empty = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    own = stored_blocks.select("*", F.lit(-1).alias("range"), *empty("alive", "ranks"), F.lit(0).cast("long").alias("n"))
    told = replies.where("block >= 0").select("block", F.lit(None).cast("long").alias("turn"), *empty(*BLOCK_COLUMNS[2:]), "range", "alive", "ranks", "n")
    return own.unionByName(told).repartition(n_parts, "block").sortWithinPartitions("block", "range")


def reply_values(rows: list[dict], offsets: np.ndarray | None) -> np.ndarray:
    """The replies of a block in key order: names, or bits in the last step."""
    out = []
    for r in rows:
        alive = np.unpackbits(np.frombuffer(r["alive"], np.uint8), count=r["n"]).astype(bool)
        if offsets is None:
            out.append(alive)
            continue
        value = np.zeros(r["n"], np.uint32)
        value[alive] = expand_sorted(r["ranks"], np.uint32) + np.uint32(offsets[r["range"]])
        out.append(value)
    return np.concatenate(out) if out else np.empty(0, bool if offsets is None else np.uint32)


def renamed(both: DataFrame, level: int, shared) -> DataFrame:
    """Blocks with the names of the level in place of those before."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, offsets = ranks_of(shared.value[0]), shared.value[1]
        for table in groups(batches, "block"):
            row, *told = rows_of(table)
            block = Block(row)
            at, columns = all_keys(block, level, ranks)
            values = reply_values(told, offsets)
            own = np.zeros(len(at), np.uint32)
            if len(at):
                order, new = ordered(columns)
                own[order] = np.repeat(values, np.diff(np.append(np.flatnonzero(new), len(order))))
            n = len(block.data)
            for c in (1, 2):
                mine = (at < n) if c == 1 else (at >= n)
                names = np.zeros(len(range(c, n, 3)), np.uint32)
                names[at[mine] - (0 if c == 1 else n)] = own[mine]
                row[f"names{c}"] = squeeze(names)
            del at, columns, values, own, told
            yield block_row([row[c] if isinstance(row[c], int | bytes) else row[c].to_pybytes() for c in BLOCK_COLUMNS])

    return both.mapInArrow(name, BLOCK_SCHEMA)


# ---- 4. merge and compare


def removals(both: DataFrame) -> DataFrame:
    """(text_key, from_bytes, to_bytes): what goes from each text, in one row or, if it is in several blocks, in more."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "block"):
            row, *told = rows_of(table)
            block = Block(row)
            go, part = np.zeros(len(block.data), bool), block.part()
            told_earlier = reply_values(told, None)
            for shift in range(3):
                at, keys = last_keys(block, shift)
                if len(at):
                    order, new = ordered([keys])
                    at = at[order]
                    starts = np.flatnonzero(new)
                    times = np.diff(np.append(starts, len(at)))
                    doc = block.docs[part[at]]
                    least = np.minimum.reduceat(doc, starts)
                    go[at[(doc > np.repeat(least, times)) | np.repeat(told_earlier[: len(least)], times)]] = True
                    told_earlier = told_earlier[len(least) :]
            i = np.flatnonzero(go)
            part = part[i]
            first = np.cumsum(block.lengths) - block.lengths
            begin = i - first[part] + block.starts[part]
            owner, keys = block.owners[part], block.keys.to_pybytes()
            rows = []
            bounds = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)] if len(owner) else []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                s, e = joined_intervals(np.sort(begin[lo:hi]), np.sort(begin[lo:hi]) + LENGTH)
                k = int(owner[lo])
                rows.append((keys[16 * k : 16 * k + 16], squeeze(s), squeeze(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(3)], names=["text_key", "from_bytes", "to_bytes"])

    return both.mapInArrow(decide, "text_key binary, from_bytes binary, to_bytes binary")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text_key, spans) of the distinct texts that lose something, and (text_key, rep) of all."""
    spark = docs.sparkSession
    keyed = docs.where("doc_id is not null").select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs).alias("text_key"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    firsts = stored(keyed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.max(F.octet_length("text")).alias("n")), "firsts")
    size = firsts.agg(F.sum("n")).first()[0] or 0
    chunk = unit_bytes(size)
    buckets = max(1, math.ceil(size / (BUCKET_UNITS * chunk)))
    with text_batches(spark):
        places = shared_places(anchors(keyed, buckets, CHUNK_UNITS * chunk), buckets)
        rows = keyed.join(places.join(firsts.select("text_key", "rep"), "text_key"), "text_key").where("doc_id = rep").select("doc_id", "text_key", F.col("text").cast("binary").alias("text"), "places")
        parts = stored(stretches(rows), "stretches")
        total = parts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        unit = unit_bytes(total)
        current = stored(blocks(parts, max(1, math.ceil(total / (PER_TASK * unit))), unit), "blocks")
        dropped(parts)
        spans = sorted_out(current, total)
    return spans.groupBy("text_key").agg(F.collect_list(F.struct("from_bytes", "to_bytes")).alias("spans")), firsts.select("text_key", "rep")


def sorted_out(current: DataFrame, total: int) -> DataFrame:
    """Removals from stored blocks, which hold ``total`` bytes: all levels of names, then the merge."""
    spark = current.sparkSession
    n_ranges = max(1, math.ceil(total / unit_bytes(total)))
    n_blocks = current.count()
    context = spark.sparkContext
    bitmap = triple_bitmap(current)
    n_parts = math.ceil(n_blocks / PER_TASK) or 1
    for level in (9, 27, 48, LENGTH):
        triples = bitmap if level == 9 else None
        cuts = limits(current, level, context.broadcast((triples, None)), n_blocks, n_ranges)
        replies = stored(answers(requests(current, level, context.broadcast((triples, cuts))), n_ranges, level == LENGTH), f"replies_{level}")
        both = met(current, replies, n_parts)
        if level < LENGTH:
            counts = replies.where("block < 0").select("range", "n").toArrow()
            in_range = np.zeros(n_ranges + 1, np.int64)
            in_range[counts["range"].to_numpy() + 1] = counts["n"].to_numpy()
            offsets = np.cumsum(in_range)
            if offsets[-1] >= 1 << 32:
                raise ValueError("more than 2**32 repeated strings: the ranks of a level need wider names")
            following = stored(renamed(both, level, context.broadcast((triples, offsets))), f"names_{level}")
        else:
            following = stored(removals(both), "removals")
        dropped(current, replies)
        current = following
    return current


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_text")


def cut_texts(docs: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """(row, text, found): the columns but text as ``row``, the text, and ``found`` with n_bytes, n_removed, n_spans and, if wanted, kept_bytes and kept_text."""
    spans, firsts = repeated_spans(docs)
    key = F.when(docs["doc_id"].isNotNull(), text_key(docs))
    base = docs.select(whole(docs, ("text",)).alias("row"), docs["text"].alias("text"), key.alias("key"), docs["doc_id"].cast("long").alias("id"))
    spans = spans.select(F.col("text_key").alias("span_key"), "spans")
    told = base.join(firsts.join(spans, F.col("text_key") == F.col("span_key"), "left"), F.col("key") == F.col("text_key"), "left")

    added = [*ADDED[:3], *kept]
    kinds = [pa.int64()] * 3 + [pa.binary() if c == "kept_bytes" else pa.string() for c in kept]
    want_text = "kept_text" in kept

    @F.arrow_udf(f"struct<n_bytes long, n_removed long, n_spans long, {', '.join(c + (' binary' if c == 'kept_bytes' else ' string') for c in kept)}>")
    def cut(texts: pa.Array, copies: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, copy, lost in zip(texts, copies.to_pylist(), spans, strict=True):
            raw = (text.as_py() or "").encode()
            if copy and len(raw) >= LENGTH:
                rows.append((len(raw), len(raw), 1, b"", ""))
                continue
            pieces, at, n = [], 0, 0
            if lost.is_valid and len(lost):
                found = sorted((s, e) for x in lost.as_py() for s, e in zip(expand(x["from_bytes"], np.int64).tolist(), expand(x["to_bytes"], np.int64).tolist(), strict=True))
                for s, e in zip(*(x.tolist() for x in joined_intervals(*map(np.array, zip(*found, strict=True)))), strict=True):
                    pieces.append(raw[at:s])
                    at, n = e, n + 1
            pieces.append(raw[at:])
            left = b"".join(pieces)
            clean = None if not want_text or not text.is_valid else text.as_py() if not n else "".join(x.decode(errors="ignore") for x in pieces)
            rows.append((len(raw), len(raw) - len(left), n, left, clean))
        return pa.StructArray.from_arrays([pa.array([r[ADDED.index(c)] for r in rows], k) for c, k in zip(added, kinds, strict=True)], names=added)

    small_batches(docs.sparkSession)
    return told.select("row", "text", cut("text", F.coalesce(F.col("id") > F.col("rep"), F.lit(False)), "spans").alias("found"))


def without_repeats(docs: DataFrame, kept: tuple[str, ...] = ADDED[3:]) -> DataFrame:
    """Input columns with n_bytes, n_removed, n_spans, kept_bytes and kept_text (null where the text is null).

    kept_bytes is what is left, byte by byte; kept_text is the same without
    characters that lost some of their bytes; ``kept`` names those wanted.  Input columns of these names are
    replaced.
    """
    columns = [F.col("text") if c.lower() == "text" else F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ADDED]
    return cut_texts(docs, kept).select(*columns, "found.*")


def replaced_text(docs: DataFrame) -> DataFrame:
    """The columns of docs with what is left of each text in place of it, and n_chars, where there is such a column, of it."""
    left = {"text": F.col("found.kept_text"), "n_chars": F.char_length("found.kept_text")}
    columns = [(left[c.lower()].cast(docs.schema[c].dataType) if c.lower() in left else F.col("row")[c]).alias(c) for c in docs.columns]
    return cut_texts(docs, ("kept_text",)).select(*columns)
