"""Near-duplicate texts: MinHash banding, then exact Jaccard on whole n-gram sets.

1. One pass over all texts gives each its hash and its band hashes.  Identical
   texts become one, with a number, the smallest id and a count.
2. Band hashes are shuffled into buckets; texts that share one are joined in a
   star around one of them, never pair by pair.  The stars' components are
   candidate groups: two texts that share a band are in the same group.
3. Pairs are verified in cells, either a whole candidate group or each bucket of
   it by itself, whichever moves fewer sets: a group of near copies is a cell, a
   long chain of accidental neighbours is cut into its buckets, so the work
   never exceeds that of the buckets.  A pair that shares several buckets counts
   in the first.  Cells of more than BLOCK texts are cut into blocks and every
   pair of blocks is compared on its own, so no task holds a large cell.  All
   pairs of a block are counted exactly as a product of incidence matrices; a
   task emits a row per text (its number of links, its local root), not per pair.
4. The components of the verified links are the classes.

``bands`` follow from the target recall: with r rows per band, a pair of
similarity s shares one of b bands with probability 1 - (1 - s^r)^b.  The default
finds a pair at the threshold 0.8 with probability above 0.999, more similar ones
with still higher probability.  N-grams are compared by 64-bit hashes.

Defined results: words are runs of anything but ASCII white space.  A text of one
to four words has one n-gram, all its words; a text that is null or has no word
has none, links with nothing and is a class by itself.  Identical texts link with
one another.  Extra columns are ignored.  Rows that repeat a doc_id, with equal or
other texts, count as documents of their own.  Rows without a doc_id link with
nothing and have a null class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.components import components
from granary.llm.quality import WORD
from granary.llm.rows import text_key
from granary.sources.tables import dropped, stored, text_batches

ROWS = 6
#: Texts in a block of the verification.
BLOCK = 200
#: Side of the texts of a block that is compared with itself; 0 and 1 are those of two blocks.
WITHIN = 2
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Fewest bands that find a pair of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    words = [WORD.findall(t) if t else [] for t in texts]
    lengths = [len(w) for w in words]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    hashes = pd.util.hash_array(flat, categorize=True).astype(np.uint64) if len(flat) else np.empty(0, np.uint64)
    out, start = [], 0
    for length in lengths:
        h = hashes[start : start + length]
        start += length
        if length == 0:
            out.append(h)
            continue
        width = min(n, length)
        rolled = np.full(length - width + 1, np.uint64(width))
        for k in range(width):
            rolled = rolled * MULTIPLIER + h[k : length - width + 1 + k]
        out.append(np.unique(mixed(rolled)))
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """(texts x bands) hashes of MinHash bands; sets must not be empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    folded = np.concatenate(sets)
    folded = (folded ^ (folded >> np.uint64(32))).astype(np.uint32)
    draw = np.random.default_rng(seed)
    adds, multiples = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32), draw.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), np.uint64(band + 1))
        for k in range(band * rows, band * rows + rows):
            y = (folded ^ adds[k]) * multiples[k]
            y ^= y >> np.uint32(15)
            key = key * MULTIPLIER + np.minimum.reduceat(y, starts).astype(np.uint64)
        out[:, band] = mixed(key)
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, bands) of every document; bands is empty without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # a few texts at a time stay in the processor's cache
                batch = whole.slice(at, 64)
                sets = ngram_sets(batch.column(2).to_pylist(), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                found: list[list[int]] = [[] for _ in sets]
                if full:
                    hashes = band_hashes([sets[i] for i in full], bands, rows).view(np.int64)
                    for i, h in zip(full, hashes.tolist(), strict=True):
                        found[i] = h
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_key", "bands"])

    keyed = docs.select(docs["doc_id"].cast("long"), text_key(docs).alias("text_key"), docs["text"])
    return keyed.mapInArrow(sign, "doc_id long, text_key binary, bands array<long>")


def linked_counts(sets: list[np.ndarray], weights: np.ndarray, split: int, similarity: tuple[int, int], earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of linked texts, local root) of each set in a block or a pair of blocks.

    split > 0: only pairs of one of the first ``split`` sets with one of the rest.
    earlier: (texts x k) band hashes; a pair that agrees in one of them isn't counted here.
    similarity = (p, q): a pair links if intersection / union >= p / q, in whole numbers.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(count), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((count, count), np.float32)
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [first, first + width])
        part = np.zeros((count, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        common += part @ part.T
    p, q = similarity
    link = (p + q) * common.astype(np.int64) >= p * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(link, False)
    if split:
        link[:split, :split] = False
        link[split:, split:] = False
    if earlier.shape[1]:
        i, j = np.nonzero(link)
        elsewhere = (earlier[i] == earlier[j]).any(1)
        link[i[elsewhere], j[elsewhere]] = False
    root = np.arange(count)
    while True:  # smallest index that can be reached: at most as many rounds as the longest path, halved by jumping
        reach = np.where(link, root[None, :], count).min(1, initial=count)
        new = np.minimum(root, reach)
        new = new[new]
        if (new == root).all():
            return link @ weights, root
        root = new


def verified(grouped: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """(node, links, root) per text and block pair.  grouped: (cell, side, node, copies, earlier, grams), whole cells in one task, sorted."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            split = sum(r[1] == 0 for r in rows)
            if rows[0][1] != WITHIN and split in (0, len(rows)):
                return  # one of the two blocks is empty
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            links, root = linked_counts(sets, np.array([r[3] for r in rows], np.int64), split, similarity, np.array([r[4] for r in rows], np.int64).reshape(len(rows), -1))
            nodes = np.array([r[2] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links, pa.int64()), pa.array(nodes[root])], names=["node", "links", "root"])

        held: dict[int, tuple] = {}  # a repeated row's text counts once here, its copies in r[3]
        cell = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "side", "node", "copies", "earlier", "grams")), strict=True):
                if held and cell != row[0]:
                    yield from close(list(held.values()))
                    held = {}
                cell = row[0]
                held.setdefault(row[2], row)
        if held:
            yield from close(list(held.values()))

    return grouped.mapInArrow(compare, "node long, links long, root long")


def cells(texts: DataFrame, block: int) -> DataFrame:
    """(node, places): the cells that each text is compared in, with their number of blocks and the band hashes before.

    Either all of a candidate group or each of its buckets, whichever sends fewer sets.
    """
    banded = texts.select("node", "bands", F.posexplode("bands").alias("nth", "band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = banded.join(buckets.select("band", "hub"), "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = stored(components(stars).select("node", F.col("component").alias("candidates")), "candidates")
    blocks = F.ceil(F.col("n") / block)
    of_bucket = buckets.join(groups, F.col("hub") == F.col("node")).groupBy("candidates").agg(F.sum(F.col("n") * blocks).alias("by_bucket"))
    of_group = groups.groupBy("candidates").agg(F.count("*").alias("n"))
    sizes = stored(of_group.join(of_bucket, "candidates").select("candidates", "n", (F.col("n") * blocks <= F.col("by_bucket")).alias("as_one")), "sizes")
    member = groups.join(sizes, "candidates")
    as_one = member.where("as_one").select("node", F.hex("candidates").alias("cell"), blocks.cast("int").alias("blocks"), F.array().cast("array<long>").alias("earlier"))
    apart = banded.join(member.where("not as_one").select("node", "candidates"), "node").join(buckets.select("band", F.col("n")), "band")
    by_bucket = apart.select("node", F.concat(F.hex("band"), F.lit("b")).alias("cell"), blocks.cast("int").alias("blocks"), F.slice("bands", F.lit(1), F.col("nth")).alias("earlier"))
    # a text is in one group, or in as many buckets as there are bands
    return as_one.unionByName(by_bucket).groupBy("node").agg(F.collect_list(F.struct("cell", "blocks", "earlier")).alias("places"))


def judged(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (4, 5), recall: float = 0.999, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, class_id, n_links, stays) of every row with a doc_id, as a stored table.

    ``stays`` holds for the rows of one text in each class: of those with the
    smallest id, the text whose key is the smallest.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    bands = bands_for(similarity[0] / similarity[1], recall, rows)
    with text_batches(spark):
        signed = stored(signatures(docs, n, bands, rows), "signatures")
        texts = signed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
        texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
        placed = texts.select("node", "rep", "copies", "text_key").join(cells(texts, block), "node")
        keyed = docs.select(docs["doc_id"].cast("long").alias("rep"), text_key(docs).alias("text_key"), docs["text"])
        wanted = keyed.join(placed, ["rep", "text_key"]).select("node", "copies", "places", "text")

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    nodes = batch.column(0).to_pylist()
                    fresh = [i for i, x in enumerate(nodes) if x != (nodes[i - 1] if i else last)]  # equal rows follow each other
                    last = nodes[-1]
                    batch = batch.take(pa.array(fresh, pa.int32()))
                    sets = ngram_sets(batch.column(3).to_pylist(), n)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "copies", "places", "grams"])

        kind = placed.schema["places"].dataType.simpleString()
        sets = wanted.mapInArrow(grams, f"node long, copies long, places {kind}, grams binary").select("node", "copies", "grams", F.explode("places").alias("p"))
        own = sets.select("node", "copies", "grams", "p.*").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = F.concat_ws("/", "cell", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
        dealt = dealt.select(keys.alias("cell"), F.when(F.col("own") == F.col("other"), WITHIN).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "node", "copies", "earlier", "grams")
        checked = stored(verified(dealt.repartition(F.col("cell")).sortWithinPartitions("cell", "side", "node"), n, similarity), "verified")
    found = stored(components(checked.select(F.col("node").alias("a"), F.col("root").alias("b"))), "classes_found")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    of_text = texts.join(links, "node", "left").join(found, "node", "left").select("text_key", "rep", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.size("bands") > 0).alias("filled"))
    heads = of_text.join(found.select("component").distinct(), "component").groupBy("component").agg(F.min(F.struct("rep", "text_key")).alias("head"))
    told = of_text.join(heads, "component", "left").select("text_key", "rep", "filled", "n_links", F.coalesce("head", F.struct("rep", "text_key")).alias("head"))
    out = signed.select("doc_id", "text_key").join(told, "text_key").select(
        "doc_id", "text_key", F.when(F.col("filled"), F.col("head.rep")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("filled"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        (~F.col("filled") | (F.col("doc_id") == F.col("head.rep")) & (F.col("text_key") == F.col("head.text_key"))).alias("stays"),
    )
    result = stored(out, "judged")
    dropped(signed, texts, checked, found)
    return result


def classes(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (4, 5), recall: float = 0.999, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links): smallest id of the class, and number of other documents linked directly."""
    nameless = docs.where("doc_id is null").select(docs["doc_id"].cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return judged(docs, n, similarity, recall, rows, block).select("doc_id", "class_id", "n_links").unionByName(nameless)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs but for one document of each class; rows equal in id and text are one document; rows without an id stay."""
    found = judged(docs)
    own = docs.withColumn(KEY, text_key(docs))
    ids = found.select(F.col("doc_id").alias(f"{KEY}:id"), F.col("text_key").alias(f"{KEY}:text"), "stays")
    same = (own["doc_id"].cast("long") == F.col(f"{KEY}:id")) & (own[KEY] == F.col(f"{KEY}:text"))
    kept = own.join(ids.where("not stays").distinct(), same, "left_anti")
    again = stored(ids.where("stays").groupBy(f"{KEY}:id", f"{KEY}:text").count().where("count > 1"), "repeated_rows")
    if not again.isEmpty():
        same = (kept["doc_id"].cast("long") == F.col(f"{KEY}:id")) & (kept[KEY] == F.col(f"{KEY}:text"))
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", KEY]))
    return kept.drop(KEY)


#: A column name that no table uses.
KEY = "jaccard:text_key"


#: DuckDB SQL for ``classes`` over ``documents``: all pairs that share an n-gram, and components by recursion.
SQL = """
with recursive words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
grams as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from common join sizes sx on sx.doc_id = x join sizes sy on sy.doc_id = y where 9 * c >= 4 * (sx.n + sy.n)),
reach as (select x as node, y as other from links union select r.node, l.y from reach r join links l on l.x = r.other)
select doc_id, least(doc_id, coalesce((select min(other) from reach where node = doc_id), doc_id)) as class_id, (select count(*) from links where x = doc_id) as n_links from documents
"""
