"""Byte-level BPE with the tiktoken library and a local rank file.

``encode`` and ``decode`` are map-only: Spark deals the rows out, each task
loads the rank file once, and nothing is shuffled.  Token ids travel as one
binary value per document (little-endian unsigned 32-bit), which is a quarter
of the memory of an array of longs and needs no conversion on either side.

Defined results: a null text is an empty text (no ids, empty bytes).  Texts may
be of any length: they are cut at safe boundaries (see ``safe_pieces``), which
changes no id.  Repeated rows and ties are independent rows.  Columns of the
input are kept; an existing column with the output's name is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.tables import small_batches

#: Code points after which a long text is cut at the next safe boundary.
PIECE_CHARS = 100_000

_ENCODINGS: dict[tuple[str, str], object] = {}


def rank_file_encoding(path: str, pattern: str):
    """A tiktoken encoding without special tokens; one per worker and file."""
    import tiktoken

    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text where no match of the splitting pattern can cross.

    No alternative of the pattern goes from a visible character on to white
    space, and a match depends on nothing before its start.  So a cut between
    a letter or digit and a following space or line feed leaves all matches as
    they were.  A text without such a place stays in one piece.
    """
    start, n = 0, len(text)
    while n - start > size:
        cut = start + size
        while cut < n and not (text[cut] in " \n" and text[cut - 1].isalnum()):
            cut += 1
        yield text[start:cut]
        start = cut
    if start < n:
        yield text[start:]


def encode_text(encoding, text: str | None) -> np.ndarray:
    """The ids of one text as little-endian unsigned 32-bit integers."""
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= PIECE_CHARS:
        return np.array(encoding.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(encoding.encode_ordinary(piece), "<u4") for piece in safe_pieces(text)])


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> Column:
    """Column of packed ids for ``df[text_col]``; use as ``df.withColumn(ids_col, encode(...))``."""

    small_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        encoding = rank_file_encoding(path, pattern)
        return pa.array([encode_text(encoding, x.as_py()).tobytes() for x in texts], pa.binary())

    return packed(F.coalesce(df[text_col], F.lit(""))).alias(ids_col)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Raw bytes of packed ids.  Bytes, not a string: ids may end inside a character."""

    @F.arrow_udf("binary")
    def unpacked(packs: pa.Array) -> pa.Array:
        encoding = rank_file_encoding(path, pattern)
        return pa.array([encoding.decode_bytes(np.frombuffer(x.as_py(), "<u4").tolist()) for x in packs], pa.binary())

    return unpacked(ids)


def token_count(ids: Column) -> Column:
    """Number of ids in a packed column."""
    return (F.octet_length(ids) / 4).cast("long")
