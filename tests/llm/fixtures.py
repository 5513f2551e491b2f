"""Shared rows for the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names an operator might use itself.
CLASHING = ("rep", "text_key", "bands", "class_id", "n_links", "score", "lang_pred", "_found", "kept_text", "token_ids", "row_key", "_key", "_text", "found", "row", "hub", "a.b")


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]], **constant: str) -> DataFrame:
    """A documents table of (doc_id, text) rows."""
    return spark.createDataFrame([(i, t, constant.get("lang", "en"), constant.get("source", "s"), len(t or "")) for i, t in rows], DOCUMENTS)


def with_clashing_columns(docs: DataFrame) -> DataFrame:
    """The same table with columns named as an operator's own."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def words(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(n)]


def prose(n: int, seed: int) -> str:
    return " ".join(words(n, seed))


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
