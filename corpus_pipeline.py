"""Raw documents to packed training sequences.

Five stages, each one operator: documents without a main language go (those
without a letter, where no row is labelled to learn languages from); one
document of each near-duplicate class stays; passages that repeat across
documents are cut from all but the first; personal data is masked; the rest is
packed into windows.  Between stages the rows are a parquet table, so a lost
executor costs at most the stage that runs.

All stages but the last return the columns of their input.  Empty tables pass
through.  A text that loses everything stays as an empty text.  Rows with a null
id or null text follow the operators' own definitions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import jaccard, language, packing, pii, suffix_dedup
from granary.llm.rows import whole
from granary.sources.tables import dropped, stored, table

#: A document's main language must have at least this share of it.
LEAST_SHARE = 0.5
#: A column name that no table uses.
LEFT = "corpus_pipeline:text_left"


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of docs with another text, and with its length where they hold one."""
    new = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return docs.withColumns(new)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; where no language can be learned, those with a letter."""
    languages, probabilities = language.train(docs)
    if not languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = docs.select(whole(docs).alias("row"), "text")
    found = language.predict(found, languages, probabilities).select("row", F.struct("lang_pred", "score").alias("found"))
    return found.where((F.col("found.lang_pred") != language.UND) & (F.col("found.score") >= LEAST_SHARE)).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: of those with the smallest id, rows of one text; equal rows become one."""
    return jaccard.one_of_each(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids hold."""
    return suffix_dedup.replaced_text(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked by its kind."""
    masked = docs.withColumn(LEFT, F.when(F.col("text").isNotNull(), pii.find(spark, docs["text"])["redacted_text"]))
    return with_text(masked, F.col(LEFT)).drop(LEFT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]

#: The stages hold models and byte-level work that SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES, 1):
        following = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            following = stored(following, f"stage_{name}")
        if i > 1:
            dropped(docs)
        docs = following
    return docs
