"""The subpackage's named queries and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import anchor_dedup, bpe, embeddings, fill_middle, html_text, jaccard, language, packing, pii, prefix_trie, quality, suffix_dedup, token_counts
from granary.sources.tables import dropped, shared_dir, small_batches, stored, table

BPE_MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes of 50-byte strings that documents with smaller ids hold."""
    left = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), ("kept_bytes",))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    small_batches(spark)
    texts = pages.select("page_id", "url", html_text.extract(pages["html"]).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup of all documents' tokens after a load, revisions, deletes of exact copies, and a replay.

    Counts are stored once; then batch 1 loads every document under two tokenizer versions, batch 2 revises
    the first version's counts by the end-of-document id, batch 3 deletes every
    document that copies one with a smaller id, and batch 2 is then committed
    again, which changes nothing.
    """
    docs = table(spark, sf_dir, "documents")
    versions = {"byte_bpe_50k": BPE_RANKS, "byte_bpe_multi_50k": BPE_MULTI}
    counts = [bpe.token_count(bpe.encode(docs, path, public_tokenizers.PATTERN)).alias(name) for name, path in versions.items()]
    wide = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), *counts)
    known = stored(wide.unpivot(["doc_id", "source", "lang", "text_hash"], list(versions), "tokenizer", "n_tokens"), "token_counts")
    store = f"{shared_dir(spark)}/granary/rollup-{uuid.uuid4().hex}"
    first = known.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"))
    load = known.withColumn("op", F.lit("insert")).withColumn("old_tokens", F.lit(0))
    revised = known.where(F.col("tokenizer") == "byte_bpe_50k").select("source", "lang", "tokenizer", F.lit("revise").alias("op"), F.col("n_tokens").alias("old_tokens"), (F.col("n_tokens") + 1).alias("n_tokens"))
    current = F.col("n_tokens") + (F.col("tokenizer") == "byte_bpe_50k").cast("long")
    deleted = known.join(first, "text_hash").where("doc_id > first_id").select("source", "lang", "tokenizer", F.lit("delete").alias("op"), F.lit(0).alias("old_tokens"), current.alias("n_tokens"))
    token_counts.commit(load, store, 1)
    token_counts.commit(revised, store, 2)
    token_counts.commit(deleted, store, 3)
    token_counts.commit(revised, store, 2)
    return token_counts.totals(spark, store)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), BPE_FILE, BPE_RANKS, public_tokenizers.PATTERN)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.find(spark, docs["text"]).alias("f"))
    return found.select("doc_id", "f.n_email", "f.n_ip", "f.n_card", "f.n_phone", F.sha2(F.col("f.base_spans").cast("binary"), 256).alias("base_sha256"), F.col("f.all_spans").alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and host rules over every document."""
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five-word n-grams, similarity 0.8 or more."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the rank file and decoded again, as digests."""
    docs = table(spark, sf_dir, "documents")
    encoded = docs.select("doc_id", bpe.encode(docs, BPE_MULTI, public_tokenizers.PATTERN))
    return encoded.select(
        "doc_id",
        bpe.token_count(F.col("token_ids")).alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("token_ids"), BPE_MULTI, public_tokenizers.PATTERN), 256).alias("decoded_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled rows."""
    docs = table(spark, sf_dir, "documents")
    predicted = language.predict(docs.select("doc_id", "text"), *language.train(docs))
    return predicted.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-the-middle form, as digests of output and rebuilt text."""
    docs = table(spark, sf_dir, "documents")
    wanted = ("n_units", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    found = docs.select("doc_id", fill_middle.fill_middle(docs, wanted=wanted).alias("f"))
    return found.select("doc_id", F.col("f.n_units").alias("n"), "f.form", "f.prefix_chars", "f.middle_chars", "f.output_sha256", "f.restored_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with borrowed openings."""
    turns, ids, source = prefix_trie.spliced(table(spark, sf_dir, "conversations"))
    nodes = prefix_trie.prefix_trie(turns, ids)
    dropped(source)
    return nodes


def op13_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words of 13-word windows that documents with smaller ids hold."""
    left = anchor_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_html_extraction, op3_embedding_near_dedup, op4_token_counts, op5_packing, op6_pii, op7_quality_rules, op8_ngram_jaccard, op9_byte_bpe, op10_language_id, op11_fill_middle, op12_prefix_trie, op13_anchor_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_near_dedup": embeddings.SQL, "op7_quality_rules": quality.SQL, "op8_ngram_jaccard": jaccard.SQL, "op11_fill_middle": fill_middle.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_anchor_dedup": anchor_dedup.SQL}
