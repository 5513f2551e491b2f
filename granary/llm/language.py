"""Language proportions of each document by expectation-maximisation.

A document's character trigrams are drawn from a mixture of languages.  Training
counts trigrams per language over a bounded sample of labelled rows; prediction
finds each document's mixture weights by EM and its set of languages by a
penalised likelihood: a language joins the set only if it raises the likelihood
by more than a BIC penalty.  The main language is the one of largest weight.

Trigrams are hashed to 2**16 cells, so the model is one vector per language
(512 KB), which bounds the broadcast whatever the corpus.  The sample is bounded
by ``SAMPLE_DOCS`` per language: rows are taken by a hash of their id, at a rate
that follows from the language's row count.  Prediction covers every row and
every whole text, is map-only and shuffles nothing.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text when no row can be learned from.  Rows with a null id are never
held out and never learned from.  Equal likelihoods go to the language that
sorts first.  Repeated rows get equal answers.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.rows import whole
from granary.sources.tables import small_batches

#: Labelled rows to learn from, per language, in expectation.
SAMPLE_DOCS = 8_000
#: Labels that a model can have: each is a vector of half a MB on the driver and in a broadcast.
MOST_LANGUAGES = 400
CELLS = 1 << 16
SMOOTHING = 0.2
ROUNDS = 15
#: Each character is in three trigrams, so their log-likelihoods hold about three times the evidence.
OVERLAP = 3.0
NOT_LETTERS = re.compile(r"[\W\d_]+")
UND = "und"

MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def cells(text: str | None) -> np.ndarray:
    """Hash cells of a text's trigrams over lower-case letters and word breaks; empty without letters."""
    letters = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, letters)):
        return np.empty(0, np.uint16)
    a = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), "<u4")
    mixed = a[:-2] * MULTIPLIERS[0] + a[1:-1] * MULTIPLIERS[1] + a[2:] * MULTIPLIERS[2]
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * MULTIPLIERS[1]) >> np.uint32(16)).astype(np.uint16)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (cells x languages); an error for more than MOST_LANGUAGES labels."""
    small_batches(docs.sparkSession)
    labelled = docs.where(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"]))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} different labels to learn: the model holds {MOST_LANGUAGES} languages at most; clean the labels first")
    counts = np.zeros((CELLS, len(languages)))
    if languages:
        chance = F.create_map(*(F.lit(v) for l, n in sizes.items() for v in (l, min(1.0, sample_docs / n))))
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        sample = labelled.where(draw < chance[F.col("lang")]).select("lang", "text").repartition(32)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own.setdefault(lang, np.zeros(CELLS, np.int64))
                    own[lang] += np.bincount(cells(text.as_py()), minlength=CELLS)
            for lang, n in own.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "cell", "n"])

        # at most languages x cells rows come back
        for r in sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["cell"], languages.index(r["lang"])] = r["n"]
    counts += SMOOTHING
    return languages, counts / counts.sum(0)


def mixture(p: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """EM weights of the columns of p, and the log-likelihood of the weighted rows."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = weight.sum()
    for _ in range(ROUNDS):
        share = share * (weight / (p @ share) @ p) / total
    return share, float(weight @ np.log(p @ share))


def proportions(probabilities: np.ndarray, text: str | None) -> np.ndarray | None:
    """Weight of each language in a text; None without letters.

    Languages join the set one by one, the best first.  One whose first bit of
    weight would lower the likelihood can't raise it at any weight (the
    likelihood is concave), so it isn't tried.
    """
    found = cells(text)
    if not len(found) or not probabilities.shape[1]:
        return None
    at, weight = np.unique(found, return_counts=True)
    p, weight = probabilities[at], weight / OVERLAP
    alone = weight @ np.log(p)
    chosen = [int(np.argmax(alone))]
    share, best = np.ones(1), float(alone[chosen[0]])
    penalty = 0.5 * np.log(max(2.0, weight.sum())) + 2.0
    while len(chosen) < p.shape[1]:
        slope = (weight / (p[:, chosen] @ share)) @ p - weight.sum()
        tried = [(mixture(p[:, [*chosen, j]], weight), j) for j in range(p.shape[1]) if j not in chosen and slope[j] > penalty]
        if not tried:
            break
        (new_share, value), j = max(tried, key=lambda x: (x[0][1], -x[1]))
        if value - best <= penalty:
            break
        chosen, share, best = [*chosen, j], new_share, value
    out = np.zeros(p.shape[1])
    out[chosen] = share
    return out


def predict(docs: DataFrame, languages: list[str], probabilities: np.ndarray) -> DataFrame:
    """Input columns with lang_pred, score (weight of that language) and lang_shares appended; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((languages, probabilities))

    @F.arrow_udf("struct<lang_pred string, score double, lang_shares array<double>>")
    def infer(texts: pa.Array) -> pa.Array:
        languages, probabilities = model.value
        rows = []
        for text in texts:
            share = proportions(probabilities, text.as_py())
            best = None if share is None else int(np.argmax(share))
            rows.append((UND, 0.0, None) if best is None else (languages[best], min(1.0, float(share[best])), share.tolist()))
        kinds = (pa.string(), pa.float64(), pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], names=["lang_pred", "score", "lang_shares"])

    return docs.select(whole(docs, ("lang_pred", "score", "lang_shares")).alias("row"), infer(docs["text"]).alias("found")).select("row.*", "found.*")
