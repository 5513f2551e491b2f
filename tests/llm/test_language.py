"""Language identification: held-out accuracy, mixtures, edges."""

from __future__ import annotations

import numpy as np
import pytest
from fixtures import documents, with_clashing_columns

from granary.llm import language, registry


def test_held_out_accuracy(spark, medium):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = registry.op10_language_id(spark, medium).collect()
    assert len(rows) == len(truth)
    tested = [(r, *truth[r["doc_id"]]) for r in rows if r["held_out"]]
    assert 0.15 < len(tested) / len(rows) < 0.35
    sure = [(r["lang_pred"], lang) for r, lang, text in tested if lang and text and len(text.split()) >= 20]
    assert sum(a == b for a, b in sure) / len(sure) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def toy(spark):
    rows = []
    for i in range(400):
        rows.append((i, "the cat and the dog went home with their friends" if i % 2 else "der hund und die katze gingen nach hause", "en" if i % 2 else "de", "s", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mixtures_and_undecided(spark):
    model = language.train(toy(spark))
    texts = [(1, None), (2, ""), (3, "12 + 34 = 46 ²½"), (4, "the dog and the cat"), (5, "der hund und die katze"), (6, ("the cat and the dog went home with their friends " * 6 + "der hund und die katze gingen nach hause " * 4)), (7, "the " * 200_000)]
    out = {r["doc_id"]: r for r in language.predict(with_clashing_columns(documents(spark, texts)), *model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["und", "und", "und", "en", "de", "en", "en"]
    assert [out[i]["score"] for i in (1, 2, 3)] == [0, 0, 0]
    assert 0.45 < out[6]["score"] < 0.75 and abs(sum(out[6]["lang_shares"]) - 1) < 1e-6


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "some words")])
    assert language.predict(docs, *language.train(docs.where("false"))).first()["lang_pred"] == "und"
    assert language.predict(docs.where("false"), *language.train(docs)).count() == 0


def test_held_out_rows_and_labels_teach_nothing(spark):
    docs = toy(spark)
    kept = docs.where(~language.held_out(docs["doc_id"]))
    a, b = language.train(docs), language.train(kept)
    assert a[0] == b[0] and np.array_equal(a[1], b[1])


def test_mixture_raises_likelihood():
    p = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]])
    share, value = language.mixture(p, np.array([5.0, 1.0, 5.0]))
    assert np.allclose(share, 0.5, atol=1e-6) and value > 5 * np.log(0.7) + np.log(0.2) + 5 * np.log(0.1)


def plain_proportions(probabilities, text):
    """EM and forward selection in plain loops: every language is tried at each step."""
    import math
    from collections import Counter

    counts = {int(c): n / language.OVERLAP for c, n in Counter(language.cells(text).tolist()).items()}
    if not counts:
        return None
    total = sum(counts.values())

    def fit(chosen):
        share = {j: 1 / len(chosen) for j in chosen}
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(chosen, 0.0)
            for c, n in counts.items():
                mix = sum(share[j] * probabilities[c][j] for j in chosen)
                for j in chosen:
                    new[j] += n * share[j] * probabilities[c][j] / mix
            share = {j: v / total for j, v in new.items()}
        return share, sum(n * math.log(sum(share[j] * probabilities[c][j] for j in chosen)) for c, n in counts.items())

    languages = range(len(probabilities[0]))
    share, best = max(((fit([j]), -j) for j in languages), key=lambda x: (x[0][1], x[1]))[0]
    penalty = 0.5 * math.log(max(2.0, total)) + 2.0
    while len(share) < len(languages):
        tried = max((fit([*share, j]) for j in languages if j not in share), key=lambda x: x[1])
        if tried[1] - best <= penalty:
            break
        share, best = tried
    return [share.get(j, 0.0) for j in languages]


def test_equals_plain_mixtures(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    _, probabilities = language.train(docs)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    texts = [t[:400] for t in texts if t] + [texts[0][:300] + " " + texts[k][:300] for k in range(1, 12) if texts[0] and texts[k]] + ["", "1 2", None]
    plain = probabilities.tolist()
    for text in texts:
        want, got = plain_proportions(plain, text), language.proportions(probabilities, text)
        assert (want is None) == (got is None)
        if want is not None:
            assert abs(np.array(want) - got).max() < 1e-6, text


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "la casa"), (1, "la casa"), (2, "la casa")], "doc_id long, text string")
    flat = np.full((language.CELLS, 2), 1 / language.CELLS)
    rows = language.predict(docs, ["aa", "bb"], flat).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("aa", 1.0)} and len(rows) == 3


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, f"some words {i}", f"l{i % 5}", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    with pytest.raises(ValueError, match="labels"):
        language.train(docs)
