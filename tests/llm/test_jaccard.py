"""N-gram Jaccard classes against all pairs."""

from __future__ import annotations

import re

from fixtures import documents, prose, rows_of, with_clashing_columns

from granary.llm import jaccard, registry


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    near = [[b for b in range(n) if a != b and sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((rows[a][0], None if rows[a][0] is None else min(rows[b][0] for b in seen), len(near[a])))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(registry.op8_ngram_jaccard(spark, small)) == brute(rows)


def test_edges(spark):
    base = prose(200, 1).split()
    chain = [" ".join([*base[:200 - k], *(f"new{k}x{j}" for j in range(k))]) for k in range(0, 60, 6)]
    rows = [(i, t) for i, t in enumerate(chain)] + [(100, None), (101, ""), (102, " \n\t"), (103, "one two"), (104, "one two"), (105, "one two three"), (106, "日本 語 テ キ スト"), (107, "日本 語 テ キ スト"), (108, chain[0]), (108, chain[0]), (None, chain[0]), (109, prose(30_000, 5))]
    assert rows_of(jaccard.classes(with_clashing_columns(documents(spark, rows)))) == brute(rows)


def test_group_larger_than_a_block(spark):
    base = prose(120, 2).split()
    rows = []
    for i in range(90):
        text = list(base)
        text[i] = f"changed{i}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    assert rows_of(jaccard.classes(documents(spark, rows), block=8)) == brute(rows)


def test_texts_that_share_an_id(spark):
    a, b = prose(60, 11), prose(60, 12)
    rows = [(5, a), (5, b), (6, a), (7, b), (8, a + " word"), (8, prose(40, 13)), (9, b), (9, b)]
    assert rows_of(jaccard.classes(documents(spark, rows))) == brute(rows)
    kept = sorted((r["doc_id"], r["text"]) for r in jaccard.one_of_each(documents(spark, [*rows, (None, a), (10, None), (10, None), (11, "")])).collect() if r["doc_id"] is not None)
    assert [k for k in kept if k[0] < 10] == sorted([(5, a), (5, b), (8, rows[5][1])]) and [k[0] for k in kept if k[0] >= 10] == [10, 11]


def test_chain_is_cut_into_its_buckets(spark):
    words = prose(2000, 14).split()
    rows = [(i, " ".join(words[9 * i : 9 * i + 100])) for i in range(200)] + [(300 + i, " ".join(words[300:400])) for i in range(5)]
    assert rows_of(jaccard.classes(documents(spark, rows), block=4)) == brute(rows)
    signed = jaccard.signatures(documents(spark, rows), 5, 20, 6).withColumnRenamed("doc_id", "node")
    places = [p for r in jaccard.cells(signed, 4).collect() for p in r["places"]]
    assert any(p["cell"].endswith("b") for p in places)


def test_empty_table(spark):
    assert jaccard.classes(documents(spark, [])).count() == 0


def test_bands_reach_the_recall():
    b = jaccard.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**jaccard.ROWS) ** b >= 0.999 > 1 - (1 - 0.8**jaccard.ROWS) ** (b - 1)
