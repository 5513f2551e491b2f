"""Main text of pages with known articles."""

from __future__ import annotations

import re
import time
from html.parser import HTMLParser

import pytest

from granary.llm import html_text, registry

ARTICLE = "The river rose in the night and the people of the town went up to the hills with what they could carry, while the water took the bridge and the mill and all of the lower street."
SECOND = "In the morning they came back and found that the school and the church were still there, and so they began to clear the mud from the houses that could be saved by their owners."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words", ""),
        (f"<article><h1>Flood</h1><p>{ARTICLE}</p><p>Short end.</p></article>", f"Flood\n{ARTICLE}\nShort end."),
        (f"<nav><a href=/>Home</a></nav><main><p>{ARTICLE}</main><footer>© All rights reserved</footer>", ARTICLE),
        (f"<body><div class='sidebar'><p>{SECOND}</p></div><article><p>{ARTICLE}</p></article><div id=comments><p>{SECOND}</p></div></body>", ARTICLE),
        (f"<article><p>Fish &amp; chips &#233;t&eacute; {ARTICLE}</p><script>var a = '<p>{SECOND}</p>';</script></article>", f"Fish & chips été {ARTICLE}"),
        (f"<div><p>{ARTICLE}</p><p>{SECOND}</p></div>", f"{ARTICLE}\n{SECOND}"),
        (f"<article><p>a\n\t b&nbsp; c</p><p>{ARTICLE}", f"a b c\n{ARTICLE}"),
        ("<" * 1000, ""),
    ],
)
def test_pages(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><div class='overflow-hidden' style='overflow:hidden' aria-hidden='false'><p>{ARTICLE}</p></div></article>", ARTICLE),
        (f"<article><p>{ARTICLE}</p><p hidden>{SECOND}</p><p aria-hidden=true>{SECOND}</p><p style='color:red; display: none'>{SECOND}</p></article>", ARTICLE),
        (f"<div class='page no-sidebar'><p>{ARTICLE}</p><p>{SECOND}</p></div>", f"{ARTICLE}\n{SECOND}"),
        (f"<article><div class='with-comments'><p>{ARTICLE}</p></div></article>", ARTICLE),
        (f"<article><div class='elementor-widget'><p>{ARTICLE}</p></div></article>", ARTICLE),
        (f"<div class='sidebar-right'><div class='sidebar'><p>{SECOND[:100]}</p></div><p>{ARTICLE}</p><p>{SECOND}</p></div>", f"{ARTICLE}\n{SECOND}"),
        (f"<div class=search><p>{ARTICLE}</p><div class=comments><p>{SECOND}</p><p>{SECOND}</p><p>{SECOND}</p></div></div>", ARTICLE),
        (f"<article><p>{ARTICLE}</p></article><div class='cookie-banner'><p>{SECOND}</p><p>{SECOND}</p></div><div class='related-posts'><p>{SECOND}</p></div>", ARTICLE),
        (f"<p>{ARTICLE}</p><div class='site-footer'><p>{SECOND[:120]}</p></div><div class='comments-area'><p>{SECOND}</p><p>{SECOND}</p></div>", ARTICLE),
        (f"<article><p>{ARTICLE[:90]}<span class=share>Share</span>{ARTICLE[90:]}</p></article>", ARTICLE),
        (f"<div class=ad>{SECOND}</div><article><p>Word | word | word | word | word | word | word | word | word | word | word | word</p></article>", "Word | word | word | word | word | word | word | word | word | word | word | word"),
        (f"<div class=ad><a href=x>Buy<article><p>{ARTICLE}</p></article>", ARTICLE),
    ],
)
def test_names_and_hidden_attributes(html, text):
    assert html_text.main_text(html) == text


P350 = " ".join([ARTICLE, SECOND])


@pytest.mark.parametrize("wrap", ["<div class='overflow-hidden'>{}</div>", "<div aria-hidden='false'>{}</div>", "<div class='content has-sidebar'>{}</div>", "<div class='post comments-open'>{}</div>", "<a href='/hidden/'>x</a><p>{}", "<article><div class='overflow-hidden'>{}</div></article>", "<article><section class='market-share'>{}</section></article>", "<form action='/page'><div>{}</div></form>", "<p title='it's fine'>{}</p>", "<p title=\"x>{}</p>", "<script>var a = 1;<p>{}</p>", "<svg><path d='M0'><p>{}</p>"])
def test_wrappers_and_broken_tags_keep_text(wrap):
    assert html_text.main_text(wrap.replace("{}", P350)) == P350


def test_left_out_links_end_where_they_end():
    assert html_text.main_text(f"<a class='skip-link' href='#m'>Skip</a><article><p>{ARTICLE}</p><p>{SECOND}</p></article>") == f"{ARTICLE}\n{SECOND}"
    assert html_text.main_text(f"<div><p>{P350}</p><a class='share' href='/s'>Share</a><p>{P350}</p></div>") == f"{P350}\n{P350}"


def test_stop_words_length_and_neighbours_decide():
    few = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 2
    few = few.strip()
    assert html_text.main_text(f"<div><p>{P350}</p><p>{few}</p></div>") == P350  # no stop words outside of an article
    assert html_text.main_text(f"<article><p>{P350}</p><p>{few}</p></article>") == f"{P350}\n{few}"  # open in an article, near a good one
    assert html_text.main_text(f"<div><p>{P350}</p><p>Short one.</p><p>{few}</p><p>Another.</p></div>") == f"{P350}\nShort one."
    assert html_text.main_text("<p>" + "川の水が夜に増えて町の人々は丘へ登った。" * 12 + "</p>") != ""
    linked = f"<p><a href='/x'>{P350}</a></p>"
    assert html_text.main_text(f"<div><p>{P350}</p>{linked}</div>") == P350


class Plain(HTMLParser):
    """Blocks of well-nested pages: [text, linked characters, in an article, marked]."""

    BREAKS = {"p", "div", "li", "ul", "h1", "nav", "footer", "article", "main", "body", "html", "head", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now = [], [], ["", "", False, False, False]

    def cut(self):
        if self.now[0].strip():
            self.blocks.append(self.now)
        self.now = ["", "", False, False, False]

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.cut()
        if tag == "br":
            self.now[0] += " "
        elif tag != "meta":
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.cut()
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if {"head", "script", "style"} & set(tags):
            return
        self.now[0] += data
        if data.strip():
            self.now[1] += data * ("a" in tags)
            self.now[2] |= bool({"article", "main"} & set(tags))
            self.now[4] |= "h1" in tags
            self.now[3] |= bool({"nav", "footer"} & set(tags)) or "ad" in [c for _, c in self.open]


def plain_two_passes(html: str) -> str:
    """The docstring's rules, each neighbour searched for."""
    parser = Plain()
    parser.feed(html)
    parser.cut()
    found = [(" ".join(t.split()), len("".join(a.split())), inside and not marked, marked, head) for t, a, inside, marked, head in parser.blocks]

    def first(text, linked, inside, marked, head):
        words = re.findall(r"\w+", text.lower())
        stops = sum(w in html_text.STOP_WORDS for w in words) / max(1, len(words))
        if marked or linked > 0.5 * len(text.replace(" ", "")):
            return "bad"
        if len(text) < 70:
            return "bad" if linked and not inside else "short"
        if not inside and "©" in text:
            return "bad"
        if (stops >= 0.12 and len(text) >= 200) or (inside and stops >= 0.06):
            return "good"
        return "near" if inside or stops >= 0.06 else "bad"

    label = [first(*b) for b in found]
    if "good" not in label:
        return "\n".join(b[0] for b, x in zip(found, label, strict=True) if x != "bad" and (b[2] if any(c[2] for c in found) else x == "near"))
    out = []
    for i, b in enumerate(found):
        verdict = label[i]
        if verdict in ("short", "near"):
            for same in (True, False):
                sides = []
                for way in (-1, 1):
                    near = [(abs(j - i) + 2 * found[j][3], abs(j - i), label[j]) for j in range(len(found)) if (j - i) * way > 0 and label[j] in ("good", "bad") and (found[j][2] == b[2]) == same]
                    sides += [min(near)] if near else []
                if sides:
                    break
            if b[4] and any(found_after := [x for x in sides[-1:] if way == 1 and near]):
                sides = found_after
            verdict = ("good" if any(x[2] == "good" for x in sides) else "bad") if verdict == "near" else min(sides, key=lambda x: x[0])[2]
        if verdict == "good":
            out.append(b[0])
    return "\n".join(out)


def test_equals_plain_two_passes(spark, medium):
    """Also where the article tags, or these and all class names, are taken away; then hardly any text may change."""
    pages = [r["html"] for r in spark.read.parquet(f"{medium}/pages.parquet").collect()]
    same = whole = 0
    for html in pages:
        want = plain_two_passes(html)
        assert html_text.main_text(html) == want
        bare = re.sub(r"</?(?:article|main)>", "", html)
        assert html_text.main_text(bare) == plain_two_passes(bare)
        same += html_text.main_text(bare) == want
        whole += len(html_text.main_text(bare)) >= 0.9 * len(want)
    assert same >= 0.75 * len(pages) and whole >= 0.9 * len(pages), (same, whole, len(pages))


def test_large_pages_are_linear():
    page = f"<div><p>{P350}</p></div>" * 8_000
    for html in ("</b>" * 20_000, "<div>" + "</p>" * 20_000, '<a b="c' * 20_000, "<div class=nav>" * 20_000, "<a>" * 20_000, "<script>" * 20_000, "<i>" * 10_000 + "</b>" * 10_000, "<p class='a" * 20_000, "<!--" * 20_000, "<" * 20_000):
        began = time.perf_counter()
        html_text.main_text(html)
        assert time.perf_counter() - began < 0.5, html[:20]
    assert len(html_text.main_text(page)) == 8_000 * (len(P350) + 1) - 1


def test_repeated_pages_and_clashing_columns(spark):
    rows = [(1, "u", f"<p>{P350}</p>")] * 3 + [(2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars", "'z' as `a.b`")
    got = pages.withColumn("main", html_text.extract(pages["html"])).orderBy("page_id").collect()
    assert [r["main"] for r in got] == [P350] * 3 + [""] and got[0]["text"] == "x"


def test_long_broken_markup_is_linear():
    assert html_text.main_text("<p" + " a='" * 20_000) == ""
    assert html_text.main_text("<div>" * 20_000 + ARTICLE) in ("", ARTICLE)


def test_query(spark, small):
    rows = registry.op2_html_extraction(spark, small).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == html_text.main_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])
    assert sum(r["n_chars"] > 0 for r in rows) > 0.8 * len(rows)


def test_extra_columns_and_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert pages.withColumn("main", html_text.extract(pages["html"])).count() == 0
