"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags, and the blocks are classified twice:

1. Link density, length and stop-word density decide a block as good or bad, or
   leave a short or in-between one open.  Markup is a feature of this step: in an
   article or main element fewer stop words do, and prose needn't be long; text
   of a marked element (a menu, header, footer, sidebar, form, notice, advert or
   reader comments, by tag, role or class name) is bad.  A mark doesn't count if
   its element holds most of the page's dense text: then it is a wrapper.
2. An open block takes the label of its nearest decided neighbours: good if
   either side's is good for one of medium length, or the nearer one's (ties:
   the one before) for a short one, the one behind for a heading.  Neighbours on the same side of an article's
   edge come first, and a marked block is MARK_DISTANCE places farther away than it stands.
   Without any good block, open blocks are good exactly if they stand in an
   article or main element, or, without one, if they are of medium length.

Scripts, styles, hidden elements and controls hold no text.  The work is one pass
over each page inside an Arrow UDF, in time linear in its length: no shuffle, and
the memory of one batch.  Stop words are those of four languages; where letters
are mostly of other scripts, length and links decide alone.

Defined results: a null or empty html, or one without main text, gives an empty
text; broken and truncated markup is read as far as it goes: an unclosed element
ends where its parent ends, quotes count only after an equals sign, one that
nothing closes ends with its tag, and an unclosed script ends at the next
block-level tag.  Equal pages get equal texts; columns of the input are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words of four languages.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his if in is it its not of on or she that the their there they this to was we were which who will with you "
    "à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas plus pour qu que qui sa se ses son sur un une vous y "
    "aber als am auch auf aus bei bin bis das dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war wie wir wird zu zum zur "
    "al como con del el ella ellos era es esta este ha la las lo los más me mi muy no nos o para pero por que se sin sobre son su sus también te un una y ya".split()
)
# Elements whose content is no markup, other elements without text, marked elements, elements that break a block, headings, elements without an end tag.
RAW = frozenset("script style noscript textarea title iframe".split())
LEFT_OUT = RAW | frozenset("head template svg math object select canvas audio video button label option".split())
MARKED = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Names (class, id, role) of what surrounds an article: page furniture, and prose of others.
FURNITURE = re.compile(r"banner|breadcrumbs?|complementary|contentinfo|footer|login|masthead|menu|modal|navbar|navigation|nav|notice|notification|overlay|pager|pagination|popup|search|share|sharing|sidebar|signup|social|subscribe|toc|toolbar")
FOREIGN = re.compile(r"ad|ads|adv|advert\w*|adsense|comments?|commentlist|consent|cookies?|disqus|gdpr|newsletter|promo\w*|recommended|related|replies|reply|respond|sponsor\w*")
# Whole names of furniture, and first and last parts of names that tell a state of the page ("no-sidebar", "comments-open").
WHOLE = frozenset(("site-header", "skip-link"))
STATE_FIRST = frozenset("no not non has have with without is show hide enable disable".split())
STATE_LAST = frozenset("open opened closed free on off active inactive enabled disabled none".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?![\s>])([\"']|[^\s>]+))?")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
NEXT_BLOCK = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS, key=len, reverse=True)) + r")(?=[\s/>])", re.I)
OTHER_SCRIPT, LETTER = re.compile(r"[^\W\d_\x00-\u024f]"), re.compile(r"[^\W\d_]")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
WORD = re.compile(r"\w+")

#: Code points of a short and of a long block; shares of stop words and of linked characters.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.06, 0.12
LINKS_HIGH = 0.5
#: Places that a marked block is farther away than it stands.
MARK_DISTANCE = 2

GOOD, BAD, SHORT_OPEN, NEAR = "good", "bad", "short", "near"


@dataclass
class Mark:
    """A marked element, the one around it, and whether it or one around it holds prose of others."""

    parent: Mark | None
    foreign: bool
    dense: int = 0
    left_out: bool = True


@dataclass
class Block:
    """A block: parts (text, whether linked, innermost mark), and markup."""

    parts: list[tuple[str, bool, Mark | None]] = field(default_factory=list)
    in_article: bool = False
    heading: bool = False
    whole: Text | None = None


@dataclass
class Text:
    """What pass 1 sees of a block."""

    text: str
    linked: int
    in_article: bool
    heading: bool = False
    marked: bool = False
    label: str = ""


def tag_rest(html: str, at: int, quotes_end: dict[str, int]) -> tuple[dict[str, str], int]:
    """(attributes, end) of the tag whose name ends at a position; the first attribute of a name counts."""
    own: dict[str, str] = {}
    while True:
        found = ATTRIBUTE.match(html, at)
        if not found:
            end = html.find(">", at)
            return own, end + 1 if end >= 0 else len(html)
        key, value, at = found[1].lower(), found[2] or "", found.end()
        if value in ("'", '"') and value:
            if quotes_end.get(value, len(html)) <= at:  # known: none behind this place
                close = -1
            else:
                close = html.find(value, at)
            if close < 0:
                quotes_end[value] = min(at, quotes_end.get(value, at))
                end = html.find(">", at)
                return own, end + 1 if end >= 0 else len(html)
            value, at = html[at:close], close + 1
        own.setdefault(key, value.lower())


def is_hidden(found: dict[str, str]) -> bool:
    """Whether a tag's attributes hide the element."""
    return "hidden" in found or found.get("aria-hidden", "").strip() == "true" or bool(NO_DISPLAY.search(found.get("style", "")))


def names_mark(found: dict[str, str]) -> re.Pattern | None:
    """What a tag's names say it is, by whole names or their first or last part; FURNITURE, FOREIGN or None."""
    for name in " ".join(found.get(x, "") for x in ("class", "id", "role")).split():
        parts = [x for x in re.split("[-_]+", name.split("--")[0]) if x]
        if not parts or parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
            continue
        if "-".join(parts) in WHOLE:
            return FURNITURE
        for kind in (FOREIGN, FURNITURE):
            if kind.fullmatch(parts[0]) or kind.fullmatch(parts[-1]):
                return kind
    return None


def read(html: str) -> tuple[list[Block], list[Mark]]:
    """Blocks of a page with all text that can be seen, and the marked elements, outer ones first."""
    out: list[Block] = []
    marks: list[Mark] = []
    current = Block()
    stack: list[tuple[str, Mark | None]] = []  # open elements with the innermost mark
    open_names: dict[str, int] = {}
    quotes_end: dict[str, int] = {}
    unclosed: set[str] = set()  # raw elements that no end tag follows any more
    skip_at = link_at = -1  # depths of the element without text and of the link that are open
    breaks = 0
    at, n = 0, len(html)

    def in_article() -> bool:
        return bool(open_names.get("article") or open_names.get("main"))

    def close(heading: bool = False) -> None:
        nonlocal current
        if any(not p[0].isspace() for p in current.parts):
            out.append(current)
        current = Block(heading=heading)

    def add(text: str) -> None:
        nonlocal breaks
        if skip_at < 0 and text:
            if not text.isspace():
                breaks = 0
                current.in_article = current.in_article or in_article()
            current.parts.append((text, link_at >= 0, stack[-1][1] if stack else None))

    def pop() -> str:
        nonlocal skip_at, link_at
        name = stack.pop()[0]
        open_names[name] -= 1
        if skip_at == len(stack):
            skip_at = -1
        if link_at == len(stack):
            link_at = -1
        return name

    while at < n:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        add(html[at:start])
        following = html[start + 1 : start + 2]
        if following in ("!", "?"):
            for opening, ending in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if html.startswith(opening, start):
                    end = html.find(ending, start + len(opening) - (opening == "<!--") * 2)
                    at = end + len(ending) if end >= 0 else n
                    break
            continue
        ending = following == "/"
        named = NAME.match(html, start + 1 + ending)
        if not named:
            if not ending or start + 2 >= n:
                add("<")
                at = start + 1
            else:  # browsers read "</" without a name as a comment
                end = html.find(">", start)
                at = end + 1 if end >= 0 else n
            continue
        name, at = named[0].lower(), named.end()
        if html.startswith(">", at):
            own, at = {}, at + 1
        else:
            own, at = tag_rest(html, at, quotes_end)
        if name in RAW and not ending:
            end = None if name in unclosed else RAW_END[name].search(html, at)
            if not end:
                unclosed.add(name)
                end = NEXT_BLOCK.search(html, at)
                at = end.start() if end else n
            else:
                at = tag_rest(html, end.end(), quotes_end)[1]
            add(" ")
            continue
        if name == "br":
            if skip_at < 0:
                breaks += 1
                close(current.heading) if breaks == 2 else add(" ")
            continue
        if name in BLOCKS and skip_at >= 0 and not ending and stack[skip_at][0] in ("svg", "math"):
            while skip_at >= 0:  # drawings and formulas hold no blocks
                pop()
        if name in BLOCKS and skip_at < 0:
            close(name in HEADINGS and not ending)
        if name in VOID:
            continue
        if ending:
            if open_names.get(name):
                while pop() != name:
                    pass
            continue
        if name in ("article", "main") and not in_article():
            # what is left out or marked hasn't been closed
            depth = next((i for i, x in enumerate(stack) if x[1] or i == skip_at), None)
            while depth is not None and len(stack) > depth:
                pop()
            close()
        if name == "a":
            if link_at >= 0:  # a link ends where the next begins
                stack[link_at] = ("", stack[link_at][1])
                open_names["a"] -= 1
                open_names[""] = open_names.get("", 0) + 1
            link_at = len(stack)
        inside = stack[-1][1] if stack else None
        if skip_at < 0 and name not in ("html", "body", "article", "main"):
            kind = names_mark(own) if own else None
            if name in LEFT_OUT or own and is_hidden(own):
                skip_at = len(stack)
            elif kind or name in MARKED:
                inside = Mark(inside, kind is FOREIGN or inside is not None and inside.foreign)
                marks.append(inside)
        stack.append((name, inside))
        open_names[name] = open_names.get(name, 0) + 1
    close()
    return out, marks


def seen(block: Block, marked: bool | None) -> Text:
    """Text of a block's parts: those whose marks count (True) or don't (False), or all (None)."""
    parts = [p for p in block.parts if marked is None or (p[2] is not None and p[2].left_out) == marked]
    text = " ".join(unescape("".join(p[0] for p in parts)).split())
    return Text(text, len("".join(unescape("".join(p[0] for p in parts if p[1])).split())), block.in_article, block.heading)


def weigh(found: list[Block], marks: list[Mark]) -> None:
    """Lift the marks of elements that hold more than half of the dense text.

    Dense text in articles counts if there is any, else that of the page; prose
    of others (comments, consent, adverts) counts only if there is no other and no
    article, and then weighs against all text of the page.
    """
    of = lambda block: next((p[2] for p in block.parts if not p[0].isspace()), None)
    foreign = lambda block: (m := of(block)) is not None and m.foreign
    for b in found:
        b.whole = seen(b, None)
        b.whole.label = first_label(b.whole)
    dense = [b for b in found if b.whole.label in (GOOD, NEAR)]
    own = [b for b in dense if not foreign(b)]
    if not own and not any(b.in_article and not foreign(b) for b in found):
        own = dense
    scope = [b for b in own if b.in_article] or own
    for b in scope:
        for text, _, m in b.parts:
            if m is not None:
                m.dense += len(text)
    total = sum(len(p[0]) for b in (found if any(map(foreign, scope)) else scope) for p in b.parts)
    for m in reversed(marks):
        if m.parent is not None:
            m.parent.dense += m.dense
    for m in marks:
        m.left_out = 2 * m.dense <= total or m.parent is not None and m.parent.left_out


def blocks(html: str) -> list[Text]:
    """The blocks of a page as pass 1 sees them; those that only marked elements fill are marked."""
    found, marks = read(html)
    if marks:
        weigh(found, marks)
    out = []
    for block in found:
        own = block.whole if block.whole and not any(p[2] for p in block.parts) else seen(block, False)
        if not own.text:
            own = seen(block, True)
            own.marked, own.in_article = True, False
        if own.text:
            out.append(own)
    return out


def stop_share(text: str) -> float:
    """Share of stop words; the high limit where letters are mostly of other scripts."""
    words = WORD.findall(text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if share < STOPS_HIGH and not text.isascii() and 2 * len(OTHER_SCRIPT.findall(text)) > len(LETTER.findall(text)):
        return STOPS_HIGH
    return share


def first_label(block: Text) -> str:
    """Pass 1: a block by itself."""
    size = len(block.text)
    if block.marked:
        return BAD
    if block.linked > LINKS_HIGH * (size - block.text.count(" ")):
        return SHORT_OPEN if block.heading and block.in_article and size < LONG else BAD
    if size < SHORT:
        return BAD if block.linked and not block.in_article else SHORT_OPEN
    if not block.in_article and ("©" in block.text or "all rights reserved" in block.text.lower()):
        return BAD
    stops = stop_share(block.text)
    if stops >= STOPS_HIGH and size >= LONG or block.in_article and stops >= STOPS_LOW:
        return GOOD
    return NEAR if stops >= STOPS_LOW or block.in_article else BAD


def labels(found: list[Text]) -> list[bool]:
    """Pass 2: whether each block belongs to the main text."""
    first = [b.label or first_label(b) for b in found]
    if GOOD not in first:
        articles = any(b.in_article for b in found)
        return [x != BAD and (b.in_article if articles else x == NEAR) for x, b in zip(first, found, strict=True)]
    n = len(first)
    nearest: dict[tuple[bool, int], list[tuple[int, int]]] = {}  # by side of an article's edge and direction: (distance, index)
    for inside in (False, True):
        for step in (1, -1):
            last, out = (1 << 40, -1), [(1 << 40, -1)] * n
            for i in range(n)[::step]:
                out[i] = last = (last[0] + 1, last[1])
                if first[i] in (GOOD, BAD) and found[i].in_article == inside and (own := MARK_DISTANCE * found[i].marked) <= last[0]:
                    last = (own, i)
            nearest[inside, step] = out
    out = []
    for i, (x, b) in enumerate(zip(first, found, strict=True)):
        if x in (GOOD, BAD):
            out.append(x == GOOD)
            continue
        sides = [nearest[b.in_article, step][i] for step in (1, -1)]
        if max(j for _, j in sides) < 0:
            sides = [nearest[not b.in_article, step][i] for step in (1, -1)]
        sides = [(d, j) for d, j in sides if j >= 0]
        if b.heading and sides[-1][1] > i:
            sides = sides[-1:]
        out.append(any(first[j] == GOOD for _, j in sides) if x == NEAR else first[min(sides, key=lambda s: s[0])[1]] == GOOD)
    return out


def main_text(html: str | None) -> str:
    """Main text of a page: its good blocks, one per line."""
    found = blocks(html or "")
    return "\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extract(html: Column) -> Column:
    """Column of main texts."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return run(html)
