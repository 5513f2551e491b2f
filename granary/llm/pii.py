"""Personal data by fixed patterns and a semi-Markov conditional random field.

Patterns find the base spans.  The model looks at the stretches of a text that
could hold personal data (runs of digits and separators, words around an at
sign), cut into units, and scores whole candidate segments of up to MAX_UNITS
units as email, ip, card, phone or nothing.  Dynamic programming chooses
boundaries and types of a stretch jointly, in time linear in its length.  Spans
of the model that overlap no base span are added; base spans always stay.

The weights are trained here, by gradient ascent on the conditional likelihood
(forward-backward over segmentations) of generated examples: entities in the
forms people write them and number sequences that are none.  No corpus row is
used, so the model is the same at every size.

Finding is map-only in an Arrow UDF.  All scans are linear in the text, however
long.  Defined results: a null text is an empty text and has no spans; repeated
rows get equal answers; extra columns are kept.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from granary.sources.tables import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each at sign outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    out = emails(text)
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# ---- stretches and candidate segments

NUMBERS = re.compile(r"[+(]?[0-9](?:[0-9().\x20-]*[0-9])?")
AT_WORDS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@| ?[(\[{]at[)\]}] ?)[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]{1,63}){0,6}")
UNIT = {"number": re.compile(r"[+(]{0,2}[0-9]+"), "at": re.compile(r"[A-Za-z0-9%+_-]+")}
HINT = {
    "phone": re.compile(r"(?:phone|tel|call|mobile|cell|fax|dial|whatsapp|téléphone|telefon|handy|anruf|teléfono|llam|móvil|appel)[^\n]{0,16}$", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|pan)[^\n]{0,16}$", re.I),
    "ip": re.compile(r"(?:\bip|address|host|server|adresse|dirección|from)[^\n]{0,16}$", re.I),
    "email": re.compile(r"(?:mail|contact|write|écri|correo|schreib)[^\n]{0,16}$", re.I),
}
#: A segment has at most this many units; stretches with fewer digits than this hold at most an ip.
MAX_UNITS, LEAST_DIGITS = 8, 7


def stretches(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(sort, units) of each part of a text that is worth a look."""
    out = []
    if "@" in text or "at]" in text or "at)" in text or "at}" in text:
        out += [("at", [u.span() for u in UNIT["at"].finditer(text, *m.span())]) for m in AT_WORDS.finditer(text)]
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            if m.end() - m.start() >= LEAST_DIGITS:
                units = [u.span() for u in UNIT["number"].finditer(text, *m.span())]
                if len(digits_of(m[0])) >= LEAST_DIGITS or len(units) >= 4:
                    out.append(("number", units))
    return out


def span_features(sort: str, text: str, units: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Names of the features that hold for the segment of units i to j."""
    start, end = units[i][0], units[j - 1][1]
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 1]
    glued = before[-1:].isalnum() or after.isalnum() or (after in "@_" and after != "")
    if sort == "at":
        at = "@" in span or re.search(r"[(\[{]at[)\]}]", span) is not None
        labels = [text[a:b] for a, b in units[i:j]]
        return [f"at={at}", f"dotted={at and ('.' in span.rpartition('@')[2] or 'dot' in labels)}", f"whole={i == 0 and j == len(units)}", f"top={labels[-1].isalpha() and 2 <= len(labels[-1]) <= 12}", f"glued={glued}", f"hint={bool(HINT['email'].search(before))}"]
    groups = [digits_of(text[a:b]) for a, b in units[i:j]]
    digits = "".join(groups)
    n = len(digits)
    gaps = {text[units[k][1] : units[k + 1][0]] + text[units[k + 1][0] : units[k + 1][1]].rstrip("0123456789") for k in range(i, j - 1)}
    gap = "none" if not gaps else next(iter(gaps)) if len(gaps) == 1 and len(next(iter(gaps))) == 1 else "round" if any("(" in g or ")" in g for g in gaps) or "(" in span else "mixed"
    shape = "-".join(str(len(g)) for g in groups) if len(groups) <= 5 else "many"
    quad = len(groups) == 4 and gaps == {"."} and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    size = next(name for top, name in ((6, "few"), (7, "7"), (9, "8-9"), (10, "10"), (12, "11-12"), (15, "13-15"), (19, "16-19"), (10**9, "more")) if n <= top)
    out = [f"size={size}", f"gap={gap}", f"size&gap={size}{gap}", f"units={min(len(groups), 6)}", f"quad={quad}", f"luhn={n >= 12 and luhn(digits)}", f"luhn&size={n >= 12 and luhn(digits)}{size}", f"plus={'+' in span}", f"glued={glued}", f"longest={min(6, max(map(len, groups)))}", f"shape={shape}", f"edge={i == 0}{j == len(units)}"]
    out += [f"hint={k}" for k in ("phone", "card", "ip") if HINT[k].search(before)]
    out += ["money"] * (before.rstrip()[-1:] in ("$", "€", "£", "#", "₹") or after in ("%", "€", "$"))
    return out


LABELS = {"at": ("email",), "number": ("ip", "card", "phone")}


def segments(sort: str, text: str, units: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
    """For each end j: (start i, features) of the candidate segments that end there."""
    out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(units) + 1)]
    for j in range(1, len(units) + 1):
        digits = 0
        for i in range(j - 1, max(-1, j - 1 - MAX_UNITS), -1):
            digits += units[i][1] - units[i][0]
            if sort == "at" or (digits >= LEAST_DIGITS or j - i == 4) and digits <= 32:
                out[j].append((i, span_features(sort, text, units, i, j)))
    return out


Weights = dict[str, dict[str, float]]


def decode(sort: str, text: str, units: list[tuple[int, int]], weights: Weights) -> list[Span]:
    """Best segmentation of a stretch: a unit outside of every entity scores 0."""
    best, back = [0.0], [(0, "")]
    for j, ending in enumerate(segments(sort, text, units)[1:], 1):
        top = (best[j - 1], j - 1, "")
        for i, features in ending:
            for label in LABELS[sort]:
                w = weights[label]
                score = best[i] + w["bias"] + sum(w.get(f, 0.0) for f in features)
                if score > top[0]:
                    top = (score, i, label)
        best.append(top[0])
        back.append(top[1:])
    out, j = [], len(units)
    while j:
        i, label = back[j]
        if label:
            start, end = units[i][0], units[j - 1][1]
            out.append((label, start, end))
        j = i
    return out[::-1]


# ---- training


def examples(seed: int = 7, n: int = 700) -> list[tuple[str, list[Span]]]:
    """Generated texts with their spans."""
    draw = random.Random(seed)
    number = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    word = lambda: "".join(draw.choice("abcdefghilmnorstu") for _ in range(draw.randint(3, 8)))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        country = draw.choice(["+1 ", "+44 ", "+49 ", "+33 ", "", "", "", "1-", "0"])
        return country + draw.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"{number(2)} {number(2)} {number(2)} {number(2)}" if country.startswith("+3") else f"{a}-{b}-{c}", f"{number(4)} {number(6)}" if country.startswith("+4") else f"({a}){b}-{c}"])

    def card() -> str:
        body = number(15)
        digits = next(body + d for d in "0123456789" if luhn(body + d))
        return draw.choice([" ", "-", "", "."]).join(digits[i : i + 4] for i in range(0, 16, 4))

    def ip() -> str:
        return ".".join(str(draw.randint(0, 255)) for _ in range(4))

    def email() -> str:
        at, dot = draw.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", ".")])
        return draw.choice([word(), f"{word()}.{word()}", word() + number(2)]) + at + word() + dot + draw.choice(["com", "org", "net", "example", "co.uk" if dot == "." else "de"])

    def other() -> str:
        year = str(draw.randint(1900, 2030))
        return draw.choice([
            f"{year}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.{year}", number(draw.randint(7, 14)), number(20), f"{number(1)}.{number(6)}", f"{number(2)} {number(3)} {number(3)}", f"{number(3)} {number(3)} {number(3)} {number(3)}",
            f"{number(1)}.{number(2)}.{number(1)}.{number(4)}", f"{year} {year}", f"{year}-{year}", " ".join(number(draw.randint(1, 3)) for _ in range(draw.randint(4, 12))), f"{number(5)}-{number(5)}", ".".join(number(draw.randint(1, 2)) for _ in range(5)),
            f"300.{number(3)}.{number(2)}.999", "-".join([number(4)] * 2), f"{number(3)}-{number(2)}-{number(4)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{word()}@{word()}", f"@{word()}", "1" + "0" * 15, " ".join(number(4) for _ in range(6)),
        ])

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    lead = {"email": ["mail ", "contact: ", ""], "ip": ["ip ", "host ", ""], "card": ["card ", "visa: ", ""], "phone": ["call ", "tel: ", "phone ", ""]}
    out = []
    for _ in range(n):
        text, spans = word() + " ", []
        for _ in range(draw.randint(1, 2)):
            kind = draw.choice([*KINDS, "", "", ""])
            if kind:
                text += draw.choice(lead[kind])
                value = make[kind]()
                if value:
                    spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += draw.choice(["", "no. ", "$", "order ", "since "]) + other()
            text += f" {word()} "
        out.append((text, spans))
    return out


def train(seed: int = 7, epochs: int = 6, rate: float = 0.25, decay: float = 1e-3) -> Weights:
    """Weights that make the examples' segmentations likely: AdaGrad on the regularised likelihood."""
    ready = []
    for text, spans in examples(seed):
        for sort, units in stretches(text):
            gold = {(next((k for k, u in enumerate(units) if u[0] == s), -1), next((k + 1 for k, u in enumerate(units) if u[1] == e), -1)): kind for kind, s, e in spans}
            ready.append((sort, segments(sort, text, units), len(units), {k: v for k, v in gold.items() if min(k) >= 0 and v in LABELS[sort]}))
    weights: Weights = {k: {"bias": -1.0} for k in KINDS}
    squares: Weights = {k: {} for k in KINDS}
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(ready)
        for sort, candidates, n, gold in ready:
            scored = [(i, j, label, f, weights[label]["bias"] + sum(weights[label].get(x, 0.0) for x in f)) for j in range(1, n + 1) for i, f in candidates[j] for label in LABELS[sort]]
            if not scored:
                continue
            ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
            by_end: dict[int, list] = {}
            by_start: dict[int, list] = {}
            for s in scored:
                by_end.setdefault(s[1], []).append(s)
                by_start.setdefault(s[0], []).append(s)
            for j in range(1, n + 1):
                ahead[j] = float(np.logaddexp.reduce([ahead[j - 1], *(ahead[s[0]] + s[4] for s in by_end.get(j, ()))]))
            for i in range(n - 1, -1, -1):
                behind[i] = float(np.logaddexp.reduce([behind[i + 1], *(behind[s[1]] + s[4] for s in by_start.get(i, ()))]))
            for i, j, label, features, score in scored:
                slope = (gold.get((i, j)) == label) - math.exp(min(0.0, ahead[i] + score + behind[j] - ahead[n]))
                if abs(slope) < 1e-4:
                    continue
                w, q = weights[label], squares[label]
                for x in ("bias", *features):
                    g = slope - decay * w.get(x, 0.0)
                    q[x] = q.get(x, 0.0) + g * g
                    w[x] = w.get(x, 0.0) + rate * g / math.sqrt(q[x] + 1e-8)
    return weights


# ---- use


def found_spans(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the model adds)."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added, k = [], 0
    decoded = sorted((span for sort, units in stretches(text) for span in decode(sort, text, units, weights)), key=lambda x: x[1:])
    reach = 0  # the farthest end of base spans that begin before the span at hand
    for span in decoded:
        while k < len(taken) and taken[k][0] <= span[1]:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= span[1] and not (k < len(taken) and taken[k][0] < span[2]):
            added.append(span)
    return base, added


def listed(spans: list[Span]) -> str:
    """kind:start:end, by kind and start, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def find(spark: SparkSession, text: Column, weights: Weights | None = None) -> Column:
    """Struct of base_spans, all_spans (strings as by ``listed``), n_<kind> of the base spans, and redacted_text."""
    small_batches(spark)
    model = spark.sparkContext.broadcast(weights or train())

    @F.arrow_udf("struct<base_spans string, all_spans string, n_email long, n_ip long, n_card long, n_phone long, redacted_text string>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            text = text or ""
            base, added = found_spans(text, model.value)
            kinds = [k for k, _, _ in base]
            rows.append((listed(base), listed(base + added), *(kinds.count(k) for k in KINDS), redacted(text, base + added)))
        types = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["base_spans", "all_spans", *(f"n_{k}" for k in KINDS), "redacted_text"])

    return run(text)
