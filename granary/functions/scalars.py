"""Scalar functions as Column expressions: names, dates, money, checksums, bounds, classifiers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplication, permutation and inverse tables of the Verhoeff check digit.
VERHOEFF_D = "0123456789 1234067895 2340178956 3401289567 4012395678 5987604321 6598710432 7659821043 8765932104 9876543210".split()
VERHOEFF_P = "0123456789 1576283094 5803796142 8916043527 9453126870 4286573901 2793806415 7046913258".split()
# Keyword rules in the order that they are tried.
MESSAGE_RULES = (
    ("rejection", "reject|denied|declin|repudiat"),
    ("approval", "approv|sanction"),
    ("settlement", "settle|paid|payment"),
    ("query", "query|clarif|please (?:send|provide|submit)|require"),
    ("ack", "received|acknowledg|thank"),
)
# A decimal point may have slipped by these factors, tried in order.
SHIFTS = (10.0, 100.0, 0.1, 0.01)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def plain_name(text: Column) -> Column:
    """Lower case, ASCII letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def unicode_name(text: Column) -> Column:
    """Lower case, letters and digits of any script, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def name_tokens(text: Column, least: int = 3) -> Column:
    """Distinct tokens of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(unicode_name(text), " "), lambda t: F.length(t) >= least))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Shared tokens over those of the smaller set; 0 if either is empty."""
    return token_share_of(name_tokens(a, 1), name_tokens(b, 1))


def token_share_of(x: Column, y: Column) -> Column:
    """``token_set_ratio`` of distinct tokens that are there already."""
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def distinctive(text: Column) -> Column:
    """The longest token, of equals the first."""
    tokens = F.split(plain_name(text), " ")
    return F.aggregate(tokens, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))


def name_distance(a: Column, b: Column) -> Column:
    """Edit distance of the distinctive tokens over the longer one's length; 1 if either is empty."""
    return token_distance(distinctive(a), distinctive(b))


def token_distance(x: Column, y: Column) -> Column:
    """``name_distance`` of distinctive tokens that are there already."""
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) > 0) & (F.length(y) > 0), F.levenshtein(x, y) / longest).otherwise(F.lit(1.0))


def _month_start(year: Column, month: Column) -> Column:
    """First day of a month that exists, else null; make_date isn't reached with what it would reject."""
    ok = year.between(1, 9999) & month.between(1, 12)
    return F.when(ok, F.make_date(F.when(ok, year).otherwise(1), F.when(ok, month).otherwise(1), F.lit(1)))


def _rolled_day(year: Column, month: Column, day: Column) -> Column:
    """Days up to 31; those beyond a month's end roll over."""
    return F.when(day.between(1, 31), F.date_add(_month_start(year, month), F.coalesce(day, F.lit(1)) - 1))


def _day(year: Column, month: Column, day: Column) -> Column:
    """Days that exist."""
    rolled = _rolled_day(year, month, day)
    return F.when(F.month(rolled) == month, rolled)


ISO, NAMED, SLASHED = r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}[ -][A-Za-z]{3}[a-z]*[ ,-]+(?:\d{4}|\d{2})$", r"^\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})$"


def _written_day(text: Column, day: Callable[[Column], Column]) -> Column:
    """``day`` of a struct (form, a, b, c): which of the three forms a text has, and its numbers in order; null for other texts.

    Text, tokens and struct are each the only element of an array, so they are made once however often they are read.
    """

    def tokens(bare: Column) -> Column:
        form = F.when(bare.rlike(ISO), "iso").when(bare.rlike(NAMED), "named").when(bare.rlike(SLASHED), "slashed")
        return F.struct(form.alias("form"), F.split(bare, "[ /.,-]+").alias("t"))

    def parts(x: Column) -> Column:
        number = lambda i: F.get(x["t"], F.lit(i)).try_cast("int")
        month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.get(x["t"], F.lit(1)), 1, 3))), F.lit(0)).cast("int")
        return F.struct(x["form"].alias("form"), number(0).alias("a"), F.when(x["form"] == "named", month).otherwise(number(1)).alias("b"), number(2).alias("c"))

    found = F.filter(F.transform(F.array(F.btrim(text, F.lit(" \t\n\r\x0b\f"))), tokens), lambda x: x["form"].isNotNull())
    return F.get(F.transform(F.transform(found, parts), day), F.lit(0))


def _century(year: Column, pivot: int | None) -> Column:
    if pivot is None:
        return F.when(year < 100, year + 2000).otherwise(year)
    return F.when(year >= 100, year).when(year < pivot, year + 2000).otherwise(year + 1900)


def clinical_day(text: Column) -> Column:
    """A day from ISO, ``DD Mon YYYY`` or ``DD/MM/YYYY``; two-digit years are 20xx; days beyond a month's end roll over."""

    def day(p: Column) -> Column:
        iso = p["form"] == "iso"
        return _rolled_day(F.when(iso, p["a"]).otherwise(_century(p["c"], None)), p["b"], F.when(iso, p["c"]).otherwise(p["a"]))

    return _written_day(text, day)


def strict_day(text: Column) -> Column:
    """As ``clinical_day`` with a pivot of 80 for two-digit years, day and month swapped where only that fits, and real days only."""

    def day(p: Column) -> Column:
        iso, swap = p["form"] == "iso", (p["form"] == "slashed") & (p["b"] > 12) & (p["a"] <= 12)
        return _day(F.when(iso, p["a"]).otherwise(_century(p["c"], 80)), F.when(swap, p["a"]).otherwise(p["b"]), F.when(iso, p["c"]).when(swap, p["b"]).otherwise(p["a"]))

    return _written_day(text, day)


def amount(text: Column) -> Column:
    """A rupee amount without sign words, ``/-`` and commas; null if anything else is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^(?:rs\.?|inr|₹)\s*", ""), r"(?:/-)?\s*$|,", "")
    return F.when(bare.rlike(r"^-?\d+(?:\.\d+)?$"), bare).try_cast("double")


def line_amount(net: Column, gross: Column, quantity: Column, rate: Column) -> Column:
    """The first amount that is there, else quantity times rate."""
    return F.coalesce(net, gross, quantity * rate)


def _verhoeff_pairs() -> list[list[int]]:
    """For each pair of places, the check digit behind it by the one before it and the two digits (10 x 100)."""
    d = lambda a, b: int(VERHOEFF_D[a][b])
    p = lambda i, n: int(VERHOEFF_P[i % 8][n])
    return [[d(d(c, p(i, low)), p(i + 1, high)) for c in range(10) for high in range(10) for low in range(10)] for i in range(0, 12, 2)]


def verhoeff_valid(text: Column) -> Column:
    """Twelve digits with a right check digit, the first neither 0 nor 1; two digits are looked up at once."""
    check = F.lit(0)
    for i, table in enumerate(_verhoeff_pairs()):
        steps = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # a constant
        check = F.get(steps, check * 100 + F.substring(text, 11 - 2 * i, 2).try_cast("int"))
    return F.when(text.rlike(r"^[2-9]\d{11}$"), check == 0).otherwise(F.lit(False))


def hamming_hex(a: Column, b: Column, digits: int) -> Column:
    """Bits that differ between two hex strings, eight digits at a time."""
    part = lambda x, i: F.conv(F.substring(x, i, 8), 16, 10).cast("long")
    return reduce(lambda s, i: s + F.bit_count(part(a, i).bitwiseXOR(part(b, i))), range(1, digits + 1, 8), F.lit(0)).cast("long")


def bounded_value(value: Column, low: float, high: float) -> Column:
    """The value if within bounds, else the first decimal shift of it that is; null if none."""
    fits = lambda v: F.when(v.between(low, high), v)
    return F.coalesce(fits(value), *(fits(value * k) for k in SHIFTS))


def stay_check(days: Column) -> Column:
    """abstain below 0 or above 365 days, warn above 120, else ok."""
    return F.when(days.isNull() | (days < 0) | (days > 365), "abstain").when(days > 120, "warn").otherwise("ok")


def message_class(text: Column) -> Column:
    """The first keyword rule that matches, or ``other``."""
    return reduce(lambda rest, r: F.when(F.lower(text).rlike(r[1]), r[0]).otherwise(rest), reversed(MESSAGE_RULES), F.lit("other"))


def run_cost(pages: Column, calls: Column, unit: float = 2.0, heavy: float = 30.0, light: float = 10.0, safety: float = 1.2) -> Column:
    """Pages, one heavy call and light ones after it, with a margin, rounded up to tens."""
    raw = pages * unit + F.when(calls > 0, heavy + (calls - 1) * light).otherwise(F.lit(0.0))
    return F.ceil(raw * safety / 10) * 10


def completeness_gate(confidence: Column, has_procedure: Column, has_diagnosis: Column, side_conflict: Column) -> Column:
    """At most 0.4 where procedures lack a diagnosis, less 0.1 on a left/right conflict, within 0 and 1."""
    capped = F.when(has_procedure & ~has_diagnosis, F.least(confidence, F.lit(0.4))).otherwise(confidence)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), capped - F.when(side_conflict, 0.1).otherwise(0.0)))


def stable_key(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON in sorted order, whatever order they come in."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
