"""Entities and references in letters, and templates, as Column expressions.

A pattern finds only what can be a fact: the lengths of the groups of digits and the
words that must stand near, at a bounded distance, are part of it; check digits and
calendars then decide.  Work on single rows' arrays, which Spark interprets, is left
to the few tokens found.  All stays in the JVM; a null text gives null, an empty one
empty arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.scalars import let, verhoeff_valid

# Bodies that register doctors, words between a body and its number, words that name the scheme, its members and the health id, words that look like a scheme id.
COUNCILS = ("MPMC", "MCI", "NMC", "MMC", "KMC", "GMC", "TNMC", "DMC", "RMC", "HPMC", "MSMC", "UPMC")
COUNCIL_NAMES = ("MP MEDICAL COUNCIL", "MAHARASHTRA MEDICAL COUNCIL", "KARNATAKA MEDICAL COUNCIL", "DELHI MEDICAL COUNCIL")
REGISTERED, NUMBERED = ("REG", "REGISTRATION"), ("NO", "NUMBER", "#")
SCHEME_WORDS, MEMBER_WORDS, HEALTH_WORDS = ("PMJAY", "AYUSHMAN"), ("BENEFICIARY ID", "BENEFICIARY NO", "BEN ID"), ("ABHA", "HEALTH ID", "PHR ADDRESS")
NOT_SCHEME_IDS = ("PMJAY", "AYUSHMAN", "BHARAT", "BENEFICIARY", "ABPMJAY", "AB", "NUMBER", "CARDNUMBER", "CARD", "ISSUED", "UNDER", "NAME", "SCHEME", "GOVERNMENT", "INDIA")
# Characters around an id in which its word must stand; digits of the ids' printed groups; currency marks before and after a number and the characters within which they stand; years of dates.
SCHEME_WINDOW, HEALTH_WINDOW = 80, 60
NATIONAL_GROUPS, HEALTH_GROUPS = (4, 4, 4), (2, 4, 4, 4)
MARKS_BEFORE, MARKS_AFTER = ("RS", "RS.", "INR", "₹", "RUPEES"), ("/-", "RS", "INR", "RUPEES", "ONLY")
MARK_WINDOW = 12
CENTURIES = r"(?:19\d\d|20\d\d|2100)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Labels of a claim number in the order that they are tried, and its own beginning, which goes before them.
CLAIM_LABELS, CLAIM_START = ("CLAIM#", "CCN:", "CCN#", "CLAIMID:", "CLAIMID#"), "CLM-"
#: Characters before a number in which its label is looked for.
LABEL_WINDOW = 60
# Form of an identifier and of an address token.
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
TOKEN = r"(?i)\+(t[0-9a-f]{12})@"
PLACEHOLDER = re.compile(r"\{\{\s*([\w.\[\]-]+)\s*\}\}")
# Edges of words.
EDGE, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# Digits joined by single blanks or hyphens; possessive, so that no length of it is tried twice or recurses.
RUN = rf"\d++{END}(?:[\s-]\d++{END})*+"
# Nothing; but a pattern that names a character beyond the basic plane counts all of them as one in what it looks back at.
WIDE = "\U0001f600{0}"
# A private character as a mark, and another one that texts have in its place: neither is a letter, digit, blank or punctuation.
MARK, NO_MARK = "\ue000", "\ue001"


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def spoken(words: Sequence[str], blanks: int) -> str:
    """A pattern of upper-case words in any case, the blanks in them as up to ``blanks`` of white space."""
    forms = {" ": rf"\s{{1,{blanks}}}", "I": "[Iiı]", "S": "[Ssſ]"}
    one = lambda w: "".join(forms.get(c, f"[{c}{c.lower()}]" if c.isalpha() else re.escape(c)) for c in w)
    both = lambda p: p.replace("[Ff][Iiı]", "(?:[Ff][Iiı]|ﬁ)").replace("[Ssſ][Ssſ]", "(?:[Ssſ][Ssſ]|ß)")
    return "|".join(both(one(w)) for w in words)


def near(token: str, words: Sequence[str], size: int) -> str:
    """A condition in front of a token: one of the words stands, as a whole, in the ``size`` characters before or behind it.

    Words are letters and a token has edges, so none lies across them.
    """
    said, ends = spoken(words, size), spoken(sorted({w[-2:] for w in words}), size)
    first, last = (f"[{''.join(sorted({w[i] + w[i].lower() for w in words}))}ſıß]" for i in (0, -1))  # tried before all else
    return rf"(?s:(?<={first}(?<=(?={said}).).{{0,{size - 1}}})|(?={token}.{{0,{size - 1}}}?{last}(?<={ends})(?<={said})){WIDE})"


def tokens(text: Column, token: str) -> Column:
    """array<struct<at, token>>: all matches of a pattern without groups, with their places (from 1)."""
    pattern = F.lit(rf"(?s)(.*?)({token}|\z)")  # the end counts as a match, or what follows the last token would be tried again from each of its characters
    found = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("token"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,token:string>>").alias("found"))

    def step(seen: Column, x: Column) -> Column:
        at = seen["next"] + F.length(x["gap"])
        return F.struct((at + F.length(x["token"])).alias("next"), F.array_append(seen["found"], F.struct(at.alias("at"), x["token"].alias("token"))).alias("found"))

    return F.aggregate(F.filter(found, lambda x: x["token"] != ""), start, step, lambda seen: seen["found"])


def before(text: Column, at: Column, size: int) -> Column:
    """At most ``size`` characters in front of a place."""
    return F.substr(text, F.greatest(at - size, F.lit(1)), F.least(at - 1, F.lit(size)))


def names_any(context: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(context, F.lit(w)) for w in words))


def _words(text: Column) -> Column:
    """Upper-case words with single blanks between, # as one of its own; dots inside initials vanish, so U.P.M.C. is one word."""
    joined = F.regexp_replace(F.upper(text), r"\.(?<=(?<![A-Z])[A-Z].)(?=[A-Z](?![A-Z]))", "")
    return F.trim(F.regexp_replace(F.replace(joined, F.lit("#"), F.lit(" # ")), r"[^\p{L}\p{N}#]+", " "))


def registrations(text: Column) -> Column:
    """array<struct<council, number>>: three to seven digits, perhaps behind a letter, that a council or "registration number" introduces; the council is null where none is named.

    A number with a council is not told again without one.
    """
    fillers = "|".join((*REGISTERED, *NUMBERED))
    named = rf"(?:^| )({'|'.join((*COUNCILS, *COUNCIL_NAMES))})(?: (?:{fillers}))*$"
    labelled = rf"(?:^| )(?:{'|'.join(REGISTERED)})(?: (?:{'|'.join(NUMBERED)}))+$"
    last = rf"(?:{spoken(('MC', 'M.C', 'MCI', 'C.I', 'COUNCIL', *REGISTERED, '#'), 1)}|{EDGE}(?:{spoken(NUMBERED, 1)}))"  # how the last word in front can end
    token = r"[A-Za-z]?\d{3,7}"
    introducing = rf"(?=[MCRNmcrn#])(?:{last})[^\p{{L}}\p{{N}}#]{{0,{LABEL_WINDOW - 1}}}+(?<=[\s.:#/-])(?={token}{END})"
    parts = F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(NO_MARK)), introducing, "$0" + MARK), MARK)  # what stands before the first number, then each with what follows it

    def told(number: Column, context: Column) -> Column:
        as_told = lambda words, council: F.when((council != "") | words.rlike(labelled), F.struct(F.when(council != "", council).alias("council"), F.upper(number).alias("number")))
        return let(_words(context), lambda words: let(F.regexp_extract(words, named, 1), lambda council: as_told(words, council)))

    def each(parts: Column) -> Column:
        context = lambda i: F.substring(F.array_join(F.slice(parts, F.greatest(i + 2 - LABEL_WINDOW // 3, F.lit(1)), F.least(i + 1, F.lit(LABEL_WINDOW // 3))), ""), -LABEL_WINDOW, LABEL_WINDOW)  # noqa: E731  a part has three characters at least
        return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda part, i: told(F.regexp_extract(part, f"^{token}", 0), context(i)))

    def once(found: Column) -> Column:
        known = F.transform(F.filter(found, lambda t: t["council"].isNotNull()), lambda t: t["number"])
        return let(known, lambda k: F.filter(found, lambda t: t["council"].isNotNull() | ~F.array_contains(k, t["number"])))

    return only_if(holds_any(text, ("REG", "MC", "M.C", "COUNCIL")) & text.rlike(r"\d{3}"), let(F.array_distinct(F.filter(let(parts, each), lambda t: t.isNotNull())), once))


def merged_groups(groups: Sequence[int]) -> list[list[int]]:
    """All group lengths that arise where some neighbours are written together."""
    shapes = [[groups[0]]]
    for g in groups[1:]:
        shapes = [[*s, g] for s in shapes] + [[*s[:-1], s[-1] + g] for s in shapes]
    return shapes


def grouped_numbers(text: Column, groups: Sequence[int]) -> Column:
    """Digits of the numbers written in these groups, or with some of them together, each once.

    They are read from the left, and digits that were taken once are not taken again.
    """
    shapes = "|".join(r"[\s-]".join(rf"\d{{{n}}}" for n in shape) for shape in merged_groups(groups))
    return F.array_distinct(F.transform(all_of(text, rf"(?=\d){EDGE}(?:{shapes}){END}"), lambda n: F.regexp_replace(n, r"\D", "")))


def only_if(test: Column, found: Column) -> Column:
    """``found`` where a cheap necessary condition holds, else an empty array: most texts have none of these and are not scanned for tokens."""
    return F.when(test, found).otherwise(F.when(test.isNotNull(), F.array()))


def holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of some upper-case words, in any case."""
    return names_any(F.upper(text), words)


def national_ids(text: Column) -> Column:
    """Numbers of three groups of four digits whose check digit is right and whose first is neither 0 nor 1."""
    return F.filter(grouped_numbers(text, NATIONAL_GROUPS), verhoeff_valid)


def health_ids(text: Column) -> Column:
    """Numbers of 2, 4, 4 and 4 digits in a run of digits near a word for the health id."""
    runs = all_of(text, rf"(?=\d){EDGE}(?:(?=(?:\d[\s-]?){{{sum(HEALTH_GROUPS)}}}){near(RUN, HEALTH_WORDS, HEALTH_WINDOW)}({RUN})|{RUN})", 1)
    return only_if(holds_any(text, [w.split()[0] for w in HEALTH_WORDS]) & text.rlike(r"\d"), grouped_numbers(F.array_join(runs, ";"), HEALTH_GROUPS))


def scheme_ids(text: Column) -> Column:
    """Codes of 8 to 12 capitals and digits near the scheme's name, then 12 to 15 digits near it or near a word for its members, unless they are a national id."""
    code, number = rf"[A-Z][A-Z0-9]{{7,11}}+{END}", rf"\d{{12,15}}+{END}"
    within = rf"(?=[A-Z0-9]*(?:{'|'.join(SCHEME_WORDS)}))"
    capital = all_of(text, rf"(?=[A-Z]){EDGE}(?={code})(?!(?:{'|'.join(NOT_SCHEME_IDS)}){END})(?:{within}|{near(code, SCHEME_WORDS, SCHEME_WINDOW)}){code}")
    digits = all_of(text, rf"(?=\d){EDGE}(?={number}){near(number, (*SCHEME_WORDS, *MEMBER_WORDS), SCHEME_WINDOW)}{number}")
    return only_if(holds_any(text, (*SCHEME_WORDS, *(w.split()[0] for w in MEMBER_WORDS))), F.array_distinct(F.concat(capital, F.filter(digits, lambda n: ~verhoeff_valid(n)))))


def mobiles(text: Column) -> Column:
    """Ten-digit mobile numbers in order, without country code, each once."""
    return F.array_distinct(all_of(text, r"(?=[6-9])(?<!\d)(?:91)?([6-9]\d{9})(?!\d)", 1))


def _day(year: Column, month: Column, day: Column) -> Column:
    """ISO date of three strings of digits, null where there is none between 1900 and 2100; two-digit years from 80 on are of the last century."""
    full = F.when(F.length(year) == 2, F.concat(F.when(year < "80", "20").otherwise("19"), year)).otherwise(year)
    return let(F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), lambda t: F.when(t.rlike(rf"^{CENTURIES}-") & t.try_cast("date").isNotNull(), t))


def days(text: Column) -> Column:
    """array<struct<day, form>>: ISO dates in the text, those written year first, then numeric, then with a month's name.

    Forms: ``year_first``, ``day_first``, ``month_first`` (only that fits), ``either``
    (day first is assumed) and ``named``.
    """
    made = lambda day, form: F.struct(day.alias("day"), form.alias("form"))
    part = lambda t, by, i: F.split_part(t, F.lit(by), F.lit(i))

    def numeric(t: Column) -> Column:
        two = lambda i: F.lpad(part(t, ".", i), 2, "0")
        return let(F.struct(two(1).alias("a"), two(2).alias("b"), part(t, ".", 3).alias("y")), of_parts)

    def of_parts(p: Column) -> Column:
        first, second = p["a"] <= "12", p["b"] <= "12"
        day = F.when(second, _day(p["y"], p["b"], p["a"])).when(first, _day(p["y"], p["a"], p["b"]))
        return made(day, F.when(first & second, "either").when(second, "day_first").otherwise("month_first"))

    def named(t: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(t, " ", 2), 1, 3))).cast("string")
        return made(_day(part(t, " ", 3), month, part(t, " ", 1)), F.lit("named"))

    iso = F.transform(F.filter(all_of(text, rf"(?=\d){EDGE}{CENTURIES}-\d\d-\d\d{END}"), lambda t: t.try_cast("date").isNotNull()), lambda t: made(t, F.lit("year_first")))
    numbers = F.transform(all_of(text, rf"(?=\d){EDGE}\d\d?[/.-]\d\d?[/.-]\d{{2,4}}{END}"), lambda t: let(F.translate(t, "/-", ".."), numeric))
    names = F.transform(all_of(text, rf"(?i)(?=\d){EDGE}\d\d?\s+(?:{'|'.join(MONTHS)})[a-z]*\s+\d{{2,4}}{END}"), lambda t: let(F.regexp_replace(t, r"\s+", " "), named))
    return F.array_distinct(F.filter(F.concat(iso, numbers, names), lambda d: d["day"].isNotNull()))


def amounts(text: Column) -> Column:
    """Amounts above zero that a currency mark stands right before, then those that one follows, as numbers, each once."""
    number = r"\d[\d,]*+(?:\.\d{1,2})?+"
    blanks = lambda m: f"\\x20{{0,{MARK_WINDOW - len(m)}}}"
    ahead = "|".join(spoken([m], 1) + blanks(m) for m in MARKS_BEFORE)
    lasts = r"\x20ſ" + "".join(sorted({m[-1] + m[-1].lower() for m in MARKS_BEFORE}))
    behind = "|".join(blanks(m) + spoken([m], 1) for m in MARKS_AFTER)
    marked = lambda pattern: F.array_remove(all_of(text, rf"(?=\d)(?:{pattern}|{number})", 1), "")  # noqa: E731  a number without a mark is read over as a whole
    found = F.concat(marked(rf"(?<=[{lasts}])(?<={ahead})({number})"), marked(rf"(?<![\p{{L}}_])({number})(?={behind})"))
    return F.array_distinct(F.filter(F.transform(found, lambda n: F.replace(n, F.lit(",")).try_cast("double")), lambda v: v > 0))


def facts(text: Column) -> dict[str, Column]:
    """Lists of all kinds but amounts, as strings: a registration is its council, a colon and its number."""
    doctors = F.transform(registrations(text), lambda r: F.concat_ws(":", F.coalesce(r["council"], F.lit("")), r["number"]))
    return {"registrations": doctors, "national_ids": national_ids(text), "scheme_ids": scheme_ids(text), "health_ids": health_ids(text), "mobiles": mobiles(text), "days": F.transform(days(text), lambda d: d["day"])}


def claim_number(text: Column) -> Column:
    """A token that begins as claim numbers do, else the first behind the first label that has one; six characters at least."""
    label = lambda x: F.upper(F.regexp_replace(before(text, x["at"], LABEL_WINDOW), r"\s+", ""))

    def chosen(found: Column) -> Column:
        own = F.filter(F.transform(found, lambda x: F.regexp_extract(x["token"], rf"(?i)(?:^|-)({CLAIM_START}[a-z0-9]{{6,}})", 1)), lambda t: t != "")
        behind = lambda name: F.get(F.filter(found, lambda x: F.endswith(label(x), F.lit(name))), F.lit(0))["token"]
        return F.coalesce(F.get(own, F.lit(0)), *map(behind, CLAIM_LABELS))

    return let(tokens(text, r"[A-Za-z0-9-]{6,}"), chosen)


def patient_uuid(text: Column) -> Column:
    """The identifier after "Patient UHID", else the first one; lower case."""
    def chosen(found: Column) -> Column:
        named = F.filter(found, lambda x: F.endswith(F.upper(F.regexp_replace(before(text, x["at"], LABEL_WINDOW), r"\s+", "")), F.lit("PATIENTUHID")))
        return F.lower(F.coalesce(F.get(named, F.lit(0))["token"], F.get(found, F.lit(0))["token"]))

    return let(tokens(text, rf"(?<![\p{{L}}\p{{N}}_])(?i:{UUID})(?![\p{{L}}\p{{N}}_])"), chosen)


def address_token(addresses: Column) -> Column:
    """The token of the first address that has one; lower case."""
    own = F.transform(addresses, lambda a: F.nullif(F.regexp_extract(a, TOKEN, 1), F.lit("")))
    return F.lower(F.get(F.filter(own, lambda t: t.isNotNull()), F.lit(0)))


def rupees(value: Column) -> Column:
    """A whole amount in Indian grouping, as ₹12,34,567."""
    digits = F.format_string("%d", F.abs(F.round(value)).cast("long"))
    return F.concat(F.when(F.round(value) < 0, "-").otherwise(""), F.lit("₹"), F.regexp_replace(digits, r"\B(?=(?:\d{2})*\d{3}$)", ","))


def rendered(template: str, context: Column, currency: tuple[str, ...] = (), keep_missing: bool = False) -> Column:
    """A template with ``{{path}}`` filled from a JSON column: arrays are joined by commas, named currency fields grouped; what is missing is empty or kept."""
    parts: list[Column] = []
    at = 0
    for hole in PLACEHOLDER.finditer(template):
        parts.append(F.lit(template[at : hole.start()]))
        path = hole[1]
        value = F.get_json_object(context, f"$.{path}")
        if path in currency or path.rpartition(".")[2] in currency:
            value = F.coalesce(rupees(value.try_cast("double")), value)
        listed = F.when(F.startswith(value, F.lit("[")), F.array_join(F.from_json(value, "array<string>"), ", "))
        parts.append(F.coalesce(listed, value, F.lit(hole[0] if keep_missing else "")))
        at = hole.end()
    return F.concat(*parts, F.lit(template[at:]))
