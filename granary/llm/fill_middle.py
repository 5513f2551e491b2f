"""Fill-in-the-middle form of texts, and the way back.

A text is cut into units (lines by default); two numbers drawn from its id choose
where the middle begins and ends, a third whether the text is changed at all and a
fourth which of two forms it takes:

* ``psm``: mark P, prefix, mark S, suffix, mark M, middle
* ``spm``: mark S, suffix, mark P, prefix, mark M, middle
* ``plain``: the text as it is

The draws are 32-bit groups of the SHA-256 of ``seed:id``, so they are the same in
every run, on every machine and for any partitioning.  The work is map-only: an
Arrow-batched pandas UDF walks the units once with the regex library, keeps their
end offsets in a compact array and slices the text at two of them; nothing is
shuffled and a task holds one Arrow batch.

``restored`` rebuilds a text from form and output alone.  That is exact because a
text that holds a mark stays plain, and because a mark's first character occurs
nowhere else in any mark: an inserted mark can then not overlap one that begins in
the text before it, so the first mark found is the inserted one.

Defined results: a null text is an empty text, which is plain with no units; a null
id is drawn from ``seed:``; code points between the units' matches (none with the
default pattern) belong to the following unit.  Rows with one id take the same
draws.  Texts may be of any length; one has to fit in a worker.  Extra columns are
not touched: the operator is a column.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.tables import small_batches

LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
KINDS = {"n_units": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "output_sha256": "string", "restored_sha256": "string"}


@lru_cache
def compiled(units: str):
    import regex

    return regex.compile(units)


def checked_marks(marks: Sequence[str]) -> tuple[str, str, str]:
    """The three marks, or an error where outputs could not be taken apart again."""
    prefix, suffix, middle = marks
    firsts = {m[:1] for m in marks}
    if len({*marks}) < 3 or "" in marks or any(c in firsts for m in marks for c in m[1:]) or any(a != b and b.startswith(a) for a in marks for b in marks):
        raise ValueError(f"marks must differ, not begin one another, and hold no mark's first character behind their own: {marks}")
    return prefix, suffix, middle


def draws(seed: int, key: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))  # type: ignore[return-value]


def unit_ends(text: str, units: str) -> array:
    """End offsets of the units in code points, with 0 before the first."""
    ends = array("Q", (0,))
    ends.extend(match.end() for match in compiled(units).finditer(text))
    return ends


def rearranged(text: str, draw: tuple[int, int, int, int], units: str, marks: tuple[str, str, str], change_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(n_units, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text, units)
    n = len(ends) - 1
    if not text or draw[2] % 100 >= change_percent or any(m in text for m in marks):
        return n, PLAIN, None, None, text
    begin, end = sorted((ends[draw[0] % (n + 1)], ends[draw[1] % (n + 1)]))
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    p, s, m = marks
    if draw[3] % 100 < spm_percent:
        return n, SPM, len(prefix), len(middle), "".join((s, suffix, p, prefix, m, middle))
    return n, PSM, len(prefix), len(middle), "".join((p, prefix, s, suffix, m, middle))


def rebuilt(output: str, form: str, marks: tuple[str, str, str]) -> str:
    """The text behind an output."""
    if form == PLAIN:
        return output
    p, s, m = marks
    first, second = (p, s) if form == PSM else (s, p)
    if form not in (PSM, SPM) or not output.startswith(first):
        raise ValueError(f"no output of form {form}")
    head, _, rest = output[len(first) :].partition(second)
    tail, _, middle = rest.partition(m)
    prefix, suffix = (head, tail) if form == PSM else (tail, head)
    return prefix + middle + suffix


def fill_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    units: str = LINES,
    marks: Sequence[str] = MARKS,
    change_percent: int = 100,
    spm_percent: int = 50,
    wanted: Sequence[str] = ("n_units", "form", "prefix_chars", "middle_chars", "output"),
) -> Column:
    """Struct column with the ``wanted`` of: n_units, form, prefix_chars, middle_chars (null if plain), output, output_sha256 and restored_sha256.

    ``change_percent`` of the texts are changed, ``spm_percent`` of those into the
    form that begins with the suffix.  The digests are of the UTF-8 bytes of the
    output and of the text that ``rebuilt`` makes from it.
    """
    signs, names = checked_marks(marks), [c for c in KINDS if c in set(wanted)]
    small_batches(df.sparkSession)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

    @F.pandas_udf(", ".join(f"{c} {KINDS[c]}" for c in names))
    def changed(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for key, text in zip(keys, texts, strict=True):
            row = dict(zip(KINDS, rearranged(text, draws(seed, key), units, signs, change_percent, spm_percent), strict=False))
            if "output_sha256" in names:
                row["output_sha256"] = digest(row["output"])
            if "restored_sha256" in names:
                row["restored_sha256"] = digest(rebuilt(row["output"], row["form"], signs))
            rows.append([row[c] for c in names])
        made = pd.DataFrame(rows, columns=names, dtype=object)
        return made.astype({c: "Int64" for c in names if KINDS[c] == "long"})

    return changed(df[id_col].cast("string"), F.coalesce(df[text_col], F.lit("")))


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The texts behind outputs; null where output or form is null."""
    signs = checked_marks(marks)

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else rebuilt(o, f, signs) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return back(output, form)


#: DuckDB SQL for the rows of op11_fill_middle.
SQL = """
with docs as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as hash from documents),
drawn as (
  select doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') as units, ('0x' || hash[1:8])::ubigint as h1, ('0x' || hash[9:16])::ubigint as h2,
    ('0x' || hash[17:24])::ubigint as h3, ('0x' || hash[25:32])::ubigint as h4
  from docs),
cuts as (
  select doc_id, text, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b, units,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select doc_id, text, n, form, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from cuts)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
