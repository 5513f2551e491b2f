"""Facts in letters: single cases, a plain version over random letters and over whole documents."""

from __future__ import annotations

import random
import re
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from granary.functions import entities as en
from granary.functions.scalars import VERHOEFF_D, VERHOEFF_P
from granary.plans import catalog, claims


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def checked(digits: str) -> bool:
    c = 0
    for i, d in enumerate(reversed(digits)):
        c = int(VERHOEFF_D[c][int(VERHOEFF_P[i % 8][int(d)])])
    return c == 0


def with_check_digit(eleven: str) -> str:
    return next(eleven + d for d in "0123456789" if checked(eleven + d))


NATIONAL = with_check_digit("23456789012")


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (en.registrations, "Registration Number: a1234", [(None, "A1234")]),
        (en.registrations, "M.P.M.C. Reg. No. 21274 and MPMC/21274, Reg No 555", [("MPMC", "21274"), (None, "555")]),
        (en.registrations, "Delhi  Medical Council 4455; DMC#77777; Reg # 88; Room 4321; MPMC 12345678", [("DELHI MEDICAL COUNCIL", "4455"), ("DMC", "77777")]),
        (en.registrations, "", []),
        (en.national_ids, f"no {NATIONAL[:4]} {NATIONAL[4:8]}-{NATIONAL[8:]}, ok {NATIONAL}", [NATIONAL]),
        (en.national_ids, "0000 1234 5678 and 1111 2222 3333 and 2345 6789 0123", []),
        (en.national_ids, f"x{NATIONAL} {NATIONAL}7 1{NATIONAL[:4]} {NATIONAL[4:8]} {NATIONAL[8:]}", []),
        (en.scheme_ids, "PMJAY no MCETESFVS, AYUSHMAN BENEFICIARY", ["MCETESFVS"]),
        (en.scheme_ids, "PMJAY " + "." * 90 + " MCETESFVS", []),
        (en.scheme_ids, f"Beneficiary   ID 123456789012345 or {NATIONAL}", ["123456789012345"]),
        (en.health_ids, "Health  ID 91-1234-5678-9012, 91123456789012", ["91123456789012"]),
        (en.health_ids, "ABHA " + "." * 300 + " 91-1234-5678-9012", []),
        (en.health_ids, "id 91-1234-5678-9012", []),
        (en.mobiles, "+919812345678, 6012345678 and 19812345678, 91-9812345678", ["9812345678", "6012345678"]),
        (en.amounts, "INR 1,200.50 and 300/- or 300 only, ₹1,200.50, 0 only, code A12 Rs", [1200.5, 300.0]),
        (en.days, "on 2024-02-30, 2024-02-29, 31/12/99, 12/31/2020, 05.06.2021, 3 sept 24, 13/13/2020, 1/1/020", [("2024-02-29", "year_first"), ("1999-12-31", "day_first"), ("2020-12-31", "month_first"), ("2021-06-05", "either"), ("2024-09-03", "named")]),
        (en.claim_number, "Claim ID: AB-12345", "AB-12345"),
        (en.claim_number, "claim id # 123456 and CCN: 7654321 see x-clm-99887766", "clm-99887766"),
        (en.claim_number, "Claim # 12345", None),
    ],
)
def test_single_cases(spark, column, text, want):
    found = one(spark, column, text)
    assert ([tuple(x) if isinstance(x, tuple) else x for x in found] if isinstance(found, list) else found) == want


def test_null_texts(spark):
    for column in (en.registrations, en.national_ids, en.scheme_ids, en.health_ids, en.mobiles, en.amounts, en.days, en.claim_number, en.patient_uuid):
        assert one(spark, column, None) is None


# ---- a plain version, by scanning with positions


def near(text: str, start: int, end: int, size: int, words) -> bool:
    span = re.sub(r"\s+", " ", text[max(0, start - size) : end + size]).upper()
    return any(w in span for w in words)


def in_groups(text: str, groups: tuple[int, ...]) -> list[tuple[int, int, str]]:
    shapes, out = {tuple(s) for s in en.merged_groups(groups)}, []
    for run in re.finditer(r"(?<!\w)\d+(?:[\s-]\d+)*(?!\w)", text):
        parts, i = re.split(r"[\s-]", run[0]), 0
        while i < len(parts):
            fits = [k for k in range(1, len(groups) + 1) if tuple(map(len, parts[i : i + k])) in shapes]
            if fits:
                out.append((run.start(), run.end(), "".join(parts[i : i + fits[0]])))
            i += fits[0] if fits else 1
    return out


def plain_facts(text: str) -> dict[str, list]:
    once = lambda xs: list(dict.fromkeys(xs))
    mobiles = [n[-10:] for n in re.findall(r"\d+", text) if re.fullmatch(r"(91)?[6-9]\d{9}", n)]
    days = []
    iso = lambda y, m, d: (lambda y: f"{y:04d}-{m:02d}-{d:02d}" if 1900 <= y <= 2100 and valid(y, m, d) else None)(int(y) + (2000 if int(y) < 80 else 1900) if len(y) == 2 else int(y))

    def valid(y, m, d):
        try:
            return bool(date(y, m, d))
        except ValueError:
            return False

    for m in re.finditer(r"(?<!\w)(\d{4})-(\d\d)-(\d\d)(?!\w)", text):
        days.append((iso(m[1], int(m[2]), int(m[3])), "year_first"))
    for m in re.finditer(r"(?<!\w)(\d\d?)[/.-](\d\d?)[/.-](\d{2,4})(?!\w)", text):
        a, b = int(m[1]), int(m[2])
        if min(a, b) <= 12:
            days.append((iso(m[3], a, b), "month_first") if b > 12 else (iso(m[3], b, a), "day_first" if a > 12 else "either"))
    for m in re.finditer(rf"(?i)(?<!\w)(\d\d?)\s+({'|'.join(en.MONTHS)})[a-z]*\s+(\d{{2,4}})(?!\w)", text):
        days.append((iso(m[3], en.MONTHS.index(m[2].lower()) + 1, int(m[1])), "named"))
    amounts: list[float] = []
    numbers = list(re.finditer(r"\d[\d,]*(?:\.\d{1,2})?", text))
    for ahead in (True, False):
        for m in numbers:
            left, right = text[max(0, m.start() - 12) : m.start()].rstrip(" ").upper(), text[m.end() : m.end() + 12].lstrip(" ").upper()
            fits = left.endswith(en.MARKS_BEFORE) if ahead else right.startswith(en.MARKS_AFTER) and not re.fullmatch(r"[^\W\d]", text[max(0, m.start() - 1) : m.start()])
            if fits and float(m[0].replace(",", "")) > 0:
                amounts.append(float(m[0].replace(",", "")))
    schemes = [m[0] for m in re.finditer(r"(?<!\w)[A-Z][A-Z0-9]{7,11}(?!\w)", text) if m[0] not in en.NOT_SCHEME_IDS and near(text, m.start(), m.end(), 80, en.SCHEME_WORDS)]
    schemes += [m[0] for m in re.finditer(r"(?<!\w)\d{12,15}(?!\w)", text) if near(text, m.start(), m.end(), 80, (*en.SCHEME_WORDS, *en.MEMBER_WORDS)) and not (len(m[0]) == 12 and m[0][0] not in "01" and checked(m[0]))]
    return {
        "national_ids": once(n for _, _, n in in_groups(text, (4, 4, 4)) if n[0] not in "01" and checked(n)),
        "health_ids": once(n for s, e, n in in_groups(text, (2, 4, 4, 4)) if near(text, s, e, 60, en.HEALTH_WORDS)),
        "scheme_ids": once(schemes),
        "mobiles": once(mobiles),
        "days": [d for d, _ in once(x for x in days if x[0])],
        "amounts": once(amounts),
    }


COLUMNS = ("national_ids", "health_ids", "scheme_ids", "mobiles", "days")


def test_random_letters(spark):
    draw = random.Random(5)
    digit = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    makers = [
        lambda: draw.choice(" -").join((NATIONAL[:4], NATIONAL[4:8], NATIONAL[8:])), lambda: " ".join(digit(draw.randint(1, 5)) for _ in range(draw.randint(1, 7))), lambda: "-".join(digit(4) for _ in range(draw.randint(2, 6))), lambda: digit(draw.randint(8, 16)),
        lambda: draw.choice(["ABHA", "Health ID", "PMJAY", "Ayushman Bharat", "Beneficiary ID", "Rs.", "INR", "₹", "only", "/-", "x" * 70]), lambda: draw.choice("6789") + digit(9), lambda: "91" + draw.choice("56789") + digit(9), lambda: "".join(draw.choice("ABCXYZ0189") for _ in range(draw.randint(6, 13))),
        lambda: f"{draw.randint(1, 33)}{draw.choice('/.-')}{draw.randint(1, 14)}{draw.choice('/.-')}{draw.choice(['24', '1999', '85', '020'])}", lambda: f"2023-{draw.randint(10, 13)}-{draw.randint(10, 32)}", lambda: f"{draw.randint(1, 32)} {draw.choice(['Jan', 'FEBRUARY', 'Sept', 'Foo'])} {draw.choice(['24', '2021'])}", lambda: f"{digit(2)},{digit(3)}.{digit(2)}",
    ]
    letters = ["".join(draw.choice(makers)() + draw.choice([" ", "\n", ", ", "", "-", "; "]) for _ in range(draw.randint(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(letters)), "i long, t string").select("i", *claims._facts(F.col("t"))).collect()
    n = 0
    for r in rows:
        want = plain_facts(letters[r["i"]])
        assert {c: r[c] for c in COLUMNS} == {c: ",".join(want[c]) for c in COLUMNS}, letters[r["i"]]
        assert r["amounts"] == want["amounts"], letters[r["i"]]
        n += sum(map(len, want.values()))
    assert n > 500


def test_whole_documents(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = catalog.queries()["f6_document_facts"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_facts(texts[r["doc_id"]])
        assert {c: r[c] for c in COLUMNS} == {c: ",".join(want[c]) for c in COLUMNS}


def test_letters_are_not_walked_token_by_token(spark, small):
    plan = catalog.queries()["f6_letter_facts"](spark, small)._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" not in plan and "(.*?)" not in plan, "patterns find what can be a fact, tokens are not folded over"


def test_windows_and_edges_count_characters_beyond_the_basic_plane(spark):
    face, letter = "\U0001f600", "\U0001d49c"
    assert one(spark, en.health_ids, "ABHA" + face * 56 + "91123456789012") == ["91123456789012"]
    assert one(spark, en.health_ids, "ABHA" + face * 57 + "91123456789012") == []
    assert one(spark, en.scheme_ids, "MCETESFVS" + face * 75 + "PMJAY") == ["MCETESFVS"]
    assert one(spark, en.scheme_ids, "MCETESFVS" + face * 76 + "PMJAY") == []
    assert one(spark, en.scheme_ids, f"PMJAY {letter}123456789012345") == [], "a letter stands right before the number"


def test_councils_are_looked_for_in_sixty_characters(spark):
    assert one(spark, en.registrations, "MPMC" + " " * 56 + "12345") == [("MPMC", "12345")]
    assert one(spark, en.registrations, "MPMC" + " " * 57 + "12345") == []
    assert one(spark, en.registrations, "".join(f"MCI {n:03d};" for n in range(100, 130)) + " Reg\ue000 No 777") == [*(("MCI", str(n)) for n in range(100, 130)), (None, "777")]


def test_entities_of_documents_are_of_all_kinds(spark, tmp_path):
    draw = random.Random(6)
    digit = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    makers = [
        lambda: draw.choice(["M.P.M.C.", "mci", "Reg", "Registration", "No.", "Number", "#", "Delhi  Medical Council", "XMCI", "U.P.M.C", "A.B.M.C.I", "."]), lambda: draw.choice("akZ") + digit(draw.randint(3, 8)), lambda: draw.choice(" -").join((NATIONAL[:4], NATIONAL[4:8], NATIONAL[8:])), lambda: "-".join(digit(4) for _ in range(draw.randint(2, 6))),
        lambda: "91 " + " ".join(digit(4) for _ in range(3)), lambda: draw.choice(["ABHA", "health \n id", "PMJAY", "xPMJAYx", "Ayushman", "Beneficiary  ID", "BEN ID", "Rs.", "inr", "₹", "only", "/-", "." * 70, " " * 20]), lambda: draw.choice(["", "91"]) + draw.choice("6789") + digit(9), lambda: digit(draw.randint(8, 16)), lambda: "".join(draw.choice("ABCXYZ0189") for _ in range(draw.randint(6, 13))),
        lambda: f"{draw.randint(1, 33)}{draw.choice('/.-')}{draw.randint(1, 14)}{draw.choice('/.-')}{draw.choice(['24', '1999', '85', '020', '2101'])}", lambda: f"{draw.randint(1890, 2110)}-{draw.randint(10, 13)}-{draw.randint(10, 32)}", lambda: f"{draw.randint(1, 32)} {draw.choice(['Jan', 'FEBRUARY', 'Sept', 'Foo'])} {draw.choice(['24', '2021'])}", lambda: f"{digit(2)},{digit(3)}.{digit(3)}",
    ]
    texts = ["".join(draw.choice(makers)() + draw.choice([" ", "\n", ", ", "", "-", "; ", "<", ": "]) for _ in range(draw.randint(1, 20))) for _ in range(1500)]
    spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(con.execute(catalog.oracle_sql()["f6_entities"]).fetchall())
    found = catalog.queries()["f6_entities"](spark, str(tmp_path))
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == want
    for kind in ("registrations", *COLUMNS, "amounts"):
        assert found.where(F.col(kind) != "").count() > 50, kind


def test_names_are_unique(monkeypatch):
    from granary.plans import scalars

    monkeypatch.setitem(scalars.plans.queries, "s9_job_coalescing", lambda spark, sf_dir: None)
    with pytest.raises(ValueError, match="s9_job_coalescing"):
        catalog.queries()
