"""Scalar functions on edge cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from granary.functions import scalars as fn


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clinical_days_roll_over(spark):
    values = ["2024-02-29", "31/02/2023", "5 Mar 24", "05-March-2024", "2024-13-01", "hello", None, "", "00/01/2024", "1/2/2024"]
    assert [str(x) if x else None for x in column(spark, values, fn.clinical_day)] == ["2024-02-29", "2023-03-03", "2024-03-05", "2024-03-05", None, None, None, None, None, "2024-02-01"]


def test_strict_days_are_real(spark):
    values = ["31/02/2023", "12/25/2020", "25/12/2020", "01/01/79", "01/01/80", "2023-02-29", "3 Jan 2020", None, "99/99/2020"]
    assert [str(x) if x else None for x in column(spark, values, fn.strict_day)] == [None, "2020-12-25", "2020-12-25", "2079-01-01", "1980-01-01", None, "2020-01-03", None, None]


def test_amounts(spark):
    assert column(spark, ["1,23,456/-", "Rs. 500", "₹ 12.50", "inr 7", "12 approx", "", None, "-5"], fn.amount) == [123456.0, 500.0, 12.5, 7.0, None, None, None, -5.0]


def test_check_digits_equal_plain_version(spark):
    d, p = ([[int(x) for x in row] for row in rows] for rows in (fn.VERHOEFF_D, fn.VERHOEFF_P))

    def valid(text: str) -> bool:
        c = 0
        for i, x in enumerate(reversed(text)):
            c = d[c][p[i % 8][int(x)]]
        return c == 0 and text[0] not in "01"

    draw = random.Random(1)
    values = ["".join(draw.choice("0123456789") for _ in range(12)) for _ in range(400)]
    assert column(spark, values, fn.verhoeff_valid) == [valid(v) for v in values]
    assert column(spark, ["", None, "12345", "x" * 12], fn.verhoeff_valid) == [False] * 4


def test_hamming(spark):
    zero, four, ones = "0" * 64, "f" + "0" * 63, "f" * 64
    rows = spark.createDataFrame([(zero, zero), (zero, four), (zero, ones), (four, ones)], "a string, b string")
    assert [r[0] for r in rows.select(fn.hamming_hex(F.col("a"), F.col("b"), 64)).collect()] == [0, 4, 256, 252]


def test_names(spark):
    rows = spark.createDataFrame([("Dr. Anita Rao", "anita rao"), ("Müller", "mueller"), ("", "x"), ("Ravi Kumar", "Ravi Kumarr")], "a string, b string")
    got = rows.select(fn.token_set_ratio(F.col("a"), F.col("b")), fn.name_distance(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 1.0 and got[2][1] == 1.0 and abs(got[3][1] - 1 / 6) < 1e-9


def test_bounds_messages_and_keys(spark):
    assert column(spark, [37.0, 3.7, 370.0, 5.0, None], lambda v: fn.bounded_value(v, 36.0, 42.0), "double") == [37.0, 37.0, 37.0, None, None]
    assert column(spark, ["Claim rejected, query raised", "approved", "please send the bill", "received", "", None], fn.message_class) == ["rejection", "approval", "query", "ack", "other", "other"]
    rows = spark.createDataFrame([(1, None)], "b int, a string")
    assert rows.select(fn.stable_key("a", "b") == fn.stable_key("b", "a")).first()[0]
