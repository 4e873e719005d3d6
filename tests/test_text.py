import pytest
from pyspark.sql import functions as F

from cueloom.functions import matching, text as X, timing


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("shown", "units"), [("中文字幕", 4.0), ("AI 25", 2.5), ("　", 0.5), ("Café", 2.0), ("👨‍👩‍👧", 2.5), ("", 0.0)])
def test_display_units(spark, shown, units):
    assert one(spark, shown, X.display_units) == units
    from cueloom.operators.segment import width

    assert width(shown) == units


@pytest.mark.parametrize(
    ("shown", "line"),
    [("1 < 2 and <i>three</i> > 2", "1 < 2 and three > 2"), ("a⁠b c", "a b c"), ("x<br/>y", "x y"), ("<00:01.500>sung", "sung"), ("﻿ hi　", "hi"), (None, ""), ("<v Ann>now</v>", "now"), ("a <3 b", "a <3 b")],
)
def test_clean_text(spark, shown, line):
    assert one(spark, shown, X.clean_text) == line


def test_line_breaks_stay(spark):
    assert one(spark, " a \n\n b ", X.clean_lines) == "a\nb"
    assert one(spark, "a b\nc", X.comparison_key) == "abc"


def test_utf16_length(spark):
    assert one(spark, "a😀", X.utf16_length) == 3


def test_numbers(spark):
    assert one(spark, "25, 1,000 and 3.5%", X.numbers) == ["1000", "25", "3.5%"]


def test_fold_pairs():
    for a, b in (("σ", "ς"), ("ß", "ẞ"), ("K", "K"), ("ſ", "s")):
        assert X.simple_fold(a) == X.simple_fold(b)
    assert X.simple_fold("İ") != X.simple_fold("i")


def test_unicode_forms(spark):
    row = spark.createDataFrame([("ﬃ x² é",), (None,)], "v string").select(X.unicode_forms(F.col("v")).alias("u")).collect()
    assert row[0]["u"]["nfkc"] == "ffi x2 é" and row[0]["u"]["nfc"] == "ﬃ x² é"


@pytest.mark.parametrize(("raw", "ms"), [("00:00:01,5", 1500), ("1:02.003", 62003), ("999:59:59,999", 3599999999), ("00:60:00,000", None), ("x", None), ("00:00:00.000", 0)])
def test_clock(spark, raw, ms):
    assert one(spark, raw, timing.clock_ms) == ms


def test_clock_writers(spark):
    row = spark.range(1).select(timing.srt_clock(F.lit(3_599_999_999)).alias("a"), timing.srt_clock(F.lit(3_600_000_000)).alias("b"), timing.ass_clock(F.lit(3_661_005)).alias("c")).first()
    assert tuple(row) == ("999:59:59,999", None, "1:01:01.01")


def test_tolerance_is_decided_in_seconds(spark):
    row = spark.range(1).select(timing.same_time(F.lit(1002), F.lit(1000)).alias("a"), timing.same_time(F.lit(2), F.lit(0)).alias("b")).first()
    assert tuple(row) == (False, True)


@pytest.mark.parametrize(
    ("text", "form", "exact", "spans"),
    [
        ("You may continue.", "May", True, []), ("You may continue.", "May", False, [(4, 7)]), ("a a a", "a", True, [(0, 1), (2, 3), (4, 5)]), ("new  york city", "new york", True, [(0, 9)]),
        ("C++ and C++", "C++", True, [(0, 3), (8, 11)]), ("ΣΑΣ", "σας", False, [(0, 3)]), ("", "x", True, []), ("office", "off", True, []), ("a+a+", "a+", True, [(0, 2)]),
    ],
)
def test_occurrences(text, form, exact, spans):
    assert matching.occurrences(text, form, exact) == spans


def test_slugs(spark):
    assert one(spark, "Hello, World!", X.slug) == "hello-world"
    assert one(spark, "CON", X.slug) == "con-job" and one(spark, "??", X.slug) == "track"
    assert one(spark, "C++", X.term_slug) == "c" and one(spark, "中", X.term_slug) == "term"


def test_texts_that_need_no_cleaning_are_kept_and_all_others_cleaned(spark):
    marks = [chr(c) for c in (*range(1, 0x400), *range(0x1680, 0x1690), *range(0x2000, 0x2070), *range(0x3000, 0x3040), 0xFEFF, 0xFF01, 0xFF5E, 0x1F600)]
    texts = [shape.replace("#", c) for c in marks for shape in ("a#b", "#a", "a#", "a# b", "##")] + ["", "a b", " a", "a ", "a  b", "<i>a</i>", "a<b", "a\n\nb", "<00:01.500>x", "a<br>b", "\ufeffa", "é", "甲，乙"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    whole = X._clean_lines(F.coalesce("text", F.lit("")))
    assert rows.where(~X.clean_lines("text").eqNullSafe(whole) | ~X.clean_text("text").eqNullSafe(X.squeeze(whole))).count() == 0
