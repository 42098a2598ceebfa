"""Golden values of the text, name and date functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldtrust.functions import dates, names, text


def values(spark, rows, schema, column):
    return [r.v for r in spark.createDataFrame(rows, schema).select("*", column.alias("v")).collect()]


def test_normalized_pairs_are_equal(spark):
    pairs = [("أَحْمَد", "احمد"), ("فاطمة", "فاطمه"), ("مصطفى", "مصطفي"), ("عـــلي", "علي"), ("عبد الله", "عبدالله"), ("محمد عبد الرحمن", "محمد عبدالرحمن"), ("کريم", "كريم"), (None, ""), ("Straße  ", " STRASSE")]
    got = spark.createDataFrame(pairs, "a string, b string").select(text.normalized(F.col("a")).alias("a"), text.normalized(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert values(spark, [("کەریم",)], "a string", text.normalized(F.col("a"))) == ["کەریم"]
    assert values(spark, [("١٩٩٠١٢٣٤٥٦٧٨",), ("۱۲۳",)], "a string", text.western_digits(F.col("a"))) == ["199012345678", "123"]


def test_distances(spark):
    rows = [("martha", "marhta"), ("", ""), ("a", ""), ("dixon", "dicksonx"), ("abc", "abc")]
    got = values(spark, rows, "a string, b string", text.jaro_winkler(F.col("a"), F.col("b")))
    assert got == pytest.approx([0.961111, 1.0, 0.0, 0.813333, 1.0], abs=1e-5)
    assert values(spark, [("كاظم", "كاظ"), ("", ""), ("", "x")], "a string, b string", text.character_error_rate(F.col("a"), F.col("b"))) == [0.25, 0.0, 1.0]


def test_located(spark):
    rows = [("1990 1234", "الرقم الوطني:  ١٩٩٠ ١٢٣٤"), ("1990 1235", "الرقم الوطني:  ١٩٩٠ ١٢٣٤"), ("a.b (c)", "x a.b   (c) y"), (" ", "x")]
    assert values(spark, rows, "a string, b string", text.located(F.col("a"), F.col("b"))) == ["١٩٩٠ ١٢٣٤", None, "a.b   (c)", None]


def test_span_confidence_and_json(spark):
    df = spark.createDataFrame([([("x", -0.5), ("a", -0.01), ("b", -1.0), ("c", -0.01)], "xabc", "abc")], "p array<struct<token string, logprob double>>, r string, f string")
    assert df.select(text.span_confidence(F.col("p"), F.col("r"), F.col("f")).alias("v")).first().v == pytest.approx(0.7117703, abs=1e-6)
    got = values(spark, [("<think>{x}</think>```json\n{\"a\": \"1\"}```",), ("no object",)], "a string", text.json_object(F.col("a"), "map<string,string>"))
    assert got == [{"a": "1"}, None]


NAMES = [
    ("علي حسين كاظم", "على حسين كاظم", "match"),
    ("عبد الله حسن", "عبدالله حسن", "match"),
    ("مثال أحمد جاسم محمد", "مثال احمد محمد", "partial_match"),
    ("علي حسين كاظم", "عمر حسين كاظم", "mismatch"),
    ("علي حسين كاظم", "علي كاظم حسين", "mismatch"),
    ("علي حسين كاظم", "Ali Hussein Kadhim", "transliteration_match"),
    ("علي حسين كاظم", "Omar Hussein Kadhim", "mismatch"),
    (None, "علي", "skipped"),
]


def test_names(spark):
    got = {(r.a, r.b): r.name_match for r in names.with_name_match(spark.createDataFrame([x[:2] for x in NAMES], "a string, b string"), "a", "b").collect()}
    for a, b, status in NAMES:
        assert got[a, b].status == status, (a, b, got[a, b])
    assert "جاسم" in got["مثال أحمد جاسم محمد", "مثال احمد محمد"].detail


DATES = [
    ("2031/04/12", datetime.date(2031, 4, 12), "gregorian"),
    ("12/04/2031", datetime.date(2031, 4, 12), "gregorian"),
    ("١٢/٠٤/٢٠٣١", datetime.date(2031, 4, 12), "gregorian"),
    ("12 نيسان 2031", datetime.date(2031, 4, 12), "gregorian"),
    ("3 تشرين الثاني 1990", datetime.date(1990, 11, 3), "gregorian"),
    ("5 أيلول 2030", datetime.date(2030, 9, 5), "gregorian"),
    ("garbage", None, None),
    ("2031/13/40", None, None),
    (None, None, None),
    ("١ رمضان ١٤٤٥ هـ", datetime.date(2024, 3, 11), "hijri"),
    ("1445/09/01", datetime.date(2024, 3, 11), "hijri"),
    ("01/09/1445 هـ", datetime.date(2024, 3, 11), "hijri"),
]


def test_dates(spark):
    got = {r.t: r.parsed for r in dates.with_parsed_date(spark.createDataFrame([(t,) for t, _, _ in DATES], "t string"), "t").collect()}
    for t, value, calendar in DATES:
        assert (got[t] and (got[t].value, got[t].calendar, got[t].converted)) == (value and (value, calendar, calendar == "hijri")), t
    printed = dates.with_printed_date(spark.createDataFrame([(datetime.date(2024, 3, 11), "hijri"), (datetime.date(2031, 4, 2), "gregorian")], "d date, c string"), "d", "c")
    assert {r.printed for r in printed.collect()} == {"1445/09/01 هـ", "2031/04/02"}


def test_every_day_of_the_hijri_calendar_is_printed(spark):
    """The first of March after a short February too, whose month began in that February or in January."""
    days = spark.sql("SELECT explode(sequence(DATE'1990-01-01', DATE'2035-12-31')) AS d, 'hijri' AS c")
    got = dates.with_parsed_date(dates.with_printed_date(days, "d", "c"), "printed").collect()
    assert len(got) == 16801 and all(r.printed.endswith("هـ") and r.parsed.value == r.d and r.parsed.calendar == "hijri" for r in got)
