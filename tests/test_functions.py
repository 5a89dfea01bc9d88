import datetime as dt

from pyspark.sql import functions as F

from segmenter.functions import (boldify, extract_after, l2_distance, normalize_id, parse_date, period_key,
                                 text_to_number, week_of_year_sunday, wrap_fixed)


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {typ}")
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_normalize_id(spark):
    vals = ["8 (900) 123-45-67", "8123", "C-001", "12 34", None]
    assert one_col(spark, vals, normalize_id) == ["+79001234567", "+7123", "C001", "1234", None]
    assert one_col(spark, vals, lambda c: normalize_id(c, phone_only=True)) == [
        "+79001234567", "8123", "C001", "1234", None]


def test_text_to_number(spark):
    vals = [" 5 ", "1_000", "1e3", "1d", "nan", "inf", "two hundred five", "twenty-one", "два",
            "about two dollars", "-3.5", None]
    assert one_col(spark, vals, text_to_number) == [5.0, 1000.0, 1000.0, None, None, None, 205.0, 21.0,
                                                    None, 2.0, -3.5, None]
    assert one_col(spark, ["two point five", "one hundred point two five", "point five", "two point"],
                   text_to_number) == [2.5, 100.25, 0.5, 2.0]


def test_parse_date(spark):
    vals = ["2024-01-31", "31.01.2024", "01/31/2024", "03/04/2024", "2024-13-01", "hello"]
    got = one_col(spark, vals, parse_date)
    d = dt.datetime
    assert got == [d(2024, 1, 31), d(2024, 1, 31), d(2024, 1, 31), d(2024, 3, 4), None, None]


def test_week_matches_strftime_U(spark):
    start = dt.date(2019, 12, 20)
    days = [start + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(x,) for x in days], "d date")
    got = [r[0] for r in df.select(week_of_year_sunday(F.col("d"))).collect()]
    assert got == [int(x.strftime("%U")) for x in days]
    keys = [r[0] for r in df.select(period_key(F.col("d"), "week", "en")).collect()]
    assert keys[:3] == [x.strftime("Week %U, %Y") for x in days[:3]]
    assert [r[0] for r in df.select(period_key(F.col("d"), "month")).limit(1).collect()] == ["December 2019"]


def test_boldify_and_wrap(spark):
    assert one_col(spark, ["a **b\nc** d **e**"], boldify) == ["a <b>b\nc</b> d <b>e</b>"]
    text = "x" * 120
    got = one_col(spark, [text, "short", "y" * 50], lambda c: wrap_fixed(c, 50))
    assert got == ["\n".join([text[i:i + 50] for i in range(0, 120, 50)]), "short", "y" * 50]


def test_extract_after(spark):
    report = "VIP-клиенты:\n  Клиентов: 12\n  Средний чек: 1.00 руб.\n"
    assert one_col(spark, [report], lambda c: extract_after(c, "VIP-клиенты", "Клиентов")) == [12]


def test_l2(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(l2_distance("a", "b")).collect()] == [5.0, None]


def test_label_fallback_and_language(spark):
    from segmenter.operators.summary import labels_with_fallback, language_or_default
    df = spark.createDataFrame([({"a": "A-ru", "b": "B-ru"}, {"a": "A-en"}, "en"), ({"a": "x"}, {}, "de")],
                               "d map<string,string>, l map<string,string>, lang string")
    rows = df.select(labels_with_fallback(F.col("l"), F.col("d")).alias("m"),
                     language_or_default(F.col("lang")).alias("lang")).collect()
    assert rows[0]["m"] == {"a": "A-en", "b": "B-ru"} and rows[0]["lang"] == "en"
    assert rows[1]["m"] == {"a": "x"} and rows[1]["lang"] == "ru"


def test_parse_date_with_times_and_zones(spark):
    at = "2024-01-31 10:00:00"
    cases = {"2024-01-31T10:00:00Z": at, "2024-01-31T10:00:00+03:00": at, "2024-01-31 10:00:00.123": at + ".123000",
             "2024-01-31T10:00": at, "31-01-2024": "2024-01-31 00:00:00", "01-02-2024": "2024-01-02 00:00:00",
             "31.01.24": "2024-01-31 00:00:00", "2024.01.31": "2024-01-31 00:00:00",
             "01/31/2024 5:00 PM": "2024-01-31 17:00:00", "01/31/2024 12:05 am": "2024-01-31 00:05:00",
             "31.01.2024 10:00:00": at, "Jan 31, 2024 10:00": at, "2024-01-31 25:00": None, "2024-01-31 10:75": None,
             "31/01/2024": "2024-01-31 00:00:00", "31/01/2024 10:00": at, "02/01/2024": "2024-02-01 00:00:00", "31/13/2024": None,
             "31/01/69": "1969-01-31 00:00:00", "01/31/68": "2068-01-31 00:00:00", "31.01.99": "1999-01-31 00:00:00",
             "2024-02-31": None, "10:00": None, "soon 5": None, "": None}
    got = one_col(spark, list(cases), parse_date)
    assert [None if g is None else str(g) for g in got] == list(cases.values())
