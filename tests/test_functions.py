import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterwise.functions import columns as C
from meterwise.functions import dates as D


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


NAMES = ["a.b.c", "a.b.c.d", "a.b.c.d-e", "a.b", "a.b.c-d", "a.b.c.", "é.b.ü", "plain", None, ""]


def test_collections_and_roles(spark):
    assert values(spark, C.collection_name, NAMES) == ["a.b", "a.b", "a.b", None, None, "a.b", "é.b", None, None, None]
    assert values(spark, C.role_name, NAMES) == ["a.b.c", "a.b.d", "a.b.c.", "a.b", None, "a.b.c.", "é.b.ü", None, None, None]


def test_host_variables(spark):
    texts = ['{"x_host": "1.2.3.4"}', '---\nx_host: "abc"  \nother: 1', "x_host=y z", "  x_host: indented", "my_x_host: no", "{broken", None, "", '{"other": 1}', "x_host: a # comment"]
    assert values(spark, lambda c: C.variable(c, "x_host"), texts) == ["1.2.3.4", "abc", "y z", None, None, None, None, None, None, "a # comment"]


def test_event_fields_keep_escapes(spark):
    assert values(spark, lambda c: C.event_field(c, "a"), [json.dumps({"a": "é\u0000x"}), '{"a": 5}', "no", None]) == ["\\u00e9\\u0000x", "5", None, None]


def test_null_tokens(spark):
    df = spark.createDataFrame([("NA", 1), ("null", 2), ("", 3), ("host", None)], "h string, n int")
    assert [tuple(r) for r in C.without_null_tokens(df).orderBy(F.col("n").asc_nulls_last()).collect()] == [(None, 1), (None, 2), (None, 3), ("host", None)]


def test_whole_days(spark):
    begin = datetime(2024, 1, 1)
    rows = [(begin, begin + timedelta(hours=47)), (begin, begin - timedelta(days=3)), (begin, None), (begin, begin + timedelta(days=2))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.orderBy("i").select(C.whole_days(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, 2]


def test_rounding_is_that_of_binary_numbers(spark):
    assert values(spark, C.rounded, [2.675, 1.005, 10.0, None], "double") == [2.68, 1.0, 10.0, None]


NOW = datetime(2024, 3, 31, 15, 45)


def test_dates_as_they_are_written():
    assert D.parse_date("1d", NOW) == datetime(2024, 3, 31)
    assert D.parse_date("3d", NOW) == datetime(2024, 3, 29)
    assert D.parse_date("1mo", NOW) == D.parse_date("1month", NOW) == datetime(2024, 2, 29)
    assert D.parse_date("13months", NOW) == datetime(2023, 2, 28)
    assert D.parse_date("10m", NOW) == datetime(2024, 3, 31, 15, 35)
    assert D.parse_date("2024-01-02T03:04", NOW) == datetime(2024, 1, 2, 3, 4)
    assert D.parse_date(None, NOW) is D.parse_date("", NOW) is None
    assert [D.parse_days(x) for x in ("5d", "1day", "2days", "2mo", "1month", "3months")] == [5, 1, 2, 60, 30, 90]
    assert D.parse_month(None, NOW) == date(2024, 2, 1) and D.parse_month("2023-11", NOW) == date(2023, 11, 1)
    for wrong in (lambda: D.parse_days("x"), lambda: D.parse_days(None), lambda: D.parse_date("5days", NOW), lambda: D.parse_month("2023", NOW)):
        with pytest.raises(D.UnparsableParameter):
            wrong()
    assert D.period(date(2024, 2, 9), None, None) == (date(2024, 2, 1), date(2024, 2, 29))
    assert D.period(None, date(2024, 2, 9), date(2024, 3, 1)) == (date(2024, 2, 9), date(2024, 3, 1))
    with pytest.raises(ValueError):
        D.period(None, None, None)


def test_days(spark):
    days = lambda *a: [r.day for r in D.days_between(spark, *a).collect()]
    assert days(date(2024, 2, 28), date(2024, 3, 1)) == [date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    assert days(date(2024, 5, 3), date(2024, 1, 1)) == [date(2024, 1, 1)]
    assert days(date(2022, 5, 3), date(2024, 1, 1), "yearly") == [date(2022, 1, 1), date(2023, 1, 1), date(2024, 1, 1)]


def test_slices(spark):
    slices = lambda *a, **k: [tuple(r) for r in D.day_slices(spark, *a, **k).orderBy("slice_start").collect()]
    a, b = datetime(2024, 1, 1, 22), datetime(2024, 1, 3, 1)
    assert slices(a, b) == [(a, datetime(2024, 1, 2)), (datetime(2024, 1, 2), datetime(2024, 1, 3)), (datetime(2024, 1, 3), b)]
    assert slices(a, a) == []
    assert slices(a, datetime(2024, 1, 2)) == [(a, datetime(2024, 1, 2))]
    assert slices(None, b, last=datetime(2020, 1, 1))[0][0] == b - timedelta(weeks=4)
    assert slices(None, b, last=a)[0][0] == a


def test_windows(spark):
    windows = D.sliding_windows(spark, date(2024, 1, 1), date(2024, 1, 5), 3).orderBy("window_start").collect()
    assert [w.window_start.day for w in windows] == [1, 2, 3]
    assert windows[0].window_end == datetime(2024, 1, 3, 23, 59, 59, 999999)
    assert D.sliding_windows(spark, date(2024, 1, 1), date(2024, 1, 2), 3).count() == 0
