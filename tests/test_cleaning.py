from __future__ import annotations

import statistics
import struct
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwise.operators import cleaning
from tillwise.operators.date_formats import detected_formats, format_coverage
from tillwise.operators.derive import dated_lines, delivery_speed, parsed_date, parsed_number
from tillwise.operators.median import exact_medians, ordered_keys
from tillwise.schema import numeric_columns, require_columns, snake_names, text_columns, with_headers

RAW = (
    "order_date string, ship_date string, sales double, profit double, discount double,"
    " quantity bigint, category string, state string"
)


def line(**changes):
    base = {
        "order_date": "2020-01-05", "ship_date": "2020-01-08", "sales": 100.0, "profit": 12.345,
        "discount": 0.1, "quantity": 2, "category": "Chairs", "state": "Ohio",
    }
    return tuple({**base, **changes}.values())


def test_median_fill_of_odd_even_and_empty_columns(rows):
    frame = rows(
        [(1, 1.0, None, "a"), (2, 2.0, None, None), (None, None, None, "c"), (9, None, None, "d")],
        "odd int, even double, none double, word string",
    )
    filled = cleaning.fill_nulls(frame)
    got = filled.orderBy("word").collect()
    assert sorted(r["odd"] for r in got) == [1.0, 2.0, 2.0, 9.0]
    assert sorted(r["even"] for r in got) == [1.0, 1.5, 1.5, 2.0]
    assert [r["none"] for r in got] == [None] * 4
    assert sorted(r["word"] for r in got) == ["Unknown", "a", "c", "d"]
    assert dict(filled.dtypes)["odd"] == "double"


def test_column_without_gaps_keeps_its_type(rows):
    assert dict(cleaning.fill_numbers(rows([(1,), (2,)], "n int")).dtypes) == {"n": "int"}


def test_nan_counts_as_missing(rows):
    filled = cleaning.fill_numbers(rows([(1.0,), (3.0,), (float("nan"),)], "x double"))
    assert sorted(r[0] for r in filled.collect()) == [1.0, 2.0, 3.0]


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    numbers=st.lists(
        st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6), st.none()),
        min_size=1, max_size=300,
    )
)
def test_median_search_equals_sorting(spark, numbers):
    frame = spark.createDataFrame([(n,) for n in numbers], "x double").repartition(3)
    known = [n for n in numbers if n is not None]
    want = statistics.median(known) if known else None
    assert exact_medians(frame, ["x"]) == {"x": want}


def test_median_search_on_many_and_hot_values(spark):
    frame = spark.range(200_001).select(
        (F.col("id") * 7919 % 200_003).cast("double").alias("spread"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("hot"),
        F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0).alias("two"),
    )
    got = exact_medians(frame, ["spread", "hot", "two"])
    pdf = frame.toPandas()
    assert got == {name: pdf[name].median() for name in pdf.columns}


def test_keys_sort_as_doubles_do(spark):
    inf, tiny = float("inf"), 5e-324
    edges = [2.0**e * f for e in (-1074, -1073, -1023, -1022, -1021, -1, 0, 1, 52, 53, 1023) for f in (1.0, 1.5, 1 + 2**-52, 2 - 2**-52)]
    values = sorted({v * s for v in [*edges, 0.0, 0.1, 1e308, inf, tiny, 3 * tiny] for s in (1, -1)})
    frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    keys = [r[0] for r in ordered_keys(frame, ["x"]).collect()]
    assert keys[-2:] == [None, None] and sorted(keys[:-2]) == keys[:-2]
    assert [abs(k) for k in keys[:-2]] == [struct.unpack(">q", struct.pack(">d", abs(v)))[0] for v in values]


def test_medians_of_whole_numbers_and_passes(spark):
    big = 2**62
    frame = spark.createDataFrame([(big + i,) for i in range(5)] + [(None,)] * 4, "n bigint")
    assert exact_medians(frame, ["n"]) == {"n": big + 2}
    assert exact_medians(frame.where("n < 0"), ["n"]) == {"n": None}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("medians", "")
    exact_medians(frame.repartition(2), ["n"])
    few = len(jobs.getJobIdsForGroup("medians"))
    spark.sparkContext.setJobGroup("many medians", "")
    wide = spark.range(50_000).select(F.expr("CASE WHEN id % 2 = 0 THEN id ELSE id * id * id END AS n"))
    exact_medians(wide.repartition(2), ["n"])
    assert len(jobs.getJobIdsForGroup("many medians")) == few
    spark.sparkContext.setJobGroup("", "")


def test_formats_are_found_from_the_data(rows):
    frame = rows(
        [("13-02-2017", "2017-02-14", "1/2/2020", None), ("01-03-2017", "2017/3/5", "2/2/2020", "x"),
         (None, "gap", "3/4/2020", "y")],
        "a string, b string, c string, d string",
    )
    assert detected_formats(frame, ["a", "b", "d"]) == {
        "a": ("d-M-yyyy",), "b": ("yyyy-MM-dd", "yyyy/M/d"), "d": (),
    }
    with pytest.raises(ValueError, match="column c: day and month can't be told apart"):
        detected_formats(frame, ["c"])
    mixed = rows([("13/1/2020",), ("1/13/2020",)], "c string")
    with pytest.raises(ValueError, match="told apart"):
        detected_formats(mixed, ["c"])
    counts = {r["date_format"]: tuple(r)[2:] for r in format_coverage(frame, ["a"]).collect()}
    assert counts["d-M-yyyy"] == (2, 2, 1) and counts["M-d-yyyy"] == (2, 1, 0) and counts["yyyy-MM-dd"] == (2, 0, 0)


def test_lines_with_the_day_first_are_kept(rows):
    raw = rows([line(order_date="13-02-2017", ship_date="15-02-2017"), line(order_date="01-03-2017", ship_date="x")], RAW)
    assert cleaning.clean_lines(raw).count() == 0
    formats = detected_formats(raw, ["order_date", "ship_date"])
    kept = cleaning.clean_lines(raw, formats).first()
    assert (str(kept["order_date"]), str(kept["ship_date"])) == ("2017-02-13", "2017-02-15")
    assert cleaning.cleaning_summary(raw, {"order_date": ["d-M-yyyy"], "ship_date": []}).first() is not None


def test_duplicates_and_invalid_dates(rows):
    raw = rows(
        [
            line(), line(), line(),
            line(state=None), line(state=None),
            line(state="Unknown"),
            line(order_date=None),
            line(order_date="13/13/2020"),
            line(ship_date="Unknown"),
            line(order_date="2/3/2020", ship_date="2/3/2020"),
        ],
        RAW,
    )
    summary = cleaning.cleaning_summary(raw).first().asDict()
    # the filled state equals the line that says "Unknown"
    assert summary == {
        "rows_read": 10, "duplicates_removed": 4, "invalid_date_rows": 3, "rows_kept": 3,
    }
    clean = cleaning.clean_lines(raw)
    assert clean.count() == 3
    odd = clean.where("delivery_days = 0").first()
    assert (odd["order_date"], odd["year"], odd["quarter"]) == (date(2020, 2, 3), 2020, 1)
    usual = clean.where("state = 'Ohio' and delivery_days = 3").first()
    assert usual["profit_margin_pct"] == 12.34 or usual["profit_margin_pct"] == 12.35
    assert usual["discount_impact"] == 10.0
    assert usual["delivery_speed"] == "Second Class"


def test_zero_sales_has_zero_margin(rows):
    clean = cleaning.clean_lines(rows([line(sales=0.0)], RAW))
    assert clean.first()["profit_margin_pct"] == 0.0


def test_delivery_speed_bounds(rows):
    days = [None, -1, 0, 1, 2, 3, 4, 5]
    frame = rows([(d,) for d in days], "d int").select(delivery_speed(F.col("d")))
    assert [r[0] for r in frame.collect()] == [
        "Unknown", "Same day", "Same day", "First Class", "First Class", "Second Class",
        "Second Class", "Standard",
    ]


def test_tolerant_parsing(rows):
    frame = rows(
        [("2020-02-29", " 3.5 "), ("2020-02-30", "x"), ("7/4/2021", "1e3"), ("Unknown", None),
         ("2020-01-02 10:11:12", "-2")],
        "d string, n string",
    )
    got = frame.select(parsed_date(frame, "d"), parsed_number(frame, "n")).collect()
    assert [r[0] for r in got] == [date(2020, 2, 29), None, date(2021, 7, 4), None, date(2020, 1, 2)]
    assert [r[1] for r in got] == [3.5, None, 1000.0, None, -2.0]


def test_derived_columns_are_kept_when_present(rows):
    frame = rows(
        [("2020-05-01", 3.0, 1.0, 99.0, 1), (None, 1.0, 1.0, 1.0, 1)],
        "order_date string, sales double, profit double, profit_margin_pct double, month int",
    )
    got = dated_lines(frame, "year", "month", "profit_margin_pct").collect()
    assert len(got) == 1
    assert (got[0]["year"], got[0]["month"], got[0]["profit_margin_pct"]) == (2020, 1, 99.0)


def test_missing_columns_are_named(rows):
    with pytest.raises(ValueError, match="columns not found: a, c"):
        require_columns(rows([(1,)], "b int"), {"c", "a", "b"})


def test_headers_round_trip(rows):
    frame = rows([(1.0, "x")], "`Profit Margin %` double, `Sub-Category` string")
    snake = snake_names(frame)
    assert snake.columns == ["profit_margin_pct", "sub_category"]
    assert with_headers(snake).columns == frame.columns


def test_columns_by_kind(rows):
    frame = rows([], "a int, b string, c double, d date, e decimal(5,2)")
    assert numeric_columns(frame) == ["a", "c", "e"]
    assert text_columns(frame) == ["b"]
    kinds = {r["column_name"]: r["kind"] for r in cleaning.column_types(frame).collect()}
    assert kinds == {"a": "number", "b": "text", "c": "number", "d": "date", "e": "number"}


def test_null_counts_and_shape(rows):
    frame = rows([(1, None), (None, None)], "a int, `b c` string")
    assert {tuple(r) for r in cleaning.null_counts(frame).collect()} == {("a", 1), ("b c", 2)}
    assert tuple(cleaning.table_shape(frame).first()) == (2, 2)


def test_wide_lines_are_told_apart_by_fingerprint(spark):
    rows = [(None, "a", 1.0), ("a", None, 1.0), ("a", "", 1.0), ("a", "", 1.0), (None, "a", 1.0), ("a", None, None)]
    rows += [("b", str(i % 7), float(i % 7)) for i in range(70)] + [("c", None, 0.0), ("c", None, -0.0)]
    df = spark.createDataFrame(rows, "half_one string, `odd name` string, line double")

    def listed(out):
        return sorted((str(r[0]), str(r[1]), str(r[2])) for r in out.selectExpr("half_one", "`odd name`", "line + 0.0").collect())

    want = listed(cleaning.distinct_lines(df))
    assert listed(cleaning.distinct_wide_lines(df)) == want and len(want) == 12
    assert listed(cleaning.distinct_wide_lines(df, most=2)) == want
    assert cleaning.distinct_wide_lines(df.limit(0)).count() == 0
