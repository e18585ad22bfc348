from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwise.functions.measures import (
    change,
    exact_mean,
    exact_sum,
    margin_fraction,
    margin_pct,
    named,
    ratio,
    sql_change_pct,
    sql_margin_pct,
    total,
)
from tillwise.functions.rounding import half_even, half_up
from tillwise.functions.tails import f_upper, student_t_two_sided, verdict

SLOW = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def values(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "x double")


def test_ties(spark):
    got = values(spark, [0.125, -0.125, 2.5, 0.375, 1.005, -0.004, None]).select(
        *named(even=half_even("x", 2), up=half_up("x", 2))
    )
    even, up = zip(*got.collect())
    assert even[:4] == (0.12, -0.12, 2.5, 0.38)
    assert up[:4] == (0.13, -0.13, 2.5, 0.38)
    # 1.005 is stored just below the tie
    assert even[4] == up[4] == 1.0
    assert even[5] == 0 and up[5] == 0
    assert even[6] is None and up[6] is None


@SLOW
@given(numbers=st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=200))
def test_half_even_equals_numpy(spark, numbers):
    got = values(spark, numbers).selectExpr(half_even("x", 2)).collect()
    assert [row[0] for row in got] == list(np.round(np.array(numbers), 2))


@SLOW
@given(ten_thousandths=st.lists(st.integers(-(10**12), 10**12), min_size=1, max_size=200))
def test_exact_sum_is_exact(spark, ten_thousandths):
    exact = float(Decimal(sum(ten_thousandths)) / 10000)
    frame = values(spark, [n / 10000 for n in ten_thousandths]).repartition(3)
    assert frame.agg(F.expr(exact_sum("x"))).first()[0] == exact


def test_exact_sum_beyond_long_of_ten_thousandths(spark):
    big = 4.0e14
    frame = spark.range(1000).select(F.lit(big).alias("x"))
    assert frame.agg(F.expr(exact_sum("x"))).first()[0] == 1000 * big


def test_empty_sums(spark):
    nothing = values(spark, [None, None])
    got = nothing.agg(*named(a=exact_sum("x"), b=total("x"), c=exact_mean("x"))).first()
    assert tuple(got) == (None, 0.0, None)


def test_margins_differ_by_unit_and_null_rule(rows):
    frame = rows(
        [(200.0, 25.0), (0.0, 5.0), (None, 5.0), (80.0, None)], "sales double, profit double"
    )
    rules = (margin_pct, margin_fraction, sql_margin_pct)
    got = frame.selectExpr(*[rule("profit", "sales") for rule in rules]).collect()
    assert [tuple(r) for r in got] == [
        (12.5, 0.125, 12.5),
        (0.0, 0.0, 0.0),
        (0.0, 0.0, None),
        (0.0, 0.0, None),
    ]


def test_growth_is_null_when_undefined(rows):
    frame = rows([(5.0, 4.0), (5.0, 0.0), (0.0, 0.0), (5.0, None)], "now double, before double")
    got = frame.selectExpr(change("now", "before"), sql_change_pct("now", "before")).collect()
    assert [tuple(r) for r in got] == [(0.25, 25.0), (None, None), (None, None), (None, None)]


def test_ratio_of_zero_orders(rows):
    frame = rows([(5.0, 0), (6.0, 4)], "s double, n int")
    assert [r[0] for r in frame.selectExpr(ratio("s", "n")).collect()] == [0.0, 1.5]


@SLOW
@given(cents=st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=100))
def test_half_up_of_thousandths(spark, cents):
    # n/8 is stored exactly, so the decimal rule applies to the letter
    numbers = [c / 8 for c in cents]
    got = values(spark, numbers).selectExpr(half_up("x", 2)).collect()
    want = [float(Decimal(n).quantize(Decimal("0.01"), ROUND_HALF_UP)) for n in numbers]
    assert [r[0] for r in got] == want


@pytest.mark.parametrize("t", [0.0, 0.3, 1.0, 2.5, 12.7])
def test_t_tail_closed_forms(t):
    assert student_t_two_sided(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-12)
    assert student_t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
    assert student_t_two_sided(-t, 7) == student_t_two_sided(t, 7)
    assert student_t_two_sided(t, 9) == pytest.approx(f_upper(t * t, 1, 9), abs=1e-12)
    normal = math.erfc(t / math.sqrt(2))
    assert student_t_two_sided(t, 6e11) == pytest.approx(normal, abs=1e-7)


@pytest.mark.parametrize("f", [0.1, 1.0, 3.3, 40.0])
@pytest.mark.parametrize("n", [1, 5, 30, 1e6, 1e11])
def test_f_tail_closed_form(f, n):
    assert f_upper(f, 2, n) == pytest.approx(math.exp(-n / 2 * math.log1p(2 * f / n)), rel=1e-6)


def test_published_critical_values():
    assert student_t_two_sided(2.2281388520, 10) == pytest.approx(0.05, abs=1e-9)
    assert student_t_two_sided(1.9839715185, 100) == pytest.approx(0.05, abs=1e-9)
    assert f_upper(4.1028210, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_upper(2.4628, 4, 100) == pytest.approx(0.05, abs=1e-4)


def test_tails_of_undefined_tests():
    assert student_t_two_sided(None, 5) is None
    assert student_t_two_sided(1.0, 0) is None
    assert student_t_two_sided(math.inf, 5) == 0.0
    assert f_upper(2.0, 0, 5) is None
    assert f_upper(math.nan, 2, 5) is None
    assert f_upper(0.0, 2, 5) == 1.0


def test_verdict(rows):
    frame = rows([(0.049,), (0.05,), (None,)], "p double")
    assert [r[0] for r in frame.select(verdict(F.col("p"))).collect()] == [
        "reject",
        "fail to reject",
        None,
    ]


@pytest.mark.parametrize("t", [0.5, 5.0, 10.0, 20.0, 30.0])
def test_t_tail_with_very_many_degrees_of_freedom(t):
    # The first term by which Student's tail differs from the normal one falls with 1 / df.
    normal = math.erfc(t / math.sqrt(2))
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    expected = normal + 2 * density * (t**3 + t) / 4 / 1e12
    assert student_t_two_sided(t, 1e12) == pytest.approx(expected, rel=1e-9)


def test_exact_sum_keeps_small_fractions_and_leaves_out_nan(spark):
    small = spark.range(10_000).selectExpr("0.00004D AS x")
    assert small.agg(F.expr(exact_sum("x"))).first()[0] == pytest.approx(0.4, rel=1e-12)
    halves = spark.range(1000).selectExpr("41.91365D AS x")
    assert halves.agg(F.expr(exact_sum("x"))).first()[0] == pytest.approx(41913.65, rel=1e-12)
    odd = spark.sql("SELECT explode(array(1.5D, double('NaN'), null)) AS x")
    row = odd.agg(*named(a=exact_sum("x"), b=exact_mean("x"))).first()
    assert (row["a"], row["b"]) == (1.5, 1.5)
