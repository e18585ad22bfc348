from __future__ import annotations

import math
from datetime import date

import numpy as np
import pytest

from tillwise.operators import sketches
from tillwise.operators.hypothesis import (
    anova,
    correlation_matrix,
    correlation_tests,
    mean_confidence,
    pearson_t,
    welch_test,
)
from tillwise.operators.moments import correlation_of, count_of, mean_of, pair_name, rolled_up, states, variance_of
from tillwise.plans import insights, significance
from pyspark.sql import functions as F


def test_constant_column_has_no_correlation(rows):
    frame = rows([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    got = {(r["column_x"], r["column_y"]): r["r"] for r in correlation_matrix(frame, ["a", "b"]).collect()}
    assert got == {("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}
    tested = correlation_tests(frame, [("a", "b")]).first()
    assert (tested["r"], tested["t_stat"], tested["p_value"], tested["verdict"]) == (None,) * 4


def test_perfect_correlation(rows):
    frame = rows([(float(i), -2.0 * i) for i in range(5)], "a double, b double")
    tested = correlation_tests(frame, [("a", "b")]).first()
    assert tested["r"] == pytest.approx(-1.0)
    assert tested["p_value"] == pytest.approx(0.0, abs=1e-12)
    assert tested["verdict"] == "reject"


def test_t_of_a_correlation(rows):
    frame = rows([(1.0, 9), (-1.0, 9), (0.6, 18), (0.5, 2), (None, 9)], "r double, n int")
    got = [r[0] for r in frame.select(pearson_t(F.col("r"), F.col("n"))).collect()]
    assert got == [math.inf, -math.inf, pytest.approx(3.0), None, None]


def test_correlation_uses_complete_pairs(rows):
    data = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, None), (None, 9.0), (6.0, 6.0)]
    frame = rows(data, "a double, b double")
    full = [(a, b) for a, b in data if a is not None and b is not None]
    tested = correlation_tests(frame, [("a", "b")]).first()
    assert tested["n"] == 4
    assert tested["r"] == pytest.approx(np.corrcoef(*zip(*full))[0, 1])


def by_hand_anova(groups):
    groups = [g for g in groups if g]
    everything = [x for g in groups for x in g]
    grand = sum(everything) / len(everything)
    ssb = sum(len(g) * (sum(g) / len(g) - grand) ** 2 for g in groups)
    ssw = sum(sum((x - sum(g) / len(g)) ** 2 for x in g) for g in groups)
    return (ssb / (len(groups) - 1)) / (ssw / (len(everything) - len(groups)))


def test_anova_skips_empty_groups_and_keeps_null_keys(rows):
    groups = {"a": [1.0, 2.0, 4.0], "b": [3.0], None: [8.0, 9.5], "empty": [None, None]}
    frame = rows([(k, x) for k, xs in groups.items() for x in xs], "g string, x double")
    got = anova(frame, "g", "x").first()
    assert (got["groups"], got["total_n"], got["df_between"], got["df_within"]) == (3, 6, 2, 3)
    want = by_hand_anova([[1.0, 2.0, 4.0], [3.0], [8.0, 9.5]])
    assert got["f_stat"] == pytest.approx(want)


def test_anova_survives_a_large_common_offset(rows):
    base = [[0.1, 0.2, 0.4], [0.3, 0.5, 0.25], [0.9, 1.1, 0.7]]
    frame = rows(
        [(str(i), 1.0e7 + x) for i, g in enumerate(base) for x in g], "g string, x double"
    )
    assert anova(frame, "g", "x").first()["f_stat"] == pytest.approx(by_hand_anova(base), rel=1e-6)


def test_anova_without_spread_is_undefined(rows):
    frame = rows([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    got = anova(frame, "g", "x").first()
    assert (got["f_stat"], got["p_value"], got["verdict"]) == (None, None, None)


def test_anova_needs_two_groups(rows):
    with pytest.raises(Exception, match="needs two groups"):
        anova(rows([("a", 1.0), ("a", 2.0)], "g string, x double"), "g", "x").collect()


def test_welch_by_hand(rows):
    first, second = [3.0, 4.0, 8.0, 1.0], [10.0, 2.0, 7.5]
    frame = rows(
        [(0.2, x) for x in first] + [(0.0, x) for x in second] + [(-0.1, 99.0)],
        "discount double, m double",
    )
    got = welch_test(frame, "m", "discount > 0", "discount = 0").first()
    a, b = np.var(first, ddof=1) / 4, np.var(second, ddof=1) / 3
    assert got["t_stat"] == pytest.approx((np.mean(first) - np.mean(second)) / math.sqrt(a + b))
    assert got["df"] == pytest.approx((a + b) ** 2 / (a * a / 3 + b * b / 2))
    assert got["first_n"] + got["second_n"] == 7
    assert 0 < got["p_value"] < 1


def test_welch_edge_cases(rows):
    same = rows([(1.0, 5.0), (1.0, 5.0), (0.0, 5.0), (0.0, 5.0)], "d double, m double")
    got = welch_test(same, "m", "d > 0", "d = 0").first()
    assert (got["t_stat"], got["df"], got["p_value"]) == (None, None, None)
    single = rows([(1.0, 5.0), (0.0, 5.0), (0.0, 6.0)], "d double, m double")
    assert welch_test(single, "m", "d > 0", "d = 0").first()["p_value"] is None
    one_sided = rows([(1.0, 5.0), (1.0, 6.0)], "d double, m double")
    with pytest.raises(Exception, match="both groups"):
        welch_test(one_sided, "m", "d > 0", "d = 0").collect()


def test_single_value_has_no_interval(rows):
    frame = rows([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, x double")
    got = [r.asDict() for r in mean_confidence(frame, "g", "x").collect()]
    assert [r["g"] for r in got] == ["b", "a"]
    assert (got[1]["std"], got[1]["sem"], got[1]["ci95"]) == (None, None, 0.0)
    assert got[0]["ci95"] == pytest.approx(1.96 * math.sqrt(2) / math.sqrt(2))


LINES = (
    "order_date date, sales double, profit double, discount double, region string, segment string"
)


def test_months_tie_to_the_earlier_one(rows):
    days = [date(2020, 3, 1), date(2020, 1, 1), date(2021, 1, 1), date(2020, 2, 1)]
    sales = [5.0, 9.0, 9.0, 5.0]
    frame = rows([(d, s, 1.0, 0.0, "E", "H") for d, s in zip(days, sales)], LINES)
    got = {r["place"]: (r["year"], r["month_label"]) for r in significance.best_and_worst_month(frame).collect()}
    assert got == {"best": (2020, "Jan"), "worst": (2020, "Feb")}


def test_threshold_insight_needs_both_sides(rows):
    data = [
        (date(2020, 1 + i % 3, 1), 10.0 + i, 1.0 + (i % 4), 0.1 * (i % 2), "EW"[i % 2], "HC"[i // 2 % 2])
        for i in range(12)
    ]
    frame = rows(data, LINES)
    default = insights.business_insights(frame).collect()
    assert [r["insight_no"] for r in default] == [1, 2, 3, 4, 5, 7]
    lower = insights.business_insights(frame, 0.1).collect()
    assert [r["insight_no"] for r in lower] == [1, 2, 3, 4, 5, 6, 7]
    assert all(r["message"] for r in lower)
    assert "10% or more" in lower[5]["message"]


def test_insights_agree_with_the_single_statistics(small_lines):
    found = {r["insight_no"]: r for r in insights.business_insights(small_lines, 0.05).collect()}
    tests = {r["column_x"]: r for r in significance.correlation_analysis(small_lines).collect()}
    spread = significance.regional_anova(small_lines).first()
    split = significance.discount_ttest(small_lines).first()
    assert found[1]["statistic"] == pytest.approx(tests["sales"]["r"])
    assert found[2]["p_value"] == pytest.approx(tests["discount"]["p_value"])
    assert found[3]["statistic"] == pytest.approx(spread["f_stat"])
    assert found[7]["statistic"] == pytest.approx(split["t_stat"])


def test_merged_moments_are_those_of_the_whole(spark, rows):
    pick = np.random.default_rng(6)
    x = 1e9 + pick.normal(0, 1, 3000)
    y = np.where(pick.random(3000) < 0.2, np.nan, 0.5 * x + pick.normal(0, 1, 3000))
    group = [None if i % 7 == 0 else f"g{i % 3}" for i in range(3000)]
    data = [(g, i % 200, float(a), None if np.isnan(b) else float(b)) for i, (g, a, b) in enumerate(zip(group, x, y))]
    frame = rows(data, "g string, cell int, x double, y double")
    both, alone = pair_name("x", "y"), pair_name("x")
    cells = frame.groupBy("g", "cell").agg(*states([("x", "y"), ("x", None)]))
    for keys in ([], ["g"]):
        got = rolled_up(cells, keys, [both, alone]).select(
            *keys, count_of(both).alias("n"), correlation_of(both).alias("r"), mean_of(alone).alias("mean"),
            variance_of(alone).alias("variance"),
        )
        for row in got.collect():
            held = [i for i, g in enumerate(group) if not keys or g == row["g"]]
            full = [i for i in held if not np.isnan(y[i])]
            assert row["n"] == len(full)
            assert row["r"] == pytest.approx(np.corrcoef(x[full], y[full])[0, 1], rel=1e-6)
            assert row["mean"] == pytest.approx(np.mean(x[held]), rel=1e-14)
            assert row["variance"] == pytest.approx(np.var(x[held], ddof=1), rel=1e-6)
        assert got.count() == (4 if keys else 1)


def test_a_constant_stays_constant_when_merged(rows):
    frame = rows([(i % 30, 0.1, float(i), None) for i in range(900)], "cell int, x double, y double, z double")
    pairs = [("x", "y"), ("x", None), ("z", None)]
    cells = frame.groupBy("cell").agg(*states(pairs))
    names = [pair_name(*p) for p in pairs]
    got = rolled_up(cells, [], names).select(
        correlation_of(names[0]), variance_of(names[1]), count_of(names[2]), mean_of(names[2]), variance_of(names[2])
    )
    assert tuple(got.first()) == (None, 0.0, 0, None, None)
    empty = rolled_up(cells.where("false"), [], names).select(count_of(names[0]), correlation_of(names[0]))
    assert tuple(empty.first()) == (0, None)


def test_statistics_from_shared_cells_are_those_of_the_lines(small_lines):
    cells = significance.statistic_cells(small_lines, 0.05)
    shared = significance.tables_of_cells(cells) | {"business_insights": insights.insights_of_cells(cells, 0.05)}
    alone = {
        name: getattr(significance, name)(small_lines)
        for name in shared
        if name not in ("discount_split_means", "business_insights")
    }
    alone["discount_split_means"] = significance.discount_split_means(small_lines, 0.05)
    alone["business_insights"] = insights.business_insights(small_lines, 0.05)
    assert len(shared) == 11
    for name, table in shared.items():
        ours, theirs = (
            sorted((r.asDict() for r in df.select(table.columns).collect()), key=lambda r: str(sorted((k, v) for k, v in r.items() if not isinstance(v, float))))
            for df in (table, alone[name])
        )
        assert len(ours) == len(theirs) > 0
        for a, b in zip(ours, theirs):
            for column, value in b.items():
                same = pytest.approx(value, rel=1e-9, abs=1e-12) if isinstance(value, float) else value
                assert a[column] == same, (name, column)


def test_distinct_sketches_merge_to_any_group(spark, small_lines):
    keys, counted = ["region", "segment", "year"], ["order_id", "customer_id"]
    cells = sketches.distinct_cells(small_lines, keys, counted)
    for group in ([], ["region"], ["segment", "year"]):
        merged = sketches.merged_cells(cells, group, counted)
        got = sketches.distinct_counts(merged, counted).collect()
        exact = small_lines.groupBy(*group).agg(*[F.count_distinct(c).alias(c) for c in counted]).collect()
        want = {tuple(r[k] for k in group): r for r in exact}
        assert len(got) == len(want)
        for row in got:
            for name in counted:
                right = want[tuple(row[k] for k in group)][name]
                assert abs(row[name] - right) <= 4 * sketches.standard_error() * right + 1
    none = sketches.distinct_cells(small_lines.where("false"), [], ["order_id"])
    assert sketches.distinct_counts(none, ["order_id"]).first()[0] == 0
