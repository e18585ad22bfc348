"""Statistics over the clean table: correlations, tests, segments, seasonality.

Margins are used as stored (two decimals, set at cleaning) and computed only if absent. Each
statistic can be had from the lines alone; ``statistic_tables`` gives all of them from one table of
cells per region, segment, year and month, for which the lines are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.measures import exact_sum, named, total
from tillwise.operators.derive import dated_lines
from tillwise.operators.hypothesis import (
    anova,
    anova_of_groups,
    confidence_of_groups,
    correlation_matrix,
    correlation_tests,
    group_means,
    matrix_cells,
    matrix_pairs,
    mean_confidence,
    means_of_groups,
    tested_correlations,
    welch_of_states,
    welch_test,
)
from tillwise.operators.keep import keep_small
from tillwise.operators.moments import count_of, mean_of, pair_name, rolled_up, state, states
from tillwise.schema import require_columns

MARGIN = "profit_margin_pct"
TESTED_PAIRS = (("discount", MARGIN), ("sales", "profit"))
HIGH_DISCOUNT = 0.20
#: A negative discount is neither.
DISCOUNTED, UNDISCOUNTED = "discount > 0", "discount = 0"
MARGIN_COLUMNS = ("discount", MARGIN, "sales", "profit")
SALES_COLUMNS = ("sales", "profit", "discount", "quantity")
CELL_KEYS = ("region", "segment", "year", "month")
#: States of the margin in parts of the lines, besides those of pairs of columns.
SUBSETS = ("discounted_part", "undiscounted_part", "high_part", "low_part")


def statistic_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """Dated lines with margin and calendar; ``keys`` are the grouping columns needed."""
    require_columns(lines, {"order_date", "sales", "profit", "discount", *keys})
    return dated_lines(lines, MARGIN, "year", "month")


def correlation_analysis(lines: DataFrame, alpha: float = 0.05) -> DataFrame:
    return correlation_tests(statistic_lines(lines), TESTED_PAIRS, alpha)


def margin_correlation_matrix(lines: DataFrame) -> DataFrame:
    return correlation_matrix(statistic_lines(lines), MARGIN_COLUMNS)


def sales_correlation_matrix(lines: DataFrame) -> DataFrame:
    return correlation_matrix(lines, SALES_COLUMNS)


def regional_anova(lines: DataFrame, alpha: float = 0.05) -> DataFrame:
    return anova(statistic_lines(lines, "region"), "region", MARGIN, alpha)


def region_margin_means(lines: DataFrame) -> DataFrame:
    return group_means(statistic_lines(lines, "region"), "region", MARGIN)


def discount_ttest(lines: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Margins of discounted against undiscounted lines; a negative discount is neither."""
    return _ttest_columns(
        welch_test(statistic_lines(lines), MARGIN, DISCOUNTED, UNDISCOUNTED, alpha)
    )


def _ttest_columns(tested: DataFrame) -> DataFrame:
    return tested.select(
        F.col("first_mean").alias("discounted_avg_margin"),
        F.col("second_mean").alias("non_discounted_avg_margin"),
        F.col("first_n").alias("discounted_count"),
        F.col("second_n").alias("non_discounted_count"),
        "t_stat",
        "df",
        "p_value",
        "verdict",
    )


def discount_split_means(lines: DataFrame, threshold: float = HIGH_DISCOUNT) -> DataFrame:
    """Mean margin at or above a discount and below it; null for an empty side."""
    return _split_columns(statistic_lines(lines).agg(*_subset_states(threshold)))


def _subset_states(threshold: float) -> list[Column]:
    at = f"cast({threshold!r} as double)"
    parts = (DISCOUNTED, UNDISCOUNTED, f"discount >= {at}", f"discount < {at}")
    return [state(MARGIN, where=part).alias(name) for name, part in zip(SUBSETS, parts)]


def _split_columns(held: DataFrame) -> DataFrame:
    return held.select(
        mean_of("high_part").alias("high_discount_margin"),
        mean_of("low_part").alias("low_discount_margin"),
        count_of("high_part").alias("high_discount_count"),
        count_of("low_part").alias("low_discount_count"),
    )


def segment_profitability(lines: DataFrame) -> DataFrame:
    return mean_confidence(statistic_lines(lines, "segment"), "segment", MARGIN)


def month_label(month: Column) -> Column:
    """Three-letter English month name."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def revenue_seasonality(lines: DataFrame) -> DataFrame:
    monthly = statistic_lines(lines).groupBy("year", "month").agg(
        *named(revenue=total("sales"))
    )
    return _labelled(monthly)


def _labelled(monthly: DataFrame) -> DataFrame:
    return monthly.withColumn("month_label", month_label(F.col("month"))).orderBy("year", "month")


def best_and_worst_month(lines: DataFrame) -> DataFrame:
    """The strongest and the weakest month, the earlier one on a tie."""
    return extreme_months(revenue_seasonality(lines))


def extreme_months(monthly: DataFrame) -> DataFrame:
    shown = F.struct("year", "month", "month_label", "revenue")
    best = F.max_by(shown, F.struct("revenue", -F.col("year"), -F.col("month")))
    worst = F.min_by(shown, F.struct("revenue", "year", "month"))
    extremes = monthly.agg(best.alias("best"), worst.alias("worst"))
    both = F.array(
        F.struct(F.lit("best").alias("place"), F.col("best").alias("at")),
        F.struct(F.lit("worst").alias("place"), F.col("worst").alias("at")),
    )
    rows = extremes.select(F.inline(both))
    return rows.where(F.col("at").isNotNull()).select("place", "at.*")


def cell_pairs(lines: DataFrame) -> list[tuple[str, str | None]]:
    """The pairs of columns whose states all statistics together need; those with quantity only where
    the lines have it."""
    pairs = dict.fromkeys([*TESTED_PAIRS, *matrix_pairs(MARGIN_COLUMNS), *matrix_pairs(SALES_COLUMNS)])
    known = {*MARGIN_COLUMNS, *lines.columns}
    return [(x, y) for x, y in pairs if x in known and (y is None or y in known)]


def statistic_cells(lines: DataFrame, threshold: float = HIGH_DISCOUNT) -> DataFrame:
    """The states of all pairs and subsets and the revenue per region, segment, year and month. What
    isn't used of them isn't computed."""
    dated = statistic_lines(lines, "region", "segment")
    return dated.groupBy(*CELL_KEYS).agg(
        *states(cell_pairs(lines)), *_subset_states(threshold), *named(revenue=total("sales"))
    )


def statistic_tables(lines: DataFrame, threshold: float = HIGH_DISCOUNT) -> dict[str, DataFrame]:
    """All statistics from one reading of the lines."""
    return tables_of_cells(keep_small(statistic_cells(lines, threshold)))


def tables_of_cells(cells: DataFrame) -> dict[str, DataFrame]:
    names = [c for c in cells.columns if c not in (*CELL_KEYS, "revenue")]
    whole = keep_small(rolled_up(cells, [], names))
    regions = rolled_up(cells, ["region"], [pair_name(MARGIN)])
    segments = rolled_up(cells, ["segment"], [pair_name(MARGIN)])
    monthly = _labelled(
        cells.groupBy("year", "month").agg(*named(revenue=f"coalesce({exact_sum('revenue')}, 0D)"))
    )
    found = {
        "correlation_analysis": tested_correlations(whole, TESTED_PAIRS),
        "margin_correlation_matrix": matrix_cells(whole, MARGIN_COLUMNS),
        "regional_anova": anova_of_groups(regions, pair_name(MARGIN)),
        "region_margin_means": means_of_groups(regions, "region", pair_name(MARGIN)),
        "discount_ttest": _ttest_columns(welch_of_states(whole, SUBSETS[0], SUBSETS[1])),
        "discount_split_means": _split_columns(whole),
        "segment_profitability": confidence_of_groups(segments, "segment", pair_name(MARGIN)),
        "revenue_seasonality": monthly,
        "best_and_worst_month": extreme_months(monthly),
    }
    if pair_name("quantity") in names:
        found["sales_correlation_matrix"] = matrix_cells(whole, SALES_COLUMNS)
    return found
