"""Correlation, analysis of variance and the unequal-variance t-test.

Spark reduces the lines to mergeable moment states (see ``moments``); the statistics follow
from those few numbers. Each statistic has a form that takes states, which may come from the lines
or from cells that other statistics share, and one that takes lines. What is undefined - a constant
column, an empty spread - is null, never NaN and never a failed job, except where a test lacks the
groups it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.tails import f_p_value, t_p_value, verdict
from tillwise.operators.moments import (
    all_merged,
    correlation_of,
    count_of,
    mean_of,
    pair_name,
    squares_of,
    state,
    states,
    variance_of,
    varies,
)


def pearson_t(r: Column, n: Column) -> Column:
    """Student-t statistic of a correlation; infinite for a perfect one."""
    rest = 1 - r * r
    perfect = F.signum(r) * F.lit(float("inf"))
    t = r * F.sqrt((n - 2) / F.nullif(rest, F.lit(0)))
    return F.when(n > 2, F.when(rest <= 0, perfect).otherwise(t))


def correlations(held: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per pair of columns, n and r, from a row with the pairs' states."""
    structs = [
        F.struct(
            F.lit(x).alias("column_x"),
            F.lit(y).alias("column_y"),
            count_of(pair_name(x, y)).alias("n"),
            correlation_of(pair_name(x, y)).alias("r"),
        )
        for x, y in pairs
    ]
    return held.select(F.inline(F.array(*structs)))


def tested_correlations(
    held: DataFrame, pairs: Sequence[tuple[str, str]], alpha: float = 0.05
) -> DataFrame:
    """Correlations with the two-sided test of no linear relation, from a row with the pairs' states."""
    tested = correlations(held, pairs).withColumn("t_stat", pearson_t(F.col("r"), F.col("n")))
    tested = tested.withColumn("df", F.col("n") - 2)
    tested = tested.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("df")))
    return tested.withColumn("verdict", verdict(F.col("p_value"), alpha))


def correlation_tests(
    lines: DataFrame, pairs: Sequence[tuple[str, str]], alpha: float = 0.05
) -> DataFrame:
    return tested_correlations(lines.agg(*states(pairs)), pairs, alpha)


def matrix_pairs(columns: Sequence[str]) -> list[tuple[str, str | None]]:
    """The pairs whose states make a correlation matrix; a column alone stands on the diagonal."""
    return [*((x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]), *((x, None) for x in columns)]


def matrix_cells(held: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise correlations as (column_x, column_y, r) rows, mirrored, from a row with the states of
    ``matrix_pairs``. The diagonal is one, or null for a constant column."""
    cells = []
    for x, y in matrix_pairs(columns):
        if y is None:
            cells.append((x, x, F.when(varies(pair_name(x)), F.lit(1.0))))
        else:
            r = correlation_of(pair_name(x, y))
            cells += [(x, y, r), (y, x, r)]
    structs = [
        F.struct(F.lit(x).alias("column_x"), F.lit(y).alias("column_y"), r.alias("r"))
        for x, y, r in cells
    ]
    return held.select(F.inline(F.array(*structs)))


def correlation_matrix(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    return matrix_cells(lines.agg(*states(matrix_pairs(columns))), columns)


def means_of_groups(held: DataFrame, key: str, name: str) -> DataFrame:
    """Mean per key, best first, from a row with a state for each key."""
    means = held.select(key, mean_of(name).alias("mean"))
    return means.orderBy(F.desc_nulls_last("mean"), F.asc_nulls_last(key))


def group_states(lines: DataFrame, key: str, value: str) -> DataFrame:
    return lines.groupBy(key).agg(*states([(value, None)]))


def group_means(lines: DataFrame, key: str, value: str) -> DataFrame:
    return means_of_groups(group_states(lines, key, value), key, pair_name(value))


def with_f_statistic(sums: DataFrame) -> DataFrame:
    """Adds degrees of freedom and F to rows of groups, total_n, between_ss, within_ss.

    Fewer than two groups is an error, raised when the result is computed.
    """
    degrees = sums.withColumns(
        {"df_between": F.col("groups") - 1, "df_within": F.col("total_n") - F.col("groups")}
    )
    spread = F.col("within_ss") / F.nullif(F.col("df_within"), F.lit(0))
    f = F.col("between_ss") / F.nullif(F.col("df_between"), F.lit(0)) / F.nullif(spread, F.lit(0))
    too_few = F.raise_error(F.lit("analysis of variance needs two groups")).cast("double")
    return degrees.withColumn("f_stat", F.when(F.col("groups") < 2, too_few).otherwise(f))


def variance_parts(name: str, kept: str = "true") -> list[Column]:
    """Groups with values, their values, and the spreads between and inside them, as aggregates over
    rows with a state each, of which the condition ``kept`` keeps some. Merging states without inner
    spread leaves the spread of the means."""
    counted = f"({kept}) AND {name}.n > 0"
    flat = (
        f"named_struct('n', {name}.n, 'mean_x', {name}.mean_x, 'mean_y', 0D, 'square_x', 0D, 'square_y', 0D,"
        " 'product', 0D)"
    )
    return [
        F.count(F.when(F.expr(counted), 1)).alias("groups"),
        F.coalesce(F.sum(F.when(F.expr(counted), F.col(name)["n"])), F.lit(0)).alias("total_n"),
        all_merged(f"if({counted}, {flat}, null)")["square_x"].alias("between_ss"),
        F.coalesce(F.sum(F.when(F.expr(counted), squares_of(name))), F.lit(0.0)).alias("within_ss"),
    ]


def anova_of_groups(held: DataFrame, name: str, alpha: float = 0.05) -> DataFrame:
    """One-way analysis of variance, as one row, from a row with a state for each group."""
    result = with_f_statistic(held.agg(*variance_parts(name)))
    p = f_p_value(F.col("f_stat"), F.col("df_between"), F.col("df_within"))
    return result.withColumn("p_value", p).withColumn("verdict", verdict(F.col("p_value"), alpha))


def anova(lines: DataFrame, key: str, value: str, alpha: float = 0.05) -> DataFrame:
    """One-way analysis of variance of ``value`` over the groups of ``key``."""
    return anova_of_groups(group_states(lines, key, value), pair_name(value), alpha)


def split_moments(first: str, second: str) -> list[Column]:
    """n, mean and variance of two subsets from their states."""
    return [
        column.alias(f"{side}_{what}")
        for side, name in (("first", first), ("second", second))
        for what, column in (("n", count_of(name)), ("mean", mean_of(name)), ("var", variance_of(name)))
    ]


def welch_statistics(moments: DataFrame) -> DataFrame:
    """Adds t_stat and df to rows holding the moments of two subsets."""
    a = F.col("first_var") / F.nullif(F.col("first_n"), F.lit(0))
    b = F.col("second_var") / F.nullif(F.col("second_n"), F.lit(0))
    gap = F.col("first_mean") - F.col("second_mean")
    squares = a * a / F.nullif(F.col("first_n") - 1, F.lit(0)) + b * b / F.nullif(
        F.col("second_n") - 1, F.lit(0)
    )
    empty = (F.col("first_n") == 0) | (F.col("second_n") == 0)
    t = gap / F.nullif(F.sqrt(a + b), F.lit(0))
    no_values = F.raise_error(F.lit("both groups of the t-test need values")).cast("double")
    return moments.withColumns(
        {
            "t_stat": F.when(empty, no_values).otherwise(t),
            "df": (a + b) * (a + b) / F.nullif(squares, F.lit(0)),
        }
    )


def welch_of_states(held: DataFrame, first: str, second: str, alpha: float = 0.05) -> DataFrame:
    """Two-sided t-test with unequal variances, as one row, from a row with the states of two subsets."""
    tested = welch_statistics(held.select(*split_moments(first, second))).withColumn(
        "p_value", t_p_value(F.col("t_stat"), F.col("df"))
    )
    return tested.withColumn("verdict", verdict(F.col("p_value"), alpha))


def welch_test(
    lines: DataFrame, value: str, first: str, second: str, alpha: float = 0.05
) -> DataFrame:
    """The test of two subsets of the lines, given as conditions in SQL text, from one pass."""
    held = lines.agg(
        state(value, where=first).alias("first_part"), state(value, where=second).alias("second_part")
    )
    return welch_of_states(held, "first_part", "second_part", alpha)


def confidence_of_groups(held: DataFrame, key: str, name: str, z: float = 1.96) -> DataFrame:
    """Mean, count, spread and half-width of the 95 % interval per key, best first."""
    grouped = held.select(
        key, mean_of(name).alias("mean"), count_of(name).alias("count"), F.sqrt(variance_of(name)).alias("std")
    )
    sem = F.col("std") / F.sqrt(F.nullif(F.col("count"), F.lit(0)))
    return (
        grouped.withColumn("sem", sem)
        .withColumn("ci95", F.coalesce(F.lit(z) * F.col("sem"), F.lit(0.0)))
        .orderBy(F.desc_nulls_last("mean"), F.asc_nulls_last(key))
    )


def mean_confidence(lines: DataFrame, key: str, value: str, z: float = 1.96) -> DataFrame:
    return confidence_of_groups(group_states(lines, key, value), key, pair_name(value), z)
