"""Group totals, pivots, top-k and growth: the building blocks of the reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.measures import exact_sum, margin_fraction, named, sql_name, total
from tillwise.operators.keep import keep_small


def group_totals(
    lines: DataFrame,
    keys: Sequence[str],
    sales: str = "total_sales",
    profit: str = "total_profit",
    orders: str | None = "order_count",
    **more: str,
) -> DataFrame:
    """Sales, profit and distinct orders per key; null keys form a group of their own.

    Counting distinct orders first groups by key and order, on the map side as well, so
    a key that holds a third of the lines is spread over all tasks by order.
    """
    measures = {sales: total("sales"), profit: total("profit")}
    if orders:
        measures[orders] = "count(distinct order_id)"
    return lines.groupBy(*keys).agg(*named(**measures, **more))


def top_rows(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows; each task keeps ``k`` and only those are merged."""
    return df.orderBy(*order).limit(k)


def top_and_bottom(
    df: DataFrame, k: int, best: Sequence[Column], worst: Sequence[Column], label: str
) -> DataFrame:
    """The ``k`` best and ``k`` worst rows, labelled; a row can be in both."""
    upper = top_rows(df, k, *best).select(F.lit(f"Top {k}").alias(label), "*")
    lower = top_rows(df, k, *worst).select(F.lit(f"Bottom {k}").alias(label), "*")
    return upper.unionByName(lower)


def previous(value: str, order: Sequence[str], within: Sequence[str] = ()) -> Column:
    """The value of the row before, per group. Only for rows already aggregated to periods."""
    return F.lag(value).over(Window.partitionBy(*within).orderBy(*order))


def column_slug(text: str) -> str:
    """A value as the leading part of a column name."""
    return re.sub(r"[^0-9a-z]+", "_", text.lower()).strip("_")


def text_literal(text: str) -> str:
    """A string as a SQL literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def cell_totals(lines: DataFrame, key: str, on: str) -> DataFrame:
    """Sales and profit per (key, on): what every cross-tab is made of."""
    sums = named(sales=exact_sum("sales"), profit=exact_sum("profit"))
    return lines.groupBy(key, on).agg(*sums)


def conditional_totals(lines: DataFrame, key: str, on: str, values: Sequence[str]) -> DataFrame:
    """Per key, sales and profit of each listed value of ``on`` and over all of them.

    The conditions are evaluated on cell totals, so a line updates two sums and not two
    for every listed value.
    """
    measures = {}
    slugs = [column_slug(value) for value in values]
    if len({*slugs, "total"}) <= len(slugs):
        raise ValueError(f"values of {on} that give the same column names: {sorted(slugs)}")
    on_name = sql_name(on)
    for value in values:
        for name in ("sales", "profit"):
            part = f"if({on_name} = {text_literal(value)}, {name}, 0D)"
            measures[f"{column_slug(value)}_{name}"] = exact_sum(part)
    measures["total_sales"] = exact_sum("sales")
    measures["total_profit"] = exact_sum("profit")
    return cell_totals(lines, key, on).groupBy(key).agg(*named(**measures))


def distinct_values(cells: DataFrame, column: str) -> list[str]:
    """Sorted values of a pivot column, refused beyond Spark's own pivot limit."""
    most = int(cells.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = cells.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1)
    values = sorted(row[0] for row in found.collect())
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values to pivot on")
    return values


def sales_pivot(lines: DataFrame, key: str, on: str, total_label: str) -> DataFrame:
    """Sales per key and value of ``on`` with totals, margin and a grand-total row.

    Lines are aggregated once to (key, on) cells; the column names, the pivot and the
    total row all come from those. A line with a null key or null ``on`` has no cell in
    the pivot, but the profit total of a key covers its lines with a null ``on``.
    """
    cells = keep_small(cell_totals(lines.where(F.col(key).isNotNull()), key, on))
    values = distinct_values(cells, on)
    taken = [key, "total_sales", "total_profit", "shown_cells", "is_total", "profit_margin"]
    if len({name.lower() for name in [*values, *taken]}) < len(values) + len(taken):
        raise ValueError(f"values of {on} that can't be told apart as column names")
    on_name = sql_name(on)
    sums = {v: total(f"if({on_name} = {text_literal(v)}, sales, null)") for v in values}
    sums["total_sales"] = total(f"if({on_name} is not null, sales, null)")
    sums["total_profit"] = total("profit")
    by_key = cells.groupBy(key).agg(*named(**sums, shown_cells=f"count({on_name})"))
    rolled = (
        by_key.where("shown_cells > 0")
        .rollup(key)
        .agg(*named(**{name: total(sql_name(name)) for name in sums}, is_total=f"grouping({sql_name(key)})"))
    )
    return rolled.select(
        F.when(F.col("is_total") == 1, F.lit(total_label)).otherwise(F.col(key)).alias(key),
        *map(sql_name, sums),
        *named(profit_margin=margin_fraction("total_profit", "total_sales")),
    ).orderBy("is_total", key)
