"""The five dashboard extracts.

Percentages with two decimals, ties to even; an empty sum and an undefined margin are
zero, undefined growth is null. ``EXTRACT_HEADERS`` holds the published column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.measures import change, exact_mean, margin_pct, named, ratio
from tillwise.functions.rounding import half_even
from tillwise.operators.derive import dated_lines
from tillwise.operators.shaping import group_totals, previous
from tillwise.schema import HEADERS, REQUIRED, require_columns

_TOTALS = {
    "total_sales": "Total Sales",
    "total_profit": "Total Profit",
    "total_orders": "Total Orders",
    "order_count": "Order Count",
    "avg_order_value": "Avg Order Value",
    "avg_discount": "Avg Discount",
    "first_order_date": "First Order Date",
    "last_order_date": "Last Order Date",
    "customer_lifetime_days": "Customer Lifetime (days)",
    "yoy_growth_pct": "YoY Growth %",
    "mom_growth_pct": "MoM Growth %",
    "orders": "Orders",
}

EXTRACT_HEADERS: dict[str, str] = {**HEADERS, **_TOTALS}


def _margin(profit: str, sales: str) -> str:
    return half_even(margin_pct(profit, sales), 2)


def _rounded(*names: str) -> dict[str, str]:
    return {name: half_even(name, 2) for name in names}


def executive_summary(lines: DataFrame) -> DataFrame:
    """Yearly totals with growth over the year before; the first year has none."""
    yearly = group_totals(dated_lines(lines, "year"), ["year"], orders="total_orders")
    yearly = yearly.withColumn("before", previous("total_sales", ["year"]))
    growth = f"{change('total_sales', 'before')} * 100D"
    return yearly.select(
        "year",
        *named(
            **_rounded("total_sales", "total_profit"),
            total_orders="total_orders",
            avg_order_value=half_even(ratio("total_sales", "total_orders"), 2),
            profit_margin_pct=_margin("total_profit", "total_sales"),
            yoy_growth_pct=half_even(growth, 2),
        ),
    ).orderBy("year")


def regional_performance(lines: DataFrame) -> DataFrame:
    keys = ["region", "state", "city", "category", "sub_category"]
    cells = group_totals(
        dated_lines(lines), keys, sales="sales", profit="profit", orders="orders"
    )
    return cells.select(
        *keys,
        *named(
            **_rounded("sales", "profit"),
            profit_margin_pct=_margin("profit", "sales"),
            orders="orders",
        ),
    )


def customer_segments(lines: DataFrame) -> DataFrame:
    """Per customer: totals, first and last order day and the days between."""
    keys = ["customer_id", "customer_name", "segment"]
    customers = group_totals(
        dated_lines(lines),
        keys,
        first_day="min(order_date)",
        last_day="max(order_date)",
    )
    return customers.select(
        *keys,
        *named(
            **_rounded("total_sales", "total_profit"),
            order_count="order_count",
            avg_order_value=half_even(ratio("total_sales", "order_count"), 2),
            first_order_date="date_format(first_day, 'yyyy-MM-dd')",
            last_order_date="date_format(last_day, 'yyyy-MM-dd')",
            customer_lifetime_days="datediff(last_day, first_day)",
        ),
    )


def time_trends(lines: DataFrame) -> DataFrame:
    """Monthly sales per category with growth over its previous month, across years."""
    keys = ["year", "month", "quarter", "category"]
    months = group_totals(
        dated_lines(lines, "year", "month", "quarter"),
        keys,
        sales="sales",
        profit="profit",
        orders="orders",
    )
    months = months.withColumn("before", previous("sales", ["year", "month"], ["category"]))
    growth = f"if(category is null, null, {change('sales', 'before')} * 100D)"
    return months.select(
        *keys,
        *named(
            **_rounded("sales", "profit"),
            orders="orders",
            mom_growth_pct=half_even(growth, 2),
        ),
    ).orderBy(F.asc_nulls_last("category"), "year", "month")


def product_performance(lines: DataFrame) -> DataFrame:
    keys = ["category", "sub_category", "product_name"]
    products = group_totals(dated_lines(lines), keys, avg_discount=exact_mean("discount"))
    return products.select(
        *keys,
        *named(
            **_rounded("total_sales", "total_profit"),
            profit_margin_pct=_margin("total_profit", "total_sales"),
            order_count="order_count",
            avg_discount=half_even("avg_discount", 4),
        ),
    )


EXTRACTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "executive_summary": executive_summary,
    "regional_performance": regional_performance,
    "customer_segments": customer_segments,
    "time_trends": time_trends,
    "product_performance": product_performance,
}


def build_extracts(lines: DataFrame) -> dict[str, DataFrame]:
    """All extracts of one table, ready for ``write_batch``."""
    require_columns(lines, REQUIRED["extracts"])
    return {name: build(lines) for name, build in EXTRACTS.items()}
