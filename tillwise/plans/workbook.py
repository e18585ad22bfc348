"""The tables of the report workbook.

Unlike the dashboard extracts these keep full precision, give margins and growth as
fractions, and start growth at zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.measures import change, margin_fraction, named, ratio, total
from tillwise.operators.derive import dated_lines
from tillwise.operators.shaping import group_totals, previous, sales_pivot, top_rows
from tillwise.schema import HEADERS, REQUIRED, require_columns

GRAND_TOTAL = "Grand Total"
LOW_MARGIN, HIGH_MARGIN = -0.2, 0.3


def workbook_yearly_summary(lines: DataFrame) -> DataFrame:
    yearly = group_totals(
        dated_lines(lines, "year"), ["year"], sales="total_revenue", orders="total_orders"
    )
    yearly = yearly.withColumn("before", previous("total_revenue", ["year"]))
    return yearly.select(
        "year",
        "total_revenue",
        "total_profit",
        "total_orders",
        *named(
            avg_order_value=ratio("total_revenue", "total_orders"),
            profit_margin=margin_fraction("total_profit", "total_revenue"),
            yoy_growth=f"coalesce({change('total_revenue', 'before')}, 0D)",
        ),
    ).orderBy("year")


def workbook_regional_pivot(lines: DataFrame) -> DataFrame:
    return sales_pivot(dated_lines(lines), "region", "category", GRAND_TOTAL)


def workbook_top_customers(lines: DataFrame, k: int = 20) -> DataFrame:
    """Best customers with the segment looked up by id.

    A customer in several segments has a row each, and every one of them shows the first
    segment by name. It is looked up among the customers' totals, so lines are read once.
    """
    dated = dated_lines(lines)
    keys = ["customer_id", "customer_name", "segment"]
    customers = group_totals(dated, keys, sales="total_revenue")
    order = (
        F.desc("total_revenue"), F.desc("total_profit"), F.asc("customer_id"), F.asc("segment")
    )
    first = F.min("segment").over(Window.partitionBy("customer_id"))
    return top_rows(customers.withColumn("segment_lookup", first), k, *order).select(
        "customer_id", "customer_name", "segment_lookup", "total_revenue", "total_profit",
        "order_count", *named(avg_order_value=ratio("total_revenue", "order_count")),
    )


def workbook_product_performance(lines: DataFrame) -> DataFrame:
    keys = ["category", "sub_category", "product_name"]
    products = group_totals(dated_lines(lines), keys, sales="sales", profit="profit")
    margin = F.expr(margin_fraction("profit", "sales"))
    return products.withColumn("margin", margin).orderBy(F.desc("margin"), *keys)


def workbook_kpis(lines: DataFrame) -> DataFrame:
    """Four headline figures as (metric, value) rows, from one pass."""
    overall = dated_lines(lines).agg(
        *named(revenue=total("sales"), profit=total("profit"), orders="count(distinct order_id)")
    )
    texts = {
        "Total Revenue": "revenue",
        "Total Profit": "profit",
        "Total Orders": "cast(orders as double)",
        "Avg Order Value": ratio("revenue", "orders"),
    }
    figures = overall.select(*named(**texts))
    return figures.unpivot([], figures.columns, "metric", "value")


def growth_flag(growth: Column) -> Column:
    """What the sheet's growth colours say: up, down or unmarked."""
    return F.when(growth > 0, "up").when(growth < 0, "down").otherwise("none")


def scale_position(margin: Column) -> Column:
    """Place of a margin on the sheet's colour scale, from -1 (low) over 0 to 1 (high)."""
    low = F.greatest(margin / F.lit(-LOW_MARGIN), F.lit(-1.0))
    high = F.least(margin / F.lit(HIGH_MARGIN), F.lit(1.0))
    return F.when(margin < 0, low).otherwise(high)


def yearly_growth_flags(lines: DataFrame) -> DataFrame:
    yearly = workbook_yearly_summary(lines)
    return yearly.select("year", "yoy_growth", growth_flag(F.col("yoy_growth")).alias("flag"))


def regional_margin_scale(lines: DataFrame) -> DataFrame:
    pivot = workbook_regional_pivot(lines)
    place = scale_position(F.col("profit_margin"))
    return pivot.select("region", "profit_margin", place.alias("scale_position"))


SHEETS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "executive_kpis": workbook_kpis,
    "executive_yearly": workbook_yearly_summary,
    "regional_analysis": workbook_regional_pivot,
    "top_customers": workbook_top_customers,
    "product_performance": workbook_product_performance,
}


# The published column names of each sheet, where they differ from the table's.
_MONEY = {
    "total_revenue": "Total Revenue",
    "total_profit": "Total Profit",
    "order_count": "Order Count",
    "avg_order_value": "Avg Order Value",
}
SHEET_HEADERS: dict[str, dict[str, str]] = {
    "executive_kpis": {"metric": "Metric", "value": "Value"},
    "executive_yearly": {
        **HEADERS,
        **_MONEY,
        "total_orders": "Total Orders",
        "profit_margin": "Profit Margin %",
        "yoy_growth": "YoY Growth %",
    },
    "regional_analysis": {
        "region": "Region",
        "total_sales": "Total Sales",
        "total_profit": "Total Profit",
        "profit_margin": "Profit Margin",
    },
    "top_customers": {**HEADERS, **_MONEY, "segment_lookup": "Segment Lookup"},
    "product_performance": {**HEADERS, **_MONEY, "margin": "Margin %"},
}


def build_sheets(lines: DataFrame) -> dict[str, DataFrame]:
    """All workbook tables of one table of lines, ready for ``write_batch``."""
    require_columns(lines, REQUIRED["workbook"])
    return {name: build(lines) for name, build in SHEETS.items()}
