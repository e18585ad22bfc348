"""The eight SQL reports over the clean table.

Sums and ratios follow the SQL rules: ties round away from zero, an undefined margin
is zero, undefined growth is null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.measures import (
    exact_mean,
    exact_sum,
    named,
    sql_change_pct,
    sql_margin_pct,
)
from tillwise.functions.rounding import half_up
from tillwise.operators.shaping import conditional_totals, previous, top_and_bottom, top_rows

CATEGORIES = ("Furniture", "Office Supplies", "Technology")


def _sums(sales: str, profit: str) -> list[Column]:
    return named(**{sales: exact_sum("sales"), profit: exact_sum("profit")})


def _margin(profit: str, sales: str) -> str:
    return half_up(sql_margin_pct(profit, sales), 2)


def _order_value(sales: str, orders: str) -> str:
    return half_up(f"{sales} / nullif({orders}, 0)", 2)


def yearly_kpis(lines: DataFrame) -> DataFrame:
    yearly = lines.groupBy("year").agg(
        *_sums("revenue", "profit_sum"), F.countDistinct("order_id").alias("total_orders")
    )
    return yearly.select(
        "year",
        *named(
            total_revenue=half_up("revenue", 2),
            total_profit=half_up("profit_sum", 2),
            total_orders="total_orders",
            average_order_value=_order_value("revenue", "total_orders"),
        ),
    ).orderBy(F.asc_nulls_first("year"))


def top_customers(lines: DataFrame, k: int = 10) -> DataFrame:
    customers = lines.groupBy("customer_id", "customer_name").agg(*_sums("revenue", "profit_sum"))
    report = customers.select(
        "customer_id",
        "customer_name",
        *named(
            total_revenue=half_up("revenue", 2),
            total_profit=half_up("profit_sum", 2),
            profit_margin_pct=_margin("profit_sum", "revenue"),
        ),
    )
    return top_rows(
        report, k, F.desc("total_revenue"), F.desc("total_profit"), F.asc("customer_id")
    )


def region_category_crosstab(
    lines: DataFrame, categories: Sequence[str] = CATEGORIES
) -> DataFrame:
    wide = conditional_totals(lines, "region", "category", categories)
    sums = {name: half_up(name, 2) for name in wide.columns if name != "region"}
    return wide.select("region", *named(**sums)).orderBy(F.desc("total_sales"), F.asc("region"))


def monthly_revenue_growth(lines: DataFrame) -> DataFrame:
    """Growth within a year: each January starts afresh, without a previous month."""
    monthly = lines.groupBy("year", "month").agg(*named(revenue=exact_sum("sales")))
    linked = monthly.withColumn("before", previous("revenue", ["month"], ["year"]))
    # the current month enters the ratio rounded, the previous one does not
    growth = sql_change_pct(half_up("revenue", 2), "before")
    return linked.select(
        "year",
        "month",
        *named(
            monthly_revenue=half_up("revenue", 2),
            previous_month_revenue=half_up("before", 2),
            revenue_growth_pct=half_up(growth, 2),
        ),
    ).orderBy("year", "month")


def negative_margin_products(lines: DataFrame) -> DataFrame:
    """Products losing money; a loss that rounds to zero does not count."""
    keys = ["product_id", "product_name", "category"]
    products = lines.groupBy(*keys).agg(
        *_sums("sales_sum", "profit_sum"), *named(avg_discount=exact_mean("discount"))
    )
    report = products.select(
        *keys,
        *named(
            total_sales=half_up("sales_sum", 2),
            total_profit=half_up("profit_sum", 2),
            avg_discount_pct=half_up("avg_discount * 100D", 2),
            profit_margin_pct=_margin("profit_sum", "sales_sum"),
        ),
    )
    return report.where("profit_margin_pct < 0").orderBy(
        F.asc("profit_margin_pct"), F.desc("total_sales"), F.asc("product_id")
    )


def segment_analysis(lines: DataFrame) -> DataFrame:
    """Two distinct counts: lines collapse to (segment, order, customer) first, so the
    row copies that counting two things at once needs are made of far fewer rows."""
    trios = lines.groupBy("segment", "order_id", "customer_id").agg(
        *_sums("sales", "profit")
    )
    segments = trios.groupBy("segment").agg(
        *_sums("revenue", "profit_sum"),
        F.countDistinct("order_id").alias("order_frequency"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )
    return segments.select(
        "segment",
        "order_frequency",
        *named(
            total_revenue=half_up("revenue", 2),
            total_profit=half_up("profit_sum", 2),
            average_order_value=_order_value("revenue", "order_frequency"),
        ),
        "unique_customers",
    ).orderBy(F.desc("total_revenue"), F.asc("segment"))


def state_profit_margin_rank(lines: DataFrame, k: int = 5) -> DataFrame:
    """Best and worst states by margin; both branches read one shuffle of state sums."""
    states = lines.groupBy("state").agg(*_sums("sales_sum", "profit_sum"))
    report = states.select(
        "state",
        *named(
            total_sales=half_up("sales_sum", 2),
            total_profit=half_up("profit_sum", 2),
            profit_margin_pct=_margin("profit_sum", "sales_sum"),
        ),
    )
    ranked = top_and_bottom(
        report,
        k,
        [F.desc("profit_margin_pct"), F.desc("total_profit"), F.asc("state")],
        [F.asc("profit_margin_pct"), F.asc("total_profit"), F.asc("state")],
        "ranking_group",
    )
    top_first = F.when(F.col("ranking_group") == f"Top {k}", 1).otherwise(2)
    return ranked.orderBy(top_first, F.desc("profit_margin_pct"), F.asc("state"))


def ship_mode_impact(lines: DataFrame) -> DataFrame:
    modes = lines.groupBy("ship_mode").agg(
        *_sums("revenue", "profit_sum"),
        F.avg("delivery_days").alias("avg_days"),
        F.countDistinct("order_id").alias("total_orders"),
    )
    return modes.select(
        "ship_mode",
        *named(
            average_delivery_days=half_up("avg_days", 2),
            total_orders="total_orders",
            total_revenue=half_up("revenue", 2),
            total_profit=half_up("profit_sum", 2),
            profit_margin_pct=_margin("profit_sum", "revenue"),
        ),
    ).orderBy(F.desc("total_revenue"), F.asc("ship_mode"))


# In the order the batch exports them.
REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "yearly_kpis": yearly_kpis,
    "top_customers": top_customers,
    "region_category_crosstab": region_category_crosstab,
    "monthly_revenue_growth": monthly_revenue_growth,
    "negative_margin_products": negative_margin_products,
    "segment_analysis": segment_analysis,
    "state_profit_margin_rank": state_profit_margin_rank,
    "ship_mode_impact": ship_mode_impact,
}

# Reports bounded by a calendar, a top-k or a fixed dimension.
SMALL_REPORTS = tuple(name for name in REPORTS if name != "negative_margin_products")
