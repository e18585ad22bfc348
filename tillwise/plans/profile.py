"""A first look at the clean table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.measures import named, total
from tillwise.operators.shaping import top_rows


def top_categories(lines: DataFrame, k: int = 5) -> DataFrame:
    sums = lines.groupBy("category").agg(*named(total_sales=total("sales")))
    return top_rows(sums, k, F.desc("total_sales"), F.asc("category"))


def top_states(lines: DataFrame, k: int = 5) -> DataFrame:
    sums = lines.groupBy("state").agg(*named(total_profit=total("profit")))
    return top_rows(sums, k, F.desc("total_profit"), F.asc("state"))


def final_summary(lines: DataFrame) -> DataFrame:
    """Rows, totals, the unweighted mean of line margins, and the dates covered."""
    return lines.agg(
        *named(
            total_rows="count(1)",
            total_revenue=total("sales"),
            total_profit=total("profit"),
            average_profit_margin="avg(profit_margin_pct)",
            first_order_date="date_format(min(order_date), 'yyyy-MM-dd')",
            last_order_date="date_format(max(order_date), 'yyyy-MM-dd')",
        )
    )


def summary_text(summary: DataFrame) -> DataFrame:
    """The final summary as lines for reading."""
    money = {"Total revenue": "total_revenue", "Total profit": "total_profit"}
    shown = [
        F.concat(F.lit("Total rows: "), F.format_number("total_rows", 0)).alias("a"),
        *[
            F.concat(F.lit(f"{label}: "), F.format_number(name, 2)).alias(name)
            for label, name in money.items()
        ],
        F.concat(
            F.lit("Average profit margin: "), F.format_number("average_profit_margin", 2), F.lit("%")
        ).alias("b"),
        F.concat_ws(" to ", "first_order_date", "last_order_date").alias("c"),
    ]
    texts = summary.select(F.array(*shown).alias("texts"))
    return texts.select(F.explode("texts").alias("summary_line"))
