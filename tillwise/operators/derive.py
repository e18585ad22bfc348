"""Columns derived from an order line."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.measures import margin_pct
from tillwise.functions.rounding import half_even

# Date spellings accepted in text columns, tried in this order.
DATE_FORMATS: tuple[str, ...] = ("yyyy-MM-dd", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss")


def parsed_date(df: DataFrame, name: str, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """The column as a date; text in none of the formats becomes null."""
    kind = df.schema[name].dataType
    value = F.col(name)
    if not isinstance(kind, T.StringType):
        return value.cast("date")
    if not (formats := tuple(formats)):
        return F.lit(None).cast("date")
    attempts = [F.try_to_timestamp(value, F.lit(pattern)).cast("date") for pattern in formats]
    return F.coalesce(*attempts)


def parsed_number(df: DataFrame, name: str) -> Column:
    """The column as a double; text that is no number becomes null."""
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, T.StringType):
        return F.trim(value).try_cast("double")
    return value.cast("double")


def with_dates(
    df: DataFrame, *names: str, formats: Mapping[str, Iterable[str]] | None = None
) -> DataFrame:
    """The columns as dates; ``formats`` gives the spellings of some, the others have DATE_FORMATS."""
    given = formats or {}
    return df.withColumns({n: parsed_date(df, n, given.get(n, DATE_FORMATS)) for n in names})


def delivery_speed(days: Column) -> Column:
    """Speed class of a delivery by its days in transit."""
    return (
        F.when(days.isNull(), "Unknown")
        .when(days <= 0, "Same day")
        .when(days <= 2, "First Class")
        .when(days <= 4, "Second Class")
        .otherwise("Standard")
    )


def delivery_days() -> Column:
    return F.datediff("ship_date", "order_date")


def _on_request() -> dict[str, Column]:
    return {
        "year": F.year("order_date"),
        "month": F.month("order_date"),
        "quarter": F.quarter("order_date"),
        "profit_margin_pct": F.expr(margin_pct("profit", "sales")),
    }


def dated_lines(df: DataFrame, *derived: str) -> DataFrame:
    """Lines with a valid order date, plus the derived columns asked for.

    A derived column the lines already carry is kept as it is, so stored values such
    as a margin rounded at cleaning time are used rather than recomputed.
    """
    dated = with_dates(df, "order_date").dropna(subset=["order_date"])
    rules = _on_request()
    return dated.withColumns({n: rules[n] for n in derived if n not in df.columns})


def with_features(df: DataFrame) -> DataFrame:
    """Calendar, profitability and delivery columns of a cleaned line."""
    featured = df.withColumns(
        {
            "year": F.year("order_date"),
            "month": F.month("order_date"),
            "quarter": F.quarter("order_date"),
            "profit_margin_pct": F.expr(half_even(margin_pct("profit", "sales"), 2)),
            "discount_impact": F.expr(half_even("sales * discount", 2)),
            "delivery_days": delivery_days(),
        }
    )
    return featured.withColumn("delivery_speed", delivery_speed(F.col("delivery_days")))
