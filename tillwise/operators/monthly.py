"""Monthly sales series without gaps, their hold-out split and forecast accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.measures import exact_sum, named
from tillwise.operators.derive import parsed_date, parsed_number
from tillwise.schema import REQUIRED, require_columns

TEST_MONTHS = 6
SEASON = 12
SHORTEST = TEST_MONTHS + SEASON + 1


def usable_sales(lines: DataFrame) -> DataFrame:
    """Lines whose order date and sales both parse."""
    require_columns(lines, REQUIRED["forecast"])
    parsed = lines.withColumns(
        {"order_date": parsed_date(lines, "order_date"), "sales": parsed_number(lines, "sales")}
    )
    return parsed.dropna(subset=["order_date", "sales"])


def unusable_count(lines: DataFrame) -> DataFrame:
    """How many lines the series leaves out, as one row."""
    require_columns(lines, REQUIRED["forecast"])
    bad = parsed_date(lines, "order_date").isNull() | parsed_number(lines, "sales").isNull()
    return lines.agg(F.count_if(bad).alias("dropped_rows"), F.count(F.lit(1)).alias("rows_read"))


def require_sales(lines: DataFrame) -> DataFrame:
    """Return the usable lines, or raise when there are none."""
    usable = usable_sales(lines)
    if usable.isEmpty():
        raise ValueError("no line has both an order date and sales")
    return usable


def monthly_sales(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sales per month end and key, with a zero for every month inside a series' range.

    Only month totals cross the network. A month fills the gap up to the next one of
    its series, so no calendar has to be joined in.
    """
    usable = usable_sales(lines)
    totals = usable.groupBy(*keys, F.trunc("order_date", "month").alias("start")).agg(
        *named(sales=exact_sum("sales"))
    )
    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    until = F.coalesce(F.add_months(after, -1), F.col("start"))
    spread = totals.withColumn("until", until).select(
        *keys,
        "start",
        F.explode(F.sequence("start", "until", F.expr("interval 1 month"))).alias("spine"),
        "sales",
    )
    return spread.select(
        *keys,
        F.last_day("spine").alias("month"),
        F.when(F.col("spine") == F.col("start"), F.col("sales")).otherwise(F.lit(0.0)).alias("sales"),
    )


def describe_series(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Length and range of each series and whether it is long enough to forecast."""
    return series.groupBy(*keys).agg(
        F.count("month").alias("months"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.lit(TEST_MONTHS).alias("held_out"),
        F.when(F.count("month") < SHORTEST, "too_short").otherwise("ok").alias("status"),
    )


def hold_out(series: DataFrame, keys: Sequence[str] = (), months: int = TEST_MONTHS) -> DataFrame:
    """Marks each series' last months as the test part and the others as training."""
    from_end = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("month")))
    part = F.when(from_end <= months, "test").otherwise("train")
    return series.withColumn("part", part)


def seasonal_naive(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The test months of each series with last year's same month as prediction."""
    year_ago = F.lag("sales", SEASON).over(Window.partitionBy(*keys).orderBy("month"))
    predicted = hold_out(series.withColumn("predicted", year_ago), keys)
    return predicted.where("part = 'test'").select(
        *keys, "month", F.col("sales").alias("actual"), "predicted"
    )


def accuracy(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute, root mean square and mean percentage error of predictions.

    Months without sales are left out of the percentage, which is null when none is left.
    """
    error: Column = F.col("actual") - F.col("predicted")
    share = F.abs(error / F.nullif(F.col("actual"), F.lit(0)))
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(share) * 100).alias("mape"),
    )
