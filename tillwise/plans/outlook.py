"""Monthly series, forecast and forecast accuracy, overall or per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators.monthly import (
    SHORTEST,
    accuracy,
    describe_series,
    monthly_sales,
    require_sales,
    seasonal_naive,
)
from tillwise.operators.seasonal_model import seasonal_fits, seasonal_forecast


def _long_enough(forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A single series too short to forecast is an error; of many, each just shows a status. One
    long enough to forecast and too short to hold months out has no held-out rows."""
    if keys:
        return forecast
    complaint = F.raise_error(F.lit(f"a forecast needs at least {SHORTEST} months of sales"))
    return forecast.where(
        F.when(F.col("status") != "too_short", True)
        .when(F.col("phase") == "held_out", False)
        .otherwise(complaint)
    )


def _series(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The monthly series of the lines; an error when no line has both a date and sales."""
    require_sales(lines)
    return monthly_sales(lines, keys)


def sales_forecast(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The next six months with their 95 % interval; months as text."""
    rows = seasonal_forecast(_series(lines, keys), keys, ["future"])
    return _long_enough(rows, keys).select(
        *keys,
        F.date_format("month", "yyyy-MM-dd").alias("month"),
        "predicted_sales",
        "lower_ci",
        "upper_ci",
        "status",
    )


def held_out_pairs(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Actual and predicted sales of the held-out months."""
    rows = seasonal_forecast(_series(lines, keys), keys, ["held_out"])
    return _long_enough(rows, keys).where("status <> 'too_short'").select(
        *keys,
        "month",
        F.col("actual_sales").alias("actual"),
        F.col("predicted_sales").alias("predicted"),
    )


def model_parameters(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each series' fitted coefficients with standard errors, likelihood and status."""
    return seasonal_fits(_series(lines, keys), keys)


def model_likelihood(lines: DataFrame, params: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """How well given coefficients describe each series that is long enough."""
    rows = seasonal_fits(_series(lines, keys), keys, params).where("parameter = 'ar'")
    return rows.select(*keys, "differenced_months", "log_likelihood", "variance")


def given_forecast(lines: DataFrame, params: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """The next six months and the held-out ones by given coefficients instead of fitted ones."""
    rows = seasonal_forecast(_series(lines, keys), keys, params=params)
    return rows.where("status <> 'too_short'").drop("status")


def forecast_accuracy(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return accuracy(held_out_pairs(lines, keys), keys)


def naive_accuracy(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The yardstick: accuracy of repeating last year's month."""
    return accuracy(seasonal_naive(_series(lines, keys), keys), keys)


def series_description(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return describe_series(_series(lines, keys), keys)


def forecast_chart(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Everything a forecast chart shows, one tagged row per point."""
    series = _series(lines, keys)
    none = F.lit(None).cast("double")
    history = series.select(
        *keys,
        F.lit("history").alias("series"),
        "month",
        F.col("sales").alias("value"),
        none.alias("lower_ci"),
        none.alias("upper_ci"),
    )
    modelled = _long_enough(seasonal_forecast(series, keys), keys).where("status <> 'too_short'")
    held = F.col("phase") == "held_out"

    def point(tag: Column, value: str) -> Column:
        return F.struct(tag.alias("series"), F.col(value).alias("value"))

    shown = F.when(
        held,
        F.array(
            point(F.lit("held_out_actual"), "actual_sales"),
            point(F.lit("held_out_predicted"), "predicted_sales"),
        ),
    ).otherwise(F.array(point(F.lit("forecast"), "predicted_sales")))
    points = modelled.withColumn("point", F.explode(shown)).select(
        *keys,
        "point.series",
        "month",
        "point.value",
        F.when(~held, F.col("lower_ci")).alias("lower_ci"),
        F.when(~held, F.col("upper_ci")).alias("upper_ci"),
    )
    return history.unionByName(points)
