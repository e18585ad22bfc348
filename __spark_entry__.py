"""Registered queries over the driver tables and their SQL counterparts.

The driver tables are mapped to order lines (see ``tillwise.sources.star``); every query
runs over all of them. Parameters that depend on the data - category names, the discount
threshold - are passed in here, the package's defaults are those of the retail data set.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_queries  # noqa: E402
from tillwise.functions.rounding import half_up  # noqa: E402
from tillwise.operators import cleaning, monthly  # noqa: E402
from tillwise.operators.date_formats import format_coverage  # noqa: E402
from tillwise.operators.seasonal_model import seasonal_forecast  # noqa: E402
from tillwise.operators.derive import dated_lines, with_dates, with_features  # noqa: E402
from tillwise.plans import extracts, insights, outlook, profile, significance  # noqa: E402
from tillwise.plans import sql_reports, workbook  # noqa: E402
from tillwise.schema import with_headers  # noqa: E402
from tillwise.sources.star import order_lines  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
CATEGORIES = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")
THRESHOLD = 0.05
KEYS = ("region", "category")
DATE_CANDIDATES = ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy")

Query = Callable[[SparkSession, str], DataFrame]


def _lines(*columns: str, features: bool = False) -> Query:
    """Order lines with the given columns, optionally with all derived ones."""

    def read(spark: SparkSession, folder: str) -> DataFrame:
        if not features:
            return order_lines(spark, folder, columns)
        base = ("order_date", "ship_date", "sales", "profit", "discount")
        return with_features(order_lines(spark, folder, dict.fromkeys([*base, *columns])))

    return read


def _raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as a messy file would hold them: dates as text in several spellings or
    missing, gaps in text and numbers, and every urgent line twice."""
    columns = (
        "order_id", "order_date", "ship_date", "ship_mode", "segment", "city", "state", "region",
        "product_id", "category", "sub_category", "product_name", "sales", "quantity", "discount",
        "profit",
    )
    c = F.col
    spelled = (
        F.when(c("state") == "NATION_7", None)
        .when(c("sub_category") == "Brand#3", F.date_format("order_date", "M/d/yyyy"))
        .when(c("sub_category") == "Brand#4", F.concat(F.lit("week "), c("quantity")))
        .otherwise(F.date_format("order_date", "yyyy-MM-dd"))
    )
    shipped = F.when(c("city") == "Supplier#000000003", None).otherwise(
        F.date_format("ship_date", "yyyy-MM-dd")
    )
    messy = order_lines(spark, folder, columns).withColumns(
        {
            "order_date": spelled,
            "ship_date": shipped,
            "quantity": F.when(c("discount") != 0.1, c("quantity")),
            "discount": F.when(c("quantity") != 1, c("discount")),
            "ship_mode": F.when(c("ship_mode") != "5-LOW", c("ship_mode")),
        }
    )
    copies = F.when(c("ship_mode") == "1-URGENT", F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return messy.withColumn("copy", F.explode(copies)).drop("copy")


def _of(read: Query, build: Callable[[DataFrame], DataFrame], **digits: int) -> Query:
    """A query that builds a result from lines, rounding unrounded columns to compare."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = build(read(spark, folder))
        rounded = {name: F.expr(half_up(name, places)) for name, places in digits.items()}
        return result.withColumns(rounded) if rounded else result

    return run


def _iso(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


def _months_as_text(build: Callable[[DataFrame], DataFrame], *names: str):
    return lambda df: _iso(*(names or ("month",)))(build(df))


def _tolerant_dates(raw: DataFrame) -> DataFrame:
    parsed = with_dates(
        cleaning.distinct_lines(cleaning.fill_nulls(raw)), "order_date", "ship_date"
    )
    return parsed.groupBy(F.year("order_date").alias("order_year")).agg(
        F.count(F.lit(1)).alias("line_count"), F.count("ship_date").alias("shipped_count")
    )


def _filled_numbers(raw: DataFrame) -> DataFrame:
    return cleaning.fill_numbers(raw).select(
        "order_id", "product_id", "sales", "quantity", "discount", "profit"
    )


def _delivery_speeds(lines: DataFrame) -> DataFrame:
    return lines.groupBy("delivery_speed").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.min("delivery_days").alias("fewest_days"),
        F.max("delivery_days").alias("most_days"),
    )


def _forecast_months(lines: DataFrame) -> DataFrame:
    """Which months each series is forecast for, and the actual sales held out."""
    rows = seasonal_forecast(monthly.monthly_sales(lines, KEYS), KEYS)
    return rows.where("status <> 'too_short'").select(
        *KEYS, "phase", F.date_format("month", "yyyy-MM-dd").alias("month"), "actual_sales"
    )


def _insight_figures(lines: DataFrame) -> DataFrame:
    return insights.business_insights(lines, THRESHOLD).drop("message")


def _corpus():
    """The module of the corpus operators' queries, or None where that subpackage is left out."""
    try:
        import corpus_pipeline  # noqa: F401
        from tillwise.llm import queries as corpus
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "tillwise.llm", "tillwise.llm.queries"):
            raise
        return None
    return corpus


def queries() -> dict[str, Query]:
    corpus = _corpus()
    return core_queries() | (corpus.queries() if corpus else {})


def core_queries() -> dict[str, Query]:
    """The queries besides those of the corpus operators."""
    order = ("order_id", "order_date", "sales", "profit")
    customer = ("customer_id", "customer_name", "segment")
    product = ("category", "sub_category", "product_name")
    margins = _lines(features=True)
    everything = _lines(
        *customer, *product, "order_id", "product_id", "city", "state", "region", "ship_mode",
        "quantity", features=True,
    )
    date_sales = _lines("order_date", "sales")
    keyed_sales = _lines(*KEYS, "order_date", "sales")
    region_margins = _lines("region", features=True)
    insight_lines = _lines("region", "segment", features=True)
    forecast_digits = {"mae": 4, "rmse": 4, "mape": 6}

    def year_lines(spark: SparkSession, folder: str) -> DataFrame:
        return dated_lines(_lines(*order)(spark, folder), "year", "month")

    found: dict[str, Query] = {
        # SQL reports
        "yearly_kpis": _of(year_lines, sql_reports.yearly_kpis),
        "top_customers": _of(
            _lines("customer_id", "customer_name", "sales", "profit"), sql_reports.top_customers
        ),
        "region_category_crosstab": _of(
            _lines("region", "category", "sales", "profit"),
            lambda df: sql_reports.region_category_crosstab(df, CATEGORIES),
        ),
        "monthly_revenue_growth": _of(
            lambda s, d: dated_lines(date_sales(s, d), "year", "month"),
            sql_reports.monthly_revenue_growth,
        ),
        "negative_margin_products": _of(
            _lines("product_id", "product_name", "category", "sales", "profit", "discount"),
            sql_reports.negative_margin_products,
        ),
        "segment_analysis": _of(
            _lines("segment", "order_id", "customer_id", "sales", "profit"),
            sql_reports.segment_analysis,
        ),
        "state_profit_margin_rank": _of(
            _lines("state", "sales", "profit"), sql_reports.state_profit_margin_rank
        ),
        "ship_mode_impact": _of(
            _lines("ship_mode", "order_id", features=True), sql_reports.ship_mode_impact
        ),
        # dashboard extracts
        "executive_summary": _of(_lines(*order), extracts.executive_summary),
        "regional_performance": _of(
            _lines(*order, "region", "state", "city", "category", "sub_category"),
            extracts.regional_performance,
        ),
        "customer_segments": _of(_lines(*order, *customer), extracts.customer_segments),
        "time_trends": _of(_lines(*order, "category"), extracts.time_trends),
        "product_performance": _of(
            _lines(*order, *product, "discount"), extracts.product_performance
        ),
        "product_performance_headers": _of(
            _lines(*order, *product, "discount"),
            lambda df: with_headers(extracts.product_performance(df), extracts.EXTRACT_HEADERS),
        ),
        # workbook tables
        "workbook_yearly_summary": _of(
            _lines(*order), workbook.workbook_yearly_summary, total_revenue=4, total_profit=4,
            avg_order_value=6, profit_margin=6, yoy_growth=6,
        ),
        "workbook_regional_pivot": _of(
            _lines("order_date", "region", "category", "sales", "profit"),
            workbook.workbook_regional_pivot, total_sales=4, total_profit=4, profit_margin=6,
        ),
        "workbook_top_customers": _of(
            _lines(*order, *customer), workbook.workbook_top_customers, total_revenue=4,
            total_profit=4, avg_order_value=6,
        ),
        "workbook_product_performance": _of(
            _lines(*order, *product), workbook.workbook_product_performance, sales=4, profit=4,
            margin=6,
        ),
        "workbook_kpis": _of(_lines(*order), workbook.workbook_kpis, value=4),
        "yearly_growth_flags": _of(_lines(*order), workbook.yearly_growth_flags, yoy_growth=6),
        "regional_margin_scale": _of(
            _lines("order_date", "region", "category", "sales", "profit"),
            workbook.regional_margin_scale, profit_margin=6, scale_position=6,
        ),
        # cleaning and first look
        "cleaned_sales": _of(
            _raw_lines, lambda df: _iso("order_date", "ship_date")(cleaning.clean_lines(df))
        ),
        "cleaning_summary": _of(_raw_lines, cleaning.cleaning_summary),
        "median_filled_numbers": _of(_raw_lines, _filled_numbers),
        "tolerant_dates": _of(_raw_lines, _tolerant_dates),
        "date_format_coverage": _of(
            _raw_lines, lambda df: format_coverage(df, ["order_date", "ship_date"], DATE_CANDIDATES)
        ),
        "raw_null_counts": _of(_raw_lines, cleaning.null_counts),
        "unusable_line_count": _of(_raw_lines, monthly.unusable_count),
        "table_shape": _of(everything, cleaning.table_shape),
        "delivery_speeds": _of(margins, _delivery_speeds),
        "eda_top_categories": _of(
            _lines("category", "sales"), profile.top_categories, total_sales=4
        ),
        "eda_top_states": _of(_lines("state", "profit"), profile.top_states, total_profit=4),
        "final_summary": _of(
            margins, profile.final_summary, total_revenue=4, total_profit=4,
            average_profit_margin=6,
        ),
        # statistics
        "correlation_analysis": _of(
            margins, significance.correlation_analysis, r=6, t_stat=6, p_value=6
        ),
        "sales_correlation_matrix": _of(
            _lines("sales", "profit", "discount", "quantity"),
            significance.sales_correlation_matrix, r=6,
        ),
        "margin_correlation_matrix": _of(
            margins, significance.margin_correlation_matrix, r=6
        ),
        "regional_anova": _of(
            region_margins, significance.regional_anova, between_ss=4, within_ss=4, f_stat=6,
            p_value=6,
        ),
        "region_margin_means": _of(region_margins, significance.region_margin_means, mean=6),
        "discount_ttest": _of(
            margins, significance.discount_ttest, discounted_avg_margin=6,
            non_discounted_avg_margin=6, t_stat=6, df=4, p_value=6,
        ),
        "discount_split_means": _of(
            margins, lambda df: significance.discount_split_means(df, THRESHOLD),
            high_discount_margin=6, low_discount_margin=6,
        ),
        "segment_profitability": _of(
            _lines("segment", features=True), significance.segment_profitability, mean=6, std=6, sem=6, ci95=6
        ),
        "revenue_seasonality": _of(margins, significance.revenue_seasonality, revenue=4),
        "best_and_worst_month": _of(margins, significance.best_and_worst_month, revenue=4),
        "business_insights": _of(insight_lines, _insight_figures, statistic=6, p_value=6),
        "business_insight_messages": _of(
            insight_lines, lambda df: insights.business_insights(df, THRESHOLD), statistic=6, p_value=6,
        ),
        # monthly series and forecasts
        "monthly_series": _of(date_sales, _months_as_text(monthly.monthly_sales), sales=4),
        "keyed_monthly_series": _of(
            keyed_sales, _months_as_text(lambda df: monthly.monthly_sales(df, KEYS)), sales=4
        ),
        "series_description": _of(
            date_sales, _months_as_text(outlook.series_description, "first_month", "last_month")
        ),
        "keyed_series_description": _of(
            keyed_sales,
            _months_as_text(
                lambda df: outlook.series_description(df, KEYS), "first_month", "last_month"
            ),
        ),
        "hold_out_split": _of(
            date_sales,
            _months_as_text(lambda df: monthly.hold_out(monthly.monthly_sales(df))),
            sales=4,
        ),
        "naive_forecast_accuracy": _of(date_sales, outlook.naive_accuracy, **forecast_digits),
        "keyed_naive_forecast_accuracy": _of(
            keyed_sales, lambda df: outlook.naive_accuracy(df, KEYS), **forecast_digits
        ),
        "forecast_accuracy": _of(date_sales, outlook.forecast_accuracy),
        "keyed_forecast_accuracy": _of(
            keyed_sales, lambda df: outlook.forecast_accuracy(df, KEYS)
        ),
        "sales_forecast": _of(date_sales, outlook.sales_forecast),
        "keyed_sales_forecast": _of(keyed_sales, lambda df: outlook.sales_forecast(df, KEYS)),
        "keyed_forecast_months": _of(keyed_sales, _forecast_months, actual_sales=4),
        "model_parameters": _of(date_sales, outlook.model_parameters),
        "keyed_model_parameters": _of(keyed_sales, lambda df: outlook.model_parameters(df, KEYS)),
        "keyed_model_likelihood": _of(
            keyed_sales, lambda df: outlook.model_likelihood(df, oracle_queries.GIVEN, KEYS),
            log_likelihood=6, variance=2,
        ),
        "keyed_given_forecast": _of(
            keyed_sales,
            _months_as_text(
                lambda df: outlook.given_forecast(df, oracle_queries.GIVEN, KEYS).drop("lower_ci", "upper_ci")
            ),
            actual_sales=4, predicted_sales=4,
        ),
        "forecast_chart": _of(date_sales, _months_as_text(outlook.forecast_chart)),
    }
    return found


def oracle_sql() -> dict[str, str]:
    corpus = _corpus()
    return oracle_queries.oracle_sql() | (corpus.oracle_sql() if corpus else {})


def entry(spark: SparkSession) -> DataFrame:
    return queries()["yearly_kpis"](spark, SMOKE_DIR)
