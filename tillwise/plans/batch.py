"""The nightly run: raw files to clean table to every published result."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tillwise.operators.cleaning import clean_lines, distinct_wide_lines
from tillwise.operators.date_formats import detected_formats
from tillwise.operators.keep import keep_small
from tillwise.plans import insights, significance
from tillwise.plans.extracts import EXTRACT_HEADERS, build_extracts
from tillwise.plans.outlook import sales_forecast
from tillwise.plans.sql_reports import REPORTS, SMALL_REPORTS
from tillwise.plans.workbook import SHEET_HEADERS, build_sheets
from tillwise.schema import HEADERS, REQUIRED, require_columns
from tillwise.sources.order_files import (
    read_clean_table,
    read_order_csv,
    run_named_queries,
    sort_out_order_csv,
    write_batch,
    write_clean_table,
    write_csv,
)


def clean_files(
    spark: SparkSession,
    csv_path: str,
    table_path: str,
    raw_path: str | None = None,
    csv_copy: str | None = None,
    formats: Mapping[str, Iterable[str]] | None = None,
    detect: bool = False,
    rejected_path: str | None = None,
) -> DataFrame:
    """Clean raw CSV files into a Parquet table and return that table.

    The files are parsed once, into typed Parquet at ``raw_path`` (by default next to the
    table): the median passes then read a few number columns instead of parsing text again.
    A CSV copy of the table, if asked for, is written in parallel as many files. ``formats`` gives
    the date spellings of a column; with ``detect`` they are found from the data. A cell that is no
    number fails the job, unless ``rejected_path`` is given: rows with such cells or with a wrong
    number of them are left out and written there as JSON, with the reason.
    """
    raw_path = raw_path or table_path.rstrip("/") + "_raw"
    if rejected_path:
        raw, rejected, _ = sort_out_order_csv(spark, csv_path, raw_path, REQUIRED["cleaning"])
        rejected.write.mode("overwrite").json(rejected_path)
    else:
        read_order_csv(spark, csv_path, REQUIRED["cleaning"]).write.mode("overwrite").parquet(raw_path)
        raw = spark.read.parquet(raw_path)
    if detect:
        formats = detected_formats(raw, ["order_date", "ship_date"]) | dict(formats or {})
    write_clean_table(clean_lines(raw, formats, distinct_wide_lines), table_path)
    clean = read_clean_table(spark, table_path)
    if csv_copy:
        write_csv(clean, csv_copy, HEADERS)
    return clean


def publish(
    lines: DataFrame, folder: str, forecast_keys: Sequence[str] = ()
) -> dict[str, dict[str, int]]:
    """Write reports, extracts, workbook tables, statistics and the forecast; return row counts.

    All statistics and insights come from one table of cells, for which the lines are read once."""
    require_columns(lines, REQUIRED["reports"] | REQUIRED["extracts"])
    bounded = ("executive_summary", "executive_kpis", "executive_yearly", "regional_analysis",
               "top_customers")
    forecast = sales_forecast(lines, forecast_keys).drop("status")
    extracts, sheets = build_extracts(lines), build_sheets(lines)
    cells = keep_small(significance.statistic_cells(lines))
    statistics = significance.tables_of_cells(cells) | {"business_insights": insights.insights_of_cells(cells)}
    return {
        "reports": run_named_queries(lines, REPORTS, f"{folder}/reports", one_file=SMALL_REPORTS),
        "extracts": write_batch(
            extracts, f"{folder}/extracts", dict.fromkeys(extracts, EXTRACT_HEADERS), bounded
        ),
        "workbook": write_batch(sheets, f"{folder}/workbook", SHEET_HEADERS, bounded),
        "statistics": write_batch(statistics, f"{folder}/statistics", one_file=tuple(statistics)),
        "forecast": {
            "sales_forecast": write_csv(
                forecast, f"{folder}/sales_forecast", one_file=not forecast_keys
            )
        },
    }
