"""From raw order lines to the clean table every report reads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.measures import sql_name
from tillwise.operators.derive import with_dates, with_features
from tillwise.operators.keep import keep_small
from tillwise.operators.median import medians_and_counts
from tillwise.schema import REQUIRED, numeric_columns, require_columns, text_columns

UNKNOWN = "Unknown"
#: So many fingerprints of repeated lines, of 16 bytes each, are sent to every task at most.
MOST_REPEATED = 1_000_000


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of nulls, from one pass."""
    counted = df.agg(*[F.count_if(F.col(sql_name(c)).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], counted.columns, "column_name", "null_count")


def _without_nan(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.FractionalType):
        return F.when(~F.isnan(name), F.col(name))
    return F.col(name)


def fill_numbers(df: DataFrame) -> DataFrame:
    """Replace nulls in numeric columns by the column's exact median.

    A column with nulls becomes a double, as its median may lie between two integers;
    one without any values stays null.
    """
    names = numeric_columns(df)
    if not names:
        return df
    df = df.withColumns({c: _without_nan(df, c) for c in names})
    medians, counts, rows = medians_and_counts(df, names, holed_only=True)
    holed = {c for c in names if counts[c] < rows}
    as_double = df.withColumns({c: F.col(c).cast("double") for c in names if c in holed})
    known: dict[str, Any] = {c: m for c, m in medians.items() if m is not None and c in holed}
    return as_double.fillna(known) if known else as_double


def fill_text(df: DataFrame) -> DataFrame:
    """Replace nulls in text columns, date text included, by a fixed word."""
    return df.fillna(UNKNOWN, subset=text_columns(df))


def fill_nulls(df: DataFrame) -> DataFrame:
    return fill_text(fill_numbers(df))


def distinct_lines(df: DataFrame) -> DataFrame:
    """One copy of each line; two nulls count as equal."""
    return df.dropDuplicates()


def fingerprint(df: DataFrame) -> list[Column]:
    """128 bits of a whole line, as two longs. Hashes pass over nulls, so which cells are null is
    hashed as well."""
    cells = [F.col(sql_name(c)) for c in df.columns]
    gaps = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return [F.xxhash64(F.lit(half), gaps, *cells) for half in (1, 2)]


def distinct_wide_lines(df: DataFrame, most: int = MOST_REPEATED) -> DataFrame:
    """As ``distinct_lines``, for lines that are cheap to read again: their fingerprints are shuffled
    instead of all their columns.

    A fingerprint that occurs once is that of a line without a copy. Lines whose fingerprint is
    repeated are compared in all columns, so the result is exact. Where more than ``most``
    fingerprints are repeated, too many to send to every task, all lines are compared that way.
    """
    halves = [c.alias(name) for c, name in zip(fingerprint(df), ("half_one", "half_two"))]
    counted = df.select(*halves).groupBy("half_one", "half_two").count()
    repeated = keep_small(counted.where("count > 1").drop("count"))
    if repeated.count() > most:
        return distinct_lines(df)
    line = F.struct(*[F.col(sql_name(c)) for c in df.columns]).alias("line")
    marked, listed = df.select(line, *halves), F.broadcast(repeated)
    single = marked.join(listed, ["half_one", "half_two"], "left_anti").select("line.*")
    copied = marked.join(listed, ["half_one", "half_two"], "left_semi").select("line.*")
    return single.union(copied.dropDuplicates())


def _undated() -> Column:
    return F.col("order_date").isNull() | F.col("ship_date").isNull()


def clean_lines(
    raw: DataFrame,
    formats: Mapping[str, Iterable[str]] | None = None,
    distinct: Callable[[DataFrame], DataFrame] = distinct_lines,
) -> DataFrame:
    """Fill, deduplicate, parse dates, drop undated lines and add the features.

    ``formats`` gives the date spellings of a column, as ``detected_formats`` finds them;
    ``distinct`` is ``distinct_lines`` or ``distinct_wide_lines``.

    The order matters: filling first lets lines that differ only by a gap collapse, and
    turns missing date text into a word that then fails to parse.
    """
    require_columns(raw, REQUIRED["cleaning"])
    parsed = with_dates(
        distinct(fill_nulls(raw)), "order_date", "ship_date", formats=formats
    )
    return with_features(parsed.where(~_undated()))


def cleaning_summary(
    raw: DataFrame, formats: Mapping[str, Iterable[str]] | None = None
) -> DataFrame:
    """How many lines cleaning reads, removes and keeps, as one row.

    Copies are counted by fingerprint, so two longs a line are shuffled and not its columns.
    """
    require_columns(raw, REQUIRED["cleaning"])
    filled = fill_nulls(raw)
    halves = [c.alias(name) for c, name in zip(fingerprint(filled), ("half_one", "half_two"))]
    slim = filled.select("order_date", "ship_date", *halves)
    dated = with_dates(slim, "order_date", "ship_date", formats=formats)
    different = dated.groupBy("half_one", "half_two").agg(
        F.count(F.lit(1)).alias("copies"), F.max(_undated()).alias("undated")
    )
    return different.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if("undated").alias("invalid_date_rows"),
        F.count_if(~F.col("undated")).alias("rows_kept"),
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Row and column count as one row."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count")
    )


def column_types(df: DataFrame) -> DataFrame:
    """One row per column with its type and kind."""
    rows = []
    for field in df.schema.fields:
        number = isinstance(field.dataType, T.NumericType)
        text = isinstance(field.dataType, T.StringType)
        kind = "number" if number else "text" if text else "date"
        rows.append((field.name, field.dataType.simpleString(), kind))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, data_type string, kind string"
    )
