"""Order-line files: raw CSV in, Parquet and CSV out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.measures import sql_name
from tillwise.schema import (
    NA_TOKENS,
    NUMBER_TYPES,
    require_columns,
    snake_names,
    with_headers,
)


def _cell(name: str, types: Mapping[str, T.DataType], tolerant: bool) -> Column:
    text = F.col(sql_name(name))
    present = F.when(~F.trim(text).isin(*NA_TOKENS), text)
    if name not in types:
        return present.alias(name)
    number = F.trim(present)
    if isinstance(types[name], T.IntegralType):  # also as a file may spell it, 2.0
        real = number.try_cast("double")
        whole = F.when(real == F.rint(real), real.try_cast(types[name]))
        parsed = F.coalesce(number.try_cast(types[name]), whole)
        if not tolerant:  # what is no whole number fails here
            parsed = F.when(present.isNull() | parsed.isNotNull(), parsed).otherwise(number.cast(types[name]))
    else:
        parsed = number.try_cast(types[name]) if tolerant else number.cast(types[name])
    return parsed.alias(name)


def _text_reader(spark: SparkSession, multi_line: bool, encoding: str) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("encoding", encoding)
    )


def read_order_csv(
    spark: SparkSession,
    path: str | list[str],
    needed: Iterable[str] = (),
    types: Mapping[str, T.DataType] = NUMBER_TYPES,
    tolerant: bool = False,
    multi_line: bool = False,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Read order-line CSV files with a header row.

    Columns are matched by header, so extra ones pass through as text and the
    order does not matter. The usual missing-value spellings become null. A cell
    that is no number fails the job, or becomes null when ``tolerant``. Files stay
    splittable unless ``multi_line`` is asked for (line breaks inside quotes).
    """
    text = _text_reader(spark, multi_line, encoding).csv(path)
    named = require_columns(snake_names(text), needed)
    return named.select(*[_cell(name, types, tolerant) for name in named.columns])


def sort_out_order_csv(
    spark: SparkSession,
    path: str | list[str],
    folder: str,
    needed: Iterable[str] = (),
    types: Mapping[str, T.DataType] = NUMBER_TYPES,
    multi_line: bool = False,
    encoding: str = "UTF-8",
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Read order-line CSV files without failing on any row: (kept, rejected, row counts).

    A row is rejected where it has more or fewer cells than the header, or a cell of a number column
    that is no such number. ``kept`` is as ``read_order_csv`` gives it. ``rejected`` has ``reason``,
    ``raw_row`` (the row as it stands in the file, for a wrong number of cells) and ``cells`` as text.
    The files are parsed once, into two parts below ``folder`` (replaced); the counts, observed
    during that write, add up to the files' rows.
    """
    found = _text_reader(spark, multi_line, encoding).csv(path)
    header = require_columns(snake_names(found), needed)
    raw_row, reason, is_rejected = (_free(header, n) for n in ("raw_row", "reason", "is_rejected"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*found.columns, raw_row]])
    read = (
        _text_reader(spark, multi_line, encoding)
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)  # else only the cells that a query reads are counted
        .option("columnNameOfCorruptRecord", raw_row)
        .schema(schema)
    )
    text = read.csv(path).toDF(*header.columns, raw_row)
    typed = {n: _cell(n, types, True) for n in header.columns}
    wrong = [
        F.when(typed[n].isNull() & _cell(n, {}, True).isNotNull(), F.lit(f"{n} is no number"))
        for n in header.columns
        if n in types
    ]
    malformed = F.when(F.col(raw_row).isNotNull(), F.lit("wrong number of cells"))
    why = F.when(malformed.isNotNull(), malformed).otherwise(F.concat_ws(", ", *wrong)) if wrong else malformed
    at = _free(header, "cells")
    cells = F.struct(*[F.col(sql_name(n)) for n in header.columns]).alias(at)
    checked = text.select(*typed.values(), raw_row, F.nullif(why, F.lit("")).alias(reason), cells)
    rejected = F.col(reason).isNotNull()
    seen = Observation()
    checked = checked.withColumn(is_rejected, rejected).withColumn(at, F.when(rejected, F.col(at)))
    checked = checked.observe(
        seen, F.count_if(~F.col(is_rejected)).alias("kept"), F.count_if(F.col(is_rejected)).alias("rejected")
    )
    checked.write.mode("overwrite").partitionBy(is_rejected).parquet(folder)
    stored = spark.read.schema(checked.schema).parquet(folder)
    kept = stored.where(~F.col(is_rejected)).select(*[F.col(sql_name(n)) for n in header.columns])
    dropped = stored.where(is_rejected).select(
        F.col(reason).alias("reason"), F.col(raw_row).alias("raw_row"), F.col(at).alias("cells")
    )
    return kept, dropped, {name: seen.get[name] for name in ("kept", "rejected")}


def _free(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def write_clean_table(lines: DataFrame, path: str, balance: bool = True) -> None:
    """Store cleaned lines as Parquet partitioned by year, replacing ``path``.

    Reports then read one columnar copy instead of parsing CSV again, and a filter
    on ``year`` skips whole folders. Rows are brought together by year first, as the
    rebalance hint lets adaptive execution cut a heavy year into many tasks; without
    it every task writes a small file per year.
    """
    placed = lines.hint("rebalance", "year") if balance else lines
    placed.write.mode("overwrite").partitionBy("year").parquet(path)


def read_clean_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register_lines(lines: DataFrame, view: str = "order_lines") -> None:
    """Make lines available to SQL text, replacing an earlier view of that name."""
    lines.createOrReplaceTempView(view)


def save_lines_table(lines: DataFrame, table: str) -> None:
    """Store lines as a catalog table, replacing it."""
    lines.write.mode("overwrite").format("parquet").saveAsTable(table)


def save_bucketed_lines(lines: DataFrame, table: str, buckets: int, key: str = "order_id") -> None:
    """Store lines as a catalog table, bucketed and sorted by ``key``, replacing it.

    Joins and aggregates by ``key``, as distinct orders by any column need, then read it without an
    exchange below them; so do joins with another table of as many buckets. Lines are brought
    together by bucket first, so that each bucket is one file and not one for every task.
    """
    placed = lines.repartition(buckets, key)
    (
        placed.write.mode("overwrite").format("parquet")
        .bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    )


def write_csv(
    df: DataFrame,
    path: str,
    headers: Mapping[str, str] | None = None,
    one_file: bool = False,
) -> int:
    """Write ``df`` as CSV with a header row, replacing ``path``; return its row count.

    The count is observed during the write, not by a second run. ``one_file`` is for
    results bounded by a calendar or a top-k only: it passes all rows through a task.
    """
    shown = with_headers(df, headers) if headers else df
    seen = Observation()
    shown = shown.observe(seen, F.count(F.lit(1)).alias("rows"))
    if one_file:
        shown = shown.coalesce(1)
    shown.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return seen.get["rows"]


def write_batch(
    results: Mapping[str, DataFrame],
    folder: str,
    headers: Mapping[str, Mapping[str, str]] | None = None,
    one_file: Iterable[str] = (),
) -> dict[str, int]:
    """Write each named result to its own CSV folder; return rows written per name."""
    small = set(one_file)
    return {
        name: write_csv(df, f"{folder}/{name}", (headers or {}).get(name), name in small)
        for name, df in results.items()
    }


def run_named_queries(
    lines: DataFrame,
    queries: Mapping[str, str | Callable[[DataFrame], DataFrame]],
    folder: str,
    view: str = "order_lines",
    one_file: Iterable[str] = (),
) -> dict[str, int]:
    """Run every named query in order and export it as ``NN_name``, counted from 01.

    A query is SQL text over ``view`` or a function of the lines.
    """
    register_lines(lines, view)
    small = set(one_file)
    rows = {}
    for number, (name, query) in enumerate(queries.items(), start=1):
        result = lines.sparkSession.sql(query) if isinstance(query, str) else query(lines)
        rows[name] = write_csv(result, f"{folder}/{number:02d}_{name}", one_file=name in small)
    return rows
