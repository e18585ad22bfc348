"""Column names, types and the column sets each job needs.

Inside the package every column is snake_case; report headers are put on only
when a result is written or shown (see ``with_headers``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Header of each column of the order-line file, raw then derived.
HEADERS: dict[str, str] = {
    "order_id": "Order ID",
    "order_date": "Order Date",
    "ship_date": "Ship Date",
    "ship_mode": "Ship Mode",
    "customer_id": "Customer ID",
    "customer_name": "Customer Name",
    "segment": "Segment",
    "city": "City",
    "state": "State",
    "region": "Region",
    "product_id": "Product ID",
    "category": "Category",
    "sub_category": "Sub-Category",
    "product_name": "Product Name",
    "sales": "Sales",
    "quantity": "Quantity",
    "discount": "Discount",
    "profit": "Profit",
    "year": "Year",
    "month": "Month",
    "quarter": "Quarter",
    "profit_margin_pct": "Profit Margin %",
    "discount_impact": "Discount Impact",
    "delivery_days": "Delivery Days",
    "delivery_speed": "Delivery Speed",
}

# Columns that are numbers in the file; every other one is read as text.
NUMBER_TYPES: dict[str, T.DataType] = {
    "sales": T.DoubleType(),
    "profit": T.DoubleType(),
    "discount": T.DoubleType(),
    "quantity": T.LongType(),
    "year": T.IntegerType(),
    "month": T.IntegerType(),
    "quarter": T.IntegerType(),
    "profit_margin_pct": T.DoubleType(),
    "discount_impact": T.DoubleType(),
    "delivery_days": T.IntegerType(),
}

# Cell texts that mean "missing" in a CSV file.
NA_TOKENS: tuple[str, ...] = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Every column a job reads, so that a gap is reported before the job starts.
REQUIRED: dict[str, frozenset[str]] = {
    "cleaning": frozenset(
        {"order_date", "ship_date", "sales", "profit", "discount", "quantity", "category", "state"}
    ),
    "reports": frozenset(
        {"order_id", "order_date", "customer_id", "customer_name", "segment", "state", "region",
         "product_id", "product_name", "category", "ship_mode", "sales", "profit", "discount",
         "year", "month", "delivery_days"}
    ),
    "statistics": frozenset({"order_date", "sales", "profit", "discount", "region", "segment"}),
    "forecast": frozenset({"order_date", "sales"}),
    "extracts": frozenset(
        {"order_id", "order_date", "sales", "profit", "region", "state", "city", "category",
         "sub_category", "customer_id", "customer_name", "segment", "product_name", "discount"}
    ),
    "workbook": frozenset(
        {"order_id", "order_date", "sales", "profit", "region", "category", "sub_category",
         "customer_id", "customer_name", "segment", "product_name"}
    ),
}


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise naming the columns it lacks."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError("columns not found: " + ", ".join(missing))
    return df


def snake_names(df: DataFrame) -> DataFrame:
    """Rename file headers to the package's names; other columns pass through."""
    return df.withColumnsRenamed({header: name for name, header in HEADERS.items()})


def with_headers(df: DataFrame, headers: Mapping[str, str] = HEADERS) -> DataFrame:
    """Rename snake_case columns to the headers a report is published under."""
    return df.withColumnsRenamed(dict(headers))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
