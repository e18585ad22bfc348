"""Order lines assembled from a star schema of Parquet tables.

Every line is kept: dimensions are attached by left joins on their unique keys, so
a line whose customer or part is unknown shows nulls instead of vanishing. That also
makes it safe to leave out the joins a report has no column from, which Catalyst
cannot do for inner joins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The table columns used, typed, so that opening a table starts no job to look them up.
TABLES: dict[str, str] = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double,"
    " l_extendedprice double, l_discount double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz,"
    " o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string,"
    " p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string",
}

# Which table each order-line column comes from.
COLUMN_TABLE: dict[str, str] = {
    "order_id": "lineitem",
    "ship_date": "lineitem",
    "product_id": "lineitem",
    "sales": "lineitem",
    "quantity": "lineitem",
    "discount": "lineitem",
    "profit": "part",
    "category": "part",
    "sub_category": "part",
    "product_name": "part",
    "city": "supplier",
    "order_date": "orders",
    "ship_mode": "orders",
    "customer_id": "orders",
    "customer_name": "customer",
    "segment": "customer",
    "state": "nation",
    "region": "region",
}

COLUMNS: tuple[str, ...] = (
    "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "customer_name",
    "segment", "city", "state", "region", "product_id", "category", "sub_category",
    "product_name", "sales", "quantity", "discount", "profit",
)

# Tables a table's rows hang on, nearest first.
PARENTS: dict[str, tuple[str, ...]] = {
    "region": ("nation", "customer", "orders"),
    "nation": ("customer", "orders"),
    "customer": ("orders",),
}


# Line profit is the discounted price less twice the list price of the units sold. All
# its factors have two decimals, so four hold the result exactly.
_PROFIT = (
    "rint((l_extendedprice * (1 - l_discount) - 2 * l_quantity * p_retailprice) * 10000.0D)"
    " / 10000.0D"
)

EXPRESSIONS: dict[str, str] = {
    "order_id": "l_orderkey",
    "order_date": "cast(o_orderdate as date)",
    "ship_date": "cast(l_shipdate as date)",
    "ship_mode": "o_orderpriority",
    "customer_id": "o_custkey",
    "customer_name": "c_name",
    "segment": "c_mktsegment",
    "city": "s_name",
    "state": "n_name",
    "region": "r_name",
    "product_id": "l_partkey",
    "category": "p_type",
    "sub_category": "p_brand",
    "product_name": "p_name",
    "sales": "l_extendedprice",
    "quantity": "cast(l_quantity as int)",
    "discount": "l_discount",
    "profit": _PROFIT,
}


def order_lines(
    spark: SparkSession, folder: str, columns: Iterable[str] = COLUMNS
) -> DataFrame:
    """The requested order-line columns, joining only the tables they come from.

    No join carries a broadcast hint: Catalyst broadcasts a table when its size allows.
    Customer, nation and region are attached to orders first, so that where the tables
    are too big to broadcast the lines are shuffled once for the whole branch and not
    once per table. Orders come last: lines that are then grouped by order, as every count of
    distinct orders does, are already in place. Adaptive execution splits the partitions of a
    hot order or part.
    """
    wanted = list(columns)
    unknown = sorted(set(wanted) - set(COLUMN_TABLE))
    if unknown:
        raise ValueError("no such order-line columns: " + ", ".join(unknown))
    tables = {COLUMN_TABLE[name] for name in wanted}
    for name in list(tables):
        tables.update(PARENTS.get(name, ()))

    def read(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")

    def attach(child: DataFrame, name: str, key: str, parent_key: str) -> DataFrame:
        if name not in tables:
            return child
        return child.join(read(name), F.col(key) == F.col(parent_key), "left")

    lines = attach(read("lineitem"), "part", "l_partkey", "p_partkey")
    lines = attach(lines, "supplier", "l_suppkey", "s_suppkey")
    if "orders" in tables:
        orders = attach(read("orders"), "customer", "o_custkey", "c_custkey")
        orders = attach(orders, "nation", "c_nationkey", "n_nationkey")
        orders = attach(orders, "region", "n_regionkey", "r_regionkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return lines.selectExpr(*[f"{EXPRESSIONS[name]} as {name}" for name in wanted])
