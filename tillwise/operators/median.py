"""Exact medians of many columns by radix selection, in a fixed number of passes.

Every number gets a long key of its own that sorts as the number does. The value at a rank is
found 16 bits of its key at a time: one aggregation counts, for all columns together, the rows of
each digit among those that share the digits known so far, and a running sum over at most 65,536
digits tells which one holds the rank. After four such passes the key is known. No value is
gathered or sorted, whatever the size or the spread of a column. The keys are stored once, so the
input itself, which may be a join or text to parse, is read a single time.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.operators.keep import store

_DIGIT = 16
_PASSES = 64 // _DIGIT


def _double_key(value: str, place: str) -> Column:
    """The bits of a double as a long that sorts as the double does; both zeros are 0. ``place``
    holds an exponent that is right or, as logarithms are rounded, next to the right one."""
    x, size, near = F.col(value), F.abs(value), F.col(place)
    power = F.pow(F.lit(2.0), near)
    lower, higher = power > size, power * 2 <= size
    right = F.when(lower, power / 2).when(higher, power * 2).otherwise(power)
    exponent = near + F.when(lower, -1).when(higher, 1).otherwise(0) + 1023
    bits = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(size < F.lit(2.0**-1022), (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long"))
        .when(size == F.lit(float("inf")), F.lit(0x7FF << 52))
        .otherwise(F.shiftleft(exponent, 52) + ((size / right - 1) * F.lit(2.0**52)).cast("long"))
    )
    return F.when(~F.isnan(x), F.when(x < 0, -bits).otherwise(bits))


def _double_of(key: int) -> float:
    value = struct.unpack(">d", struct.pack(">q", abs(key)))[0]
    return -value if key < 0 else value


@dataclass
class _Search:
    """Looks for the key at ``rank`` (from 0) among those that begin with ``prefix``."""

    column: str
    rank: int
    prefix: int | None = None


def ordered_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Longs ``key_0``, ``key_1``, ... that sort as the columns do; null for nulls and NaN."""
    whole = [isinstance(df.schema[c].dataType, T.IntegralType) for c in columns]
    values = df.select(
        *[F.col(c).cast("long" if w else "double").alias(f"key_{i}") for i, (c, w) in enumerate(zip(columns, whole))]
    )
    fractions = [name for name, w in zip(values.columns, whole) if not w]
    places = {f"place_of_{n}": F.least(F.floor(F.log2(F.abs(n))), F.lit(1023)) for n in fractions}
    keyed = values.withColumns(places) if places else values
    return keyed.select(
        *[_double_key(n, f"place_of_{n}").alias(n) if n in fractions else n for n in values.columns]
    )


def _counts(keys: DataFrame, parts: Sequence[tuple[str, int | None]], known: int) -> DataFrame:
    """(part, digit, before, rows): for each part, how many rows have the digit, and a smaller one."""
    shift = 64 - _DIGIT * (known + 1)
    found = []
    for number, (column, prefix) in enumerate(parts):
        key = F.col(column)
        if prefix is None:  # the first digit carries the sign
            digit, inside = F.shiftright(key, shift), key.isNotNull()
        else:
            digit = F.shiftright(key, shift).bitwiseAND((1 << _DIGIT) - 1)
            inside = F.shiftright(key, shift + _DIGIT) == F.lit(prefix)
        found.append(F.when(inside, F.struct(F.lit(number).alias("part"), digit.alias("digit"))))
    rows = keys.select(F.explode(F.array(*found)).alias("found")).where("found IS NOT NULL")
    counted = rows.groupBy("found.part", "found.digit").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("part").orderBy("digit"))
    return counted.withColumn("before", upto - F.col("rows"))


def _narrow(keys: DataFrame, searches: Sequence[_Search], known: int) -> None:
    """Adds the next digit to every search; the driver sees one row for each."""
    parts = list(dict.fromkeys((s.column, s.prefix) for s in searches))
    wanted = F.lit(False)
    for search in searches:
        part = parts.index((search.column, search.prefix))
        wanted = wanted | (
            (F.col("part") == part)
            & (F.col("before") <= search.rank)
            & (F.col("before") + F.col("rows") > search.rank)
        )
    hits = _counts(keys, parts, known).where(wanted).collect()
    for search in searches:
        part = parts.index((search.column, search.prefix))
        for hit in hits:
            if hit["part"] == part and hit["before"] <= search.rank < hit["before"] + hit["rows"]:
                above = 0 if search.prefix is None else search.prefix << _DIGIT
                search.prefix, search.rank = above + hit["digit"], search.rank - hit["before"]
                break


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    """Median of each column, the mean of the two middle values for an even count.

    A column without values has the median ``None``; NaN is no value, decimals count as doubles.
    """
    return medians_and_counts(df, columns)[0]


def medians_and_counts(
    df: DataFrame, columns: Sequence[str], holed_only: bool = False
) -> tuple[dict[str, Any], dict[str, int], int]:
    """Medians, number of values by column, and number of rows.

    ``df`` is read once: the keys of its columns are stored, and all passes read those. With
    ``holed_only`` only columns that lack values are searched.
    """
    if not columns:
        return {}, {}, df.count()
    keys = store(ordered_keys(df, columns))
    rows, *counted = keys.agg(F.count(F.lit(1)), *[F.count(name) for name in keys.columns]).first()
    values = dict(zip(columns, counted))
    searches = {
        name: [_Search(key, rank) for rank in sorted({(values[name] - 1) // 2, values[name] // 2})]
        for name, key in zip(columns, keys.columns)
        if values[name] and not (holed_only and values[name] == rows)
    }
    every = [search for pair in searches.values() for search in pair]
    if every:
        for known in range(_PASSES):
            _narrow(keys, every, known)
    medians: dict[str, Any] = dict.fromkeys(columns)
    for name, pair in searches.items():
        whole = isinstance(df.schema[name].dataType, T.IntegralType)
        middle = [search.prefix if whole else _double_of(search.prefix) for search in pair]
        medians[name] = middle[0] if len(middle) == 1 else (middle[0] + middle[1]) / 2
    return medians, values, rows
