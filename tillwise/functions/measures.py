"""Aggregates and ratios, each with its null, zero and unit rules stated once.

Several reports share a name but not a rule: margins come as a percentage or as a
fraction, growth starts with null or with zero, an empty sum is null or zero. The
variants live here side by side so that a report picks one by name.

They take and return SQL text, which nests freely and reaches Spark as one expression;
``named`` turns a set of them into columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_name(name: str) -> str:
    """A column name as SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def named(**texts: str) -> list[Column]:
    """SQL texts as columns called by the argument names."""
    return [F.expr(f"{text} as {sql_name(name)}") for name, text in texts.items()]


def known(value: str) -> str:
    """A number as a double, with NaN as a missing one."""
    return f"nullif(cast({value} as double), double('NaN'))"


def exact_sum(value: str) -> str:
    """Sum of a money-like column that does not depend on row order.

    A value is cut into whole units, ten-thousandths and 10^-12ths of a unit, each summed as a
    long: exact under any partitioning, and without a decimal object for each row. What is left
    of a value after four decimals counts unless it is no more than a double's own rounding of
    that value. Null when there is no value to sum; NaN is no value.
    """
    value = known(value)
    whole = f"floor({value})"
    scaled = f"(({value}) - {whole}) * 10000D"
    rest = f"({scaled} - rint({scaled}))"
    told = f"if(abs({rest}) > abs({value}) * 4.5e-12D, {rest}, 0D)"
    return (
        f"cast(cast(sum({whole}) as decimal(20,0))"
        f" + sum(cast(rint({scaled}) as bigint)) * 0.0001BD"
        f" + sum(cast(rint({told} * 1e8D) as bigint)) * 0.000000000001BD as double)"
    )


def total(value: str) -> str:
    """``exact_sum`` with the data-frame rule that an empty sum is zero."""
    return f"coalesce({exact_sum(value)}, 0D)"


def exact_mean(value: str) -> str:
    """Mean of a money-like column from its exact sum; null when empty."""
    return f"({exact_sum(value)} / nullif(count({known(value)}), 0))"


def ratio(numerator: str, denominator: str) -> str:
    """Quotient that is zero where it is undefined."""
    return f"coalesce(({numerator}) / nullif({denominator}, 0), 0D)"


def margin_fraction(profit: str, sales: str) -> str:
    """Profit per unit of sales, zero where undefined."""
    return ratio(profit, sales)


def margin_pct(profit: str, sales: str) -> str:
    """Profit as a percentage of sales, zero where undefined."""
    return f"coalesce(({profit}) / nullif({sales}, 0) * 100D, 0D)"


def sql_margin_pct(profit: str, sales: str) -> str:
    """Percentage margin of the SQL reports: zero for zero sales, null for null sums."""
    return f"if(({sales}) = 0, 0D, ({profit}) * 100D / nullif({sales}, 0))"


def change(current: str, previous: str) -> str:
    """Fractional growth; null for a missing or zero previous value."""
    return f"(({current}) / nullif({previous}, 0) - 1D)"


def sql_change_pct(current: str, previous: str) -> str:
    """Percentage growth of the SQL reports; null for a missing or zero previous value."""
    return f"((({current}) - ({previous})) * 100D / nullif({previous}, 0))"
