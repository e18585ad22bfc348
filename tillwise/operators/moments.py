"""Moments that merge: counts, means, squares and products about the means of pairs of columns.

A state is a struct (n, mean_x, mean_y, square_x, square_y, product) over the rows where both columns
have a value; for one column, both are that column. States of parts of a table merge into the state
of the whole without loss of digits, as each carries sums about its own means. So one grouping of the
lines by the finest keys any statistic needs serves all of them: a coarser group's state is merged from
the states of its cells, and lines are read once and never copied.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.measures import exact_sum, named, sql_name

NOTHING = (
    "named_struct('n', 0L, 'mean_x', 0D, 'mean_y', 0D, 'square_x', 0D, 'square_y', 0D, 'product', 0D)"
)
#: Cells of a group are merged in so many parts first, so that no task gathers all of a large group's.
PARTS = 64
#: A spread this small against the mean is what rounding leaves of a constant column.
_ROUNDING = 4e-15


def state(x: str, y: str | None = None, where: str = "true") -> Column:
    """The state of a pair of columns, or of one column, as an aggregate over the rows that meet a
    condition given as SQL text."""
    x, y = sql_name(x), sql_name(y or x)
    kept = f"({where}) AND {x} IS NOT NULL AND {y} IS NOT NULL"
    left, right = (f"if({kept}, cast({c} as double), null)" for c in (x, y))
    product = f"var_pop({left})" if x == y else f"covar_pop({left}, {right})"
    return F.expr(
        f"named_struct('n', count({left}),"
        f" 'mean_x', coalesce(avg({left}), 0D), 'mean_y', coalesce(avg({right}), 0D),"
        f" 'square_x', coalesce(var_pop({left}) * count({left}), 0D),"
        f" 'square_y', coalesce(var_pop({right}) * count({left}), 0D),"
        f" 'product', coalesce({product} * count({left}), 0D))"
    )


def pair_name(x: str, y: str | None = None) -> str:
    """The column that holds the state of a pair, or of one column."""
    return f"{x}_and_{y}" if y else f"{x}_alone"


def states(pairs: Iterable[tuple[str, str | None]]) -> list[Column]:
    """Aggregates of several pairs, under their names."""
    return [state(x, y).alias(pair_name(x, y)) for x, y in pairs]


#: The state of two parts together, as a lambda over states.
_SHARE = "coalesce(b.n / nullif(a.n + b.n, 0), 0D)"
MERGED = f"""(a, b) -> named_struct(
  'n', a.n + b.n,
  'mean_x', a.mean_x + (b.mean_x - a.mean_x) * {_SHARE},
  'mean_y', a.mean_y + (b.mean_y - a.mean_y) * {_SHARE},
  'square_x', a.square_x + b.square_x + (b.mean_x - a.mean_x) * (b.mean_x - a.mean_x) * a.n * {_SHARE},
  'square_y', a.square_y + b.square_y + (b.mean_y - a.mean_y) * (b.mean_y - a.mean_y) * a.n * {_SHARE},
  'product', a.product + b.product + (b.mean_x - a.mean_x) * (b.mean_y - a.mean_y) * a.n * {_SHARE})"""


def all_merged(state_text: str) -> Column:
    """The state of all rows of a group together, as an aggregate of states given as SQL text; null
    ones are left out."""
    return F.expr(f"aggregate(collect_list({state_text}), {NOTHING}, {MERGED})")


def rolled_up(
    cells: DataFrame, keys: Sequence[str], names: Sequence[str], sums: Sequence[str] = ()
) -> DataFrame:
    """Cells merged into groups of ``keys``: the states called ``names`` and exact sums of ``sums``."""
    finer = [c for c in cells.columns if c not in (*names, *sums)]
    totals = named(**{s: exact_sum(s) for s in sums})
    aggregates = [*(all_merged(sql_name(n)).alias(n) for n in names), *totals]
    part = F.pmod(F.xxhash64(*(finer or [F.lit(0)])), F.lit(PARTS)).alias("part")
    parts = cells.select(*keys, part, *names, *sums).groupBy(*keys, "part").agg(*aggregates)
    return parts.groupBy(*keys).agg(*aggregates)


def _at(held: str | Column, field: str) -> Column:
    return (F.col(held) if isinstance(held, str) else held)[field]


def count_of(held: str | Column) -> Column:
    return _at(held, "n")


def mean_of(held: str | Column) -> Column:
    """The mean of the first column; null when there is no value."""
    return F.when(_at(held, "n") > 0, _at(held, "mean_x"))


def squares_of(held: str | Column, side: str = "x") -> Column:
    """The sum of squares about the mean; what rounding leaves of a constant column is zero."""
    square, mean, n = (_at(held, f"square_{side}"), _at(held, f"mean_{side}"), _at(held, "n"))
    least = F.lit(_ROUNDING) * F.abs(mean)
    return F.when(square <= least * least * n, 0.0).otherwise(square)


def variance_of(held: str | Column) -> Column:
    """The sample variance of the first column; null for fewer than two values."""
    n = _at(held, "n")
    return F.when(n > 1, squares_of(held) / F.nullif(n - 1, F.lit(0)))


def varies(held: str | Column) -> Column:
    return squares_of(held) > 0


def correlation_of(held: str | Column) -> Column:
    """The correlation of both columns; null when either is constant."""
    spread = F.sqrt(squares_of(held, "x")) * F.sqrt(squares_of(held, "y"))
    r = _at(held, "product") / F.nullif(spread, F.lit(0))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)
