"""Distinct counts that merge: one sketch per cell, made once and rolled up to any coarser group.

An exact distinct count has to be made anew for each grouping, as counts of two cells can't be
added, and shuffles every (group, value) pair. A HyperLogLog sketch of a cell has a fixed size, two
of them merge to that of both, and only sketches are shuffled. Opt-in: the reports keep exact counts.

The estimate's relative standard error is at most ``1.04 / sqrt(2^log_size)``; nulls are not counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_SIZE = 12


def standard_error(log_size: int = LOG_SIZE) -> float:
    return 1.04 / math.sqrt(2**log_size)


def distinct_cells(
    lines: DataFrame, keys: Sequence[str], counted: Sequence[str], log_size: int = LOG_SIZE
) -> DataFrame:
    """One row per cell of ``keys``, with a sketch of each counted column under its name."""
    made = [F.hll_sketch_agg(F.col(c).cast("string"), log_size).alias(c) for c in counted]
    return lines.groupBy(*keys).agg(*made)


def merged_cells(cells: DataFrame, keys: Sequence[str], counted: Sequence[str]) -> DataFrame:
    """Cells of coarser keys, from cells; without keys, the whole."""
    return cells.groupBy(*keys).agg(*[F.hll_union_agg(c).alias(c) for c in counted])


def distinct_counts(cells: DataFrame, counted: Sequence[str]) -> DataFrame:
    """Estimated distinct counts in place of the sketches; 0 for a column without values."""
    return cells.withColumns({c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0)) for c in counted})
