"""Which date formats the text columns of a file are written in, found from the data.

One aggregation counts for every column and candidate how many texts it parses. A format whose day and
month stand the other way round parses many of the same texts; of such twins the one is chosen that
alone parses some, and where none or both do, the column is refused instead of guessed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidates, those with the month first beside their twins with the day first.
TWINS: tuple[tuple[str, str], ...] = (
    ("M/d/yyyy", "d/M/yyyy"),
    ("M-d-yyyy", "d-M-yyyy"),
    ("M.d.yyyy", "d.M.yyyy"),
)
CANDIDATES: tuple[str, ...] = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/M/d", *(f for twins in TWINS for f in twins),
)


def _parses(name: str, pattern: str) -> Column:
    return F.try_to_timestamp(F.col(name), F.lit(pattern)).isNotNull()


def format_coverage(
    df: DataFrame, names: Sequence[str], candidates: Sequence[str] = CANDIDATES
) -> DataFrame:
    """(column_name, date_format, text_count, parsed_count, alone_count) for each column and candidate,
    from one pass; alone_count is how many texts a format parses that its twin doesn't."""
    twin = {a: b for pair in TWINS for a, b in (pair, pair[::-1])}
    cells = []
    for name in names:
        for pattern in candidates:
            parsed = _parses(name, pattern)
            other = twin.get(pattern)
            alone = parsed & ~_parses(name, other) if other in candidates else parsed
            cells.append(
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.lit(pattern).alias("date_format"),
                    F.count(name).alias("text_count"),
                    F.count_if(parsed).alias("parsed_count"),
                    F.count_if(alone).alias("alone_count"),
                )
            )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def detected_formats(
    df: DataFrame, names: Sequence[str], candidates: Sequence[str] = CANDIDATES
) -> dict[str, tuple[str, ...]]:
    """The formats that each column's texts are written in, the most frequent first. A column whose
    day and month can't be told apart is an error; one without any date has no formats."""
    found: dict[str, dict[str, tuple[int, int]]] = {name: {} for name in names}
    for row in format_coverage(df, names, candidates).collect():  # a row for each column and candidate
        if row["parsed_count"]:
            found[row["column_name"]][row["date_format"]] = (row["parsed_count"], row["alone_count"])
    for name, counts in found.items():
        for first, second in TWINS:
            if first in counts and second in counts:
                alone = {f: counts[f][1] for f in (first, second)}
                if bool(alone[first]) == bool(alone[second]):
                    raise ValueError(
                        f"column {name}: day and month can't be told apart between {first} and"
                        f" {second}; give the formats"
                    )
                del counts[min(alone, key=alone.get)]
    return {
        name: tuple(sorted(counts, key=lambda f: (-counts[f][0], candidates.index(f))))
        for name, counts in found.items()
    }
