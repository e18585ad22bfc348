"""Line dedup over overlapping three-line windows.

A window is three consecutive lines of a text that hold a character other than white space; blank
lines lie in no window and always stay. Windows are hashed to 128 bits; a window is repeated if it
starts at more than one place of the corpus. All its occurrences but the first (smallest doc_id,
then smallest text key, then line) are removed, and the lines they cover are merged to spans.

Windows are counted with partial sums before the shuffle, and only their join with the repeated
ones moves single windows; adaptive execution splits that join where a window is very frequent.

Defined results: a null text has no lines. A text with fewer than three lines that aren't blank
has no window and stays. Rows that repeat a doc_id and its text are one document; each gets its
row. A null doc_id counts as the smallest. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import WHITE, same_document, text_key

LINES = 3


def _numbered(lines: str) -> Column:
    """(at, line) of the lines that are not blank."""
    return F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line"))),
        lambda x: x["line"].rlike(f"[^{WHITE}]"),
    )


def line_windows(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, hash, check, at, lines) of every window; lines: the numbers it covers."""
    df = documents.select("doc_id", text_key().alias("text_key"), F.split("text", "\n").alias("lines"))
    df = df.withColumn("held", _numbered("lines")).drop("lines")

    def window(x: Column, i: Column) -> Column:
        held = [x, *[F.get("held", i + k) for k in range(1, LINES)]]
        texts = [h["line"] for h in held]
        return F.struct(
            F.xxhash64(*texts).alias("hash"),
            F.xxhash64(F.lit(1), *texts).alias("check"),
            x["at"].alias("at"),
            F.array(*[h["at"] for h in held]).alias("lines"),
        )

    starts = F.slice("held", 1, F.greatest(F.size("held") - (LINES - 1), F.lit(0)))
    return df.select("doc_id", "text_key", F.explode(F.transform(starts, window)).alias("w")).select(
        "doc_id", "text_key", "w.*"
    )


def line_dedup(documents: DataFrame) -> DataFrame:
    """Per row: n_lines, n_removed, removed (spans of line numbers, both ends in), kept_text."""
    place = F.struct("doc_id", "text_key", "at")
    windows = line_windows(documents)
    repeated = (
        windows.groupBy("hash", "check")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .drop("n")
    )
    later = windows.join(repeated, ["hash", "check"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("covered")
    )
    df = documents.select(
        "doc_id", text_key().alias("text_key"),
        F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n")).alias("lines"),
    )
    none = F.array().cast("array<int>")
    df = df.join(covered, same_document(df, covered), "left").select(
        df["doc_id"], "lines", F.coalesce("covered", none).alias("covered")
    )
    numbers = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(none)
    df = df.withColumn("left", F.array_except(numbers, "covered"))
    first = F.filter("covered", lambda x, i: F.coalesce(F.get("covered", i - 1) < x - 1, F.lit(True)))
    last = F.filter("covered", lambda x, i: F.coalesce(F.get("covered", i + 1) > x + 1, F.lit(True)))
    return df.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("covered").cast("long").alias("n_removed"),
        F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last"))).alias("removed"),
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n").alias("kept_text"),
    )
