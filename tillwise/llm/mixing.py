"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target divided by its size is how often each of its words is wanted: whole copies of
every document, and a fraction that becomes each document's inclusion probability. The cube
method draws the fraction so that both the number of documents and the number of words of the
draw keep their expected values: three undecided documents at a time move along the null space of
the two constraints until one of them is decided.

Documents fly in blocks of about ``BLOCK_ROWS``; the at most two a block leaves undecided meet
those of other blocks in a next flight, and so on, until one group a source is left. Only its last
two are landed, with the word constraint dropped. The longest tend to be undecided longest, so
landing may miss the words by a long document; the last group then takes back or adds the documents
that bring its words nearest to what was expected, a few in all.

Rows equal in doc_id, text and source are counted first and dealt over blocks by a running number,
so no block grows with the copies of one row.

Defined results: a null or empty text has size 0 and nothing is taken from it. Documents without a
source form a source that comes last. Repeated rows are drawn one by one. Every draw is seeded by
source, block and flight and goes through documents in a fixed order, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import expanded, keep, numbered, text_key, words_column

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_ROWS = 20_000
#: So many blocks' undecided documents fly together next.
BLOCKS_TOGETHER = 5_000
SEED = 20


def size_column() -> Column:
    return F.size(words_column()).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_no, source, rows, source_size, target) from (source, size) of documents.

    Shares are by weight; where a share is above ``MOST_COPIES`` times the source's size it stops
    there, and the rest is shared again among the others. Each round is one aggregation over
    sources, of which the driver sees two sums.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    per = numbered(per, F.col("source").asc_nulls_last()).withColumnRenamed("number", "source_no")
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weight = F.get(cycle, (F.col("source_no") % len(WEIGHTS)).cast("int"))
    most = MOST_COPIES * F.col("source_size")
    total, weights = per.agg(F.sum("source_size"), F.sum(weight)).first()
    wanted, level, before = SHARE * (total or 0), 0.0, -1.0
    if wanted:
        level = wanted / weights
    while level > before and wanted:
        stopped = F.lit(level) * weight > most
        used, weights = per.agg(
            F.sum(F.when(stopped, most).otherwise(0)), F.sum(F.when(stopped, 0.0).otherwise(weight))
        ).first()
        if not weights:
            break
        before, level = level, (wanted - used) / weights
    return per.withColumn("target", F.least(F.lit(level) * weight, most.cast("double")))


def fly(chance: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """One flight: chances after it, of which at most two lie strictly between 0 and 1."""
    p, x = chance.tolist(), size.tolist()
    active: list[int] = []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        move = (x[b] - x[c], x[c] - x[a], x[a] - x[b])  # keeps the number and the words
        if not any(move):
            move = (1.0, -1.0, 0.0)
        active = _step(p, active, move, random)
    return np.array(p)


def land(chance: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Decides what a flight has left: the number is kept as near as can be, words are not."""
    p = chance.tolist()
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    while len(left) > 1:
        left = _step(p, left[:2], (1.0, -1.0), random) + left[2:]
    for i in left:
        p[i] = float(random.random() < p[i])
    return np.array(p)


def settle(chance: np.ndarray, decided: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Changes single decisions on documents that were open, as long as that brings the words nearer to
    those expected."""
    decided, open_ = decided.copy(), np.flatnonzero((chance > 0) & (chance < 1))
    off = float((decided - chance) @ size)
    while len(open_):
        change = np.where(decided[open_] > 0.5, -size[open_], size[open_])
        best = int(np.argmin(np.abs(off + change)))
        if abs(off + change[best]) >= abs(off) - 1e-6:
            break
        off += change[best]
        decided[open_[best]] = 1 - decided[open_[best]]
    return decided


def _step(p: list[float], active: list[int], move: tuple, random: np.random.Generator) -> list[int]:
    """Goes along ``move`` or against it to the border of the cube, so that means stay."""
    ahead = min((1 - p[i]) / m if m > 0 else p[i] / -m for i, m in zip(active, move) if m)
    back = min(p[i] / m if m > 0 else (1 - p[i]) / -m for i, m in zip(active, move) if m)
    by = ahead if random.random() * (ahead + back) < back else -back
    for i, m in zip(active, move):
        value = p[i] + by * m
        p[i] = 0.0 if value < 1e-9 else 1.0 if value > 1 - 1e-9 else value
    return [i for i in active if 0 < p[i] < 1]


def _flight(level: int, last: bool):
    def of(group: pd.DataFrame) -> pd.DataFrame:
        number, block = int(group.source_no.iloc[0]), int(group.block.iloc[0])
        random = np.random.default_rng([SEED, level, number, block])
        group = group.sort_values(["size", "spread", "doc_id", "text_key", "copy"], ascending=False, kind="stable")
        before, size = group.chance.to_numpy(), group["size"].to_numpy().astype(float)
        chance = fly(before, size, random)
        return group.assign(chance=settle(before, land(chance, random), size) if last else chance)

    return of


def copies(documents: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, text_key, size, source_size, target, copies) of every row. ``text_key`` tells rows
    of one doc_id apart, by text or by ``key``."""
    rows = documents.select(
        "doc_id", "source", (text_key() if key is None else key).alias("text_key"), size_column().alias("size")
    )
    rows = keep(rows)
    targets = keep(source_targets(rows))
    most_rows = targets.agg(F.max("rows")).first()[0] or 0
    df = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "text_key", "size", "source_no", "source_size", "target", "rows"
    )
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    df = df.withColumn("whole", F.floor(wanted + 1e-12)).withColumn("chance", F.greatest(wanted - F.col("whole"), F.lit(0.0)))
    # Nothing to draw where there are no words; such rows would only fill flights.
    df = df.withColumn("chance", F.when(F.col("size") > 0, F.col("chance")).otherwise(0.0))
    equal = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    df = expanded(keep(equal), "n")
    spread = F.xxhash64(F.lit(SEED), "doc_id", "text_key", "copy")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    df = df.withColumns({"spread": spread, "block": F.pmod(F.xxhash64(spread, F.lit(1)), blocks)})

    decided, level = None, 0
    n_blocks = math.ceil(most_rows / BLOCK_ROWS)
    last = False
    while True:
        flown = keep(df.groupBy("source_no", "block").applyInPandas(_flight(level, last), df.schema))
        done = flown.where("chance <= 0 OR chance >= 1")
        decided = done if decided is None else decided.union(done)
        if last:
            break
        df = flown.where("chance > 0 AND chance < 1").withColumn(
            "block", F.floor(F.col("block") / BLOCKS_TOGETHER)
        )
        n_blocks = math.ceil(n_blocks / BLOCKS_TOGETHER)
        level, last = level + 1, n_blocks <= 1
    return decided.select(
        "doc_id", "text_key", "size", "source_size", "target",
        (F.col("whole") + F.col("chance")).cast("long").alias("copies"),
    )


def mixing(documents: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return copies(documents).select("doc_id", "size", "source_size", "target", taken)


def mixed(documents: DataFrame) -> DataFrame:
    """The documents the mix takes, each as often as it takes it, with all their columns. Only rows
    equal in every column stand for each other: one of them comes as often as all."""
    names = documents.columns
    own = documents.select(F.struct(*[documents[c] for c in names]).alias("row"))
    drawn = copies(documents, F.xxhash64(*[documents[c] for c in names])).where("copies > 0")
    drawn = drawn.groupBy("text_key").agg(F.sum("copies").alias("copies"))
    df = own.withColumn("row_key", F.xxhash64("row"))
    met = df.join(drawn, df["row_key"] == drawn["text_key"]).dropDuplicates(["row_key"])
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")
    return met.select("row", again).select("row.*")
