"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in blocks. How many rows of each block go to each shard is drawn first, block by block,
from the multivariate hypergeometric law, so that every shard ends with exactly its number of rows
(numbers differ by one at most). Then each block is permuted and dealt out by its line of the
matrix, rows are exchanged, and each shard is permuted again, piece by piece.

The driver sees row counts of blocks and pieces only; both are bounded in number (``MOST_BLOCKS``),
not in rows. All order comes from seeded hashes of a row, so reruns agree. Rows that stand in the
table more often than a block has rows are counted and told apart by a running number, which goes
into their hashes; so no block and no piece holds all copies of a row.

Defined results: a null text has no bytes, size 1 and the checksum of the empty text. Rows equal in
every column are interchangeable; each gets its own slot. Columns named shard or slot are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import expanded, keep

SHARDS = 8
BLOCK_ROWS = 20_000
MOST_BLOCKS = 1 << 16
#: Lines of the matrix are drawn by numpy from at most so many rows at once (its own limit is 10^9).
#: The room of each such wave of blocks in each shard is drawn from the same law before.
WAVE_ROWS = 900_000_000
SEED = 20


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (i < rows % shards) for i in range(shards)], np.int64)


def _log_rise(m: int, by: int) -> float:
    """log((m + by)! / m!), without the cancellation that two logarithms of large ones have."""
    if min(m, m + by) < 1_000_000:
        return math.lgamma(m + by + 1) - math.lgamma(m + 1)
    rise = (m + by + 0.5) * math.log1p(by / m) + by * (math.log(m) - 1)
    return rise + (1 / (m + by) - 1 / m) / 12


def hypergeometric(good: int, bad: int, drawn: int, random: np.random.Generator) -> int:
    """How many of ``drawn`` rows out of good + bad are good, for numbers of any size: the ratio of
    uniforms under the law's table-mountain hat, accepted by the law's exact ratio to its mode."""
    least, most = max(0, drawn - bad), min(good, drawn)
    if least >= most:
        return least
    rows = good + bad
    if rows < 1_000_000_000:
        return int(random.hypergeometric(good, bad, drawn))
    mean = drawn * (good / rows)
    spread = math.sqrt(mean * (bad / rows) * ((rows - drawn) / (rows - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = min(most, max(least, (drawn + 1) * (good + 1) // (rows + 2)))
    while True:
        u, v = 1.0 - random.random(), random.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if not least <= x <= most:
            continue
        by = x - mode
        ratio = _log_rise(mode, by) + _log_rise(bad - drawn + mode, by)
        ratio += _log_rise(good - mode, -by) + _log_rise(drawn - mode, -by)
        if 2 * math.log(u) <= -ratio:
            return x


def _room(left: np.ndarray, rows: int, random: np.random.Generator) -> np.ndarray:
    """How many of the next ``rows`` rows go to each shard, of which ``left`` are still open."""
    room, behind = np.zeros_like(left), int(left.sum())
    for i, open_ in enumerate(left.tolist()):
        behind -= open_
        room[i] = hypergeometric(open_, behind, rows, random)
        rows -= int(room[i])
    return room


def communication_matrix(blocks: list[int], shards: int, seed: int = SEED, wave_rows: int = WAVE_ROWS) -> np.ndarray:
    """Rows of each block (line) for each shard (column). Lines sum to the blocks' rows, columns
    to the shard sizes; the law is the same however the lines are cut into waves."""
    random = np.random.default_rng(seed)
    left, left_rows = shard_sizes(sum(blocks), shards), sum(blocks)
    matrix, i = np.zeros((len(blocks), shards), np.int64), 0
    while i < len(blocks):
        j, rows = i, 0
        while j < len(blocks) and (j == i or rows + blocks[j] <= wave_rows):
            rows += blocks[j]
            j += 1
        room = left.copy() if rows == left_rows else _room(left, rows, random)
        left, left_rows = left - room, left_rows - rows
        if j == i + 1:
            matrix[i] = room  # a block of its own, of any size
        else:
            for k in range(i, j):
                matrix[k] = random.multivariate_hypergeometric(room, blocks[k], method="marginals")
                room = room - matrix[k]
        i = j
    return matrix


def _lookup(spark, keys: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of whole numbers; at most shards x MOST_BLOCKS rows."""
    made = spark.createDataFrame(rows, ", ".join(keys)) if rows else spark.createDataFrame([], ", ".join(keys))
    return F.broadcast(made)


def _pieces(rows: int) -> int:
    return max(1, min(MOST_BLOCKS, math.ceil(rows / BLOCK_ROWS)))


def _told_apart(df: DataFrame, most: int) -> DataFrame:
    """The rows with ``copy``, a running number for rows that occur more than ``most`` times, else 0.
    At most rows / ``most`` such rows are looked up, which MOST_BLOCKS bounds."""
    key = F.xxhash64("row")
    often = df.select(key.alias("key")).groupBy("key").count().where(F.col("count") > most).collect()
    once = df.withColumn("copy", F.lit(0).cast("long"))
    if not often:
        return once
    hot = _lookup(df.sparkSession, ["key bigint"], [(r["key"],) for r in often])
    keyed = df.withColumn("key", key)
    equal = keyed.join(hot, "key", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    rest = keyed.join(hot, "key", "left_anti").select("row", F.lit(0).cast("long").alias("copy"))
    return rest.unionByName(expanded(keep(equal), "n"))


def sharded(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of ``documents`` with ``shard`` and ``slot``, its place in the shard from 0."""
    spark = documents.sparkSession
    given = [c for c in documents.columns if c.lower() not in ("shard", "slot")]
    # The row goes as one column, so that no name of its own clashes with those used here.
    df = documents.select(F.struct(*[documents[c] for c in given]).alias("row"))

    def random_key(n: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(n), "row", "copy")

    total = df.count()
    df = _told_apart(df, max(BLOCK_ROWS, total // MOST_BLOCKS))
    n_blocks, n_pieces = _pieces(total), _pieces(math.ceil(total / shards))
    df = df.withColumn("_block", F.pmod(random_key(0), F.lit(n_blocks)))
    counts = {r["_block"]: r["count"] for r in df.groupBy("_block").count().collect()}
    order = sorted(counts)
    bounds = communication_matrix([counts[b] for b in order], shards, seed).cumsum(1) if order else []
    table = _lookup(spark, ["_block bigint", "_bounds array<bigint>"], [(b, x.tolist()) for b, x in zip(order, bounds)])
    place = F.row_number().over(Window.partitionBy("_block").orderBy(random_key(1), "row"))
    df = df.withColumn("_place", place).join(table, "_block")
    df = df.withColumn("shard", F.size(F.filter("_bounds", lambda b: b < F.col("_place"))))
    df = df.drop("_bounds", "_place", "_block").withColumn("_piece", F.pmod(random_key(2), F.lit(n_pieces)))
    held = sorted((r["shard"], r["_piece"], r["count"]) for r in df.groupBy("shard", "_piece").count().collect())
    offsets, before, shard_no = [], 0, None
    for shard, piece, n in held:
        before = 0 if shard != shard_no else before
        offsets.append((shard, piece, before))
        shard_no, before = shard, before + n
    table = _lookup(spark, ["shard int", "_piece bigint", "_before bigint"], offsets)
    place = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy(random_key(3), "row"))
    df = df.withColumn("_place", place).join(table, ["shard", "_piece"])
    return df.select("row.*", "shard", (F.col("_before") + F.col("_place") - 1).alias("slot"))


def sharding(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharded(slim, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
