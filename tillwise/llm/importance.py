"""Importance resampling of documents towards a target, ranked by a distributed radix sort.

Features are all runs of one to three words, hashed into buckets by crc32. A bucket's gain is the log
of how much more often the target holds it than the documents do; the gains are an array of
``BUCKETS`` numbers, and a document's weight is the sum of the array at its features. Random noise
added to the weight (Gumbel's law) makes the highest scores a draw without replacement.

All eligible documents are ranked by LSD radix sort over the digits of (score descending, doc_id),
the lowest digit first. Rows lie in blocks by their position. A pass counts each digit in each block;
summed over lower digits and earlier blocks, the counts say where the rows of a digit in a block go,
and a row's place among those keeps the order they had. The positions after the last pass are the
ranks. Digits that are the same in all rows are skipped, as a pass over them would move nothing.

Blocks hold ``BLOCK_ROWS`` rows whatever the digits are, so a digit that many rows share isn't gathered.
Counts have at most 2^``DIGIT_BITS`` rows for each block. To the driver go the bucket counts,
``BUCKETS`` numbers, and a fixed number of sums.

Defined results: words are runs of ASCII letters and digits and of all characters beyond ASCII, with
A-Z lowered. A null or empty text has no features and weight 0. A null doc_id is drawn by the checksum
of ``42:`` alone and comes before all others in a tie. Rows equal in score and doc_id rank in the order
of the input, which must be read from files or be kept. No target or no documents give gains of the
counts that there are. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm import tokens
from tillwise.llm.common import store

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
DRAWN_PERCENT = 5
SEED = 42
DIGIT_BITS = 12
BLOCK_ROWS = 1 << 16
#: Words beyond so many bytes have their checksum taken one by one.
_SHORT = 48


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The crc32 table of a byte, and tables that append 2^k zero bytes to a crc32, for k < 32: a crc's
    four bytes are looked up one by one and combined by XOR."""
    byte = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
    append = np.zeros((32, 4, 256), np.uint32)
    for place in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
        append[0, place] = byte[c & 255] ^ (c >> 8)
    for k in range(1, 32):
        for place in range(4):
            append[k, place] = _moved(append[k - 1], append[k - 1, place])
    return byte, append


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (
        table[0, crc & 255] ^ table[1, (crc >> 8) & 255] ^ table[2, (crc >> 16) & 255] ^ table[3, crc >> 24]
    )


def joined_crc(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """The crc32 of two strings one after the other from the crc32 of each and the length of the second."""
    _, append = _tables()
    out, k, left_over = left.copy(), 0, right_bytes.copy()
    while left_over.any():
        odd = np.flatnonzero(left_over & 1)
        out[odd] = _moved(append[k], out[odd])
        left_over >>= 1
        k += 1
    return out ^ right


def word_crcs(found: tokens.Words, prefix: bytes = b"") -> np.ndarray:
    """The crc32 of ``prefix`` and each word."""
    byte, _ = _tables()
    length = found.end - found.start
    order = np.argsort(-np.minimum(length, _SHORT + 1), kind="stable")
    begin, size = found.start[order], length[order]
    n_long = int((size > _SHORT).sum())
    state = np.full(len(order), zlib.crc32(prefix) ^ 0xFFFFFFFF, np.uint32)
    for at in range(min(_SHORT, int(size.max(initial=0)))):
        held = int(np.searchsorted(-size[n_long:], -at, side="left")) + n_long  # those longer than at
        part = slice(n_long, held)
        state[part] = byte[(state[part] ^ found.data[begin[part] + at]) & 255] ^ (state[part] >> 8)
    crc = ~state
    for i in range(n_long):
        word = found.data[begin[i] : begin[i] + size[i]].tobytes()
        crc[i] = zlib.crc32(word, zlib.crc32(prefix))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of some texts, each feature's text number, and the texts' word counts."""
    found = tokens.words(texts, lower=True, separators=tokens.NOT_ALNUM)
    alone, after_blank = word_crcs(found), word_crcs(found, b" ")
    size = found.end - found.start + 1
    buckets, owners, run = [], [], alone
    for n in range(1, LONGEST_RUN + 1):
        if n > 1:
            run = joined_crc(run[:-1], after_blank[n - 1 :], size[n - 1 :]) if len(run) else run
        starts, owner = tokens.gram_starts(found.first, n)
        buckets.append((run[starts] % BUCKETS).astype(np.int64))
        owners.append(owner)
    return np.concatenate(buckets), np.concatenate(owners), found.counts


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for i, j in tokens.slices(batch["text"]):
                held += np.bincount(features(batch["text"].slice(i, j - i))[0], minlength=BUCKETS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.collect():  # at most BUCKETS rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain from the counts in the source and in the target."""
    all_source, all_target = int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_source + BUCKETS) / ((s + 1.0) * (all_target + BUCKETS))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighted(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in tokens.slices(batch["text"]):
                buckets, owner, words = features(batch["text"].slice(i, j - i))
                # Sums of long values: a running sum over features ordered by text stays exact.
                order = np.argsort(owner, kind="stable")
                running = np.zeros(len(order) + 1, np.int64)
                np.cumsum(gain[buckets[order]], out=running[1:])
                n = np.bincount(owner, minlength=j - i)
                ends = np.cumsum(n)
                weight = running[ends] - running[ends - n]
                arrays = [batch["doc_id"].slice(i, j - i), pa.array(words), pa.array(n), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    schema = "doc_id long, n_words long, n_features long, weight long"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, the same for a doc_id in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _digits(rows: DataFrame, parts: list[Column]) -> list[Column]:
    """The digits, lowest first, of a key whose parts are unsigned 64-bit numbers, lowest first; digits
    that are the same in all rows are left out."""
    spread = rows.agg(
        *(F.bit_or(p).bitwiseXOR(F.bit_and(p)).alias(f"part_{i}") for i, p in enumerate(parts))
    ).first()
    out = []
    for i, part in enumerate(parts):
        varying = (spread[f"part_{i}"] or 0) & (2**64 - 1)
        for low in range(0, 64, DIGIT_BITS):
            mask = 2 ** min(DIGIT_BITS, 64 - low) - 1
            if (varying >> low) & mask:
                out.append(F.shiftrightunsigned(part, low).bitwiseAND(F.lit(mask)).cast("int"))
    return out


def radix_ranked(rows: DataFrame, parts: list[Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``position``, from 0, in ascending order of a key given by its parts, lowest first,
    as unsigned 64-bit numbers. ``rows`` must be stored; its columns must not be named as those added."""
    given = rows.columns
    rows = store(rows.withColumn("position", F.monotonically_increasing_id()))
    n_blocks = max(1, math.ceil(rows.count() / block_rows))
    # Any first order will do; a hash of the row's number fills the blocks evenly.
    block = F.pmod(F.xxhash64("position"), F.lit(n_blocks)).cast("int")
    # Without a varying digit a single pass over an equal digit numbers the rows.
    for digit in _digits(rows, parts) or [F.lit(0)]:
        place = F.row_number().over(Window.partitionBy("block", "digit").orderBy("position"))
        dealt = store(
            rows.select(*given, "position", block.alias("block"), digit.alias("digit")).withColumn("place", place)
        )
        rows = dealt.join(_starts(dealt), ["block", "digit"]).select(
            *given, (F.col("first") + F.col("place") - 1).alias("position")
        )
        block = F.expr(f"position DIV {block_rows}").cast("int")
    return rows


def _starts(dealt: DataFrame) -> DataFrame:
    """(block, digit, first): where the rows of a digit in a block go, after all of lower digits and those
    of the same digit in earlier blocks."""
    cells = dealt.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
    lower = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # At most 2^DIGIT_BITS rows in this window without a key.
    totals = cells.groupBy("digit").agg(F.sum("n").alias("n")).select(
        "digit", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("lower")
    )
    within = cells.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return within.join(totals, "digit").select("block", "digit", (F.col("lower") + F.col("earlier")).alias("first"))


def resampled(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for those not drawn."""
    gain = gains(bucket_counts(documents), bucket_counts(target))
    scored = store(
        weighted(documents, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    )
    enough = scored.where(F.col("n_words") >= LEAST_WORDS).drop("n_words")
    top = F.lit(enough.agg(F.max("score")).first()[0]).cast("long")
    sign = F.lit(-(2**63))
    parts = [
        F.coalesce(F.col("doc_id").bitwiseXOR(sign), F.lit(0)),
        F.col("doc_id").isNotNull().cast("long"),
        top - F.col("score"),
    ]
    drawn = F.lit(DRAWN_PERCENT * enough.count() // 100)
    rank = F.col("position") + 1
    ranked = radix_ranked(enough, parts).select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).cast("long").alias("rank")
    )
    rest = scored.where(F.col("n_words") < LEAST_WORDS).drop("n_words")
    return ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
