"""Substring dedup by a hash join of windows of 20 words. It is not a relative Lempel-Ziv parsing: no
longest match is extended and no factor boundary is checked, as every window is looked up by itself.

The reference of a document is everything before it: documents with smaller doc_id, and its own
earlier words. To find windows that stand there without trying each document against each other:

1. Of every window of 20 words, its *anchor* is the smallest hash among its runs of six words, so
   equal windows have equal anchors wherever they stand. Anchors that stand at one place only rule
   out their windows; a Bloom filter of the others goes to the tasks.
2. Windows with a repeated anchor are the phrases asked for: their 128-bit hashes are joined with the
   smallest doc_id that has them. Words of windows that stand earlier are removed.
3. Of each document, adjacent windows that point to the same reference document are listed as one
   factor.

Documents whose word sequence as a whole stands earlier are removed at once and aren't parsed.

Defined results: a null text has no words; a text of fewer than 20 words stays. Windows of one
document are compared by their start, those of different ones by doc_id, a null one being the
smallest; rows that share a doc_id don't remove each other's words. Repeated rows each get their
row. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import tokens
from tillwise.llm.common import keep, store, text_key
from tillwise.llm.filters import Filter, filter_of

WINDOW, RUN = 20, 6
NO_ID = -(1 << 63)


def _rows(documents: DataFrame) -> DataFrame:
    """A document's text under (doc_id, text_key); ``row`` is a hash of both."""
    df = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_key().alias("text_key"), "text"
    )
    return df.withColumn("row", F.xxhash64("doc_id", "text_key"))


def _slid(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def _anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, window starts, anchor of each window): anchors once for each place where a run is
    the smallest of a window."""
    starts, _ = tokens.gram_starts(first, WINDOW)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(0, np.uint64)
    runs = tokens.grams(hashes, RUN)
    width = WINDOW - RUN + 1
    least = _slid(runs, width, np.minimum)
    valid = np.zeros(len(least), np.uint64)  # 0 for windows over text borders
    valid[starts] = least[starts]
    padded = np.concatenate([np.zeros(width - 1, np.uint64), valid, np.zeros(width - 1, np.uint64)])
    chosen = (_slid(padded, width, np.maximum) == runs) & (runs > 0)
    return runs[chosen], starts, least[starts]


def word_sequences(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, row, n_words, sequence, check, whole_sha256) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in tokens.slices(batch["text"]):
                found = tokens.words(batch["text"].slice(i, j - i), lower=False)
                hashes, first = found.hashes(), found.first
                place = np.arange(len(hashes)) - np.repeat(first[:-1], found.counts)
                sums = []
                for salt in (3, 5):
                    spread = tokens.mix(hashes ^ tokens.mix(place.astype(np.uint64) * np.uint64(2 * salt + 1)))
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
                    sums.append(pa.array(tokens.as_signed(tokens.mix(total[first[1:]] - total[first[:-1]] + found.counts.astype(np.uint64)))))
                sha = [
                    hashlib.sha256(found.text(a, b)).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist())
                ]
                part = [batch[n].slice(i, j - i) for n in ("doc_id", "text_key", "row")]
                yield pa.RecordBatch.from_arrays(
                    [*part, pa.array(found.counts.astype(np.int64)), *sums, pa.array(sha)],
                    ["doc_id", "text_key", "row", "n_words", "sequence", "check", "whole_sha256"],
                )

    schema = "doc_id long, text_key long, row long, n_words long, sequence long, check long, whole_sha256 string"
    return _rows(documents).mapInArrow(of, schema)


def _chosen(batch: pa.RecordBatch, wanted: Filter) -> pa.RecordBatch:
    return batch.filter(pa.array(wanted.may_hold(batch["row"].to_numpy())))


def repeated_anchors(documents: DataFrame, firsts: Filter) -> DataFrame:
    """(anchor) of the anchors that stand at several places."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _chosen(batch, firsts)
            for i, j in tokens.slices(batch["text"]):
                found = tokens.words(batch["text"].slice(i, j - i), lower=False)
                anchors = _anchors(found.hashes(), found.first)[0]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.as_signed(anchors))], ["anchor"])

    found = _rows(documents).select("row", "text").mapInArrow(of, "anchor long")
    return found.groupBy("anchor").count().where("count > 1").select("anchor")


def phrases(documents: DataFrame, firsts: Filter, repeated: Filter) -> DataFrame:
    """(hash, check, doc_id, text_key, at, again) of the windows whose anchor is repeated; again:
    the window stands earlier in its own text. Hashes of those are null, as nothing is left to ask."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _chosen(batch, firsts)
            for i, j in tokens.slices(batch["text"]):
                found = tokens.words(batch["text"].slice(i, j - i), lower=False)
                hashes = found.hashes()
                _, starts, anchor = _anchors(hashes, found.first)
                starts = starts[repeated.may_hold(anchor)] if len(starts) else starts
                one, two = tokens.grams(hashes, WINDOW), tokens.grams(hashes, WINDOW, salt=1)
                one, two = (one[starts], two[starts]) if len(starts) else (one[:0], two[:0])
                doc = np.searchsorted(found.first, starts, side="right") - 1
                order = np.lexsort((starts, two, one, doc))
                again = np.zeros(len(order), bool)
                a, b = order[:-1], order[1:]
                again[b] = (doc[a] == doc[b]) & (one[a] == one[b]) & (two[a] == two[b])
                ids = [batch[n].slice(i, j - i).take(pa.array(doc)) for n in ("doc_id", "text_key")]
                at = pa.array((starts - found.first[doc]).astype(np.int32))
                asked = [pa.array(tokens.as_signed(h), mask=again) for h in (one, two)]
                yield pa.RecordBatch.from_arrays(
                    [*asked, *ids, at, pa.array(again)], ["hash", "check", "doc_id", "text_key", "at", "again"]
                )

    schema = "hash long, check long, doc_id long, text_key long, at int, again boolean"
    return _rows(documents).mapInArrow(of, schema)


def parse(at: np.ndarray, reference: np.ndarray) -> list[tuple[int, int, int]]:
    """Factors (start, end, reference document) from the starts of windows that stand earlier, in
    order, and the documents they point to: adjacent windows grouped, not a greedy factoring."""
    if not len(at):
        return []
    new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(reference) != 0)))
    last = np.append(new[1:], len(at)) - 1
    return [(int(at[a]), int(at[b]) + WINDOW, int(reference[a])) for a, b in zip(new, last)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, windows in zip(batch["text"], batch["windows"].to_pylist()):
            found = tokens.words(pa.array([text.as_py()], pa.string()), lower=False)
            at = np.array([w["at"] for w in windows], np.int64)
            factors = parse(at, np.array([w["reference"] for w in windows], np.int64))
            gone = np.zeros(len(found.start) + 1, np.int64)
            for a, b, _ in factors:
                gone[a] += 1
                gone[b] -= 1
            left = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            raw = found.data.tobytes()
            kept = b" ".join(raw[a:b] for a, b in zip(found.start[left].tolist(), found.end[left].tolist()))
            rows.append((len(found.start) - len(left), kept, factors))
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], batch["text_key"], pa.array([r[0] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                pa.array([r[1].decode() for r in rows], pa.string()),
                pa.array(
                    [[{"start": a, "end": b, "reference": d} for a, b, d in r[2]] for r in rows],
                    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("reference", pa.int64())])),
                ),
            ],
            ["doc_id", "text_key", "n_removed", "kept_sha256", "kept_text", "factors"],
        )


def parsed(documents: DataFrame, sequences: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_removed, kept_sha256, kept_text, factors) of the texts that have words
    removed and aren't copies as a whole."""
    first = sequences.groupBy("sequence", "check").agg(F.min("doc_id").alias("first_id"))
    whole = sequences.join(first, ["sequence", "check"]).where("doc_id = first_id")
    firsts = filter_of(whole.where(f"n_words >= {WINDOW}"), "row")
    repeated = filter_of(keep(repeated_anchors(documents, firsts)), "anchor")
    asked = store(phrases(documents, firsts, repeated))
    index = asked.where("NOT again").groupBy("hash", "check").agg(F.min("doc_id").alias("reference"))
    earlier = asked.where("NOT again").join(index, ["hash", "check"]).where("reference < doc_id")
    own = asked.where("again").withColumn("reference", F.col("doc_id"))
    place = ["doc_id", "text_key", "at", "reference"]
    windows = keep(
        earlier.select(*place).union(own.select(*place)).groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_set(F.struct("at", "reference"))).alias("windows"))  # of one text
    )
    affected = filter_of(windows.select(F.xxhash64("doc_id", "text_key").alias("row")), "row")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _chosen(batch, affected)

    rows = _rows(documents)
    texts = rows.mapInArrow(of, rows.schema).dropDuplicates(["doc_id", "text_key"])
    schema = (
        "doc_id long, text_key long, n_removed long, kept_sha256 string, kept_text string,"
        " factors array<struct<start: long, end: long, reference: long>>"
    )
    joined = texts.join(windows, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "windows")
    return joined.mapInArrow(_cut, schema)


def substring_dedup(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    sequences = keep(word_sequences(documents))
    cut = parsed(documents, sequences).select("doc_id", "text_key", "n_removed", "kept_sha256")
    first = sequences.groupBy("sequence", "check").agg(F.min("doc_id").alias("first_id"))
    rows = sequences.join(first, ["sequence", "check"]).join(cut, ["doc_id", "text_key"], "left")
    copy = (F.col("n_words") >= WINDOW) & (F.col("doc_id") > F.col("first_id"))
    return rows.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
