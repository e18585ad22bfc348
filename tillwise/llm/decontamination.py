"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are runs of letters and digits in lower case. A seed is a run of an item's words that chance
seldom makes: three words where the product of their shares of the corpus is at most ``RATE``,
else six words. Shares are counted over the whole corpus, so a phrase common in the language is no
seed. Words inside a run of ``CONTEXT`` words that the benchmark has too are counted in the total
only: how often an item leaks, in full or with a word in five changed, makes none of its words
frequent. An item too short for either gives all its runs of three words.

Texts are scanned once in tasks for runs that may be seeds, through a Bloom filter of bounded size
(``filters.py``; ``FILTER_BITS`` at least), so little that grows with the benchmark is sent to tasks. Around its hits a text
gives its word hashes as a region; regions whose hits are ``MARGIN`` words apart or less are one. Hits
are then joined with the seeds by hash, which removes the filter's false ones, and each pair of
region and item is aligned: +2 for an equal word, -1 for another one or for one left out or put in.
A pair's score is the best local alignment divided by that of the whole item, from 0 to 1. Pairs
of at least ``LEAST_SCORE`` are returned; chance hits score far less.

Defined results: a null or empty text or item matches nothing, nor do items with fewer than three
words. An item is its words: items equal in words are aligned once, and each item_id they stand
under gets its pair. An item_id with several texts gives its best pair; a null item_id is a value like
any other. Rows that repeat a doc_id are told apart by text, and a null doc_id is a value like any
other; equal rows give one pair. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import tokens
from tillwise.llm.common import keep, text_key
from tillwise.llm.filters import Filter, filter_of

SHORT, LONG = 3, 6
#: Words in runs of so many that the benchmark has are taken for copies where shares are counted.
CONTEXT = 4
RATE = 1e-8
FILTER_BITS = 24
MARGIN = 64
LEAST_SCORE = 0.4
EQUAL, OTHER, GAP = 2, -1, -1


def _hashed(texts: pa.Array) -> tuple[tokens.Words, np.ndarray]:
    found = tokens.words(texts, lower=False, separators=tokens.NOT_ALNUM)
    return found, found.hashes()


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of every row of the benchmark with SHORT words or more."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hashes = _hashed(batch["text"])
            words = tokens.list_array(tokens.as_signed(hashes), found.counts)
            yield pa.RecordBatch.from_arrays([batch["item_id"], words], ["item_id", "words"])

    listed = benchmark.select(F.col("item_id").cast("long"), F.lower("text").alias("text")).mapInArrow(hashed, "item_id long, words array<long>")
    return listed.where(F.size("words") >= SHORT)


def _runs(items: DataFrame, n: int) -> DataFrame:
    """(hash) of each run of n words of the items."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [tokens.grams(np.asarray(w, np.int64).view(np.uint64), n) for w in batch["words"].to_pylist()]
            found = np.unique(np.concatenate([*listed, np.zeros(0, np.uint64)]))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.as_signed(found))], ["hash"])

    return items.select("words").mapInArrow(of, "hash long")


def _copied(first: np.ndarray, hashes: np.ndarray, runs: Filter) -> np.ndarray:
    """Which words lie in a run of CONTEXT words of one text that the filter of runs holds."""
    if len(hashes) < CONTEXT:
        return np.zeros(len(hashes), bool)
    at = np.flatnonzero(runs.may_hold(tokens.grams(hashes, CONTEXT)))
    at = at[at + CONTEXT <= first[np.searchsorted(first, at, side="right")]]
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + CONTEXT, -1)
    return np.cumsum(steps)[:-1] > 0


def _added(value: np.ndarray, times: np.ndarray, more: np.ndarray, more_times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of distinct values with those of a slice added, so that no slice's words are kept."""
    both, place = np.unique(np.concatenate([value, more]), return_inverse=True)
    summed = np.zeros(len(both), np.int64)
    np.add.at(summed, place, np.concatenate([times, more_times]))
    return both, summed


def word_shares(documents: DataFrame, items: DataFrame, words: DataFrame) -> DataFrame:
    """(hash, share) of the benchmark's words: their part of all words of the corpus, those in
    copies of the benchmark left out."""
    bits, runs = (filter_of(of, "hash", FILTER_BITS) for of in (words, _runs(items, CONTEXT)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, value, times = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for i, j in tokens.slices(batch["text"]):
                found, hashes = _hashed(batch["text"].slice(i, j - i))
                total += len(hashes)
                held = hashes[bits.may_hold(hashes) & ~_copied(found.first, hashes, runs)]
                value, times = _added(value, times, *np.unique(held, return_counts=True))
            # The total goes with hash null.
            yield pa.RecordBatch.from_arrays(
                [pa.array([*tokens.as_signed(value).tolist(), None], pa.int64()), pa.array([*times.tolist(), total], pa.int64())],
                ["hash", "times"],
            )

    counts = documents.select(F.lower("text").alias("text")).mapInArrow(count, "hash long, times long")
    counts = keep(counts.groupBy("hash").agg(F.sum("times").alias("times")))
    total = counts.where("hash IS NULL").agg(F.sum("times")).first()[0] or 1
    return words.join(counts, "hash", "left").select(
        "hash", (F.greatest(F.coalesce("times", F.lit(0)), F.lit(1)) / F.lit(total)).alias("share")
    )


def seeds(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(hash, item, item_at): the rare runs of each item."""
    placed = items.select("item", F.posexplode("words").alias("at", "hash"))
    shares = word_shares(documents, items, placed.select("hash").distinct())
    listed = placed.join(shares, "hash").groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("at", "hash", "share"))).alias("words")  # an item's own words
    )

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch["item"].to_pylist(), batch["words"].to_pylist()):
                hashes = np.array([w["hash"] for w in words], np.int64).view(np.uint64)
                share = np.log([w["share"] for w in words])
                short, long = tokens.grams(hashes, SHORT), tokens.grams(hashes, LONG)
                chance = sum(share[k : k + len(short)] for k in range(SHORT))
                few = np.flatnonzero(chance <= np.log(RATE))
                if not len(few) and not len(long):
                    few = np.arange(len(short))  # a short item of frequent words
                rest = np.setdiff1d(np.arange(len(long)), few)
                at = np.concatenate([few, rest])
                found = np.concatenate([short[few], long[rest]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens.as_signed(found)), pa.array([item] * len(at), pa.int64()), pa.array(at.astype(np.int32))],
                    ["hash", "item", "item_at"],
                )

    return listed.mapInArrow(rare, "hash long, item long, item_at int")


def regions(documents: DataFrame, bits: Filter) -> DataFrame:
    """(doc_id, text_key, start, words, hits): stretches of texts around runs that the filter holds;
    words are hashes, hits are (at, hash) with at counted from the text's first word."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, j in tokens.slices(batch["text"]):
                found, hashes = _hashed(batch["text"].slice(i, j - i))
                ids, keys = (batch[n].slice(i, j - i) for n in ("doc_id", "text_key"))
                places, values = [], []
                for n in (SHORT, LONG):
                    runs = tokens.grams(hashes, n)
                    held = np.flatnonzero(bits.may_hold(runs))
                    doc = np.searchsorted(found.first, held, side="right") - 1
                    inside = held + n <= found.first[doc + 1]
                    places.append(held[inside])
                    values.append(runs[held[inside]])
                place, value = np.concatenate(places), np.concatenate(values)
                order = np.argsort(place, kind="stable")
                place, value = place[order], tokens.as_signed(value[order])
                doc = np.searchsorted(found.first, place, side="right") - 1
                new = np.flatnonzero(np.append(True, (np.diff(place) > MARGIN) | (np.diff(doc) > 0))) if len(place) else []
                for a, b in zip(new, [*new[1:], len(place)]):
                    d = doc[a]
                    start = max(int(found.first[d]), int(place[a]) - MARGIN)
                    end = min(int(found.first[d + 1]), int(place[b - 1]) + LONG + MARGIN)
                    first = int(found.first[d])
                    hits = [{"at": int(p) - first, "hash": int(v)} for p, v in zip(place[a:b], value[a:b])]
                    rows.append((ids[int(d)].as_py(), keys[int(d)].as_py(), start - first, tokens.as_signed(hashes[start:end]), hits))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[4] for r in rows], pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64())]))),
                ],
                ["doc_id", "text_key", "start", "words", "hits"],
            )

    schema = "doc_id long, text_key long, start int, words array<long>, hits array<struct<at: int, hash: long>>"
    given = documents.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.lower("text").alias("text"))
    return given.mapInArrow(of, schema)


def align(texts: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over many pairs at once: rows of ``texts`` (pairs x words, 0 is no word)
    against rows of ``items``. Returns the best score and the place in the text where it ends."""
    pairs, width = texts.shape
    slope = -GAP * np.arange(width + 1)
    above = np.zeros((pairs, width + 1), np.int32)
    best, end = np.zeros(pairs, np.int32), np.zeros(pairs, np.int32)
    for k in range(items.shape[1]):
        word = items[:, k : k + 1]
        met = np.where((texts == word) & (word != 0), EQUAL, OTHER)
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(np.maximum(above[:, :-1] + met, above[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope  # gaps in the item, along the row
        row[(word == 0)[:, 0]] = 0
        at = row.argmax(1)
        top = row[np.arange(pairs), at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
        above = row
    return best, end


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns pairs of similar lengths together, a bounded number of cells at a time."""
    for batch in batches:
        texts = [np.asarray(x.as_py(), np.int64) for x in batch["words"]]
        items = [np.asarray(x.as_py(), np.int64) for x in batch["item_words"]]
        order = sorted(range(len(texts)), key=lambda i: (len(items[i]), len(texts[i])))
        score, end = np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        at = 0
        while at < len(order):
            wide, to = 0, at
            while to < len(order) and (to == at or max(wide, len(texts[order[to]])) * (to - at + 1) <= 200_000):
                wide = max(wide, len(texts[order[to]]))
                to += 1
            some = order[at:to]
            left = np.zeros((len(some), wide), np.int64)
            right = np.zeros((len(some), max(len(items[i]) for i in some)), np.int64)
            for row, i in enumerate(some):
                left[row, : len(texts[i])] = texts[i]
                right[row, : len(items[i])] = items[i]
            best, ends = align(left, right)
            score[some] = best / (EQUAL * np.array([len(items[i]) for i in some]))
            end[some] = ends
            at = to
        kept = np.flatnonzero(score >= LEAST_SCORE)
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"].take(pa.array(kept)),
                batch["text_key"].take(pa.array(kept)),
                batch["item"].take(pa.array(kept)),
                pa.array(score[kept]),
                pa.array(batch["start"].to_numpy()[kept] + end[kept] - 1, pa.int32()),
            ],
            ["doc_id", "text_key", "item", "score", "last_word"],
        )


def leaking(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, score, last_word) of the documents that hold a copy of an item,
    with the best score of the pair and the last word of that passage."""
    listed = keep(item_words(benchmark).select("item_id", "words", F.xxhash64("words").alias("item")))
    items = keep(listed.groupBy("item").agg(F.first("words").alias("words")))
    found = keep(seeds(documents, items))
    held = keep(regions(documents, filter_of(found, "hash", FILTER_BITS)))
    placed = held.select("doc_id", "text_key", "start", F.size("words").alias("n"), F.explode("hits").alias("hit"))
    met = placed.join(found.distinct(), F.col("hit.hash") == found["hash"])
    pairs = met.select("doc_id", "text_key", "start", "n", "item").distinct()
    texts = held.select(
        F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key"), F.col("start").alias("of_start"),
        F.size("words").alias("of_n"), "words",
    ).distinct()
    same = F.expr("doc_id <=> of_doc AND text_key = of_key AND start = of_start AND n = of_n")
    with_text = pairs.join(texts, same).select("doc_id", "text_key", "start", "item", "words")
    both = with_text.join(items.select("item", F.col("words").alias("item_words")), "item")
    scored = both.select("doc_id", "text_key", "item", "start", "words", "item_words").mapInArrow(
        _scored, "doc_id long, text_key long, item long, score double, last_word int"
    )
    best = scored.groupBy("doc_id", "text_key", "item").agg(F.max(F.struct("score", "last_word")).alias("b"))
    named = best.join(listed.select("item", "item_id").distinct(), "item")
    each = named.groupBy("doc_id", "text_key", "item_id").agg(F.max("b").alias("b"))  # of several texts under an id
    return each.select("doc_id", "text_key", "item_id", "b.score", F.col("b.last_word").alias("last_word"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, last_word) of ``leaking``."""
    return leaking(documents, benchmark).drop("text_key")


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no copy of an item, with all their columns."""
    leaks = leaking(documents, benchmark).select(F.col("doc_id").alias("leaked_id"), "text_key").distinct()
    key = F.xxhash64(documents["text"])  # no column is added, so none can clash with the input's
    same = documents["doc_id"].cast("long").eqNullSafe(leaks["leaked_id"]) & (key == leaks["text_key"])
    return documents.join(leaks, same, "left_anti")
