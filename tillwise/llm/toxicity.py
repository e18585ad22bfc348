"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Which n-grams a text holds is hashed into a fixed number of buckets. Over the labelled fit
sample, each bucket gets the smoothed logarithm of how much more often toxic texts hold it than
clean ones. A logistic regression is fitted on those scaled features; buckets whose ratio says
little are left out, as their scaled features are near zero.

Defined results: a null or empty text holds no n-gram and gets the model's base rate as score.
Rows without a label, or with a null doc_id, are scored and never learnt from. A doc_id labelled
twice counts once, toxic if any of its labels is. Repeated rows each get their row. Without
labels of both classes every score is the smoothed share of toxic labels. Further columns of the
inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import free_name
from tillwise.llm.tokens import mix

HELD_OUT = 2
THRESHOLD = 0.3
SCORE = "toxicity_score"


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the labelled texts of each class that the model is fitted on: those
    with the smallest hashes of their doc_id. Scores are for all rows."""

    shortest: int = 3
    longest: int = 5
    bucket_bits: int = 22
    fit_rows: int = 8_000
    smoothing: float = 20.0
    least_ratio: float = 1.0
    least_texts: int = 8
    penalty: float = 5e-4
    steps: int = 300


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each bucket, ratio included
    base: float
    settings: Settings


def text_buckets(text: str, settings: Settings) -> np.ndarray:
    """Buckets of the n-grams of one text, lower-cased and padded with a blank, repeats kept."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    found = []
    for n in range(settings.shortest, settings.longest + 1):
        count = len(codes) - n + 1
        if count <= 0 or not text:
            continue
        value = np.full(count, np.uint64(n))
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + codes[k : k + count]
        found.append(mix(value) >> np.uint64(64 - settings.bucket_bits))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from."""
    return (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(F.expr(f"crc32(CAST(doc_id AS STRING)) % 4 <> {HELD_OUT}"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def fit_sample(labels: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, toxic) of at most ``fit_rows`` labelled documents of each class."""
    learnt = learnable(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = learnt.where("toxic = 1").orderBy(*order).limit(settings.fit_rows)
    return toxic.union(learnt.where("toxic = 0").orderBy(*order).limit(settings.fit_rows))


def _bucket_counts(sample: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, toxic_texts, clean_texts): how many texts of the sample hold a bucket that is not
    rarer than ``least_texts``; the bucket past the last counts all texts."""
    size = 1 << settings.bucket_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size + 1), np.int32)  # the last is of all texts
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                held = np.append(np.unique(text_buckets(text or "", settings)), size)
                counts[int(toxic == 1), held] += 1
        held = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (held, counts[1, held], counts[0, held])],
            ["bucket", "toxic_texts", "clean_texts"],
        )

    return (
        sample.select("text", "toxic")
        .mapInArrow(count, "bucket bigint, toxic_texts bigint, clean_texts bigint")
        .groupBy("bucket")
        .agg(F.sum("toxic_texts").alias("toxic_texts"), F.sum("clean_texts").alias("clean_texts"))
        .where(f"bucket = {size} OR toxic_texts + clean_texts >= {settings.least_texts}")
    )


def _logistic(features: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, s: Settings):
    """Weights of the scaled features and the intercept, by Adam on the penalised log loss."""
    lengths = np.array([len(f) for f in features])
    index = np.concatenate([*features, np.zeros(0, np.int64)])
    row = np.repeat(np.arange(len(features)), lengths)
    weight, base = np.zeros(len(ratio)), float(np.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1)))
    first, second, first_b, second_b = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    for step in range(1, s.steps + 1):
        z = base + np.bincount(row, (weight * ratio)[index], len(features))
        miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic
        slope = np.bincount(index, miss[row], len(ratio)) * ratio / len(toxic) + s.penalty * weight
        slope_b = miss.mean()
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        first_b, second_b = 0.9 * first_b + 0.1 * slope_b, 0.999 * second_b + 0.001 * slope_b**2
        rate = 0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        weight -= rate * first / (np.sqrt(second) + 1e-8)
        base -= rate * first_b / (np.sqrt(second_b) + 1e-8)
    return weight * ratio, base


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits the classifier. The sample's ids are at most 2 * fit_rows, so they are broadcast and
    no text is shuffled; the driver gets bucket counts and the informative buckets of each text."""
    texts = documents.select("doc_id", "text")
    sample = texts.join(F.broadcast(fit_sample(labels, settings)), "doc_id")
    size = 1 << settings.bucket_bits
    counts = _bucket_counts(sample, settings).toPandas()
    total = counts[counts.bucket == size]
    counts = counts[counts.bucket < size]
    n_toxic, n = int(total.toxic_texts.sum()), int(total.sum()[["toxic_texts", "clean_texts"]].sum())
    all_toxic, all_clean = (int(x or 0) for x in learnable(labels).agg(
        F.sum(F.expr("CAST(toxic = 1 AS INT)")), F.sum(F.expr("CAST(toxic = 0 AS INT)"))
    ).first())
    weights = np.zeros(size, np.float32)
    odds = float(np.log((all_toxic + 1) / (all_clean + 1)))
    if not n_toxic or n_toxic == n:
        return Model(weights, odds, settings)
    share = n_toxic / n
    held_toxic = (counts.toxic_texts + settings.smoothing * share) / n_toxic
    held_clean = (counts.clean_texts + settings.smoothing * (1 - share)) / (n - n_toxic)
    ratio = np.log(held_toxic / held_clean).to_numpy()
    told = np.abs(ratio) >= settings.least_ratio
    active, ratio = counts.bucket.to_numpy()[told], ratio[told]
    place = np.full(size, -1, np.int32)
    place[active] = np.arange(len(active))

    def informative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [place[np.unique(text_buckets(t or "", settings))] for t in batch["text"].to_pylist()]
            packed = [h[h >= 0].tobytes() for h in held]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(packed, pa.binary())], ["toxic", "held"])

    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.mapInArrow(informative, "toxic int, held binary").toPandas()
    features = [np.frombuffer(h, np.int32).astype(np.int64) for h in rows.held]
    order = sorted(range(len(rows)), key=lambda i: (rows.toxic[i], rows.held[i]))  # row order varies
    fitted, base = _logistic(
        [features[i] for i in order], (rows.toxic.to_numpy()[order] == 1).astype(float), ratio, settings
    )
    weights[active] = fitted
    # The sample holds each class up to a bound, so its odds are put right.
    return Model(weights, base + odds - float(np.log((n_toxic + 1) / (n - n_toxic + 1))), settings)


def score(documents: DataFrame, model: Model, name: str = SCORE) -> DataFrame:
    """The columns of ``documents`` and ``name``, the probability of the label 1; a column that has
    this name is replaced."""
    weights, base, settings = model.weights, model.base, model.settings
    schema = documents.drop(name).schema.add(name, "double", False)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch["text"]):
                held = text_buckets(text.as_py() or "", settings)
                held = np.unique(held[weights[held] != 0])  # a bucket counts once
                z = base + float(weights[held].sum(dtype=np.float64))
                out[i] = 1 / (1 + np.exp(-max(-40.0, min(40.0, z))))
            yield batch.append_column(name, pa.array(out))

    return documents.drop(name).mapInArrow(of, schema)


def held_out() -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.expr(f"crc32(CAST(doc_id AS STRING)) % 4 = {HELD_OUT}"), F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels, settings))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col(SCORE).alias("score"),
        F.when(F.col(SCORE) >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` that the classifier doesn't reject, with all their columns."""
    name = free_name(documents, SCORE)
    scored = score(documents, fit(documents, labels, settings), name)
    return scored.where(F.col(name) < THRESHOLD).select(*documents.columns)
