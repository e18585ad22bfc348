"""Stages and operators on rows that share ids, on frequent copies and on clashing column names."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tillwise.llm import common, decontamination, license_scan, mixing, ngram_join, pii, sharding, toxicity
from tests.llm.test_operators import docs, prose  # noqa: F401


def test_items_are_told_apart_by_words(spark, docs):  # noqa: F811
    items = [" ".join(prose(1000 + i, 40, 5000)) for i in range(4)]
    given = [(1, items[0]), (1, items[1]), (None, items[2]), (None, items[3]), (7, items[3]), (7, items[3]), (8, "a b")]
    benchmark = spark.createDataFrame(given, "item_id long, text string")
    texts = [" ".join(prose(i, 200)) for i in range(20)] + [f"x y {item} z" for item in items]
    texts.append(f"{items[0]} q {items[1]}")
    found = decontamination.contamination(docs(texts), benchmark).collect()
    assert sorted((r["doc_id"], str(r["item_id"])) for r in found) == [
        (20, "1"), (21, "1"), (22, "None"), (23, "7"), (23, "None"), (24, "1")
    ]
    assert {r["score"] for r in found} == {1.0}
    kept = decontamination.without_leaks(docs(texts), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def test_frequent_leaks_are_found_in_edited_copies(spark, docs):  # noqa: F811
    items = [prose(1000 + i, 40, 5000) for i in range(3)]
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    pick = random.Random(4)
    texts, leaks = [], set()
    for d in range(300):
        text = prose(d, 60)
        if d % 3 == 0:  # a third of all rows holds item 0, whole or with every fifth word changed
            copy = list(items[0])
            if d % 2:
                at = pick.randrange(5)
                copy[at::5] = [f"other{d}x{k}" for k in range(len(copy[at::5]))]
            text, leaks = text[:30] + copy + text[30:], leaks | {(d, 0)}
        texts.append(" ".join(text))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(docs(texts), benchmark).collect()}
    assert found <= leaks and len(found) == len(leaks)


def test_mix_keeps_sources_of_equal_texts(docs):  # noqa: F811
    texts = ["one two three"] * 6 + [f"w{i} w x" for i in range(30)]
    ids = [5] * 6 + list(range(10, 40))
    sources = ["p", "q", "p", "q", None, "p", *(["p", "q", "r"] * 10)]
    given = docs(texts, ids, sources)
    drawn = mixing.copies(given)
    size = {r["source"]: r["n"] for r in mixing.mixed(given).groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    want = collections.Counter(sources)
    targets = {r["source"]: r for r in mixing.source_targets(given.select("source", mixing.size_column().alias("size"))).collect()}
    assert set(size) == set(want) and drawn.count() == 36
    for name, rows in size.items():
        assert abs(3 * rows - targets[name]["target"]) <= 6
    again = mixing.mixed(given.repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mixed(given).collect()))


INSIDE = ["row", "row_key", "text_key", "copies", "copy", "mix_key", "mix_copies", "_block", "_place", "_piece", "_before", "_bounds", "leak_key", "leaked_id", "Slot"]


@pytest.mark.parametrize("stage", ["mixed", "sharded", "without_leaks"])
def test_stages_take_any_column_names(spark, docs, stage):  # noqa: F811
    from pyspark.sql import functions as F

    given = docs([f"text {i % 7} of words" for i in range(30)], [None if i > 26 else i // 2 for i in range(30)])
    wide = given.drop("shard").select("*", *[F.lit(f"own {c}").alias(c) for c in INSIDE])
    benchmark = spark.createDataFrame([(1, "text 3 of words")], "item_id long, text string")
    run = {
        "mixed": mixing.mixed, "sharded": sharding.sharded,
        "without_leaks": lambda df: decontamination.without_leaks(df, benchmark),
    }[stage]
    rows = run(wide).collect()
    kept = [c for c in INSIDE if not (stage == "sharded" and c == "Slot")]
    assert rows and all(r[c] == f"own {c}" for r in rows for c in kept)
    assert run(wide.where("false")).count() == 0
    if stage == "without_leaks":
        assert sorted(r["text"] for r in rows) == sorted(r["text"] for r in given.collect() if " 3 " not in r["text"])


def test_waves_keep_the_law():
    blocks, shards = [40, 30, 30, 20, 45, 35], 4
    whole = np.array([sharding.communication_matrix(blocks, shards, seed) for seed in range(3000)])
    waves = np.array([sharding.communication_matrix(blocks, shards, seed, wave_rows=50) for seed in range(3000)])
    assert (waves.sum(2) == blocks).all() and (waves.sum(1) == sharding.shard_sizes(200, shards)).all()
    n, share = np.array(blocks)[:, None], 1 / shards
    law = n * share * (1 - share) * (200 - n) / 199
    for drawn in (whole, waves):
        assert np.abs(drawn.mean(0) - n * share).max() < 0.3
        assert np.abs(drawn.var(0) / law - 1).max() < 0.15


@pytest.mark.parametrize("good, bad, drawn", [(3 * 10**11, 7 * 10**11, 10**9), (10**12, 10**12, 12 * 10**11), (50, 10**10, 10**9)])
def test_draws_of_any_size(good, bad, drawn):
    random_ = np.random.default_rng(3)
    found = np.array([sharding.hypergeometric(good, bad, drawn, random_) for _ in range(4000)], float)
    rows = good + bad
    mean = drawn * good / rows
    variance = mean * bad / rows * (rows - drawn) / (rows - 1)
    assert abs(found.mean() - mean) < 4 * (variance / len(found)) ** 0.5
    assert abs(found.var() / variance - 1) < 0.1
    assert sharding.hypergeometric(5, 0, 3, random_) == 3 and sharding.hypergeometric(0, 10**12, 10**10, random_) == 0


CLASHING = ("join_key", "toxicity_score", "mix_key", "copy", "row", "n", "_block", "text_key", "leak_key", "often")


def with_clashing_names(df):
    return df.select("*", *[F.lit(f"own {name}").alias(name) for name in CLASHING])


def test_stages_keep_columns_with_names_they_use(spark, docs):  # noqa: F811
    texts = [" ".join(prose(i, 60)) for i in range(12)]
    texts[3] = "vile awful nasty " * 20
    given = with_clashing_names(docs([*texts, texts[0], None, ""]))
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(12)], "doc_id long, toxic int")
    benchmark = spark.createDataFrame([(1, texts[5])], "item_id long, text string")
    stages = {
        "toxic": toxicity.without_toxic(given, labels),
        "near": ngram_join.one_of_each(given, ngram_join.Join(5, 80)),
        "leaks": decontamination.without_leaks(given, benchmark),
        "mix": mixing.mixed(given),
        "shards": sharding.sharded(given),
    }
    for name, out in stages.items():
        rows = out.collect()
        own = [c for c in given.columns if c != "shard" or name != "shards"]  # which that stage replaces
        assert out.columns[: len(own)] == own, name
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING), name
    assert stages["near"].count() == 14 and stages["leaks"].count() == 14 and stages["shards"].count() == 15


def test_equal_rows_are_dealt_over_blocks(docs, monkeypatch):  # noqa: F811
    texts = ["one two three four"] * 400 + [f"w{i} x y" for i in range(800)]
    ids = [None] * 400 + list(range(800))
    given = docs(texts, ids)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    told = sharding._told_apart(given.select(F.struct("doc_id", "text").alias("row")), 50)
    assert sorted(r["copy"] for r in told.where("row.doc_id IS NULL").collect()) == list(range(400))
    assert told.count() == 1200 and told.where("copy > 0").count() == 399
    slots = collections.defaultdict(list)
    copies = collections.Counter()
    for r in sharding.sharded(given).collect():
        slots[r["shard"]].append(r["slot"])
        copies[r["shard"]] += r["doc_id"] is None
    assert all(sorted(s) == list(range(150)) for s in slots.values()) and len(slots) == 8
    assert all(20 <= n <= 80 for n in copies.values())  # 50 expected
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    monkeypatch.setattr(common, "RUN", 30)
    drawn = mixing.copies(given)
    assert drawn.count() == 1200
    target = {r["target"] for r in drawn.collect()}
    taken = drawn.selectExpr("sum(size * copies) AS n").first()["n"]
    assert len(target) == 1 and abs(taken - target.pop()) <= 4


def test_settling_brings_words_near(docs):  # noqa: F811
    pick = np.random.default_rng(3)
    for _ in range(50):
        size = pick.integers(20, 2000, 60).astype(float)
        chance = np.full(60, 0.37)
        decided = mixing.land(mixing.fly(chance, size, pick), pick)
        settled = mixing.settle(chance, decided, size)
        assert set(np.unique(settled)) <= {0.0, 1.0}
        assert abs((settled - chance) @ size) <= min(abs((decided - chance) @ size), size.mean() / 4)
        assert np.abs(settled - decided).sum() <= 8


def test_notices_with_words_put_in_or_changed(docs):  # noqa: F811
    """The places of hits, tried for all offsets, decide labels as the operator does."""
    pick, texts, wanted = random.Random(6), [], []
    listed = [(label, text) for label, of in license_scan.NOTICES.items() for text in of if len(text.split()) >= 12]
    for d in range(120):
        label, text = listed[d % len(listed)]
        words = text.replace(",", "").split()
        at = pick.randrange(1, len(words))
        if d % 3 == 0:  # words of the same notice, which hit a far diagonal
            words = words[:at] + words[:3] + words[at:]
        elif d % 3 == 1:
            words = words[:at] + ["other"] + words[at:]
        else:
            words[at] = "changed"
        texts.append(" ".join(prose(d, 30) + words + prose(d + 1, 30)))
        wanted.append(label)
    found = {r["doc_id"]: r["labels"].split(",") for r in license_scan.license_scan(docs(texts)).collect()}
    assert [d for d in range(120) if wanted[d] not in found[d]] == []


def test_overlaps_are_those_of_all_pairs():
    pick = random.Random(8)
    for _ in range(200):
        spans = sorted((a, "card", a + pick.randrange(1, 9)) for a in (pick.randrange(80) for _ in range(12)))
        covered = pii._merged(spans)
        for start in range(0, 90, 3):
            end = start + pick.randrange(1, 12)
            want = not any(a < end and start < b for a, _, b in spans)
            assert pii._is_free(covered, start, end) == want
    many = " ".join(f"user{i}@host{i}.com" for i in range(20_000))
    detector = pii.Detector(None, 1.0, 0.0, (2.0,) * 4)
    assert len(pii._merged(pii.base_spans(many))) == 20_000 and detector.added(many, []) == []


def test_count_of_spans_is_that_of_the_list(docs):  # noqa: F811
    texts = [f"write to user{i}@host.com or 10.0.0.{i}, token = {i:032x}" for i in range(30)] + [None, "", "no"]
    for r in pii.pii(docs(texts)).collect():
        assert r["n_spans"] == len([s for s in r["spans"].split(",") if s])
        assert r["n_spans"] >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
