"""Token files, the Merkle manifest and importance resampling against plain versions of each."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillwise.llm import importance, merkle, simple8b, token_files, tokens
from tillwise.llm.queries import op11_token_files

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, place string, node int"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def frame(spark, rows, folder):
    """Documents read from files, with extra columns whose names clash with those used inside."""
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS).repartition(3).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def odd_rows():
    long = " ".join(f"w{i % 997} x{i}" for i in range(20_000)) + "  "
    return [
        (0, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", "en", "s", 4), (3, long, "en", "s", 9),
        (4, "Same Text", "en", "s", 1), (4, "Same Text", "en", "s", 1), (4, "Other", "en", "s", 1),
        (None, "No Id", "en", None, 5), (None, None, None, None, None), (-7, "Ünïcode ß 漢字 ÄÖ", "zh", "é", 3),
        (8, "one two " * 30, "", "t", 3), (9, "one two " * 30, None, "t", 3), (2**62, "x", "en", "s", None),
    ]


# Token files


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.integers(0, 3) | st.just(0), max_size=400),
    st.sampled_from([1, 7, 64, 1024]),
)
@example([0] * 700 + [2**60] * 3 + [5] * 10 + [2**60 - 1], 1024)
@example([2**64 - 1, 0, 2**63], 2)
def test_words_round_trip(values, block):
    ids = np.array(values, np.uint64)
    piece = simple8b.encode(ids, block)
    assert simple8b.decode(piece).tolist() == values
    for k in range(-(-len(values) // block)):
        assert simple8b.decode_block(piece, k).tolist() == values[k * block : (k + 1) * block]


def test_words_hold_as_many_numbers_as_fit():
    def words(values):
        held = simple8b.encode(np.array(values, np.uint64))
        return (len(held) - len(simple8b.encode(np.zeros(0, np.uint64))) - 12) // 8

    assert words([0] * 120) == 1 and words([1] * 60) == 1 and words([255] * 14) == 2
    assert words([32767] * 8) == 2 and words([50256] * 9) == 3 and words([2**60]) == 2
    with pytest.raises(ValueError):
        simple8b.decode(b"something else, not words at all")


def same_as_library(texts):
    ids, counts = token_files.ids_of(pa.array(texts, pa.string()), open(PATH, encoding="utf-8").read())
    theirs = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(t) for t in theirs]
    assert ids.tolist() == [i for t in theirs for i in t]


SPACES = "  \n\t\r\x0b\x1c\x85\xa0   　"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=SPACES + "ab'sT1.,é漢́​😀", max_size=14), min_size=1, max_size=5))
@example(["x  ", "y", " ", "  ", " b"])
@example(["it's <|endoftext|> a", "  　y", "a \xa0 b", "'ll 't  'S"])
def test_cut_texts_give_the_ids_of_whole_texts(texts):
    same_as_library(texts)


def test_ids_of_the_documents_are_those_of_the_library(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    same_as_library([*texts, None, "", " ", "a" * 5000])


def plain_digests(rows):
    """Ids of documents in order, rows of one doc_id in any order: as a multiset of digests, with the ids
    that all those before the doc_id have."""
    total, out = 0, defaultdict(Counter)
    by_id = defaultdict(list)
    for doc_id, text in rows:
        by_id[doc_id].append(LIBRARY.encode(text or "", add_special_tokens=False).ids + [0])
    starts = {}
    for doc_id in sorted(by_id, key=lambda i: (i is not None, i)):
        starts[doc_id] = total
        for ids in by_id[doc_id]:
            out[doc_id][len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
            total += len(ids)
    return starts, out, total


def check_digests(found, rows):
    starts, theirs, total = plain_digests(rows)
    ours, spans = defaultdict(Counter), []
    for r in found:
        ours[r["doc_id"]][r["n_tokens"], r["ids_crc32"]] += 1
        spans.append((r["start"], r["start"] + r["n_tokens"]))
    assert ours == theirs
    spans.sort()
    assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == total
    for doc_id, first in starts.items():
        assert min(r["start"] for r in found if r["doc_id"] == doc_id) == first


def test_token_files_of_the_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    check_digests(op11_token_files(spark, SMALL).collect(), [tuple(r) for r in rows])


@pytest.mark.parametrize("piece_ids", [1, 50, token_files.PIECE_IDS])
def test_token_files_of_odd_rows(spark, tmp_path, piece_ids):
    docs = frame(spark, odd_rows(), tmp_path / "docs")
    token_files.write_token_files(docs, str(tmp_path / "files"), PATH, piece_ids=piece_ids)
    found = token_files.token_digests(spark, str(tmp_path / "files"))
    check_digests(found.collect(), [(r[0], r[1]) for r in odd_rows()])
    whole = token_files.read_token_files(spark, str(tmp_path / "files")).where("doc_id = 3").first()
    assert whole["ids"] == LIBRARY.encode(odd_rows()[3][1], add_special_tokens=False).ids + [0]


def test_many_equal_rows_lie_in_many_ranges(spark, tmp_path):
    rows = [(None, "the same text", "en", "s", 1)] * 3000 + [(i, f"text {i}", "en", "s", 1) for i in range(3000)]
    docs = frame(spark, rows, tmp_path / "docs")
    token_files.write_token_files(docs, str(tmp_path / "files"), PATH, piece_ids=100)
    check_digests(token_files.token_digests(spark, str(tmp_path / "files")).collect(), [r[:2] for r in rows])


def test_token_files_of_no_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    token_files.write_token_files(docs, str(tmp_path / "files"), PATH)
    assert token_files.token_digests(spark, str(tmp_path / "files")).count() == 0


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    values = (row[0], row[3], row[2], row[4], row[1])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests):
    """The root and each leaf's proof: the siblings to the left and right on each level."""
    proofs, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            proofs[leaf].append((run[: i % 8], run[i % 8 + 1 :]))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], proofs


def plain_manifest(rows):
    languages = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in languages:
        held = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = held, *plain_tree([plain_leaf(r) for r in held])
    root, tops = plain_tree([trees[lang][1] for lang in languages])
    out = []
    for lang, top in zip(languages, tops):
        held, subroot, proofs = trees[lang]
        for row, proof in zip(held, proofs):
            path = proof + top
            changed = row
            if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 3 == 0 and row[1] is not None:
                changed = (row[0], re.sub("[A-Z]", lambda m: m[0].lower(), row[1]), *row[2:])
            now = plain_leaf(changed)
            for left, right in path:
                now = h(*left, now, *right)
            siblings = "".join(d for left, right in path for d in [*left, *right])
            out.append((row[0], plain_leaf(row), subroot, root, h(siblings), now, now == root))
    return sorted(out, key=str)


def manifest_rows(df):
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str)


def test_manifest_of_odd_rows(spark, tmp_path):
    assert manifest_rows(frame(spark, odd_rows(), tmp_path / "d")) == plain_manifest(odd_rows())


@pytest.mark.parametrize("n", [1, 9, 600])
def test_manifest_of_many_sizes(spark, tmp_path, n):
    rows = [(i, f"Text {i}", "abcdefghijkl"[i % (1 + n // 30) % 12], "s", i) for i in range(n)]
    found = manifest_rows(frame(spark, rows, tmp_path / "d"))
    assert found == plain_manifest(rows)
    assert {r[6] for r in found} <= {True, False} and any(r[6] for r in found)


def test_manifest_of_equal_rows_and_of_none(spark, tmp_path):
    rows = [(None, "Same", "en", "s", 1)] * 500 + [(i, "Same", "en", "s", 1) for i in range(500)]
    docs = frame(spark, rows, tmp_path / "d")
    assert manifest_rows(docs) == plain_manifest(rows)
    assert merkle.manifest(docs.where("false")).count() == 0


# Importance resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain_resampled(rows, target):
    """Rows as (doc_id, n_features, weight, score, rank); ranks of equal (score, doc_id) in any order."""
    source = Counter(b for r in rows for b in plain_features(r[1])[1])
    wanted = Counter(b for t in target for b in plain_features(t)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000))))

    out = []
    for doc_id, text, *_ in rows:
        words, buckets = plain_features(text)
        x = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets))
        out.append([doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def resampled_rows(df, target):
    return sorted((tuple(r) for r in importance.resampled(df, target).collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 -\né漢", max_size=90), min_size=1, max_size=5))
def test_buckets_are_those_of_the_text(texts):
    buckets, owner, words = importance.features(pa.array([*texts, None]))
    for i, text in enumerate([*texts, None]):
        theirs = plain_features(text)
        assert sorted(buckets[owner == i].tolist()) == sorted(theirs[1]) and words[i] == len(theirs[0])


def test_checksums_of_long_words():
    texts = ["a" * 47, "b" * 48, "c" * 49, "d" * 5000, "e"]
    found = tokens.words(pa.array([" ".join(texts)]), lower=False)
    assert importance.word_crcs(found, b" ").tolist() == [zlib.crc32(f" {t}".encode()) for t in texts]
    assert sorted(importance.features(pa.array([" ".join(texts)]))[0].tolist()) == sorted(plain_features(" ".join(texts))[1])


def test_resampling_of_odd_rows(spark, tmp_path):
    rows = odd_rows() + [(100 + i, f"{' '.join('abc'[(i * k) % 3] for k in range(25))} {i % 7}", "en", "s", 1) for i in range(300)]
    target = ["a b c a b", None, "one two one"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    docs = frame(spark, rows, tmp_path / "d")
    found = resampled_rows(docs, benchmark)
    assert found == plain_resampled(rows, target)
    assert sum(r[4] is not None for r in found) == 15
    assert resampled_rows(docs, benchmark.where("false")) == plain_resampled(rows, [])
    assert importance.resampled(docs.where("false"), benchmark).count() == 0


def test_radix_sort_is_a_sort(spark, tmp_path):
    pick = random.Random(4)
    keys = [(pick.choice([0, 5, -(2**63), 2**63 - 1, pick.randrange(-(2**63), 2**63)]), pick.randrange(3)) for _ in range(400)]
    spark.createDataFrame(keys, "a long, b long").repartition(3).write.parquet(str(tmp_path / "k"))
    rows = spark.read.parquet(str(tmp_path / "k"))
    for block_rows in (7, 1000):
        found = importance.radix_ranked(rows, [F.col("a"), F.col("b")], block_rows)
        ranked = [(r["a"], r["b"]) for r in sorted(found.collect(), key=lambda r: r["position"])]
        assert ranked == sorted(keys, key=lambda k: (k[1], k[0] & (2**64 - 1)))
        assert sorted(r["position"] for r in found.collect()) == list(range(400))


def test_hot_digits_are_cut_into_blocks(spark, tmp_path):
    spark.range(2000).selectExpr("CAST(id < 1500 AS bigint) AS a").write.parquet(str(tmp_path / "k"))
    rows = spark.read.parquet(str(tmp_path / "k"))
    found = importance.radix_ranked(rows, [F.col("a")], 100)
    assert sorted((r["position"], r["a"]) for r in found.collect()) == [(i, int(i >= 500)) for i in range(2000)]
