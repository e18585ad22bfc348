"""Quality rules by distribution divergence, in DataFrame functions only.

For every language of the corpus two reference histograms are counted over all of its texts:
character classes, and the language's common words (those that make up at least
``common_share`` of all its words, so at most 1 / common_share of them) with one bin for all
other words. A text is compared with its language's references by Jensen-Shannon distance (base
2, so from 0 to 1) and fails if a distance is above its limit. A distance is not judged for texts
with fewer characters or words than its minimum length, where a histogram says little.

Defined results: a null or empty text has no words and fails the base rule on length. Texts with
a null language form a language of their own. Repeated rows each get their row. Columns other
than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import WHITE, keep, words_column

#: Language references are broadcast up to so many rows, each of at most 1 / common_share words.
MOST_BROADCAST = 10_000
FEW = 32
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\t\n\x0b\f\r"
#: Classes after white space and a-z, counted by taking one after the other out of the rest of a
#: text; what is left at the end is the last class.
CLASS_RUNS = {
    "upper": "[A-Z]+", "digit": "[0-9]+", "letter": "\\p{L}+", "stop": "[.,;:!?'\"()-]+",
    "symbol": "[" + SYMBOLS + "]+",
}


@dataclass(frozen=True)
class Limits:
    least_words: int = 50
    repeat_percent: int = 50
    common_share: float = 0.01
    least_chars_judged: int = 200
    least_words_judged: int = 100
    char_distance: float = 0.32
    word_distance: float = 0.22


def _base(documents: DataFrame) -> DataFrame:
    """Words, counts of the base rules and class counts of every row, with its words."""
    c = F.col
    df = documents.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", words_column("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{WHITE}]"))
    df = df.withColumn("lines", lines)
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # Blanks, then runs without a-z: what is left to count is short.
    df = df.withColumns({"n_words": F.size("words").cast("long"), "n_chars": F.length("text")})
    black = c("text")
    for blank in BLANKS:
        black = F.replace(black, F.lit(blank), F.lit(""))
    df = df.withColumn("black", black).drop("lines", "text")
    df = df.withColumn("rest", F.array_join(F.regexp_extract_all("black", F.lit("[^a-z]+"), F.lit(0)), ""))
    df = df.withColumns({
        "word_chars": F.length("black").cast("long"),
        "white": (c("n_chars") - F.length("black")).cast("long"),
        "lower": (F.length("black") - F.length("rest")).cast("long"),
    }).drop("black")
    for name, run in CLASS_RUNS.items():
        df = df.withColumn("left", F.regexp_replace("rest", run, ""))
        df = df.withColumn(name, (F.length("rest") - F.length("left")).cast("long"))
        df = df.withColumn("rest", c("left")).drop("left")
    df = df.withColumn("other", F.length("rest").cast("long")).drop("rest")
    windows = F.transform(
        "words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    )
    df = df.withColumn("windows", F.slice(windows, 1, F.greatest(F.size("words") - 2, F.lit(0))))
    df = df.withColumn("ordered", F.sort_array("windows"))
    df = df.withColumn("twice", F.array_distinct(F.filter(
        "ordered", lambda h, i: F.coalesce(h == F.get("ordered", i + 1), F.lit(False))
    ))).drop("ordered")
    # Where the repeated windows stand: by looking through them if they are few, else by sorting
    # windows with their places, which takes n log n steps whatever repeats. Both find the same.
    many = F.size("twice") > FEW
    df = df.withColumn("placed", F.when(many, F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))
    ))))
    of_few = F.filter(
        F.transform("windows", lambda h, i: F.when(F.array_contains("twice", h), i)),
        lambda i: i.isNotNull(),
    )
    of_many = F.sort_array(F.transform(
        F.filter(
            "placed",
            lambda w, i: F.coalesce(w["hash"] == F.get("placed", i + 1)["hash"], F.lit(False))
            | F.coalesce(w["hash"] == F.get("placed", i - 1)["hash"], F.lit(False)),
        ),
        lambda w: w["at"],
    ))
    none = F.array().cast("array<int>")
    starts = F.when(F.size("twice") == 0, none).when(many, of_many).otherwise(of_few)
    df = df.withColumn("starts", starts).drop("windows", "twice", "placed")
    covered = F.aggregate(
        F.transform("starts", lambda s, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - s, F.lit(3)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    return df.select(
        "doc_id", "lang", "words", "n_words", "n_chars", "word_chars",
        c("symbol").alias("n_symbols"), "n_dup_lines", covered.cast("long").alias("n_repeat_words"),
        F.array("white", "lower", *CLASS_RUNS, "other").alias("classes"),
    )


def _distance(counts: str, total: Column, reference: str, ref_total: Column) -> Column:
    """Jensen-Shannon distance between two histograms, base 2."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    joined = F.zip_with(
        F.transform(counts, lambda n: n / total),
        F.transform(reference, lambda n: n / ref_total),
        lambda p, q: part(p, q) + part(q, p),
    )
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(joined, F.lit(0.0), lambda t, x: t + x) / 2))


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast references if there are few enough, which is counted; else none."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def frequent_words(documents: DataFrame, limits: Limits) -> DataFrame:
    """(ref_lang, candidates): sorted words that hold every common word of a language. A sketch of
    frequent items gives them: it overcounts none by more than a small part of ``common_share``,
    so with half the share as bound no common word is missed. Exact counts come later."""
    kept = int(20 / limits.common_share)
    spoken = documents.select("lang", F.explode(words_column()).alias("word"))
    sketched = spoken.groupBy(F.col("lang").alias("ref_lang")).agg(
        F.count("*").alias("n"),
        F.expr(f"approx_top_k(word, {int(2 / limits.common_share)}, {kept})").alias("top"),
    )
    often = F.filter("top", lambda t: t["count"] >= limits.common_share / 2 * F.col("n"))
    return sketched.select("ref_lang", F.sort_array(F.transform(often, lambda t: t["item"])).alias("candidates"))


def _summed(rows: DataFrame, counts: str) -> DataFrame:
    """(ref_lang, ref, ref_total): per language the sum of a histogram over rows, place by place."""
    placed = rows.select("lang", F.posexplode(counts).alias("at", "n"))
    summed = placed.groupBy("lang", "at").agg(F.sum("n").alias("n"))
    listed = summed.groupBy(F.col("lang").alias("ref_lang")).agg(
        F.sort_array(F.collect_list(F.struct("at", "n"))).alias("found"), F.sum("n").alias("ref_total")
    )
    return listed.select("ref_lang", F.transform("found", lambda x: x["n"]).alias("ref"), "ref_total")


def _common_only(counts: str) -> Column:
    """A histogram of candidates and other words, in which candidates that are not common words
    after all count as other words."""
    common = F.filter("places", lambda i: F.get("ref", i) >= F.col("share") * F.col("ref_total"))
    listed = F.transform(common, lambda i: F.get(counts, i))
    return F.concat(listed, F.array(F.aggregate(counts, F.lit(0).cast("long"), lambda t, n: t + n)
                                    - F.aggregate(listed, F.lit(0).cast("long"), lambda t, n: t + n)))


def quality_rules(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row: the base counts, both distances (null: not judged), base_failed and kept."""
    c = F.col
    documents = documents.select("doc_id", "lang", "text")
    spoken = _small(keep(frequent_words(documents, limits)))
    df = _base(documents)
    df = df.join(spoken, df["lang"].eqNullSafe(spoken["ref_lang"]), "left").drop("ref_lang")
    df = df.withColumn("known", F.filter("words", lambda w: F.array_contains("candidates", w)))
    df = df.withColumn("spoken", F.concat(
        F.transform("candidates", lambda r: F.size(F.filter("known", lambda w: w == r)).cast("long")),
        F.array(c("n_words") - F.size("known")),
    ))
    rated = keep(df.drop("words", "known", "candidates"))

    words = _small(keep(_summed(rated, "spoken")))
    df = rated.join(words, rated["lang"].eqNullSafe(words["ref_lang"]), "left").drop("ref_lang")
    df = df.withColumn("share", F.lit(limits.common_share))
    df = df.withColumn("places", F.sequence(F.lit(0), F.greatest(F.size("ref") - 2, F.lit(0))))
    df = df.withColumns({"doc_bins": _common_only("spoken"), "ref_bins": _common_only("ref")})
    df = df.withColumn("word_distance", F.when(
        c("n_words") >= limits.least_words_judged,
        _distance("doc_bins", c("n_words"), "ref_bins", c("ref_total")),
    )).drop("share", "places", "doc_bins", "ref_bins", "ref", "ref_total", "spoken")

    typical = _small(keep(_summed(rated, "classes")))
    df = df.join(typical, df["lang"].eqNullSafe(typical["ref_lang"]), "left").drop("ref_lang")
    df = df.withColumn("char_distance", F.when(
        c("n_chars") >= limits.least_chars_judged,
        _distance("classes", c("n_chars"), "ref", c("ref_total")),
    ))
    failed = (c("n_words") < limits.least_words) | (
        100 * c("n_repeat_words") > limits.repeat_percent * c("n_words")
    )
    far = (F.coalesce(c("char_distance"), F.lit(0.0)) > limits.char_distance) | (
        F.coalesce(c("word_distance"), F.lit(0.0)) > limits.word_distance
    )
    return df.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "char_distance", "word_distance", failed.alias("base_failed"), (~failed & ~far).alias("kept"),
    )
