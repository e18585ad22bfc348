"""License scans by diagonal voting, in DataFrame functions only.

Every run of ``GRAM`` words of every text is hashed and joined with the places where that hash
stands in a license notice. A hit votes for the diagonal text place - notice place. Hits are
summed by diagonal; diagonals next to each other, as an inserted or dropped word makes them, are
merged to spans; and a span is verified if its votes cover enough of the notice's runs.

A hit rests on a 64-bit hash; a verified span rests on several such hits in line, so no label comes
from one collision. The notices are a list in code, which bounds what is broadcast.

Base places are where the words of a phrase stand one after the other.

Defined results: a null or empty text has no words, no label and score 0. Rows that repeat a
doc_id and its text give equal rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import same_document, text_key

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Well-known notices by label.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files",
        "Released under the MIT License.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
}
GRAM = 3
#: Diagonals that differ by so many words at most merge.
SLACK = 3
LEAST_COVER = 0.6
_SEPARATORS = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: Column) -> Column:
    """Words of a text with A-Z in lower case. ``lower`` changes further letters, of which only
    the two below would become other words made of a-z; texts with these are folded one by one."""
    filled = F.coalesce(text, F.lit(""))
    odd = filled.contains("K") | filled.contains("İ")
    folded = F.when(odd, F.translate(filled, _UPPER, _UPPER.lower())).otherwise(F.lower(filled))
    return F.regexp_extract_all(folded, F.lit(f"[^{_SEPARATORS}]+"), F.lit(0))


def _gram_hashes(words: str) -> Column:
    hashes = F.transform(
        words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, GRAM)])
    )
    return F.slice(hashes, 1, F.greatest(F.size(words) - (GRAM - 1), F.lit(0)))


def notice_places(spark, notices: Mapping[str, Sequence[str]]) -> DataFrame:
    """(hash, notice, label, notice_at, notice_grams): where each hash stands in the notices."""
    texts = [(label, text) for label, of_label in notices.items() for text in of_label]
    listed = [
        F.struct(F.lit(i).alias("notice"), F.lit(label).alias("label"), F.lit(text).alias("text"))
        for i, (label, text) in enumerate(texts)
    ]
    df = spark.range(1).select(F.explode(F.array(*listed)).alias("n")).select("n.*")
    df = df.withColumn("words", _words(F.col("text"))).withColumn("grams", _gram_hashes("words"))
    return df.select(
        "notice", "label", F.size("grams").alias("notice_grams"),
        F.posexplode("grams").alias("notice_at", "hash"),
    )


def license_spans(documents: DataFrame, notices: Mapping[str, Sequence[str]] = NOTICES) -> DataFrame:
    """(doc_id, text_key, label, first_word, last_word, score) of every verified span."""
    texts = documents.select("doc_id", text_key().alias("text_key"), _words(F.col("text")).alias("words"))
    grams = texts.select("doc_id", "text_key", F.posexplode(_gram_hashes("words")).alias("at", "hash"))
    hits = grams.join(F.broadcast(notice_places(documents.sparkSession, notices)), "hash")
    span = ["doc_id", "text_key", "notice", "label", "notice_grams"]
    votes = hits.withColumn("diagonal", F.col("at") - F.col("notice_at")).groupBy(*span, "diagonal").agg(
        F.min("at").alias("first"), F.max("at").alias("last"),
        F.collect_set("notice_at").alias("places"),  # of one notice in one text, so bounded by it
    )
    # Along the diagonals, so that a chance hit on a far one can't cut a span in two. Hits on
    # neighbouring diagonals lie in one copy of the notice, as its places bound theirs.
    order = Window.partitionBy(*span).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > SLACK
    merged = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    merged = merged.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*span, "span").agg(
        F.min("first").alias("first_word"),
        (F.max("last") + GRAM - 1).alias("last_word"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("cover"),
    )
    spans = spans.withColumn("score", F.col("cover") / F.col("notice_grams")).where(F.col("score") >= LEAST_COVER)
    return spans.select("doc_id", "text_key", "label", "first_word", "last_word", "score")


def _phrase_places(parts: Sequence[str], label: str) -> Column:
    """(at, label) of the places of a phrase; looked for only where all its words occur."""
    all_there = F.lit(True)
    for part in parts:
        all_there = all_there & F.array_contains("words", part)

    def at(w: Column, i: Column) -> Column:
        found = w == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get("words", i + k) == part)
        return F.when(found, i)

    starts = F.filter(F.transform("words", at), lambda i: i.isNotNull())
    named = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
    return F.when(all_there, named).otherwise(F.array().cast("array<struct<at:int,label:string>>"))


def _base(documents: DataFrame, phrases: Mapping[str, str]) -> DataFrame:
    """Words and base places of every row."""
    df = documents.select("doc_id", text_key().alias("text_key"), _words(F.col("text")).alias("words"))
    places = [_phrase_places(phrase.split(), label) for phrase, label in phrases.items()]
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("places", F.concat(*places)).drop("words")
    at = F.transform("places", lambda p: p["at"])
    return df.select(
        "doc_id", "text_key", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_distinct(F.transform("places", lambda p: p["label"])).alias("base"),
    )


def license_scan(
    documents: DataFrame,
    notices: Mapping[str, Sequence[str]] = NOTICES,
    phrases: Mapping[str, str] = PHRASES,
) -> DataFrame:
    """Per row: words, base places and labels, all labels, and the best score of a span (1 where
    a base phrase stands)."""
    base = _base(documents, phrases)
    spans = license_spans(documents, notices).groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("found"), F.max("score").alias("best")
    )
    df = base.join(spans, same_document(base, spans), "left")
    none = F.array().cast("array<string>")
    labels = F.array_union("base", F.coalesce("found", none))
    return df.select(
        base["doc_id"], "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
