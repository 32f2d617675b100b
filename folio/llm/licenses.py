"""License scans: an exact set-similarity join of text blocks with license templates. Native.

A template is found in a block of words if the block holds at least THRESHOLD of the
template's distinct words. All words that templates use are counted over the corpus and put
in one global order, rare ones first. A block can hold enough of a template only if it holds
one of the template's first ``m - need + 1`` words (prefix filter), has enough template words
at all (length filter), and enough are left from there on in both (positional filter). The
pairs that pass are counted out, so no match is lost and none is wrong. The index of prefixes
is the templates' own size, whatever the corpus.

One pass over the texts takes words, phrase places and the template words that occur; only texts
with a template's prefix word are cut into blocks, by a second one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import cut, let, staged, table, text_or_empty

#: Words after lower-casing: ASCII letters and digits, and all that is not ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

THRESHOLD = 0.9
#: Blocks of this many words, each starting half a block after the one before it.
BLOCK = 64

#: Phrases that give a label wherever they stand.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Rows of the prefix index that are broadcast.
MAX_BROADCAST_INDEX = 100_000

#: Label and wording of notices; other ones may be given. Blocks hold twice the longest of them.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "no part of this publication may be reproduced or transmitted in any form without prior written permission"),
)


def words_of(text: Column) -> Column:
    # lower() also maps letters beyond ASCII; no word starts or ends elsewhere by that, and no phrase matches otherwise.
    return F.regexp_extract_all(F.lower(text), F.lit(LICENSE_WORD), F.lit(0))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(parts))
    here = lambda i: F.array(*[F.get(words, i + k) for k in range(len(parts))]) == F.array(*map(F.lit, parts))
    return F.when(F.size(words) >= len(parts), F.filter(at, here)).otherwise(F.array().cast("array<int>"))


def _phrase_columns(words: Column, joined: Column) -> dict[str, Column]:
    def of(phrase: str) -> Column:
        here = F.contains(joined, F.lit(f" {phrase} "))
        return F.when(here, let(words, lambda w: _places(w, phrase))).otherwise(F.array().cast("array<int>"))

    return {p: of(p) for p in PHRASES}


def _rows(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id and its text's hash; equal rows have equal results."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.lower(text).alias("low"), words_of(text).alias("words"))


def _present(vocabulary: list[str]) -> Column:
    return F.array_intersect(F.lit(vocabulary), F.col("words"))


def word_order(present: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, rare ones first by the number of documents of the whole corpus; a count for each word at most."""
    counts = {r["w"]: r["n"] for r in present.select(F.explode("present").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefix_index(spark: SparkSession, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(word, label, wanted, m, need, place)``: a row for each prefix word of each template."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for label, wording in templates:
        wanted = sorted(set(wording.split()), key=rank.__getitem__)
        need = math.ceil(threshold * len(wanted) - 1e-9)
        out += [(w, label, wanted, len(wanted), need, i) for i, w in enumerate(wanted[: len(wanted) - need + 1])]
    return spark.createDataFrame(out, "word string, label string, wanted array<string>, m int, need int, place int")


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def template_matches(rows: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, present: DataFrame | None = None) -> DataFrame:
    """``(doc_id, th, found, best)``: labels of the templates that some block contains, and the best containment.

    ``present`` has the template words of each text, where they are known.
    """
    spark = rows.sparkSession
    vocabulary = _vocabulary(templates)
    order = word_order(rows.select(_present(vocabulary).alias("present")) if present is None else present, vocabulary)
    block = max(BLOCK, 2 * max(len(t.split()) for _, t in templates))
    index = cut(prefix_index(spark, order, templates, threshold))
    small = index.count() <= MAX_BROADCAST_INDEX
    keys = [r["word"] for r in index.select("word").distinct().collect()]
    fewest = index.agg(F.min("need")).first()[0]
    ranked, starts = F.lit(order), F.sequence(F.lit(0), F.greatest(F.size("words") - 1 - block // 2, F.lit(0)), F.lit(block // 2))
    # A prefix word stands in the text as it is, so texts without any need not be cut into words.
    somewhere = reduce(lambda a, b: a | b, [F.contains("low", F.lit(k)) for k in keys])
    likely = rows.where(somewhere & F.arrays_overlap(F.lit(keys), F.col("words")))
    blocks = likely.select(
        "doc_id", "th", F.explode(F.transform(starts, lambda i: F.array_intersect(ranked, F.slice(F.col("words"), i + 1, block)))).alias("block")
    ).where(F.size("block") >= fewest)
    placed = blocks.select("doc_id", "th", "block", F.posexplode("block").alias("at", "word")).where(F.col("word").isin(keys))
    pairs = placed.join(F.broadcast(index) if small else index, "word")
    enough = pairs.where((F.size("block") >= F.col("need")) & (F.least(F.col("m") - F.col("place"), F.size("block") - F.col("at")) >= F.col("need")))
    shared = enough.withColumn("shared", F.size(F.array_intersect("block", "wanted"))).where("shared >= need")
    return shared.groupBy("doc_id", "th").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("m")).alias("best"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: words, phrase places, labels and a score.

    ``templates`` are pairs of label and wording (lower-case words), or a table with these two columns.
    ``score`` is 1 where a phrase stands, else the best containment of a template that is
    found, else 0. Null texts count as empty: no words, places or labels, score 0. Very long texts
    are cut into blocks whole. Of templates that tie in containment all give their labels, which are
    sorted. Repeated rows each give a row; an empty table gives none. Columns other than doc_id and
    text, whatever their names, are ignored.
    """
    if isinstance(templates, DataFrame):
        templates = [tuple(r) for r in templates.select("label", "wording").collect()]
    rows = _rows(docs)
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    places = _phrase_columns(F.col("words"), joined)
    measured = rows.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), _present(_vocabulary(templates)).alias("present"), *[x.alias(f"p{i}") for i, x in enumerate(places.values())])
    base = staged(measured)
    every = F.concat(*[f"p{i}" for i in range(len(places))])
    labelled = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(PHRASES[p])) for i, p in enumerate(places)]))
    based = base.select("doc_id", "th", "n_words", every.alias("places"), F.array_sort(labelled).alias("based"))
    found = template_matches(rows, templates, threshold, base).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "found", "best")
    both = based.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    more = F.coalesce("found", F.array().cast("array<string>"))
    return both.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("based", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("based", more)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
