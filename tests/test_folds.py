"""Spoken pieces as a fold in native expressions: the same pieces as the library's, which is the faster of the two (figures in README)."""

from math import ceil

import pytest
from pyspark.sql import functions as F

from folio.functions.text import strip
from folio.operators import segments
from folio.plans.fixtures import view

SF = "/root/testdata/sf0.001"
MARK = "\x01"


def native_pieces(text, size):
    low, wide = max(50, round(size * 0.1)), round(size * 0.1)
    high, enough = size + wide, max(ceil(size * 0.8), low + 1)

    def marked(rest, n, chars):
        return F.translate(F.substring(rest, 1, n), chars, MARK * len(chars))

    def first(w, start, end):
        k = F.instr(F.substring(w, start, max(0, end - start + 1)), MARK)
        return F.when(k > 0, k + start - 1)

    def last(w, after, end):
        k = F.instr(F.reverse(F.substring(w, after + 1, max(0, end - after))), MARK)
        return F.when(k > 0, end - k + 1)

    def step(state, _):
        rest = state["rest"]
        ends = [f for chars in ("。！？!?.", "，,；;：:、") for w in [marked(rest, high, chars)] for f in (first(w, enough, high), last(w, low, high))]
        cut = F.coalesce(*ends, last(marked(rest, size + 1, " 　"), low, size + 1), F.lit(size))
        taken = F.transform(F.array(cut), lambda n: F.struct(F.substring(rest, n + 1, F.length(rest)).alias("rest"), F.concat(state["out"], F.array(F.substring(rest, F.lit(1), n))).alias("out")))
        return F.when(F.length(rest) > round(size * 1.25), F.element_at(taken, 1)).otherwise(state)

    whole = strip(F.coalesce(text, F.lit("")))
    steps = F.when(F.length(whole) > round(size * 1.25), F.sequence(F.lit(1), F.ceil(F.length(whole) / F.lit(low + 1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(whole.alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(steps, start, step, lambda s: F.filter(F.concat(s["out"], F.array(s["rest"])), lambda x: x != ""))


@pytest.mark.parametrize("size", [60, 200, 2000])
def test_native_fold_gives_the_same_pieces(spark, size):
    own = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "x" * 9000), (-5, "中文，" * 900), (-6, "a b" * 4000)], "book_id long, text string")
    texts = view(spark, SF, "books").select("book_id", F.col("full_text").alias("text")).unionByName(own)
    pars = texts.select("book_id", F.lit(0).alias("chapter_index"), F.lit(0).alias("paragraph_index"), "text")
    got = pars.select("book_id", F.posexplode(native_pieces(F.col("text"), size)).alias("piece", "text"))
    want = segments.chunk_paragraphs(pars, size).select("book_id", "piece", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
