"""Retrieval over whole query sets, in blocks of any size."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions.text import cosine, keyword_boost, query_terms
from folio.operators import retrieval, scoring
from folio.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def test_queries_grow_with_the_table(spark):
    want = {r[0] for r in view(spark, SF, "embeddings").where("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r[0] for r in view(spark, SF, "queries").select("query_id").collect()} == want


def test_many_queries_go_in_blocks(spark, monkeypatch):
    queries, chunks, safe = (view(spark, SF, n) for n in ("queries", "chunks", "reader_progress"))

    def found():
        runs = retrieval.retrieve(queries, chunks, safe), retrieval.retrieve_safe_global(queries, chunks, safe)
        return [sorted(df.select("query_id", "chunk_id", "score", "rank").collect()) for df in runs]

    whole = found()
    for name, value in (("QUERY_BLOCK", 4), ("AT_ONCE", 3), ("SLICE", 7), ("MANY_TERMS", 2)):
        monkeypatch.setattr(scoring, name, value)
    assert found() == whole and len(whole[0]) > 0


def _plain(queries, chunks):
    """All scores by expressions, row by row."""
    pairs = queries.withColumn("terms", query_terms(F.col("query_text"))).drop("query_text").crossJoin(chunks)
    score = F.round(cosine(F.col("query_vec"), F.col("embedding")) + 0.08 * keyword_boost(F.col("text"), F.col("terms")), 6)
    return pairs.withColumn("score", score)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde读书") for _ in range(rng.randrange(2, 8)))
    vec = lambda: [rng.uniform(-1, 1) for _ in range(5)]
    chunks = [(f"b{i % 4}_{i:03d}", f"b{i % 4 if i % 3 else 0}", i * 10, i * 10 + 50, " ".join(word().upper() for _ in range(20)), vec(), f"m{i % 2}") for i in range(120)]
    chunks += [("b1_x", "b1", 0, 9, None, vec(), "m0"), ("b1_y", "b1", 0, 9, "", vec(), "m1")]
    queries = [(q, vec(), " ".join(word() for _ in range(9)) if q % 3 else None, f"m{q % 2}") for q in range(23)]
    return (
        spark.createDataFrame(queries, "query_id long, query_vec array<float>, query_text string, model_id string").cache(),
        spark.createDataFrame(chunks, "chunk_id string, book_id string, start_offset long, end_offset long, text string, embedding array<float>, model_id string").cache(),
    )


@pytest.mark.parametrize("block", [4096, 5])
@pytest.mark.parametrize("routed", [False, True])
def test_blocks_equal_expressions(spark, monkeypatch, rows, block, routed):
    for name, value in (("QUERY_BLOCK", block), ("AT_ONCE", 4), ("SLICE", 6), ("MANY_TERMS", 5 if routed else 1000)):
        monkeypatch.setattr(scoring, name, value)
    queries, chunks = rows if routed else (rows[0].drop("model_id"), rows[1])
    plain = _plain(rows[0].withColumnRenamed("model_id", "own"), rows[1])
    plain = plain.where("own = model_id") if routed else plain
    key = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    assert key(retrieval.score_pairs(queries, chunks)) == key(plain)
    for k in (1, 3):
        got = retrieval.topk_per_book(retrieval.best_pairs(queries, chunks, k), k)
        assert key(got) == key(retrieval.topk_per_book(plain, k))
    scope = spark.createDataFrame([(q, f"b{(q + d) % 4}") for q in range(23) for d in range(q % 3)] * 2, "query_id long, book_id string")
    want = plain.join(scope.distinct(), ["query_id", "book_id"], "left_semi")
    assert key(retrieval.score_pairs(queries, chunks, scope)) == key(want)
    assert key(retrieval.topk_per_book(retrieval.best_pairs(queries, chunks, 2, scope), 2)) == key(retrieval.topk_per_book(want, 2))


def test_pairs_without_a_score(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0], "word"), (2, None, "word"), (3, [1.0], None)], "query_id long, query_vec array<double>, query_text string")
    chunks = spark.createDataFrame([(1, 1, "a word", [0.5, 0.5]), (2, 1, None, [0.25]), (3, None, "x", None), (4, None, "x", [None, 1.0]), (5, None, "x", [0.0, 1.0])], "chunk_id long, book_id long, text string, embedding array<double>")
    got = retrieval.score_pairs(queries, chunks)
    assert sorted((r["query_id"], r["chunk_id"], r["score"]) for r in got.collect()) == [(1, 1, 0.58), (1, 5, 0.0), (3, 2, 0.25)]
    assert retrieval.with_passages(got, chunks).where("chunk_id = 1").first()["text"] == "a word"
    assert retrieval.retrieve(queries, chunks.limit(0)).collect() == [] and retrieval.retrieve(queries.limit(0), chunks).collect() == []


def test_plans_have_no_nested_loop(spark, monkeypatch):
    queries, chunks, safe = (view(spark, SF, n) for n in ("queries", "chunks", "reader_progress"))
    for block in (4096, 3):
        monkeypatch.setattr(scoring, "QUERY_BLOCK", block)
        for df in (retrieval.retrieve(queries, chunks, safe), retrieval.retrieve_safe(queries, chunks, safe), retrieval.score_pairs(queries, chunks)):
            plan = df._jdf.queryExecution().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan and "zip_with" not in plan.split("Physical Plan")[-1]
