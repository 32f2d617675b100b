"""Hot keys, ties, null ids, and odd rows through the whole pipeline."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from folio.llm import common, exact, licenses, mixing, pii, quality, similar, simhash, substring, urls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("share", [1000, 3])
def test_hot_and_other_keys_alike(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = spark.createDataFrame([(i, 0 if i % 2 else i % 40) for i in range(800)] + [(900, None)], "id long, k long")
    keys = rows.groupBy("k").agg(F.count("*").alias("times")).where("k < 20")
    want = sorted(i for i in range(800) if i % 2 or i % 40 < 20)
    assert sorted(r["id"] for r in common.with_keys(rows, keys, ["k"], "times", 801).collect()) == want
    got = common.with_keys(rows, keys, ["k"], "times", 801, keep_times=True).collect()
    assert sorted(r["id"] for r in got) == want and all(r["times"] == (400 + 20 if r["k"] == 0 else 20) for r in got)


@pytest.mark.parametrize(("n", "other"), [(1000, 0), (500, 500)])
def test_mixing_takes_part_of_equal_rows(spark, n, other):
    rows = [(1, "w " * 20, "a")] * n + [(2 + i, "w " * 20, "a") for i in range(other)] + [(5000 + i, "w " * 7, "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(docs).collect()
    for size in (20, 7):
        own = [r for r in got if r["size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= size / 2
    again = mixing.mix_sizes(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_beside_many_sources(spark, monkeypatch):
    rows = [(i, "w " * (i % 30), None if i % 90 == 0 else f"s{i % 45}" if i % 2 else "hot") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix_sizes(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix_sizes(docs).collect()), key=str) == want
    monkeypatch.setattr(mixing, "HOT_SHARE", 10)
    assert sorted(map(tuple, mixing.mix_sizes(docs).collect()), key=str) == want


def test_one_of_each_group_stays_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(999)) for _ in range(60)) for _ in range(4)]
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[1] + " more"), (7, texts[2]), (7, texts[2]), (7, texts[2] + " more"), (9, texts[3])]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"][:20]) for r in got), key=str) == sorted([(1, texts[0][:20]), (None, texts[1][:20]), (7, texts[2][:20]), (9, texts[3][:20])], key=str)


def test_texts_that_share_a_passage_make_no_pairs(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"d{i}x{rng.randrange(10**6)}" for _ in range(60))) for i in range(150)]
    texts = spark.createDataFrame(rows, "node long, text string")
    groups = texts.select("node", F.col("node").alias("root"))
    assert similar.prefix_pairs(similar.packed(texts, texts), groups, 5).count() == 0


def test_prefix_filter_loses_no_similar_pair(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 90))] if i % 4 == 0 else rows[-1][1].split()
        own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    sets = {i: set(similar.shingles(t.encode(), 5).tolist()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    texts = spark.createDataFrame(rows, "node long, text string")
    got = {tuple(sorted(r)) for r in similar.prefix_pairs(similar.packed(texts, texts), texts.select("node", F.col("node").alias("root")), 5).collect()}
    assert want and want <= got


def test_exact_batches(spark, tmp_path, monkeypatch):
    where = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")
    first = sorted(map(tuple, exact.exact_groups(rows, exact.DigestIndex(spark, where, 4), "b1").collect()))
    assert first == sorted(map(tuple, exact.exact_groups(rows, exact.DigestIndex(spark, where), "b1").collect()))
    assert sum(r[3] for r in first) == 101 and not any(r["kept"] for r in exact.exact_groups(rows, exact.DigestIndex(spark, where), "b2").collect())
    assert exact.keep_unique(rows, exact.DigestIndex(spark, where), "b1").count() == 101 and exact.keep_unique(rows, exact.DigestIndex(spark, where), "b3").count() == 0
    monkeypatch.setattr(exact, "HOT_SHARE", 1)
    assert sorted(map(tuple, exact.exact_groups(rows, exact.DigestIndex(spark)).collect())) == first


def odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    say = next(r["text"] for r in docs.collect() if 400 < len(r["text"]) < 2000)
    rows = [(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6 + 1, say, "en", None, 1), (10**6 + 1, say, "en", None, 1), (10**6 + 1, say, "fr", "s", 2), (None, say, None, None, None)]
    rows += [(10**6 + 2, " ".join(f"word{i % 977} tail{i % 31} x{i}" for i in range(40_000)), "en", "long", 9), (10**6 + 3, "x" * 50_000, "en", "long", 9)]
    return docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_odd_rows_through_every_stage(spark):
    docs = odd_documents(spark).withColumns({"_row": F.lit(1), "_kept": F.lit("k"), "digest": F.lit("d"), "node": F.lit(2), "_size": F.lit(3), "_key": F.lit(4)})
    for name, stage in pipeline.STAGES:
        before = docs
        docs = common.staged(stage(spark, docs, SF))
        if name != "encode":
            assert docs.columns == before.columns and docs.subtract(before).count() == 0
        if name == "exact_dedup":
            assert docs.select(F.coalesce("text", F.lit(""))).distinct().count() == docs.count()
        assert docs.count() > 0
    common.drop_staged(spark)


def test_each_stage_alone_takes_all_odd_rows(spark):
    docs = odd_documents(spark)
    n = docs.count()
    stages = dict(pipeline.STAGES)
    assert stages["encode"](spark, docs, SF).count() == n
    assert stages["near_dedup"](spark, docs, SF).where("doc_id = 1000001").count() <= 1
    assert stages["exact_dedup"](spark, docs, SF).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_clashing_columns_are_left_alone(spark):
    odd = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for c in ("h", "anchor", "spans", "words", "low", "th", "present", "target", "_key", "keep_id", "score", "host"):
        odd = odd.withColumn(c, F.lit("clash"))
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(10).withColumn("host", F.lit(1)).withColumn("keys", F.lit(2))
    vectors, net = quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    for got in (pii.find_pii(odd), substring.remove_repeats(odd), licenses.scan(odd), mixing.mix_sizes(odd), exact.exact_groups(odd, exact.DigestIndex(spark)), quality.score(odd, vectors, net)):
        assert got.count() == 30
    assert urls.judge_urls(pages).count() == 10


def test_licenses_from_a_table(spark):
    wording = " ".join(f"clause{i}" for i in range(60))
    table = spark.createDataFrame([("long-1.0", wording)], "label string, wording string")
    docs = spark.createDataFrame([(1, "before " * 100 + wording + " after" * 50), (2, " ".join(wording.split()[:40]))], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs, table).collect()} == {1: "long-1.0", 2: ""}


def test_span_classifier_learns_from_shape():
    phone, year = [pii.features(t, 3, 5, 17) for t in ("call 555 123-4567 ", "year 2001 - 2002x ")]
    w = pii.train([(phone, 0.95)] * 50 + [(year, 0.05)] * 50)
    score = lambda f: 1 / (1 + math.exp(-w[f].sum()))
    assert score(phone) > 0.8 and score(year) < 0.2
