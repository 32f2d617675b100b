"""Segmentation, index and stream operators on rows written by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folio.operators import retrieval as R
from folio.operators import segments as S
from folio.operators.staging import numbered, spread
from folio.streaming import streams as X


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_html_blocks(spark):
    html = "<head><title>t</title></head><p>One <b>two</b></p><img src='a.png' alt=\"A\" width='20px' style='height: 7.6px'><script>x</script><p>three</p><img><div> </div>"
    got = S.html_to_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), ["page_id"])
    want = [(1, 0, "text", "One two", None, None, None, None, None), (1, 1, "image", None, "a.png", "A", None, 20, 8), (1, 2, "text", "three", None, None, None, None, None)]
    assert rows(got, "page_id", "block_index") == want


def test_flatten_toc_goes_as_deep_as_the_type(spark):
    kind, depth = "struct<title:string,path:string>", 9
    entry = F.struct(F.lit("leaf").alias("title"), F.lit("x").alias("path"))
    for n in range(depth, 0, -1):
        entry = F.struct(F.lit(f"level {n}").alias("title"), F.lit("x").alias("path"), F.array(entry).alias("children"))
    got = S.flatten_toc(spark.range(1).select(F.lit(7).alias("book_id"), F.array(entry).alias("toc")))
    assert kind and [r["title"] for r in got.orderBy("toc_index").collect()] == [*(f"level {n}" for n in range(1, depth + 1)), "leaf"]


def test_flatten_toc_level_by_level(spark):
    toc = [("a", "1", [("c", "2"), ("d", "3")]), ("b", "4", [("e", "5")])]
    df = spark.createDataFrame([(1, toc)], "book_id long, toc array<struct<title:string,path:string,children:array<struct<title:string,path:string>>>>")
    assert [(r["title"], r["level"]) for r in S.flatten_toc(df).orderBy("toc_index").collect()] == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 1)]


def test_drop_title_paragraphs(spark):
    chapters = [(1, 0, "Chapter XIV", "chapter 14\nText."), (1, 1, "Part One", "Part\nOne\nText."), (1, 2, "Other", "Text one.\nText two."), (1, 3, None, "A")]
    got = S.drop_title_paragraphs(spark.createDataFrame(chapters, "book_id long, chapter_index int, title string, content string"))
    assert [(r["dropped"], r["paragraphs"]) for r in got.orderBy("chapter_index").collect()] == [(1, ["Text."]), (2, ["Text."]), (0, ["Text one.", "Text two."]), (0, ["A"])]


def test_chunk_paragraphs(spark):
    long = "word " * 60 + "end. " + "tail " * 60
    pars = spark.createDataFrame([(1, 0, 0, "short"), (1, 0, 1, long), (1, 0, 2, "x" * 500)], "book_id long, chapter_index int, paragraph_index int, text string")
    got = S.chunk_paragraphs(pars, 200).collect()
    for i, text in enumerate(["short", long.strip(), "x" * 500]):
        pieces = [r["text"] for r in sorted((r for r in got if r["paragraph_index"] == i), key=lambda r: r["piece"])]
        assert "".join(pieces) == text and all(len(p) <= 250 for p in pieces)
    assert [len(r["text"]) for r in got if r["paragraph_index"] == 2] == [200, 200, 100]


def test_group_layout_lines(spark):
    items = [(1, 1, 0.0, 100.0, 10.0), (1, 2, 5.0, 99.0, 10.0), (1, 3, 9.0, 103.0, 6.0), (1, 4, 0.0, 80.0, 10.0), (1, 5, 3.0, 78.0, 6.0), (1, 6, 4.0, 80.0, 10.0)]
    got = S.group_layout_lines(spark.createDataFrame(items, "page_id long, item_id long, x double, baseline double, font double"))
    assert rows(got.select("item_id", "line", "role"), "item_id") == [(1, 0, "base"), (2, 0, "base"), (3, 0, "sup"), (4, 1, "base"), (5, 1, "sub"), (6, 1, "base")]


def test_reading_excerpt(spark):
    text = "One one. Two two. Three three. Four"
    books = spark.createDataFrame([(1, text), (2, None)], "book_id long, full_text string")
    places = spark.createDataFrame([(1, 1, 17), (1, 2, 999), (1, 3, -5), (2, 4, 3), (9, 5, 3)], "book_id long, position_id long, position long")
    got = {r["position_id"]: (r["start"], r["end"], r["excerpt"]) for r in S.reading_excerpt(places, books, 800).collect()}
    assert got[1][2] in ("One one. ", "One one. Two two.") and got[1][2] == text[got[1][0] : got[1][1]]
    assert got[2][2] == text[got[2][0] : got[2][1]] and got[2][2].startswith("One one. Two two. Three three.")
    assert got[3] == (0, 0, "") and got[4] == (0, 0, "") and got[5] == (0, 0, "")


def test_resolve_chapters_by_kind(spark):
    books = spark.createDataFrame([(1, "Chapter 1\na\nChapter 2\nb", 0, "^Chapter"), (2, "x" * 1300, 500, None), (3, "own", 0, "^Chapter"), (4, "plain", None, "(")], "book_id long, full_text string, chapter_char_count int, chapter_regex string")
    structured = spark.createDataFrame([(3, 0, "T", "body")], "book_id long, chapter_index int, title string, content string")
    got = rows(S.resolve_chapters(books, structured).select("book_id", "chapter_index", "title", F.length("content")), "book_id", "chapter_index")
    assert [g for g in got if g[0] != 2] == [(1, 0, "Chapter 1", 12), (1, 1, "Chapter 2", 11), (3, 0, "T", 4), (4, 0, "全文", 5)]
    assert sum(g[3] for g in got if g[0] == 2) == 1300


def test_embed(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha"), (3, "gamma")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in R.embed(df, "text").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b], strict=True))
    assert dot(1, 2) == pytest.approx(1, abs=1e-6) and dot(1, 3) < 0.5
    named = {r["id"]: list(r["embedding"]) for r in R.embed(df, "text", lambda texts: [[float(len(t))] for t in texts], batch=2).collect()}
    assert named == {1: [19.0], 2: [19.0], 3: [14.0]}


def test_signature_and_refresh(spark):
    old = spark.createDataFrame([(1, 0, "t", "word. " * 200), (2, 0, "t", "other. " * 200)], "book_id long, chapter_index int, title string, content string")
    new = old.withColumn("content", F.when(F.col("book_id") == 2, F.concat(F.lit("changed. "), "content")).otherwise(F.col("content")))
    signed = [dict(R.content_signature(x).collect()) for x in (old, old.repartition(3), new)]
    assert signed[0] == signed[1] and signed[0][1] == signed[2][1] and signed[0][2] != signed[2][2]
    target = spark.createDataFrame([(1, 600), (2, 600)], "book_id long, target long")
    none = spark.createDataFrame([], "book_id long, chunk_count long, indexed_up_to long, content_signature string")
    chunks, meta = R.refresh_index(target, old, S.chunk_chapters(old.limit(0)), none, S.chunk_chapters)
    assert {r["book_id"]: r["indexed_up_to"] for r in meta.collect()} == {1: 600, 2: 600}
    again, meta2 = R.refresh_index(target, new, chunks, meta, S.chunk_chapters)
    texts = {r["book_id"]: r["text"] for r in again.where("start_offset = 0").collect()}
    assert texts[2].startswith("changed.") and texts[1].startswith("word.") and meta2.count() == 2
    assert again.where("book_id = 1").exceptAll(chunks.where("book_id = 1")).count() == 0


def test_note_query_text(spark):
    df = spark.createDataFrame([("n", "r"), (None, "r"), ("n", " "), (None, None), ("x" * 1300, "r")], "note string, reply string")
    assert [r[0] for r in df.select(R.note_query_text(F.col("note"), F.col("reply"))).collect()] == ["r\nn", "r", "n", "", "x" * 1200]


def test_numbered_and_spread(spark):
    df = spark.range(500).withColumn("v", (F.col("id") * 37) % 500)
    assert sorted((r["v"], r["n"]) for r in numbered(df, "n", F.desc("v")).collect()) == [(499 - i, i + 1) for i in range(499, -1, -1)]
    assert numbered(df.limit(0), "n", F.asc("v")).count() == 0
    assert spread(df.coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(df, "id").count() == 500


def stream(spark, tmp_path, df):
    path = f"{tmp_path}/in.parquet"
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_debounce_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    ticks = [("a", 0), ("a", 1), ("a", 3), ("a", 5), ("a", 6), ("b", 2)]
    df = spark.createDataFrame([(k, t0 + timedelta(seconds=s)) for k, s in ticks], "task_key string, ts timestamp")
    got = X.drain(X.stream_debounce(stream(spark, tmp_path, df)))
    assert rows(got.select("task_key", F.second("ts")), "task_key", "ts") == [("a", 0), ("a", 3), ("a", 6), ("b", 2)]


def test_late_sample_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, i % 7, t0 + timedelta(seconds=i), t0 + timedelta(seconds=i + i % 20)) for i in range(300)], "event_id long, user_id long, planned timestamp, actual timestamp")
    batch = rows(X.filter_late_sample(df, 20, 30).select("event_id"), "event_id")
    assert rows(X.drain(X.filter_late_sample(stream(spark, tmp_path, df), 20, 30)).select("event_id"), "event_id") == batch
    assert 0 < len(batch) < 165 and all(i % 20 <= 10 for (i,) in batch)
    assert len(rows(X.filter_late_sample(df, 20, 100), "event_id")) == 165


def test_copies_of_ranges_change_no_merge(spark):
    """The same ranges sixty times merge as they do once."""
    from folio.operators.intervals import merge_ranges

    rows = [("b", i % 3, i * 7 % 50, i * 7 % 50 + i % 9, "xyz"[i % 3 * i % 3]) for i in range(120)]
    once = spark.createDataFrame(rows, "book_id string, chapter_key int, start long, end long, color string").distinct()
    many = once.crossJoin(spark.range(60)).drop("id")
    got = [sorted(map(tuple, merge_ranges(r, ["book_id", "chapter_key"]).collect())) for r in (once, many)]
    assert got[0] == got[1] and got[0]


def test_characters_meet_lore_in_cells(spark):
    """A category with more rows than a cell, on both sides, beside a rare one: every pair once, in more than one task."""
    from pyspark.sql import functions as F

    from folio.operators import chat

    c = spark.range(9000).select(F.col("id").alias("character_id"), F.expr("if(id = 5, array(' rare ', 'wide', 'wide'), array('wide', ''))").alias("categories"))
    lore = spark.range(5000).select(F.col("id").alias("entry_id"), F.expr("if(id < 2, 'rare', 'wide')").alias("category"))
    got = chat.bind_lore(c, lore)
    n, pairs = got.agg(F.count("*"), F.approx_count_distinct(F.hash("character_id", "entry_id"))).first()
    assert n == 9000 * 4998 + 2 and pairs > 0.9 * n
    assert got.where("category = 'wide'").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_a_name_of_many_personas_makes_no_pairs(spark):
    from pyspark.sql import functions as F

    from folio.operators import chat

    c = spark.range(3000).select(F.col("id").alias("character_id"), F.lit("a").alias("name"))
    p = spark.range(2000).select((F.col("id") + 7).alias("persona_id"), F.array(F.lit("a"), F.lit("b")).alias("bound_roles"))
    got = chat.bind_persona(c, p)
    assert got.agg(F.count("*"), F.min("persona_id"), F.max("persona_id")).first() == (3000, 7, 7)
    # The join's side of names is aggregated before it.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate") and plan.count("Aggregate") == 2
