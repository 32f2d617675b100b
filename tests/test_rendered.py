"""Rendered texts and places in them, chapters by regexes of any kind, prompt records, cached titles, archives swapped whole."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import intervals as I
from folio.operators import segments as S
from folio.sources import corpus

CHAPTERS = [
    (1, 0, "Chapter One", "Chapter 1\r\n\r\n  first line here  \n\n　second　line third “word” x"),
    (1, 1, "T", "T\n\n\nfirst line here"),
    (1, 2, "  ", "no title\nof its own"),
    (1, 3, "Part Two: The End", "Part Two\nThe End\nbody"),
    (1, 4, "Blank", " \n \n"),
    (1, 5, "Null", None),
    (2, 0, None, "a  b c\n\nd"),
]
RENDERED = {
    (1, 0): 'first line here\nsecond　line\nthird "word" x',
    (1, 1): "first line here",
    (1, 2): "no title\nof its own",
    (1, 3): "body",
    (1, 4): "",
    (1, 5): "",
    (2, 0): "a b c\nd",
}


@pytest.fixture(scope="module")
def chapters(spark):
    return spark.createDataFrame(CHAPTERS, "book_id long, chapter_index int, title string, content string").cache()


def test_rendered_chapters(chapters):
    got = {(r["book_id"], r["chapter_index"]): (r["title"], r["rendered"]) for r in S.rendered_chapters(chapters).collect()}
    assert {k: v[1].replace("second line", "second　line") for k, v in got.items()} == RENDERED
    assert got[1, 2][0] == "第3章" and got[2, 0][0] == "第1章" and got[1, 1][0] == "T"


def test_pieces_map_raw_places(spark, chapters):
    whole = {(r["book_id"], r["chapter_index"]): r["rendered"] for r in S.rendered_chapters(chapters).collect()}
    raw = {(b, c): t or "" for b, c, _, t in CHAPTERS}
    pieces = S.rendered_pieces(chapters)
    rows = pieces.collect()
    for k in whole:
        own = sorted((r for r in rows if (r["book_id"], r["chapter_index"]) == k), key=lambda r: r["paragraph_index"])
        assert [r["paragraph_index"] for r in own] == list(range(len(own)))
        assert "\n".join(r["text"] for r in own) == whole[k]
        assert all(whole[k][r["start"] : r["end"]] == r["text"] for r in own)
        assert all(raw[k][r["raw_start"] : r["raw_end"]].split() == r["text"].replace('"word"', "“word”").split() for r in own)
    at = raw[1, 0].index
    points = [(1, 0, o) for o in (0, at("first"), at("line"), at("  \n"), at("second"), at("third") + 2, 999)] + [(1, 1, 0), (1, 1, 5), (1, 4, 1), (7, 0, 3)]
    got = S.to_rendered(spark.createDataFrame(points, "book_id long, chapter_index int, offset long"), pieces)
    found = {tuple(r)[:3]: r["rendered_offset"] for r in got.collect()}
    w = whole[1, 0]
    assert [found[p] for p in points] == [0, 0, w.index("line"), w.index("\n"), w.index("second"), w.index("third") + 2, len(w), 0, 1, 0, 0]


def test_highlights_resolve_in_rendered_text(spark, chapters):
    rng = random.Random(2)
    keys = ["chapter-0", "chapter-1", "chapter-01", "chapter-3", "chapter-4", "chapter-9", "full", "other"]
    rows = [(i, 1 + i % 2, rng.choice(keys), rng.randrange(-3, 20), rng.randrange(-3, 60)) for i in range(200)] + [(900, 1, "chapter-1", 0, 10), (901, 1, "full", 2, 9)]
    full = {1: "One\r\n\n two \n\n three", 2: None}
    books = spark.createDataFrame(list(full.items()), "book_id long, full_text string")
    texts = {(r["book_id"], f"chapter-{r['chapter_index']}"): r["rendered"] for r in S.rendered_chapters(chapters).collect()} | {(1, "full"): "One\ntwo\nthree", (2, "full"): ""}
    want = {}
    for i, b, key, s, e in rows:
        t = texts.get((b, key.replace("-0", "-") if key == "chapter-01" else key), "")
        lo = max(0, min(s, len(t)))
        cut = t[lo : max(lo, min(e, len(t)))]
        if cut.strip():
            want[i] = cut
    got = I.resolve_highlights(spark.createDataFrame(rows, "range_id long, book_id long, chapter_key string, start long, end long"), chapters, books)
    assert {r["range_id"]: r["text"] for r in got.collect()} == want and want[900] == "first line" and want[901] == "e\ntwo\nt"
    assert {r["title"] for r in got.where("chapter_key = 'full'").collect()} == {"全文"}


def test_positions_of_highlights(spark, chapters):
    offsets = I.chapter_offsets(chapters.where("content is not null"))
    first = len(CHAPTERS[0][3])
    h = spark.createDataFrame([(1, "chapter-1", 3), (1, "full", 5), (1, "chapter-77", 1)], "book_id long, chapter_key string, start long")
    books = spark.createDataFrame([(1, 50)], "book_id long, full_text_length long")
    got = {r["chapter_key"]: (r["global_offset"], round(r["ratio"], 6)) for r in I.highlight_position(h, offsets, books).collect()}
    assert got == {"chapter-1": (first + 3, round(3 / len(CHAPTERS[1][3]), 6)), "full": (5, 0.1)}


def test_one_regex_does_not_touch_other_books(spark):
    text = "intro\nxx one\nbody\nxx two\nend"
    regexes = ["xx", "(?P<a>xx)", "(?<a>xx)", "x{2}", "x{,2}x", "(", "  ", None, "zz", r"xx\s+\w", "[[:alpha:]"]
    books = spark.createDataFrame([(i, text, 0, r) for i, r in enumerate(regexes)] + [(99, "", 0, "xx")], "book_id long, full_text string, chapter_char_count int, chapter_regex string")
    none = spark.createDataFrame([], "book_id long, chapter_index int, title string, content string")
    split = ["序章 / 前言", "xx one", "xx two"]
    for made in (S.resolve_chapters(books, none), S.split_chapters_regex(books, F.col("chapter_regex"))):
        got = {}
        for r in sorted(made.collect(), key=lambda r: (r["book_id"], r["chapter_index"])):
            got.setdefault(r["book_id"], []).append((r["title"], r["content"]))
        assert all("".join(c for _, c in v) == text for v in got.values()) and set(got) == set(range(len(regexes)))
        assert [[t for t, _ in got[i]] for i in (0, 1, 2, 3, 9)] == [split] * 5 and all([t for t, _ in got[i]] == ["全文"] for i in (5, 6, 7, 8))
    for regex, titles in (("xx", split), ("(?<a>xx)", split), ("(?P<a>xx)", ["全文"]), ("x{,2}", ["全文"]), ("(", ["全文"]), (" ", ["全文"]), ("a)(b", ["全文"])):
        assert [r["title"] for r in S.split_chapters_regex(books.where("book_id = 0"), regex).orderBy("chapter_index").collect()] == titles


def test_prompt_records(spark):
    at = dt.datetime(2024, 5, 1, 9, 7)
    df = spark.createDataFrame([("Ann", at, " a \n b ", "Bo", " q\tq "), ("Ann", at, None, None, None)], "name string, ts timestamp, text string, who string, q string")
    c = F.col
    got = [r[0] for r in df.select(T.prompt_record(c("name"), c("ts"), c("text"), (c("who"), c("ts"), c("q")))).collect()]
    assert got == ["[发送者:Ann][2024-05-01 09:07] a b [引用:发送者=Bo;时间=2024-05-01 09:07;内容=q q]", "[发送者:Ann][2024-05-01 09:07] "]
    old = spark.createDataFrame([(" [用户消息][发送者:A][时间:2024-05-01 09:07]  hi [时间:x]",), ("[角色消息] x",), ("plain",), (None,)], "r string")
    assert [r[0] for r in old.select(T.migrate_prompt_record(c("r"))).collect()] == ["[发送者:A][2024-05-01 09:07] hi [x]", " x", "plain", ""]


def test_cached_titles(spark):
    chunks = spark.createDataFrame([(1, 0, "p", 0), (1, 1, "q", 0)], "book_id long, chapter_index int, text string, paragraph_index int")
    cache = spark.createDataFrame([(1, 0, "Title"), (1, 1, "q"), (1, 2, "Alone")], "book_id long, chapter_index int, chunk_text string")
    titles = spark.createDataFrame([(1, 0, " Title "), (1, 1, "Other"), (1, 2, "Alone"), (1, 1, None)], "book_id long, chapter_index int, title string")
    assert sorted(map(tuple, S.cached_paragraphs(chunks, cache, titles).collect())) == [(1, 0, -1), (1, 1, 0)]
    assert sorted(map(tuple, S.cached_paragraphs(chunks, cache).collect())) == [(1, 1, 0)]


def test_archives_are_swapped_whole(spark, tmp_path):
    at = f"file://{tmp_path}/live"
    one = lambda *rows: spark.createDataFrame([(r,) for r in rows], "x long")
    shown = lambda: {n: sorted(r[0] for r in df.collect()) for n, df in corpus.live_tables(spark, at).items()}
    assert shown() == {}
    corpus.replace_all({"a": one(1), "b": one(2)}, at, {"c": "x long"})
    assert shown() == {"a": [1], "b": [2], "c": []}
    broken = one(5).selectExpr("if(x = 5, raise_error('lost'), x) as x")
    with pytest.raises(Exception, match="lost"):
        corpus.replace_all({"a": one(9), "b": broken}, at)
    assert shown() == {"a": [1], "b": [2], "c": []}
    held = corpus.live_tables(spark, at)
    corpus.replace_all({"a": held["a"].selectExpr("x + 1 as x"), "b": held["b"]}, at)  # from the place itself
    assert shown() == {"a": [2], "b": [2]} and held["a"].count() == 1  # those who read the old one still do
    corpus.replace_all({"a": one(7)}, at)
    assert shown() == {"a": [7]} and len([p for p in (tmp_path / "live").iterdir() if p.name.startswith("v-")]) == 2


def test_archives_of_another_application(spark, tmp_path):
    corpus.export_archive(spark, {"t": spark.range(2)}, f"file://{tmp_path}/a", "now", app_id="other")
    with pytest.raises(ValueError, match="not an archive"):
        corpus.restore_archive(spark, f"file://{tmp_path}/a")
    assert corpus.restore_archive(spark, f"file://{tmp_path}/a", app_id="other")["t"].count() == 2


def test_highlights_meet_pieces_of_their_chapter(spark):
    """Highlights inside a piece, across its border, longer than one, before and beyond the text, and without an end, against slices of the rendered text."""
    from folio.operators.intervals import PIECE, resolve_highlights

    text = " ".join(f"w{i}é" for i in range(400)) + "\nlast line"
    spans = [(0, 5), (PIECE - 3, PIECE + 4), (2 * PIECE - 1, 3 * PIECE - 1), (7, 3 * PIECE), (-9, 4), (-9, -2), (len(text) - 3, len(text) + 50), (len(text), len(text) + 5), (10**7, 10**7 + 3), (40, None), (9, 3), (0, 10**10)]
    h = spark.createDataFrame([(1, k, i, s, e) for k in ("chapter-0", "full") for i, (s, e) in enumerate(spans)], "book_id long, chapter_key string, range_id long, start long, end long")
    chapters = spark.createDataFrame([(1, 0, "T", text)], "book_id long, chapter_index int, title string, content string")
    books = spark.createDataFrame([(1, text)], "book_id long, full_text string")
    got = {(r["chapter_key"], r["range_id"]): r["text"] for r in resolve_highlights(h, chapters, books).collect()}
    cut = {i: text[max(s, 0) : max(max(s, 0), len(text) if e is None else e)] for i, (s, e) in enumerate(spans)}
    assert got == {(k, i): t for k in ("chapter-0", "full") for i, t in cut.items() if t.strip()}
    # No row holds a copy of a chapter that is not needed: the join with pieces has the piece's number.
    assert "_piece" in resolve_highlights(h, chapters, books)._jdf.queryExecution().optimizedPlan().toString()
