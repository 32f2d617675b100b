from folio.operators import segments


def test_any_number_of_sizes_and_regexes(spark):
    rows = [(i, "a line of text\n" * 200, 500 + i, None) for i in range(70)]
    rows += [(100 + i, f"before\nPart{i}x one\nbody\nPart{i}x two\nend", None, f"^Part{i}x") for i in range(70)]
    rows += [(200, "whole", None, "("), (201, "whole", 0, None), (202, "whole", None, " ")]
    books = spark.createDataFrame(rows, "book_id long, full_text string, chapter_char_count int, chapter_regex string")
    none = spark.createDataFrame([], "book_id long, chapter_index int, title string, content string")
    got = {}
    for r in segments.resolve_chapters(books, none).orderBy("book_id", "chapter_index").collect():
        got.setdefault(r["book_id"], []).append((r["title"], r["content"]))
    assert sorted(got) == [r[0] for r in rows]
    for i in range(70):
        assert got[i] == segments._size_cuts(rows[i][1], 500 + i) and len(got[i]) > 1
        assert [t for t, _ in got[100 + i]] == ["序章 / 前言", f"Part{i}x one", f"Part{i}x two"]
    assert got[200] == got[201] == got[202] == [("全文", "whole")]
