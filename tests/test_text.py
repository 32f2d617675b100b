"""Text functions on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import segments as S
from folio.sources import corpus


def one(spark, expr, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(expr(*[F.col(c) for c in df.columns]).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("a", "key"),
    [
        ("第十二章", "第12章"), ("第12章", "第12章"), ("Chapter XIV", "chapter 14"), ("chapter 14", "chapter 14"), ("Chapter Twenty-One", "chapter 21"), ("一百零五", "105"),
        ("and", "and"), ("hundred", "100"), ("Three Hundred and Five: Title", "305 title"), ("two thousand nineteen", "2019"), ("Bread and Butter", "bread and butter"),
        ("十", "10"), ("一万二千", "12000"), ("第三回", "第3回"), ("五节", "5节"), ("mix", "1009"), ("!!!", ""), ("five and dog", "5 dog"),
    ],
)
def test_heading_key(spark, a, key):
    assert one(spark, T.heading_key, a) == key


def test_white_space(spark):
    assert one(spark, T.strip, "　﻿ a b \t") == "a b"
    assert one(spark, T.compact, " a \n　 b ") == "a b"


def test_sanitize(spark):
    raw = "Look data:image/png;base64,AAAA== here ![x](idb://pic-1) and <img src='a'> [图片：cat]\n\n\n\nend"
    out = one(spark, T.sanitize, raw)
    assert "base64" not in out and "idb" not in out and "<img" not in out and "图片" not in out and out.endswith("end")


def test_typography(spark):
    assert one(spark, T.fix_typography, "don’t “say” it.” a　b ＂x＇") == "don't \"say\" it.\" a b \"x'"


def test_keys(spark):
    assert one(spark, lambda a, b: T.conversation_key(a, b, F.lit(None)), "7", "") == "book:7::persona:none::character:none"
    assert one(spark, lambda k: T.parse_key(k), "book:none::persona:p::character:c::d")["character_id"] == "c::d"
    assert one(spark, lambda k: T.parse_key(k)["persona_id"], "nonsense") is None


def test_hashes(spark):
    assert one(spark, T.fnv1a32, "hello") == "4f9f2cab"
    assert one(spark, T.hash31, "hello") == "h1n1e4y"
    assert one(spark, T.fnv1a32, "") == "811c9dc5"


def test_placeholders(spark):
    assert one(spark, lambda t: T.fill_placeholders(t, F.lit("A$1\\"), F.lit("B")), "{{char}} and {{USER}}{{Char}}") == "A$1\\ and BA$1\\"


def test_tokens(spark):
    assert one(spark, T.token_estimate, "你好 world") == 4
    assert one(spark, T.token_estimate, "  ") == 0
    assert one(spark, T.token_estimate, "a") == 1


def test_bytes_and_names(spark):
    assert [one(spark, T.format_bytes, n) for n in (0, 1023, 1536, 20480, 1048576 * 150)] == ["0 B", "1023 B", "1.50 KB", "20.0 KB", "150 MB"]
    assert one(spark, lambda t: T.safe_file_name(t, F.lit("x")), ' a:b*c?. . ') == "a_b_c_"
    assert one(spark, lambda t: T.safe_file_name(t, F.lit("x")), "...") == "x"


def test_query_terms(spark):
    assert one(spark, T.query_terms, "The THE 中文字 a 12 x9") == ["the", "中文字", "12", "x9"]


def test_image_types(spark):
    assert one(spark, T.image_mime, bytearray(b"RIFF0000WEBPVP8 ")) == "image/webp"
    assert one(spark, T.image_mime, bytearray(b"no")) is None


def test_charsets(tmp_path, spark):
    text = "你好，世界。第一章"
    for name, raw in {"a": text.encode("gbk") + b".", "b": text.encode("utf-8-sig"), "c": b"\xff\xfe" + text.encode("utf-16-le"), "d": text.encode("utf-16-le"), "e": b"plain"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"][-1]: r["text"] for r in corpus.read_text_corpus(spark, f"file://{tmp_path}").collect()}
    assert got == {"a": text + ".", "b": text, "c": text, "d": text, "e": "plain"}


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Pi is 3.14. Next", ["Pi is 3.14. ", "Next"]), ("1,000 cats, 2 dogs", ["1,000 cats, ", "2 dogs"]), ("At 5:00 sharp", ["At 5:00 sharp"]), ("co-op 2024-2026 x", ["co-op 2024-2026 x"]),
        ("等……好", ["等……", "好"]), ("“好。”他说", ["“好。”", "他说"]), ("no end", ["no end"]), ("a - b", ["a - ", "b"]), ("a -- b", ["a -- ", "b"]), ("x! \n\ny", ["x! ", "y"]),
    ],
)
def test_sentences(spark, text, parts):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    spans = [(r["start"], r["end"]) for r in S.split_sentences(df, ["k"]).orderBy("start").collect()]
    got = [text[a:b] for a, b in spans]
    assert [p for p in got if p.strip()] == [p for p in parts if p.strip()]


def test_passages():
    for n in (0, 19):
        assert [r for r in S.passage_ranges("a" * n, 0, 1 << 40) if r[1] - r[0] >= 20] == []
    assert S.passage_ranges("a" * 20, 0, 99) == [(0, 20)]
    assert S.passage_ranges("a" * 512, 0, 999) == [(0, 512)]
    assert S.passage_ranges("a" * 513, 0, 999) == [(0, 512), (448, 513)]
    text = "a" * 511 + "." + "b" * 200
    assert S.passage_ranges(text, 0, 9999)[0] == (0, 512)
    text = "a" * 631 + "." + "b" * 200
    assert S.passage_ranges(text, 0, 9999)[0] == (0, 632)
    text = "a" * 632 + "." + "b" * 200
    assert S.passage_ranges(text, 0, 9999)[0] == (0, 512)
    text = "a" * 400 + ". \n\n" + "b" * 500
    assert S.passage_ranges(text, 0, 9999)[0] == (0, 404)


def test_passages_cover_and_overlap():
    import random

    random.seed(1)
    for _ in range(200):
        text = "".join(random.choice("abcdefg hij. \n!3.5") for _ in range(random.randint(0, 4000)))
        ranges = S.passage_ranges(text, 0, 1 << 40)
        assert (ranges and ranges[0][0] == 0 and ranges[-1][1] == len(text)) or not text
        assert all(b[0] == a[1] - 64 for a, b in zip(ranges, ranges[1:]) if a[1] - 64 > a[0])


def test_size_cuts():
    assert S._size_cuts("x" * 600, 500) == [("第1章", "x" * 600)]
    cut = S._size_cuts("x" * 480 + "\n" + "y" * 600, 500)
    assert cut[0][1] == "x" * 480 + "\n"
    assert S._size_cuts("x" * 1400, 500)[0][1] == "x" * 500


def test_quotes(spark):
    got = one(spark, S.locate_quote, "say it twice: sa y it", "s ay\nit")
    assert (got["start"], got["end"]) == (14, 21)
    assert one(spark, S.locate_quote, "abc", "x") is None and one(spark, S.locate_quote, "abc", " ") is None


def test_math(spark):
    rows = [(1, "$5 and $10"), (2, "$x^2$"), (3, "$$a$$ and \\(b\\)"), (4, "a \\$ b"), (5, "∑∞"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r["k"]: (r["regions"], r["characters"]) for r in S.math_coverage(df, ["k"]).collect()}
    assert got == {1: (0, 0), 2: (1, 5), 3: (2, 10), 4: (0, 0), 5: (1, 2), 6: (0, 0), 7: (0, 0)}
    spans = {(r["k"], r["start"], r["end"], r["content"], r["display"]) for r in S.math_regions(df, ["k"]).collect()}
    assert spans == {(2, 0, 5, "x^2", False), (3, 0, 5, "a", True), (3, 10, 15, "b", False), (5, 0, 2, "\\sum\\infty", False)}
    assert S.math_regions(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("\\[x ∈ A\\] ∈ B", [(0, 9, "x ∈ A", True), (10, 11, "\\in", False)]),  # a run inside a formula goes, one beside it stays
        ("Ω → [ −∞, ∞ prose", [(0, 11, "\\Omega \\to [ -\\infty, \\infty", False)]),
        ("α version", []),  # one hint is not enough
        ("ΩC ⊂).", [(0, 6, "\\Omega C \\subset).", False)]),
        ("α 12345 β", []),  # over four characters between
        ("α 12 β", [(0, 6, "\\alpha 12 \\beta", False)]),
        ("$$ $$ $a=b$", [(6, 11, "a=b", False)]),
        ("$$$$x$$", [(1, 7, "$x", True)]),
        ("\\\\$a+b$", [(2, 7, "a+b", False)]),  # two backslashes escape each other
        ("\\$a+b$", []),
        ("$\\$=1$", [(0, 6, "\\$=1", False)]),
        ("$a\n\nb=c$", []),
        ("$ab$", []),
        ("\\[ \\] \\(\\)", []),
        ("\\[ \\[ x", []),
    ],
)
def test_math_spans(text, want):
    assert S.math_spans(text) == want


def test_math_in_long_texts_takes_linear_time():
    for text in ("\\[" * 100_000, "$a " * 100_000, "$" * 200_001, "α" * 200_000, "\\" * 200_000 + "$"):
        assert len(S.math_spans(text)) <= 1


def test_titles(spark):
    toc = "Table of Contents\n" + "\n".join(f"Chapter {i}: Part {c} ... {i}" for i, c in enumerate("ABCDEFGH", 1))
    rows = [(1, 0, "Contents", toc), (1, 1, "Chapter 1", "x" * 50), (1, 2, "Chapter 2", "Short line\nmore"), (1, 3, "Real", "text")]
    got = {r["chapter_index"]: r["title"] for r in S.repair_chapter_titles(spark.createDataFrame(rows, "book_id long, chapter_index int, title string, content string")).collect()}
    assert got[2] == "Short line" and got[3] == "Real" and got[1].startswith("Part A")


def test_rest_of_a_heading_is_kept_by_its_key(spark):
    """Headings with one key have one rest, so no key is missed by looking at rests first."""
    from pyspark.sql import functions as F

    from folio.functions import text as T

    heads = ["Chapter One", "chapter 1", "CHAPTER I.", "第一章 起", "第1章 起", "twenty and one dogs", "21 dogs", "mix five", "1009 5", "and", "", " . ", "One\u0085", "1\u0085 x", "hundred and mild did", "100 mild did", "十二回 a", "12回 a"]
    df = spark.createDataFrame(list(enumerate(heads)), "i long, t string").select("t", T.heading_key(F.col("t")).alias("k"), T.heading_rest(T.heading_plain(F.col("t"))).alias("r"), T.heading_plain(F.col("t")).alias("p"))
    rows = df.collect()
    for a in rows:
        assert (a.k == "") == (a.p == "")
        assert all(a.r == b.r for b in rows if a.k == b.k), a
    assert len({r.k for r in rows}) < len(heads) - 4


def test_guards_change_no_text(spark):
    """Texts with and without what a pattern needs, against the patterns on their own."""
    import random

    from pyspark.sql import functions as F

    from folio.functions import text as T

    random.seed(2)
    texts = ["".join(random.choice(list("ab1 .,\n\r\t") + ["’", "“", "”", "　", " ", "＂", "ʼ", "  ", "\n\n"]) for _ in range(random.randint(0, 14))) for _ in range(1500)] + ["a b", "", None]
    plain = lambda c: F.regexp_replace(c, f"^{T.WS}+|{T.WS}+$", "")
    c = F.col("t")
    block = plain(T._chain(T._chain(c, T._TYPOGRAPHY), T._BLOCK_SPACE))
    squeezed = plain(F.regexp_replace(c, f"{T.WS}+", " "))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_block(c).alias("a"), block.alias("b"), T.compact(c).alias("x"), squeezed.alias("y"), T.strip(c).alias("m"), plain(c).alias("n"))
    assert df.where("not (a <=> b and x <=> y and m <=> n)").count() == 0


def test_sanitized_texts_and_hashes_of_long_ones(spark):
    """``sanitize`` against its patterns on their own; a hash of a long text takes no square of its length."""
    import random
    import time

    from pyspark.sql import functions as F

    from folio.functions import text as T

    random.seed(5)
    bits = ["<IMG src=x>", "DATA:image/png;base64,AA==", "IDB://a.b", "![x](idb://q)", "[图片：a]", " ", "\n", "\n\n\n", "\t", "a:b;c", "x", "　"]
    df = spark.createDataFrame([("".join(random.choices(bits, k=random.randint(0, 9))),) for _ in range(800)], "t string")
    old = F.regexp_replace(T._chain(F.col("t"), T._PROMPT_NOISE), f"^{T.WS}+|{T.WS}+$", "")
    assert df.where(~T.sanitize(F.col("t")).eqNullSafe(old)).count() == 0
    began = time.time()
    assert spark.range(1).select(T.fnv1a32(F.repeat(F.lit("ab"), 100_000 + F.col("id").cast("int")))).first()[0]
    assert time.time() - began < 20
