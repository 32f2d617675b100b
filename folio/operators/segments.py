"""Corpus preparation: chapters, blocks, paragraphs, sentences and passages."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import WS, compact, fix_typography, heading_key_of, heading_plain, heading_rest, let, normalize_block, paragraphs, sanitize, strip
from folio.operators.staging import cut

#: White space at the ends of a title.
_BLANK = " \t\n\r\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# ---- chapters -----------------------------------------------------------------------------------


def _java_compiles(spark: SparkSession, regex: str) -> bool:
    """Whether the engine that runs the split takes the regex."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(f"(?m)((?:{regex}).*)")
    except Exception:  # what the JVM throws comes as one kind of error
        return False
    return bool(regex.strip())


_PREFACE, _WHOLE = "序章 / 前言", "全文"


def _regex_cuts(text: str, regex: str | None) -> list[tuple[str, str]]:
    """The split of one text by Python's engine; names of groups may be written as Java and JavaScript do."""
    if not text:
        return []
    pattern = _pattern(regex or "")
    starts = [m.start() for m in pattern.finditer(text)] if pattern else []
    if not starts:
        return [(_WHOLE, text)]
    parts = [text[lo:hi] for lo, hi in zip(starts, [*starts[1:], len(text)], strict=True)]
    return [(_PREFACE, text[: starts[0]])] * (starts[0] > 0) + [(c.split("\n", 1)[0].strip(_BLANK), c) for c in parts]


def _pattern(regex: str) -> re.Pattern | None:
    try:
        # ``re`` keeps what it compiled. A cache by functools would be pickled by its name, and workers lack the package.
        return re.compile(f"((?:{re.sub(r'[(][?]<(?=[A-Za-z])', '(?P<', regex)}).*)", re.MULTILINE) if regex.strip() else None
    except re.error:
        return None


def split_chapters_regex(books: DataFrame, regex: str | Column, keep_empty: bool = False) -> DataFrame:
    """Chapters that start at lines with a match; what stands before the first is the preface.

    A regex for all books is Java's and runs in the JVM; a column of regexes is split by Python's engine, which
    takes each in turn. A book without matches, a blank regex or one that its engine does not take gives one chapter of
    the whole text, and does not touch other books. An empty text has no chapter, or with ``keep_empty`` one that is empty;
    a null never has one.
    """
    if isinstance(regex, Column):
        least = [(_WHOLE, "")] * keep_empty
        own = books.where("full_text is not null").withColumn("_regex", regex)
        return per_text(own, ["book_id"], "full_text", lambda t, r: [(i, *c) for i, c in enumerate(_regex_cuts(t, r) or least)], "chapter_index int, title string, content string", ("_regex",))
    text = F.coalesce("full_text", F.lit(""))
    whole = F.array(F.struct(F.lit(_WHOLE).alias("title"), text.alias("content")))
    usable = _java_compiles(books.sparkSession, regex)
    # A mark is put before each match (the rest of the line goes with it), and the text is cut there.
    mark = "\u0001\u0002"
    cut = F.split(F.regexp_replace(text, f"(?m)((?:{regex}).*)", mark + "$1") if usable else text, mark)
    head = F.element_at(cut, 1)
    rest = F.transform(F.slice(cut, F.lit(2), F.size(cut)), lambda c: F.struct(strip(F.substring_index(c, "\n", 1)).alias("title"), c.alias("content")))
    first = F.when(head != "", F.array(F.struct(F.lit(_PREFACE).alias("title"), head.alias("content")))).otherwise(F.array().cast("array<struct<title:string,content:string>>"))
    found = F.when((F.size(cut) > 1) & (text != ""), F.concat(first, rest)).otherwise(whole)
    return books.where("full_text is not null" if keep_empty else "coalesce(full_text, '') <> ''").select("book_id", F.posexplode(found).alias("chapter_index", "c")).select("book_id", "chapter_index", "c.title", "c.content")


def per_text(df: DataFrame, keys: list[str], text: str, fn: Callable[..., list[tuple]], schema: str, args: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``fn`` over each text and the columns ``args``, as ``keys`` and ``schema``; texts go through Arrow in batches."""
    own = df.select(*keys, text, *args)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[: len(keys)])
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, which = [], []
            given = [b.column(i).to_pylist() for i in range(len(keys), b.num_columns)]
            for i, (t, *more) in enumerate(zip(*given, strict=True)):
                own_rows = fn(t or "", *more)
                rows += own_rows
                which += [i] * len(own_rows)
            at = pa.array(which, pa.int64())
            parts = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kept = [b.column(i).take(at) for i in range(len(keys))]
            made = [pa.array(p, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[s.split()[1]]) for p, s in zip(parts, schema.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*keys, *names])

    return own.mapInArrow(run, f"{kinds}, {schema}")


_SURE_END = re.compile(r"[。！？；…｡!?;]|(?<![0-9])\.(?=$|[\s\"'“”‘’）)\]】》])")


def _size_cuts(text: str, target: int) -> list[tuple[str, str]]:
    """Cut near every ``target`` characters: at a line end, else a sentence end, else hard."""
    target = max(500, min(50_000, target))
    reach = int(target * 0.3)
    lines = [m.end() for m in re.finditer("\n", text)]
    ends = [m.end() for m in _SURE_END.finditer(text)]
    out, at = [], 0
    while at < len(text):
        to = len(text)
        if len(text) - at > target * 1.3:
            ideal = at + target
            low = max(at + 1, ideal - reach)
            i = bisect_right(lines, ideal + 1) - 1  # the last line end up to the ideal place
            j = bisect_right(ends, ideal + 1) - 1
            if i >= 0 and lines[i] > low:
                to = lines[i]
            elif i + 1 < len(lines) and lines[i + 1] <= min(len(text), ideal + reach):
                to = lines[i + 1]
            else:
                to = ends[j] if j >= 0 and ends[j] > low else ideal
        content = text[at:to].lstrip()
        if content:
            out.append((f"第{len(out) + 1}章", content))
        at = to
    return out


def split_chapters_chars(books: DataFrame, target: int = 2000) -> DataFrame:
    """Chapters of about ``target`` characters."""
    return per_text(books, ["book_id"], "full_text", lambda t: [(i, *c) for i, c in enumerate(_size_cuts(t, target))], "chapter_index int, title string, content string")


def split_chapters_heading(blocks: DataFrame) -> DataFrame:
    """``(book_id, block_index, tag, text)``: headings h1 to h6 start chapters; untitled ones are numbered."""
    order = Window.partitionBy("book_id").orderBy("block_index")
    is_head = F.lower("tag").rlike("^h[1-6]$")
    marked = blocks.withColumn("_h", is_head).withColumn("_c", F.sum(is_head.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("block_index", "text")))), lambda b: b["text"])
    made = marked.groupBy("book_id", "_c").agg(F.max(F.when(F.col("_h"), compact(F.col("text")))).alias("_t"), normalize_block(F.array_join(body, "\n")).alias("content")).where("content <> ''")
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("_c"))
    return made.withColumn("_n", n).select("book_id", (F.col("_n") - 1).alias("chapter_index"), F.coalesce(F.nullif("_t", F.lit("")), F.concat(F.lit("第 "), "_n", F.lit(" 章"))).alias("title"), "content")


def resolve_chapters(books: DataFrame, structured: DataFrame, keep_empty: bool = False) -> DataFrame:
    """By size where a book asks for 500 characters or more, else its own structure, else its regex.

    ``keep_empty`` is that of ``split_chapters_regex``.
    """
    sized = books.where("chapter_char_count >= 500")
    rest = books.where("coalesce(chapter_char_count, 0) < 500")
    own = structured.join(rest.select("book_id"), "book_id", "left_semi")
    plain = rest.join(structured.select("book_id"), "book_id", "left_anti")
    by_size = per_text(
        sized, ["book_id"], "full_text", lambda t, n: [(i, *c) for i, c in enumerate(_size_cuts(t, n))], "chapter_index int, title string, content string", ("chapter_char_count",)
    )
    out = own.select("book_id", "chapter_index", "title", "content").unionByName(by_size)
    return out.unionByName(split_chapters_regex(plain, F.col("chapter_regex"), keep_empty))


def merge_text_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring text blocks become one, lines apart; blank ones go; images stay."""
    order = Window.partitionBy(*keys).orderBy("block_index")
    good = blocks.withColumn("text", normalize_block(F.col("text"))).where("type <> 'text' or text <> ''")
    new = (F.col("type") != "text") | ~F.lag("type").over(order).eqNullSafe(F.lit("text"))
    runs = good.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"])
    return runs.groupBy(*keys, "_run").agg(F.first("type").alias("type"), F.array_join(parts, "\n").alias("text"), F.first("image_ref").alias("image_ref")).withColumn("block_index", F.col("_run") - 1).drop("_run")


_TOC = r"(?i)table\s+of\s+contents|目\s*录"
_PLACEHOLDER = r"(?i)^(chapter\s+\d+|table\s+of\s+contents|contents|目\s*录)?$"


#: What a text needs for a compacted line of it to have _TOC.
_TOC_HINT = f"(?i)table{WS}+of{WS}+contents|目{WS}*录"
#: No title is longer than this, not with a page number either.
_LONG = 60


def _title_line(line: Column) -> Column:
    """A compacted line without page number and chapter mark; a long line, which is no title, stays."""
    bare = strip(F.regexp_replace(line, r"\s*[·•\-–—]?\s*\d{1,5}\s*$", ""))
    bare = strip(F.regexp_replace(bare, r"(?i)^chapter\s+\d+\s*[:：.\-]?\s*", ""))
    return F.when((F.length(line) > _LONG) & ~line.rlike("(?i)^chapter"), line).otherwise(bare)


def _usable(size: int) -> Callable[[Column], Column]:
    return lambda x: (F.length(x) <= size) & (x != "") & ~x.rlike(r"^\d+$") & ~x.rlike(_TOC)


def repair_chapter_titles(chapters: DataFrame) -> DataFrame:
    """Placeholder titles from the chapter's first short line, else from the book's table of contents, which may go.

    Only books with a table of contents are brought together; chapters of others are looked at where they are.
    """
    whole = F.coalesce("content", F.lit(""))
    is_open = lambda title: compact(F.coalesce(title, F.lit(""))).rlike(_PLACEHOLDER)
    lines = F.transform(F.split(normalize_block(whole), "\n"), lambda x: let(compact(x), _title_line))
    own = F.get(F.filter(lines, _usable(36)), F.lit(0))
    c = chapters.withColumn("title", F.when(is_open(F.col("title")), F.coalesce(own, F.col("title"))).otherwise(F.col("title")))

    hinted = F.col("content").rlike(_TOC_HINT)
    all_lines = F.filter(F.transform(F.split(normalize_block(whole), "\n"), compact), lambda x: x != "")
    after = lambda ls: let(F.array_position(F.transform(ls, lambda x: x.rlike(_TOC)), True), lambda at: F.when(at > 0, F.slice(F.transform(ls, _title_line), at.cast("int") + 1, F.size(ls))).otherwise(F.array().cast("array<string>")))
    titles = lambda ls: F.array_distinct(F.filter(after(ls), lambda x: _usable(42)(x) & ~x.rlike(r"^[-=._\s]+$")))
    listing = let(all_lines, lambda ls: F.struct(titles(ls).alias("_titles"), ls.alias("_lines")))
    listing = F.when(hinted, listing)
    found = chapters.where(hinted & F.col("content").rlike(_TOC)).select("book_id", "chapter_index", listing.alias("l")).where(F.size("l._titles") >= 3)
    toc = cut(found.groupBy("book_id").agg(F.min("chapter_index").alias("_toc")))
    plain = c.join(toc, "book_id", "left_anti").select("book_id", "chapter_index", "title", "content")

    c = c.join(toc, "book_id").withColumn("_l", listing).select("*", "_l.*").withColumn("_is", F.col("chapter_index") == F.col("_toc"))
    c = c.withColumn("_open", is_open(F.col("title")) & ~F.col("_is"))
    rank = F.row_number().over(Window.partitionBy("book_id", "_open").orderBy("chapter_index"))
    listed = c.where("_is").select("book_id", F.posexplode("_titles").alias("_p", "_t")).select("book_id", (F.col("_p") + 1).alias("_rank"), "_t")
    named = c.withColumn("_rank", F.when(F.col("_open"), rank)).join(listed, ["book_id", "_rank"], "left")
    short = F.size(F.filter("_lines", lambda x: F.length(strip(F.regexp_replace(x, r"\s*[·•\-–—]?\s*\d{1,5}\s*$", ""))) <= 24))
    drop = F.coalesce(F.col("_is") & (F.size("_titles") >= 5) & (F.size("_lines") >= 8) & (short / F.size("_lines") >= 0.6), F.lit(False))
    title = F.when(F.col("_is") & is_open(F.col("title")), F.lit("目录")).otherwise(F.coalesce("_t", "title"))
    return plain.unionByName(named.where(~drop).select("book_id", "chapter_index", title.alias("title"), "content"))


def dedupe_toc(toc: DataFrame) -> DataFrame:
    order = Window.partitionBy("book_id", "path", F.coalesce("fragment", F.lit(""))).orderBy("toc_index")
    return toc.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def flatten_toc(df: DataFrame) -> DataFrame:
    """``(book_id, toc array<struct<title, path, children ...>>)`` level by level, as deep as the column's type goes."""
    level = df.select("book_id", F.posexplode("toc").alias("pos", "e")).withColumn("place", F.array("pos"))
    out = None
    for n in count():
        own = level.select("book_id", F.lit(n).alias("level"), "place", "e.title", "e.path")
        out = own if out is None else out.unionByName(own)
        kind = level.schema["e"].dataType
        if "children" not in kind.names:
            break
        level = level.select("book_id", "place", F.posexplode("e.children").alias("pos", "e")).withColumn("place", F.concat("place", F.array("pos"))).drop("pos")
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("level", "place")) - 1
    return out.withColumn("toc_index", rank).drop("place")


def assign_toc_spans(toc: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens from each entry's anchor up to the next entry's, across files.

    ``toc`` has toc_index, file and anchor token; ``tokens`` file and token. Both are one order, so
    each token's entry is the last that starts at or before it: one sort by book.
    """
    marks = toc.select("book_id", "file", F.col("anchor").alias("token"), F.lit(0).alias("_k"), F.col("toc_index").alias("_toc"))
    rows = tokens.select("book_id", "file", "token", F.lit(1).alias("_k"), F.lit(None).cast(toc.schema["toc_index"].dataType).alias("_toc"))
    order = Window.partitionBy("book_id").orderBy("file", "token", "_k", "_toc").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(marks).withColumn("toc_index", F.last("_toc", ignorenulls=True).over(order))
    return found.where("_k = 1 and toc_index is not null").select("book_id", "toc_index", "file", "token")


def diff_chapters(old: DataFrame, new: DataFrame) -> DataFrame:
    a = old.select("book_id", "chapter_index", F.struct("title", "content").alias("a"))
    b = new.select("book_id", "chapter_index", F.struct("title", "content").alias("b"))
    met = a.join(b, ["book_id", "chapter_index"], "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return met.select("book_id", "chapter_index", kind.alias("change")).where("change is not null")


# ---- paragraphs, sentences, passages ---------------------------------------------------------------


def split_paragraphs(chapters: DataFrame) -> DataFrame:
    return chapters.select("book_id", "chapter_index", F.posexplode(paragraphs(F.col("content"))).alias("paragraph_index", "text"))


def title_paragraphs(p: Column, title: Column) -> Column:
    """How many leading paragraphs say what the title says: one, two short ones together, or none."""
    first = lambda i: F.get(p, F.lit(i))
    short = lambda i: (F.length(first(i)) <= 80) & ~first(i).rlike("[。！？!?]")
    both = F.when((F.size(p) > 1) & short(0) & short(1), heading_plain(F.concat_ws(" ", first(0), first(1))))
    plain = F.array(heading_plain(F.coalesce(title, F.lit(""))), heading_plain(first(0)), both)
    # Keys are long work on long texts, so only headings with the title's rest get one; the expression stands once, as it is long too.
    like = lambda k: F.transform(k, lambda x: F.when(heading_rest(x) == heading_rest(k[0]), x))
    said = lambda k: F.when(k[1] == k[0], 1).when(k[2] == k[0], 2).otherwise(0)
    by_key = lambda k: F.when(k[1].isNotNull() | k[2].isNotNull(), let(F.transform(k, heading_key_of), said)).otherwise(0)
    return let(plain, lambda k: F.when(k[0] == "", 0).when(k[1] == k[0], 1).otherwise(let(like(k), by_key)))


def drop_title_paragraphs(chapters: DataFrame) -> DataFrame:
    """Paragraph arrays less a first one, or two short ones, that say what the title says."""
    made = chapters.withColumn("_p", paragraphs(F.col("content"))).withColumn("dropped", title_paragraphs(F.col("_p"), F.col("title")))
    return made.select("book_id", "chapter_index", "dropped", F.slice("_p", F.col("dropped") + 1, F.size("_p")).alias("paragraphs"))


def shown_title(title: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.concat(F.lit("第"), index + 1, F.lit("章")))


def rendered_chapters(chapters: DataFrame) -> DataFrame:
    """``(book_id, chapter_index, title, rendered)``: what a reader sees of each chapter, paragraphs without blank lines and repeated titles."""
    named = chapters.select("book_id", "chapter_index", shown_title(F.col("title"), F.col("chapter_index")).alias("title"), paragraphs(F.coalesce("content", F.lit(""))).alias("_p"))
    shown = F.slice("_p", title_paragraphs(F.col("_p"), F.col("title")) + 1, F.greatest(F.size("_p"), F.lit(0)))
    return named.select("book_id", "chapter_index", "title", F.array_join(shown, "\n").alias("rendered"))


_BREAK = "\r\n?|[\n\\x{2028}\\x{2029}\\x{0085}]"


def rendered_pieces(chapters: DataFrame) -> DataFrame:
    """How raw places become rendered ones: ``(book_id, chapter_index, paragraph_index, raw_start, raw_end, start, end, text)``.

    A row for each paragraph that is shown: where its line stands in the raw content, without the white space at its ends, and where it stands in the rendered text.
    """
    titled = chapters.select("book_id", "chapter_index", shown_title(F.col("title"), F.col("chapter_index")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    raw = F.regexp_extract_all("content", F.lit(f"(?s)(.*?(?:{_BREAK})|.+\\z)"), F.lit(1))
    # Typography changes no line break, so the lines of both texts belong together in order.
    lines = F.arrays_zip(raw.alias("raw"), F.split(fix_typography(F.col("content")), _BREAK).alias("fixed"))
    counted = titled.withColumn("_p", paragraphs(F.col("content"))).withColumn("_dropped", title_paragraphs(F.col("_p"), F.col("title")))
    cut = counted.select("book_id", "chapter_index", "_dropped", F.posexplode(lines).alias("_line", "l")).where("l.raw is not null")
    own = Window.partitionBy("book_id", "chapter_index").orderBy("_line")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    lead = F.length(F.regexp_extract("l.raw", f"^{WS}*", 0))
    placed = cut.select("book_id", "chapter_index", "_dropped", "_line", strip(F.col("l.fixed")).alias("text"), (F.coalesce(F.sum(F.length("l.raw")).over(before), F.lit(0)) + lead).alias("raw_start"), F.length(strip(F.col("l.raw"))).alias("_n"))
    shown = placed.where("text <> ''").withColumn("paragraph_index", F.row_number().over(own) - 1 - F.col("_dropped")).where("paragraph_index >= 0")
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return shown.select("book_id", "chapter_index", "paragraph_index", "raw_start", (F.col("raw_start") + F.col("_n")).alias("raw_end"), start.alias("start"), (start + F.length("text")).alias("end"), "text")


def to_rendered(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """``points`` (book_id, chapter_index, offset) with ``rendered_offset``: their place in the rendered text, from one sort of both sides.

    Places in white space or in a line that is not shown go to the end of the paragraph before, or to the start; a place inside a
    paragraph that typography has shortened goes to its end at the latest.
    """
    marks = pieces.select("book_id", "chapter_index", F.col("raw_start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.struct("raw_start", "start", "end").alias("_piece"))
    rows = points.withColumn("_at", F.col("offset").cast("long")).withColumn("_kind", F.lit(1)).withColumn("_piece", F.lit(None).cast(marks.schema["_piece"].dataType))
    order = Window.partitionBy("book_id", "chapter_index").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(marks, allowMissingColumns=True).withColumn("_found", F.last("_piece", ignorenulls=True).over(order)).where("_kind = 1")
    inside = F.least(F.col("_found.end"), F.col("_found.start") + F.col("_at") - F.col("_found.raw_start"))
    return found.select(*points.columns, F.coalesce(inside, F.lit(0)).cast("long").alias("rendered_offset"))


_D = "[0-9０-９]"
_ENDS = f"(?:[!?。！？｡…]|(?<!{_D})[.．]|[.．](?!{_D}))+"
_HYPHEN = r"(?:(?<=-)-|-(?=-)|(?<=\s)-|-(?=\s))"


def _apart(c: str) -> str:
    return f"(?:(?<!{_D}){c}|{c}(?!{_D}))+"


_CLAUSES = "|".join([f"(?:[—–―－]|{_HYPHEN})+", _apart(","), _apart("，"), _apart(":"), _apart("："), "、+", ";+", "；+", r"\r+", r"\n+"])
_CLOSERS = "[\"'”’)\\]}）】》」』〕〗〉〙〛]*"
#: Up to a boundary with its closers and blanks, or the rest.
#: The possessive class in front skips what cannot start a boundary.
SENTENCE = f"(?s)([^!?。！？｡….．,，:：、;；—–―－\\-\\r\\n]*+.*?(?:{_ENDS}|{_CLAUSES}){_CLOSERS}(?:(?![\\r\\n]){WS})*|.+\\z)"


def split_sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Spans ``[start, end)`` of sentences and clauses; ``boundary_type`` is null for a rest without an end."""
    parts = df.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1))).alias("i", "s"))
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("s")).over(before), F.lit(0)).cast("long")
    bare = F.regexp_replace("s", f"(?:{WS}|[\"'”’)\\]}}）】》」』〕〗〉〙〛])+$", "")
    kind = F.when(bare.rlike("[.!?。！？｡．…]$") & F.col("s").rlike(f"{_ENDS}{_CLOSERS}{WS}*$"), "sentence").when(F.col("s").rlike(f"(?:{_CLAUSES}){_CLOSERS}{WS}*$"), "clause")
    return parts.withColumn("start", start).where(strip(F.col("s")) != "").select(*keys, "start", (F.col("start") + F.length("s")).alias("end"), kind.alias("boundary_type"))


CHUNK, OVERLAP, LEAST, FORWARD, BACKWARD = 512, 64, 20, 120, 180
_GUARD = max(20, int(CHUNK * 0.35))
_STOP = re.compile(r"\n|[!?;。！？；｡…⋯︙]|(?<![0-9])[.．﹒]|[.．﹒](?![0-9])")
_TAIL = re.compile(r"[\"')\]}）】」』》〉”’ \t\r.!?;。！？；｡．﹒…⋯︙]*(?:\n+)?")


def passage_ranges(text: str, lower: int, upper: int) -> list[tuple[int, int]]:
    """Overlapping passages of a chapter that end beyond ``lower``, up to ``upper``, at sentence ends where one is near."""
    upper = min(upper, len(text))
    stops = [m.start() for m in _STOP.finditer(text)] if upper > 0 else []
    end_of = lambda i: min(upper, _TAIL.match(text, stops[i] + 1, max(upper, stops[i] + 1)).end())
    out, at = [], 0
    while 0 <= at < upper:
        to = upper
        if upper - at > LEAST:
            hard = min(at + CHUNK, upper)
            low = min(upper, at + _GUARD)
            to = hard
            if hard > low:
                ahead = range(bisect_left(stops, max(at, hard - 1)), bisect_left(stops, min(upper, hard + FORWARD)))
                behind = range(bisect_right(stops, min(upper, hard) - 1) - 1, bisect_left(stops, max(low - 1, hard - BACKWARD)) - 1, -1)
                to = next((e for part in (ahead, behind) for i in part if (e := end_of(i)) > low), hard)
            if to - at < LEAST:
                to = upper
        if to > lower:
            out.append((at, to))
        if to >= upper:
            break
        at = max(to - OVERLAP, 0) if to - OVERLAP > at else at + CHUNK - OVERLAP
    return out


def chunk_chapters(chapters: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Passages ``(chunk_id, book_id, chapter_index, start_offset, end_offset, text)`` over sanitised chapters.

    ``bounds`` (book_id, min_offset, max_offset) restricts each book to passages that end beyond
    min_offset, within max_offset. Chapters are cut on their own, in parallel.
    """
    # One pass over the texts: each is cleaned once, and its place is a prefix sum of lengths by book.
    before = Window.partitionBy("book_id").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content")).over(before), F.lit(0)).cast("long")
    clean = chapters.select("book_id", "chapter_index", sanitize(F.col("content")).alias("content")).withColumn("clean_start", start)
    if bounds is None:
        bounded = clean.withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.lit(1 << 60).cast("long"))
    else:
        bounded = clean.join(bounds, "book_id").withColumnRenamed("min_offset", "lo").withColumnRenamed("max_offset", "hi")
    local = bounded.select("book_id", "chapter_index", "clean_start", (F.col("lo") - F.col("clean_start")).alias("lo"), (F.col("hi") - F.col("clean_start")).alias("hi"), "content").where("hi > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, a, z, text = [], [], [], []
            for i, (lo, hi, t) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "content")), strict=True)):
                for s, e in passage_ranges(t, max(lo, 0), hi):
                    if e - s >= LEAST:
                        which.append(i)
                        a.append(s)
                        z.append(e)
                        text.append(t[s:e])
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("book_id", "chapter_index", "clean_start")] + [pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(text, pa.string())], names=["book_id", "chapter_index", "clean_start", "s", "e", "text"])

    kinds = ", ".join(f"{c} {local.schema[c].dataType.simpleString()}" for c in ("book_id", "chapter_index", "clean_start"))
    made = local.mapInArrow(run, f"{kinds}, s long, e long, text string")
    return made.select(
        F.concat_ws("_", "book_id", F.concat(F.lit("ch"), "chapter_index"), "s").alias("chunk_id"), "book_id", "chapter_index", (F.col("clean_start") + F.col("s")).alias("start_offset"), (F.col("clean_start") + F.col("e")).alias("end_offset"), "text"
    )


_SPOKEN = (re.compile("[。！？!?.]"), re.compile("[，,；;：:、]"), re.compile("[ 　]"))


def _speech_cuts(text: str, size: int) -> list[str]:
    out = []
    while len(text) > round(size * 1.25):
        low, high = max(50, round(size * 0.1)), min(len(text), size + round(size * 0.1))
        cut = 0
        for kind, marks in enumerate(_SPOKEN):
            places = [m.end() for m in marks.finditer(text, low, high if kind < 2 else min(high, size + 1))]
            if places:
                cut = places[-1] if kind == 2 else next((p for p in places if p >= size * 0.8), places[-1])
                break
        cut = cut or size
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text else out


def chunk_paragraphs(pars: DataFrame, size: int = 2000) -> DataFrame:
    """One piece for each paragraph; those over 1.25 times ``size`` are cut at a sentence, clause or space."""
    keys = ["book_id", "chapter_index", "paragraph_index"]
    return per_text(pars, keys, "text", lambda t: [(i, s) for i, s in enumerate(_speech_cuts(t.strip(), size))], "piece int, text string")


def group_layout_lines(items: DataFrame) -> DataFrame:
    """``(page_id, item_id, x, baseline, font)``: items within 0.85 of the font height of the one before share a line."""
    order = Window.partitionBy("page_id").orderBy(F.desc("baseline"), "x", "item_id")
    new = F.coalesce((F.lag("baseline").over(order) - F.col("baseline") > F.col("font") * 0.85).cast("int"), F.lit(1))
    lined = items.withColumn("_n", new).withColumn("line", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_n")
    mid = lined.groupBy("page_id", "line").agg(F.expr("percentile_disc(0.5) within group (order by font)").alias("f"), F.expr("percentile_disc(0.5) within group (order by baseline)").alias("b"))
    met = lined.join(mid, ["page_id", "line"])
    small = F.col("font") < F.col("f") * 0.85
    role = F.when(small & (F.col("baseline") > F.col("b") + F.col("f") * 0.15), "sup").when(small & (F.col("baseline") < F.col("b") - F.col("f") * 0.1), "sub").otherwise("base")
    return met.select("page_id", "item_id", "line", role.alias("role"))


# ---- HTML ----------------------------------------------------------------------------------------

_DROP = r"(?is)<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->|<!doctype[^>]*>"
#: Tags that stand for a line break.
_BLOCK = r"(?i)</?(?:article|aside|blockquote|dd|div|dl|dt|figcaption|figure|footer|h[1-6]|header|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>|<br\b[^>]*>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _entities(c: Column) -> Column:
    for name, value in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def _plain(html: Column) -> Column:
    broken = F.regexp_replace(F.regexp_replace(html, r"\s+", " "), _BLOCK, "\n")
    return _entities(F.regexp_replace(broken, r"<[^>]*>", ""))


def html_to_text(df: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    return df.select(*keys, normalize_block(_plain(F.regexp_replace(F.coalesce(html, F.lit("")), _DROP, " "))).alias("text"))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, r"(?i)\s" + name + r"""\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return F.nullif(strip(F.regexp_replace(found, r"""^["']|["']$""", "")), F.lit(""))


def _pixels(tag: Column, name: str) -> Column:
    own = F.coalesce(_attribute(tag, name), F.nullif(F.regexp_extract(_attribute(tag, "style"), r"(?i)(?:^|;)\s*" + name + r"\s*:\s*([^;]+)", 1), F.lit("")))
    n = F.regexp_extract(own, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:px)?\s*$", 1).try_cast("double")
    return F.when(n > 0, F.round(n).cast("int"))


def html_to_blocks(df: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Text and image blocks in order, without a shuffle: the page is cut at its images."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), _DROP, " ")
    image = r"(?i)<(?:img|image)\b[^>]*>"
    made = df.select(*keys, F.split(body, image).alias("_t"), F.regexp_extract_all(body, F.lit(image), F.lit(0)).alias("_i"))
    none = F.lit(None).cast("string")
    text = F.transform("_t", lambda t: F.struct(F.lit("text").alias("type"), normalize_block(_plain(t)).alias("text"), none.alias("tag")))
    img = F.transform("_i", lambda t: F.struct(F.lit("image").alias("type"), none.alias("text"), t.alias("tag")))
    both = F.flatten(F.zip_with(text, img, lambda a, b: F.filter(F.array(a, b), lambda x: x.isNotNull())))
    rows = made.select(*keys, F.posexplode(F.filter(both, lambda b: (b["type"] == "image") | (b["text"] != ""))).alias("block_index", "b"))
    tag = F.col("b.tag")
    src = F.coalesce(*[_attribute(tag, a) for a in ("src", "data-src", "data-original", "href", "xlink:href")])
    return rows.select(*keys, "block_index", "b.type", "b.text", src.alias("image_ref"), _attribute(tag, "alt").alias("alt"), _attribute(tag, "title").alias("title"), _pixels(tag, "width").alias("width"), _pixels(tag, "height").alias("height")).where("type = 'text' or image_ref is not null")


# ---- spoken chapters ------------------------------------------------------------------------------


def cue_times(cues: DataFrame) -> DataFrame:
    """Start and end second of each cue from the durations before it."""
    before = Window.partitionBy("book_id").orderBy("cue_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("duration").over(before), F.lit(0.0))
    return cues.withColumn("start_s", start).withColumn("end_s", F.col("start_s") + F.col("duration"))


def _stamp(seconds: Column) -> Column:
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(F.floor(ms / 3_600_000)), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def build_srt(cues: DataFrame) -> DataFrame:
    """A subtitle entry for each cue with text, under its own number."""
    timed = cue_times(cues).where(strip(F.coalesce("text", F.lit(""))) != "")
    entry = F.concat((F.col("cue_index") + 1).cast("string"), F.lit("\n"), _stamp(F.col("start_s")), F.lit(" --> "), _stamp(F.col("end_s")), F.lit("\n"), strip(F.col("text")))
    return timed.select("book_id", "cue_index", entry.alias("entry"))


def order_cached_chunks(cache: DataFrame, chapters: DataFrame) -> DataFrame:
    """Cached pieces in the order of their text in the chapter; the title first, unknown ones last."""
    met = cache.join(chapters.select("book_id", "chapter_index", "title", "content"), ["book_id", "chapter_index"])
    at = F.instr("content", F.col("chunk_text")) - 1
    kind = F.when(compact(F.col("chunk_text")) == compact(F.col("title")), 0).when(at >= 0, 1).otherwise(2)
    order = Window.partitionBy("book_id", "chapter_index").orderBy(kind, at, "created_at", "chunk_text")
    return met.select(*cache.columns, F.row_number().over(order).alias("rank"))


def cached_paragraphs(chunks: DataFrame, cache: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Paragraphs with a cached chunk of their text; with ``titles`` (book_id, chapter_index, title) a chapter's cached title counts as paragraph -1.

    Chapters without any chunk have no title either.
    """
    # Texts meet by their digest, so that none is shuffled.
    keys = ["book_id", "chapter_index", "text"]
    digest = lambda text: F.sha2(text.cast("binary"), 256).alias("text")
    stored = cache.select("book_id", "chapter_index", digest(F.col("chunk_text")))
    every = chunks.select(*keys[:2], digest(F.col("text")), "paragraph_index")
    if titles is not None:
        read = titles.join(chunks.select("book_id", "chapter_index").distinct(), ["book_id", "chapter_index"], "left_semi")
        every = every.unionByName(read.where(strip(F.col("title")) != "").select(*keys[:2], digest(strip(F.col("title"))), F.lit(-1).cast(chunks.schema["paragraph_index"].dataType).alias("paragraph_index")))
    return every.join(stored, keys, "left_semi").select("book_id", "chapter_index", "paragraph_index").distinct()


# ---- excerpts and quotes --------------------------------------------------------------------------


def _as_of(points: DataFrame, at: str, marks: DataFrame, mark: str, name: str, forward: bool = False) -> DataFrame:
    """The last mark at or before (or the first at or after) a place, by book, from one sort of both."""
    m = marks.select("book_id", F.col(mark).alias("_at"), F.col(mark).alias("_m"), F.lit(0).alias("_k")).distinct()
    p = points.withColumn("_at", F.col(at)).withColumn("_m", F.lit(None).cast("long")).withColumn("_k", F.lit(1))
    order = Window.partitionBy("book_id").orderBy("_at")
    found = F.first("_m", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing)) if forward else F.last("_m", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    return p.unionByName(m, allowMissingColumns=True).withColumn(name, found).where("_k = 1").select(*points.columns, name)


def reading_excerpt(positions: DataFrame, books: DataFrame, n: int = 800) -> DataFrame:
    """``(book_id, position_id, position)`` -> the text up to the last whole sentence, about n characters, from a sentence's start.

    Positions before or beyond the text count as its start or end; unknown books and null texts have an empty excerpt at 0.
    """
    # Only books with a position are read.
    books = books.join(positions.select("book_id").distinct(), "book_id", "left_semi")
    spans = split_sentences(books.select("book_id", F.col("full_text").alias("text")), ["book_id"])
    done = spans.where("boundary_type is not null")
    known = positions.join(books.select("book_id", F.coalesce(F.length("full_text"), F.lit(0)).alias("_n")), "book_id", "left")
    inside = F.greatest(F.lit(0), F.least(F.col("position"), F.coalesce("_n", F.lit(0)))).cast("long")
    positions = known.select("book_id", "position_id", inside.alias("position"))
    p = _as_of(positions, "position", done, "end", "_end").withColumn("_end", F.coalesce("_end", "position"))
    p = p.withColumn("_raw", F.greatest(F.lit(0), F.col("_end") - n))
    p = _as_of(_as_of(p, "_raw", spans, "end", "_prev"), "_raw", spans, "start", "_next", forward=True)
    least = max(80, round(n * 0.45))
    start = F.when(F.col("_raw") <= 0, 0).when(F.col("_next").isNull() | (F.col("_next") >= F.col("_end")) | (F.col("_end") - F.col("_next") < least), F.coalesce("_prev", "_raw")).otherwise(F.col("_next"))
    placed = p.withColumn("start", start.cast("long"))
    text = F.col("full_text").substr(F.col("start").cast("int") + 1, (F.col("_end") - F.col("start")).cast("int"))
    met = placed.join(books.select("book_id", "full_text"), "book_id", "left")
    return met.select("book_id", "position_id", "start", F.col("_end").alias("end"), F.coalesce(text, F.lit("")).alias("excerpt"))


def locate_quote(excerpt: Column, quote: Column) -> Column:
    """Struct of start and end of the quote's last place in the excerpt, white space aside; null if it has none."""
    needle, bare = F.regexp_replace(quote, f"{WS}+", ""), F.regexp_replace(excerpt, f"{WS}+", "")
    back = F.instr(F.reverse(bare), F.reverse(needle))
    first = F.length(bare) - (back - 1) - F.length(needle)  # how many characters that are not blank come before
    places = F.filter(F.transform(F.split(excerpt, ""), lambda c, i: F.when(~c.rlike(f"^{WS}$"), i)), lambda i: i.isNotNull())
    return F.when((needle != "") & (back > 0), F.struct(F.get(places, first).alias("start"), (F.get(places, first + F.length(needle) - 1) + 1).alias("end")))


# Signs that hint at mathematics, each with its LaTeX; those that suffice alone; what may stand between.
_LATEX = r"""
α \alpha β \beta γ \gamma δ \delta ε \varepsilon ζ \zeta η \eta θ \theta ι \iota κ \kappa λ \lambda μ \mu ν \nu ξ \xi π \pi ρ \rho
σ \sigma ς \varsigma τ \tau υ \upsilon φ \varphi χ \chi ψ \psi ω \omega ϵ \epsilon ϑ \vartheta ϕ \phi ϱ \varrho ϖ \varpi
Γ \Gamma Δ \Delta Θ \Theta Λ \Lambda Ξ \Xi Π \Pi Σ \Sigma Υ \Upsilon Φ \Phi Ψ \Psi Ω \Omega
± \pm ∓ \mp × \times ÷ \div · \cdot ∘ \circ ∙ \bullet ⊕ \oplus ⊗ \otimes ⊖ \ominus ⊙ \odot ∧ \wedge ∨ \vee ∩ \cap ∪ \cup
⊓ \sqcap ⊔ \sqcup ⋆ \star ⋄ \diamond † \dagger ‡ \ddagger
∑ \sum ∏ \prod ∐ \coprod ∫ \int ∬ \iint ∭ \iiint ∮ \oint ⋂ \bigcap ⋃ \bigcup ⨁ \bigoplus ⨂ \bigotimes
≤ \leq ≥ \geq ≠ \neq ≈ \approx ≡ \equiv ∼ \sim ≃ \simeq ≅ \cong ≺ \prec ≻ \succ ⪯ \preceq ⪰ \succeq
⊂ \subset ⊃ \supset ⊆ \subseteq ⊇ \supseteq ⊊ \subsetneq ⊋ \supsetneq ∈ \in ∉ \notin ∋ \ni
∝ \propto ∥ \parallel ∦ \nparallel ⊥ \perp ≪ \ll ≫ \gg ⟂ \perp ⊢ \vdash ⊨ \models
→ \to ← \leftarrow ↔ \leftrightarrow ⇒ \Rightarrow ⇐ \Leftarrow ⇔ \Leftrightarrow ↦ \mapsto ↑ \uparrow ↓ \downarrow
⇑ \Uparrow ⇓ \Downarrow ⟶ \longrightarrow ⟵ \longleftarrow ⟷ \longleftrightarrow ⟹ \Longrightarrow ⟸ \Longleftarrow
∞ \infty ∂ \partial ∇ \nabla ∀ \forall ∃ \exists ∄ \nexists ∅ \emptyset ∎ \blacksquare □ \square ¬ \neg ℵ \aleph ℓ \ell ℘ \wp
⋯ \cdots ⋮ \vdots ⋱ \ddots ℕ \mathbb{N} ℤ \mathbb{Z} ℚ \mathbb{Q} ℝ \mathbb{R} ℂ \mathbb{C} ℍ \mathbb{H} ℙ \mathbb{P} ℑ \Im ℜ \Re
′ ' ″ '' ‴ ''' ⁗ '''' − -
""".split()
_STRONG = set("⊂⊃⊆⊇⊊⊋∈∉∋∀∃∄∑∏∫∬∭∮∪∩⋂⋃→←↔⇒⇐⇔↦⟶⟵⟹⟸≤≥≠≈≡∼≃≅≪≫∞∂∇∅∝⊥∥ℕℤℚℝℂℍℙ±∓⊕⊗⊖⊙")
_BETWEEN, _AFTER, _FORMULA = r"[A-Za-z0-9 ()\[\]{}.,;:+\-*/=<>|!&^_\\'\"]", r"[.,;:)\]}!?]", r"\\^_{}=+\-*/<>"

_TO_LATEX = dict(zip(_LATEX[::2], _LATEX[1::2], strict=True))
_HINT = "[" + "".join(_TO_LATEX) + "]"
_BARE = re.compile(f"{_HINT}+(?:{_BETWEEN}{{1,4}}{_HINT}+)*{_AFTER}*")
_OPENING = re.compile(r"(\\*)(\$\$?)|\\+([\[(])")
#: Opening mark -> the whole region from there, its content as group 1.
_REGION = {
    "$$": re.compile(r"(?s)\$\$(?!\s*\$\$)((?:[^$\\]|\\.|\$(?!\$))++)\$\$"),
    "$": re.compile(rf"(?s)\$(?=\S)(?=(?:(?!\n\n)[^${_FORMULA}])*[{_FORMULA}])((?:(?!\n\n)[^$\\]|\\(?!\n\n).)++)(?<!\s)\$"),
    "[": re.compile(r"(?s)\\\[(?!\s*\\\])(.+?)\\\]"),
    "(": re.compile(r"(?s)\\\((?!\s*\\\))(.+?)\\\)"),
}
_CLOSING = {"$$": "$$", "$": "$", "[": "\\]", "(": "\\)"}


def _delimited(text: str) -> list[tuple[int, int, str, bool]]:
    """Formulas between marks: start, end, content, whether displayed. A mark after an odd number of backslashes is none."""
    final = {k: text.rfind(c) for k, c in _CLOSING.items()}
    out, at = [], 0
    while m := _OPENING.search(text, at):
        mark = m[2] or m[3]
        start = m.start(2) if m[2] else m.end() - 2
        if m[2] and len(m[1]) % 2:
            at = start + 1
        elif final[mark] > start and (found := _REGION[mark].match(text, start)):
            out.append((start, found.end(), found[1], mark in ("$$", "[")))
            at = found.end()
        else:
            at = start + (1 if m[2] else 2)
    return out


def _latex(run: str) -> str:
    """Signs as commands, parted from a letter that follows."""
    return re.sub(r"(\\[A-Za-z]+)\x00(?=([A-Za-z])?)", lambda m: m[1] + " " * bool(m[2]), "".join(f"{_TO_LATEX[c]}\x00" if c in _TO_LATEX else c for c in run)).replace("\x00", "")


def math_spans(text: str | None) -> list[tuple[int, int, str, bool]]:
    """Formulas in order: those between marks, and runs of bare mathematical signs that meet none of them.

    A run counts with one sign that suffices alone, or two hints. Null and empty texts have none.
    """
    text = text or ""
    marked = _delimited(text) if "$" in text or "\\" in text else []
    starts = [m[0] for m in marked]
    out = list(marked)
    for m in _BARE.finditer(text):
        if _STRONG.isdisjoint(m[0]) and sum(c in _TO_LATEX for c in m[0]) < 2:
            continue
        before = bisect_left(starts, m.end()) - 1  # the last formula that starts before the run's end
        if before < 0 or marked[before][1] <= m.start():
            out.append((m.start(), m.end(), _latex(m[0]), False))
    return sorted(out)


def math_regions(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``start``, ``end``, ``content`` and ``display`` of each formula in the column ``text``; code points, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *r) for i, t in enumerate(b.column("text").to_pylist()) for r in math_spans(t)]
            which, start, end, content, display = zip(*found, strict=True) if found else [()] * 5
            kept = [b.column(k).take(pa.array(which, pa.int64())) for k in keys]
            made = [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(content, pa.string()), pa.array(display, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keys, "start", "end", "content", "display"])

    df = texts.select(*keys, "text")
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.mapInArrow(run, f"{kinds}start long, end long, content string, display boolean")


def math_coverage(texts: DataFrame, keys: list[str]) -> DataFrame:
    """How many formulas each text has, and how many characters they take; ``keys`` tell rows apart."""
    found = math_regions(texts, keys).groupBy(*keys).agg(F.count("*").alias("regions"), F.sum(F.col("end") - F.col("start")).alias("characters"))
    return texts.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("characters", F.lit(0)).alias("characters"))
