"""Text offsets and ranges: chapter starts, positions, overlaps, merges and strokes.

Ranges are half-open ``[start, end)``. Range joins always have an equality: the book (and
chapter), and for long books a bucket of BUCKET characters, so no plan is a cross product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import paragraphs, sanitize, strip

#: Characters in a bucket of range joins.
BUCKET = 8192

#: Characters of a piece of text that highlights meet.
PIECE = 256


def chapter_offsets(chapters: DataFrame) -> DataFrame:
    """Start and end of each chapter in its book, raw and after ``sanitize``, and the book's totals."""
    order = Window.partitionBy("book_id").orderBy("chapter_index")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("book_id")
    sized = chapters.select("book_id", "chapter_index", F.length("content").alias("raw_length"), F.length(sanitize(F.col("content"))).alias("clean_length"))
    out = sized
    for kind in ("raw", "clean"):
        n = F.col(f"{kind}_length").cast("long")
        out = out.withColumn(f"{kind}_start", F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn(f"{kind}_end", F.col(f"{kind}_start") + n)
        out = out.withColumn(f"{kind}_total", F.sum(n).over(whole))
    return out


def _buckets(start: Column, end: Column) -> Column:
    last = F.greatest(start, end - 1)
    return F.explode(F.sequence(F.floor(start / BUCKET), F.floor(last / BUCKET)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of equal ``keys`` whose ranges overlap, once each; right columns end in ``_r``.

    Pairs are made in the bucket where their overlap begins, so none comes twice. Empty ranges overlap nothing.
    """
    right = right.select(*[F.col(c).alias(c if c in keys else f"{c}_r") for c in right.columns])
    a = left.where("start < end").withColumn("_bucket", _buckets(F.col("start"), F.col("end")))
    b = right.where("start_r < end_r").withColumn("_bucket", _buckets(F.col("start_r"), F.col("end_r")))
    met = a.join(b, [*keys, "_bucket"]).where("start < end_r and start_r < end")
    return met.where(F.floor(F.greatest("start", "start_r") / BUCKET) == F.col("_bucket")).drop("_bucket")


def locate_chapter(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """The first chapter that ends at or after a global offset; the last one beyond the end.

    ``points`` have book_id and global_char_offset. As chapters lie end to end, an as-of join is
    one sort of both sides together by book: the next chapter end from a point on is its own.
    """
    marks = offsets.select("book_id", F.col("raw_end").alias("_at"), F.lit(1).alias("_kind"), F.struct(F.col("chapter_index"), F.col("raw_start")).alias("_chapter"))
    rows = points.withColumn("_at", F.col("global_char_offset")).withColumn("_kind", F.lit(0)).withColumn("_chapter", F.lit(None).cast(marks.schema["_chapter"].dataType))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # Of chapters with one end, the first by index counts; of none after the point, the last before it.
    after = Window.partitionBy("book_id").orderBy("_at", "_kind", "_chapter.chapter_index").rowsBetween(0, Window.unboundedFollowing)
    before = Window.partitionBy("book_id").orderBy("_at", "_kind", "_chapter.chapter_index").rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.first("_chapter", ignorenulls=True).over(after), F.last("_chapter", ignorenulls=True).over(before))
    out = both.withColumn("_found", found).where("_kind = 0")
    return out.select(*points.columns, F.col("_found.chapter_index").alias("chapter_index"), F.greatest(F.lit(0), F.col("global_char_offset") - F.col("_found.raw_start")).alias("chapter_char_offset"))


def split_ranges_by_chapter(ranges: DataFrame, offsets: DataFrame) -> DataFrame:
    """Global ranges as distinct local ranges of each chapter that they touch."""
    spans = offsets.select("book_id", "chapter_index", F.col("raw_start").alias("start"), F.col("raw_end").alias("end"))
    met = overlap_join(ranges.select("book_id", "start", "end"), spans, ["book_id"])
    return met.select(
        "book_id",
        F.col("chapter_index_r").alias("chapter_index"),
        (F.greatest("start", "start_r") - F.col("start_r")).alias("start"),
        (F.least("end", "end_r") - F.col("start_r")).alias("end"),
    ).distinct()


def annotate_segments(paragraphs: DataFrame, highlights: DataFrame, underlines: DataFrame | None = None, math: DataFrame | None = None) -> DataFrame:
    """Paragraphs cut at the borders of ranges: segments with the colour of the last highlight that covers them.

    ``underlines`` (book_id, chapter_key, start, end) add cuts and the column ``underlined``. ``math`` (book_id,
    chapter_key, paragraph_index, start, end, content, display; places in the paragraph, none over another) adds
    segments with ``math`` (its content) and ``display``: those stay whole and bear neither colour nor underline.
    """
    keys = ["book_id", "chapter_key", "paragraph_index"]
    ranges = highlights.select("book_id", "chapter_key", "start", "end", "color", "range_id", F.lit(False).alias("under"))
    if underlines is not None:
        ranges = ranges.unionByName(underlines.select("book_id", "chapter_key", "start", "end", F.lit(True).alias("under")), allowMissingColumns=True)
    met = overlap_join(paragraphs.select(*keys, "start", "end"), ranges, keys[:2])
    cover = met.select(*keys, F.greatest("start", "start_r").alias("from_"), F.least("end", "end_r").alias("to_"), F.col("color_r").alias("color"), F.col("range_id_r").alias("range_id"), F.col("under_r").alias("under"))
    cuts = paragraphs.select(*keys, F.explode(F.array("start", "end")).alias("at")).union(cover.select(*keys, F.explode(F.array("from_", "to_")).alias("at")))
    if math is not None:
        local = math.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"), F.col("content").alias("math"), "display")
        placed = paragraphs.join(local, keys).select(*keys, F.greatest("start", F.col("start") + F.col("s")).alias("m_from"), F.least("end", F.col("start") + F.col("e")).alias("m_to"), "math", "display").where("m_from < m_to")
        inner = placed.select(*[F.col(k).alias(f"_{k}") for k in keys], "m_from", "m_to")
        apart = cuts.join(inner, [*(F.col(k) == F.col(f"_{k}") for k in keys), F.col("at") > F.col("m_from"), F.col("at") < F.col("m_to")], "left_anti")
        cuts = apart.union(placed.select(*keys, F.explode(F.array("m_from", "m_to")).alias("at")))
    pieces = cuts.distinct().withColumn("until", F.lead("at").over(Window.partitionBy(*keys).orderBy("at"))).where("until > at")
    inside = (F.col("from_") <= F.col("at")) & (F.col("to_") >= F.col("until"))
    last = F.max(F.when(inside & ~F.col("under"), F.struct("range_id", "color")))["color"]
    lined = F.coalesce(F.max(inside & F.col("under")), F.lit(False))
    out = pieces.join(cover, keys, "left").groupBy(*keys, "at", "until").agg(last.alias("color"), lined.alias("underlined"))
    shown = ["color"] + ["underlined"] * (underlines is not None)
    if math is not None:
        starts = placed.select(*keys, F.col("m_from").alias("at"), "math", "display")
        plain = F.col("math").isNull()
        out = out.join(starts, [*keys, "at"], "left").withColumn("color", F.when(plain, F.col("color"))).withColumn("underlined", plain & F.col("underlined"))
        shown += ["math", "display"]
    return out.select(*keys, F.col("at").alias("start"), F.col("until").alias("end"), *shown)


def excerpt_highlights(highlights: DataFrame, excerpts: DataFrame, limit: int = 12) -> DataFrame:
    """Distinct highlight ranges clipped to each excerpt's window, the first ``limit`` by start."""
    met = overlap_join(highlights.select("book_id", "chapter_key", "start", "end"), excerpts, ["book_id", "chapter_key"])
    clipped = met.select("book_id", "chapter_key", F.col("excerpt_id_r").alias("excerpt_id"), F.greatest("start", "start_r").alias("start"), F.least("end", "end_r").alias("end")).distinct()
    rank = F.row_number().over(Window.partitionBy("excerpt_id").orderBy("start", "end"))
    return clipped.withColumn("rank", rank).where(F.col("rank") <= limit)


def nearest_bookmark(targets: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """The bookmark with the least distance to each target of its book; the earliest of equals."""
    marks = bookmarks.select("book_id", "bookmark_id", F.col("global_char_offset").alias("mark"), "created_at")
    # Only the marks next to a target can be nearest: one merge pass by book, no pairs.
    m = marks.select("book_id", F.col("mark").alias("at"), F.struct("mark", "created_at", "bookmark_id").alias("m"), F.lit(None).cast("long").alias("target_id"))
    first = m.groupBy("book_id", "at").agg(F.min("m").alias("m"), F.lit(None).cast("long").alias("target_id"))
    t = targets.select("book_id", F.col("offset").alias("at"), F.lit(None).cast(first.schema["m"].dataType).alias("m"), "target_id")
    both = first.select("book_id", "at", "m", "target_id").unionByName(t)
    order = Window.partitionBy("book_id").orderBy("at")
    low = F.last("m", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    high = F.first("m", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    sides = both.withColumn("low", low).withColumn("high", high).where("target_id is not null")
    gap = lambda c: F.abs(F.col(f"{c}.mark") - F.col("at"))
    take_low = F.col("high").isNull() | (gap("low") <= gap("high"))
    best = F.when(F.col("low").isNull(), F.col("high")).when(take_low, F.col("low")).otherwise(F.col("high"))
    return sides.withColumn("best", best).where("best is not null").select("book_id", "target_id", F.col("best.bookmark_id").alias("bookmark_id"), F.abs(F.col("best.mark") - F.col("at")).alias("gap"))


def sort_bookmarks(bookmarks: DataFrame) -> DataFrame:
    order = Window.partitionBy("book_id").orderBy("global_char_offset", "created_at", "bookmark_id")
    return bookmarks.withColumn("rank", F.row_number().over(order))


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Join each range to its predecessor if it has its colour and they touch; others stand between."""
    order = Window.partitionBy(*keys).orderBy("start", "end", "color")
    good = ranges.where("end > start").select(*keys, "start", "end", "color")
    runs = good.withColumn("_new", (~F.lag("color").over(order).eqNullSafe(F.col("color"))).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_run").orderBy("start", "end")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    cut = runs.withColumn("_gap", F.coalesce((reach < F.col("start")).cast("int"), F.lit(1)))
    named = cut.withColumn("_island", F.sum("_gap").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*keys, "_run", "_island", "color").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end", "color")


def filter_highlights(h: DataFrame, books: list | None = None, color: str | None = None, chapter: str | None = None) -> DataFrame:
    out = h.where("end > start")
    for name, value in (("color", color), ("chapter_key", chapter)):
        out = out.where(F.col(name) == value) if value is not None else out
    return out.where(F.col("book_id").isin(books)) if books is not None else out


def used_colors(h: DataFrame) -> DataFrame:
    return h.where("end > start").groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_set("color")), ",").alias("colors"))


def count_highlights(h: DataFrame) -> DataFrame:
    return h.where("end > start").groupBy("book_id").agg(F.count("*").alias("highlights"))


def safe_offset(positions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Raw positions as offsets in sanitised text: by the chapter's ratio, else the book's, else clamped."""
    here = positions.join(offsets, ["book_id", "chapter_index"], "left")
    ratio = F.round(F.least(F.lit(1.0), F.col("chapter_char_offset") / F.col("raw_length")) * F.col("clean_length"))
    inside = F.col("clean_start") + F.when(F.col("raw_length") > 0, ratio).otherwise(0)
    books = offsets.groupBy("book_id").agg(F.max("raw_total").alias("_raw"), F.max("clean_total").alias("_clean"))
    whole = F.when(F.col("_raw") > 0, F.round(F.least(F.lit(1.0), F.col("global_char_offset") / F.col("_raw")) * F.col("_clean")))
    out = here.join(books, "book_id", "left")
    return out.select(*positions.columns, F.coalesce(inside, whole, F.greatest(F.lit(0), F.col("global_char_offset"))).cast("long").alias("safe_offset"))


def _chapter_of(key: str) -> Column:
    """The chapter's index in a key; null for other keys."""
    return F.expr(f"try_cast(regexp_extract({key}, '^chapter-([0-9]+)$', 1) as int)")


def highlight_position(highlights: DataFrame, offsets: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Where a highlight starts: ``global_offset`` in its book, and ``ratio``, its share of the chapter.

    Highlights of the whole text (key ``full``) need ``books`` (book_id, full_text_length); their ratio is of that.
    """
    o = offsets.select("book_id", "chapter_index", "raw_start", "raw_length")
    at, n = F.col("start"), F.col("raw_length")
    keyed = highlights.withColumn("chapter_index", _chapter_of("chapter_key"))
    share = lambda size: F.when(size > 0, at / size).otherwise(0.0).alias("ratio")
    out = keyed.join(o, ["book_id", "chapter_index"]).select(*highlights.columns, (F.col("raw_start") + at).alias("global_offset"), share(n))
    if books is None:
        return out
    whole = highlights.where("chapter_key = 'full'").join(books.select("book_id", "full_text_length"), "book_id")
    return out.unionByName(whole.select(*highlights.columns, at.cast("long").alias("global_offset"), share(F.col("full_text_length"))))


def resolve_highlights(highlights: DataFrame, chapters: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """The text that is shown under each highlight, with its chapter's title; blank ones go, and those of chapters that are not there.

    Places count in the rendered text (``segments.rendered_chapters``) and are clamped to it. Highlights of the whole text
    (key ``full``) need ``books`` (book_id, full_text).
    """
    from folio.operators.segments import rendered_chapters

    keyed = highlights.withColumn("_chapter", _chapter_of("chapter_key"))
    wanted = keyed.where("_chapter is not null").select("book_id", F.col("_chapter").alias("chapter_index")).distinct()
    c = rendered_chapters(chapters.join(wanted, ["book_id", "chapter_index"], "left_semi")).select("book_id", F.col("chapter_index").cast("int").alias("_chapter"), F.col("title").alias("_title"), "rendered")
    if books is not None:
        # The whole text is chapter -1.
        keyed = keyed.withColumn("_chapter", F.when(F.col("chapter_key") == "full", -1).otherwise(F.col("_chapter")))
        read = books.join(keyed.where("_chapter = -1").select("book_id").distinct(), "book_id", "left_semi")
        c = c.unionByName(read.select("book_id", F.lit(-1).alias("_chapter"), F.lit("全文").alias("_title"), F.array_join(paragraphs(F.coalesce("full_text", F.lit(""))), "\n").alias("rendered")))
    at = F.greatest("start", F.lit(0))
    n = F.greatest(F.coalesce("end", F.lit(1 << 40)) - at, F.lit(0))
    # A short highlight meets the one piece that it starts in, with what follows it, not a copy of its whole chapter.
    begin = lambda i: (i * PIECE + 1).cast("int")
    pieces = c.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.length("rendered") / PIECE))))
    pieces = pieces.select("book_id", "_chapter", "_title", "_piece", F.col("rendered").substr(begin(F.col("_piece")), F.lit(2 * PIECE)).alias("_text"))
    short = keyed.where(n <= PIECE).withColumn("_piece", F.floor(at / PIECE)).join(pieces, ["book_id", "_chapter", "_piece"])
    long = keyed.where(n > PIECE).join(c.withColumnRenamed("rendered", "_text"), ["book_id", "_chapter"]).withColumn("_piece", F.lit(0).cast("long"))
    text = F.col("_text").substr(F.least(at - F.col("_piece") * PIECE, F.length("_text")).cast("int") + 1, F.least(n, F.length("_text")).cast("int"))
    met = short.select(*highlights.columns, "_title", text.alias("text")).unionByName(long.select(*highlights.columns, "_title", text.alias("text")))
    return met.select(*highlights.columns, F.col("_title").alias("title"), "text").where(strip(F.col("text")) != "")


def merge_regions(explicit: DataFrame, implicit: DataFrame, keys: list[str]) -> DataFrame:
    """All explicit ranges, and the implicit ones that overlap none of them."""
    marked = implicit.withColumn("_id", F.xxhash64(*keys, "start", "end"))
    hit = overlap_join(marked, explicit.select(*keys, "start", "end"), keys).select("_id").distinct()
    return explicit.unionByName(marked.join(hit, "_id", "left_anti").drop("_id"))
