"""Queries over chapters, positions and highlights."""

from pyspark.sql import functions as F

from folio.operators import intervals as I
from folio.operators import strokes
from folio.plans.registry import query

_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(content, '\s+\n', chr(10), 'g'), '\n\s+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"
_OFFSETS = f"""offsets as (
    select book_id, chapter_index, cast(rl as bigint) as raw_length, cast(cl as bigint) as clean_length,
           cast(coalesce(sum(rl) over b, 0) as bigint) as raw_start, cast(coalesce(sum(rl) over b, 0) + rl as bigint) as raw_end, cast(sum(rl) over (partition by book_id) as bigint) as raw_total,
           cast(coalesce(sum(cl) over b, 0) as bigint) as clean_start, cast(coalesce(sum(cl) over b, 0) + cl as bigint) as clean_end, cast(sum(cl) over (partition by book_id) as bigint) as clean_total
    from (select book_id, chapter_index, length(content) as rl, length({_CLEAN}) as cl from {{chapters}})
    window b as (partition by book_id order by chapter_index rows between unbounded preceding and 1 preceding))"""
_ALL = "book_id, chapter_index, raw_length, clean_length, raw_start, raw_end, raw_total, clean_start, clean_end, clean_total"


def _offsets(t):
    return I.chapter_offsets(t.chapters)


def _longs(df):
    return df.select(*[F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes])


@query("chapter_offsets", f"with {_OFFSETS} select {_ALL} from offsets")
def chapter_offsets(t):
    return _longs(_offsets(t)).select(*_ALL.split(", "))


_LOCATED = f"""{_OFFSETS}, ends as (select book_id, max(chapter_index) as last_index from offsets group by 1), located as (
    select p.*, coalesce(min(o.chapter_index), any_value(e.last_index)) as ci from {{positions}} p left join ends e on e.book_id = p.book_id
    left join offsets o on o.book_id = p.book_id and p.global_char_offset <= o.raw_end group by all)"""


@query(
    "locate_chapter",
    f"""with {_LOCATED} select l.user_id, l.book_id, l.event_id, l.global_char_offset, l.ci as chapter_index, greatest(0, l.global_char_offset - o.raw_start) as chapter_char_offset
        from located l left join offsets o on o.book_id = l.book_id and o.chapter_index = l.ci""",
)
def locate_chapter(t):
    """Positions in unknown books have no chapter."""
    return _longs(I.locate_chapter(t.positions, _offsets(t)))


@query(
    "safe_offset",
    f"""with {_LOCATED} select l.event_id, l.book_id, cast(case when o.book_id is null then greatest(0, l.global_char_offset) else o.clean_start + case when o.raw_length > 0 then
          round(least(1.0, greatest(0, l.global_char_offset - o.raw_start) / o.raw_length) * o.clean_length) else 0 end end as bigint) as safe_offset
        from located l left join offsets o on o.book_id = l.book_id and o.chapter_index = l.ci""",
)
def safe_offset(t):
    offsets = _offsets(t)
    return I.safe_offset(I.locate_chapter(t.positions, offsets), offsets).select("event_id", "book_id", "safe_offset")


@query(
    "split_ranges_by_chapter",
    f"""with {_OFFSETS} select distinct h.book_id, chapter_index, greatest(h.start, raw_start) - raw_start as start, least(h."end", raw_end) - raw_start as "end"
        from {{highlights}} h join offsets o on o.book_id = h.book_id and h.start < raw_end and h."end" > raw_start and h."end" > h.start and raw_end > raw_start""",
)
def split_ranges_by_chapter(t):
    return _longs(I.split_ranges_by_chapter(t.highlights, _offsets(t)))


_PARAGRAPHS = """paragraphs as (
    select book_id, 'chapter-' || chapter_index as chapter_key, n as paragraph_index, cast(s as bigint) as start, cast(s + len(p) as bigint) as "end"
    from (select book_id, chapter_index, unnest(ps) as p, unnest(range(len(ps))) as n, unnest(list_transform(range(len(ps)), lambda k: list_sum(list_transform(ps[1:k], lambda q: len(q) + 1)))) as s0, 0 as z from (
        select book_id, chapter_index, string_split(content, chr(10)) as ps from {chapters})) x, lateral (select coalesce(x.s0, 0) as s))"""


def _paragraphs(t):
    """Lines of each chapter with their place in it."""
    lines = t.chapters.select("book_id", F.concat(F.lit("chapter-"), F.col("chapter_index")).alias("chapter_key"), F.posexplode(F.split("content", "\n")).alias("paragraph_index", "line"))
    from pyspark.sql import Window

    before = F.sum(F.length("line") + 1).over(Window.partitionBy("book_id", "chapter_key").orderBy("paragraph_index").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return lines.select("book_id", "chapter_key", F.col("paragraph_index").cast("long").alias("paragraph_index"), start.alias("start"), (start + F.length("line")).alias("end"))


@query(
    "annotate_segments",
    f"""with {_PARAGRAPHS}, met as (
          select p.*, greatest(p.start, h.start) as f, least(p."end", h."end") as u, h.color, h.range_id from paragraphs p join {{highlights}} h
          on h.book_id = p.book_id and h.chapter_key = p.chapter_key and h.start < p."end" and h."end" > p.start and h."end" > h.start and p."end" > p.start),
        cuts as (select book_id, chapter_key, paragraph_index, start as pos from paragraphs union select book_id, chapter_key, paragraph_index, "end" from paragraphs
                 union select book_id, chapter_key, paragraph_index, f from met union select book_id, chapter_key, paragraph_index, u from met),
        pieces as (select *, lead(pos) over (partition by book_id, chapter_key, paragraph_index order by pos) as til from cuts)
        select p.book_id, p.chapter_key, p.paragraph_index, pos as start, til as "end", arg_max(m.color, m.range_id) as color
        from pieces p left join met m on m.book_id = p.book_id and m.chapter_key = p.chapter_key and m.paragraph_index = p.paragraph_index and m.f <= pos and m.u >= til
        where til > pos group by all""",
)
def annotate_segments(t):
    return I.annotate_segments(_paragraphs(t), t.highlights)


@query(
    "annotate_layers",
    f"""with {_PARAGRAPHS}, met as (
          select p.*, greatest(p.start, h.start) as f, least(p."end", h."end") as u, h.color, h.range_id, h.color = 'view' as under from paragraphs p join {{highlights}} h
          on h.book_id = p.book_id and h.chapter_key = p.chapter_key and h.start < p."end" and h."end" > p.start and h."end" > h.start and p."end" > p.start),
        cuts as (select book_id, chapter_key, paragraph_index, start as pos from paragraphs union select book_id, chapter_key, paragraph_index, "end" from paragraphs
                 union select book_id, chapter_key, paragraph_index, f from met union select book_id, chapter_key, paragraph_index, u from met),
        pieces as (select *, lead(pos) over (partition by book_id, chapter_key, paragraph_index order by pos) as til from cuts)
        select p.book_id, p.chapter_key, p.paragraph_index, pos as start, til as "end", arg_max(m.color, m.range_id) filter (not m.under) as color, coalesce(bool_or(m.under), false) as underlined
        from pieces p left join met m on m.book_id = p.book_id and m.chapter_key = p.chapter_key and m.paragraph_index = p.paragraph_index and m.f <= pos and m.u >= til
        where til > pos group by all""",
)
def annotate_layers(t):
    """Views count as underlines, other events as highlights."""
    return I.annotate_segments(_paragraphs(t), t.highlights.where("color <> 'view'"), t.highlights.where("color = 'view'"))


_EXCERPTS = """excerpts as (select bookmark_id as excerpt_id, book_id, 'chapter-' || (bookmark_id % 5) as chapter_key, greatest(0, global_char_offset - 400) as start, global_char_offset + 400 as "end" from {bookmarks})"""


@query(
    "excerpt_highlights",
    f"""with {_EXCERPTS} select * from (select *, row_number() over (partition by excerpt_id order by start, "end") as rank from (
          select distinct h.book_id, h.chapter_key, excerpt_id, greatest(h.start, e.start) as start, least(h."end", e."end") as "end"
          from {{highlights}} h join excerpts e on e.book_id = h.book_id and e.chapter_key = h.chapter_key and h.start < e."end" and h."end" > e.start and h."end" > h.start)) where rank <= 12""",
)
def excerpt_highlights(t):
    e = t.bookmarks.select(
        F.col("bookmark_id").alias("excerpt_id"), "book_id", F.expr("concat('chapter-', bookmark_id % 5)").alias("chapter_key"),
        F.expr("greatest(0, global_char_offset - 400)").alias("start"), F.expr("global_char_offset + 400").alias("end"),
    )
    return _longs(I.excerpt_highlights(t.highlights, e))


@query(
    "nearest_bookmark",
    """select book_id, target_id, bookmark_id, gap from (
         select p.book_id, p.event_id as target_id, b.bookmark_id, abs(b.global_char_offset - p.global_char_offset) as gap,
                row_number() over (partition by p.event_id order by abs(b.global_char_offset - p.global_char_offset), b.global_char_offset, b.created_at, b.bookmark_id) as n
         from {positions} p join {bookmarks} b on b.book_id = p.book_id) where n = 1""",
)
def nearest_bookmark(t):
    targets = t.positions.select("book_id", F.col("event_id").alias("target_id"), F.col("global_char_offset").alias("offset"))
    return I.nearest_bookmark(targets, t.bookmarks)


@query("sort_bookmarks", "select book_id, bookmark_id, row_number() over (partition by book_id order by global_char_offset, created_at, bookmark_id) as rank from {bookmarks}")
def sort_bookmarks(t):
    return _longs(I.sort_bookmarks(t.bookmarks).select("book_id", "bookmark_id", "rank"))


_MERGE = """runs as (select *, sum(new) over (partition by book_id, chapter_key order by start, "end", color rows unbounded preceding) as run from (
      select *, case when lag(color) over (partition by book_id, chapter_key order by start, "end", color) = color then 0 else 1 end as new from src where "end" > start)),
    gaps as (select *, case when max("end") over (partition by book_id, chapter_key, run order by start, "end" rows between unbounded preceding and 1 preceding) >= start then 0 else 1 end as gap from runs),
    islands as (select *, sum(gap) over (partition by book_id, chapter_key, run order by start, "end" rows unbounded preceding) as island from gaps),
    merged as (select book_id, chapter_key, min(start) as start, max("end") as "end", color from islands group by book_id, chapter_key, run, island, color)"""


@query("merge_ranges", f"""with src as (select book_id, chapter_key, start, "end", color from {{highlights}}), {_MERGE} select * from merged""")
def merge_ranges(t):
    return I.merge_ranges(t.highlights, ["book_id", "chapter_key"])


#: Every bookmark is a stroke, drawn in order of creation; some are of the colours that are there.
_STROKES = """strokes as (select book_id, 'chapter-' || (bookmark_id % 5) as chapter_key, list(struct_pack(a := global_char_offset, b := global_char_offset + 100 + bookmark_id % 4 * 200,
      ink := case when bookmark_id % 3 = 0 then 'view' else 'mark' end, rs := cast([] as struct(s bigint, i bigint, e bigint, c varchar)[])) order by created_at, bookmark_id) as drawn from {bookmarks} group by 1, 2)"""

#: One stroke on the list x.rs: pieces by start and place in the list before; covered if its start and each end inside lie in some range.
_PIECES = """list_filter(flatten(list_transform(x.rs, lambda r, n: case when r.e <= y.a or r.s >= y.b then [struct_pack(s := r.s, i := n, e := r.e, c := r.c)]
      else [struct_pack(s := r.s, i := n, e := least(r.e, y.a), c := r.c), struct_pack(s := greatest(r.s, y.b), i := n, e := r.e, c := r.c)] end)), lambda r: r.e > r.s)"""
_COVERED = """len(list_filter(list_concat([y.a], list_filter(list_transform(x.rs, lambda r: r.e), lambda p: p > y.a and p < y.b)), lambda p: len(list_filter(x.rs, lambda r: r.s <= p and r.e > p)) = 0)) = 0"""
_JOINED = """coalesce(list_reduce(list_transform(list_sort({0}), lambda r: [r]), lambda o, r: case when o[-1].c = r[1].c and o[-1].e >= r[1].s
      then list_concat(o[:-2], [struct_pack(s := o[-1].s, i := 0::bigint, e := greatest(o[-1].e, r[1].e), c := r[1].c)]) else list_concat(o, r) end), [])"""
_DRAWN = _JOINED.format(f"case when {_COVERED} then {_PIECES} else list_append({_PIECES}, struct_pack(s := y.a, i := 1000000::bigint, e := y.b, c := y.ink)) end")


@query(
    "apply_stroke",
    f"""with {_STROKES}, ranges as (select book_id, chapter_key, list(struct_pack(s := start, i := 0::bigint, e := "end", c := color) order by start, "end", color) as rs from {{highlights}} group by 1, 2),
        met as (select coalesce(r.book_id, s.book_id) as book_id, coalesce(r.chapter_key, s.chapter_key) as chapter_key, coalesce(rs, []) as rs, drawn
          from ranges r full join strokes s on s.book_id = r.book_id and s.chapter_key = r.chapter_key),
        done as (select book_id, chapter_key, case when drawn is null then rs else list_reduce(list_prepend(struct_pack(a := 0::bigint, b := 0::bigint, ink := '', rs := rs), drawn),
            lambda x, y: struct_pack(a := 0::bigint, b := 0::bigint, ink := '', rs := {_DRAWN})).rs end as rs from met)
        select book_id, chapter_key, r.s as start, r.e as "end", r.c as color from (select book_id, chapter_key, unnest(rs) as r from done)""",
)
def apply_stroke(t):
    s = t.bookmarks.select(
        "book_id", F.expr("concat('chapter-', bookmark_id % 5)").alias("chapter_key"), F.col("global_char_offset").alias("start"),
        F.expr("global_char_offset + 100 + bookmark_id % 4 * 200").alias("end"), F.expr("if(bookmark_id % 3 = 0, 'view', 'mark')").alias("color"), "created_at", "bookmark_id",
    )
    return strokes.apply_strokes(t.highlights, s, ["book_id", "chapter_key"], ["created_at", "bookmark_id"])


@query("filter_highlights", """select book_id, chapter_key, range_id, start, "end", color from {highlights} where "end" > start and color = 'view' and chapter_key = 'chapter-2' and book_id in (1, 2, 3, 5, 8, 13)""")
def filter_highlights(t):
    return I.filter_highlights(t.highlights, [1, 2, 3, 5, 8, 13], "view", "chapter-2")


@query("used_colors", """select book_id, string_agg(distinct color, ',' order by color) as colors from {highlights} where "end" > start group by 1""")
def used_colors(t):
    return I.used_colors(t.highlights)


@query("count_highlights", """select book_id, count(*) as highlights from {highlights} where "end" > start group by 1""")
def count_highlights(t):
    return I.count_highlights(t.highlights)


#: Every fifth highlight is of the whole text.
_KEYED = """keyed as (select * replace (case when chapter_key = 'chapter-4' then 'full' else chapter_key end as chapter_key) from {highlights})"""


def _keyed(t):
    return t.highlights.withColumn("chapter_key", F.when(F.col("chapter_key") == "chapter-4", "full").otherwise(F.col("chapter_key")))


@query(
    "highlight_position",
    f"""with {_OFFSETS}, {_KEYED} select h.range_id, h.book_id, raw_start + h.start as global_offset, round(case when raw_length > 0 then h.start / raw_length else 0 end, 6) as ratio
        from keyed h join offsets o on o.book_id = h.book_id and h.chapter_key = 'chapter-' || o.chapter_index
        union all select h.range_id, h.book_id, h.start, round(case when full_text_length > 0 then h.start / full_text_length else 0 end, 6) from keyed h join {{books}} b on b.book_id = h.book_id where h.chapter_key = 'full'""",
)
def highlight_position(t):
    return I.highlight_position(_keyed(t), _offsets(t), t.books).select("range_id", "book_id", "global_offset", F.round("ratio", 6).alias("ratio"))


_LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(
    "resolve_highlights",
    f"""with {_KEYED}, c as (select book_id, 'chapter-' || chapter_index as chapter_key, case when chapter_index % 2 = 0 then trim(string_split(content, chr(10))[1]) else title end as title,
          array_to_string(case when chapter_index % 2 = 0 then {_LINES.format("content")}[2:] else {_LINES.format("content")} end, chr(10)) as r from {{chapters}}
          union all select book_id, 'full', '全文', array_to_string({_LINES.format("full_text")}, chr(10)) from {{books}}),
        x as (select range_id, h.book_id, title, substr(r, cast(least(start, len(r)) as bigint) + 1, cast(greatest(least("end", len(r)) - least(start, len(r)), 0) as bigint)) as text
          from keyed h join c on c.book_id = h.book_id and c.chapter_key = h.chapter_key)
        select * from x where trim(text, ' ' || chr(10)) <> ''""",
)
def resolve_highlights(t):
    """Chapters with an even index bear their first line as title, so it is not shown twice."""
    named = t.chapters.withColumn("title", F.when(F.col("chapter_index") % 2 == 0, F.substring_index("content", "\n", 1)).otherwise(F.col("title")))
    return I.resolve_highlights(_keyed(t), named, t.books).select("range_id", "book_id", "title", "text")


@query(
    "merge_regions",
    """with a as (select book_id, chapter_key, start, "end" from {highlights} where "end" > start and color = 'view'),
       b as (select book_id, chapter_key, start, "end" from {highlights} where "end" > start and color = 'click')
       select * from a union all select * from b where not exists (select 1 from a where a.book_id = b.book_id and a.chapter_key = b.chapter_key and a.start < b."end" and b.start < a."end")""",
)
def merge_regions(t):
    h = t.highlights.where("end > start")
    pick = lambda c: h.where(F.col("color") == c).select("book_id", "chapter_key", "start", "end")
    return I.merge_regions(pick("view"), pick("click"), ["book_id", "chapter_key"])
