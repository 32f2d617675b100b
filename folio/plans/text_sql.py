"""DuckDB SQL of the operators that cut texts: sizes, spoken pieces, sentences, excerpts, blocks, titles, lines.

Places are found in a copy of the text of the same length, in which every mark is one control
character, so that a cut is a search for one character in a piece of the copy.
"""

from __future__ import annotations

_MARK = "chr(1)"


def _last(text: str, start: str, size: int, mark: str) -> str:
    """The last place, from 1, of a mark among ``size`` characters from ``start``; null if there is none."""
    piece = f"substring({text}, {start}, {size})"
    return f"({start}) + length({piece}) - nullif(strpos(reverse({piece}), {mark}), 0)"


def _first(text: str, start: str, size: str | int, mark: str) -> str:
    return f"({start}) - 1 + nullif(strpos(substring({text}, {start}, {size}), {mark}), 0)"


# A full stop after a digit, or before a letter, ends nothing. Neighbouring stops share what is between them, so twice.
_STOPPED = "regexp_replace(text, '[。！？；…｡!?;]', chr(1), 'g')"
for _ in range(2):
    _STOPPED = rf"""regexp_replace({_STOPPED}, '(^|[^0-9])\.($|[\s"''“”‘’）)\]】》])', '\1' || chr(1) || '\2', 'g')"""


def size_cuts(source: str, target: int) -> str:
    """Recursive tables that cut ``source`` (book_id, text) near every ``target`` characters; the last is ``sized{target}``."""
    reach = int(target * 0.3)
    width = reach + 1
    low, ideal = f"here + {target - reach} + 1", f"here + {target}"
    after = _first("m", f"{ideal} + 2", f"greatest(0, least(n, {ideal} + {reach}) - ({ideal} + 1))", "chr(10)")
    cut = f"case when n - here <= {target * 1.3} then n else coalesce({_last('m', low, width, 'chr(10)')}, {after}, {_last('m', low, width, _MARK)}, {ideal}) end"
    return f"""marked{target} as (select book_id, text, length(text) as n, {_STOPPED} as m from {source}),
        cuts{target} as (select book_id, text, m, n, 0 as here, (select {cut} from (select 0 as here)) as upto from marked{target} where n > 0
          union all select book_id, text, m, n, here, {cut} from (select book_id, text, m, n, upto as here from cuts{target} where upto < n)),
        bodies{target} as (select book_id, here, ltrim(substring(text, here + 1, upto - here), ' ' || chr(9) || chr(10) || chr(13)) as content from cuts{target}),
        sized{target} as (select book_id, cast(row_number() over (partition by book_id order by here) - 1 as integer) as chapter_index,
          '第' || row_number() over (partition by book_id order by here) || '章' as title, content from bodies{target} where content <> '')"""


SIZED = f"with recursive {size_cuts('(select doc_id as book_id, text from {documents})', 1000)} select book_id, chapter_index, title, content from sized1000"

RESOLVED = rf"""with recursive {size_cuts('(select doc_id as book_id, text from {documents} where doc_id % 3 = 0)', 600)},
        x as (select doc_id as book_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from {{documents}}
          where doc_id % 3 = 2 or (doc_id % 3 = 1 and doc_id not in (select book_id from {{chapters}}))),
        r as (select *, cast(regexp_matches(line, '^The ') as integer) as hit from x),
        s as (select *, sum(hit) over (partition by book_id order by n rows unbounded preceding) as c, max(hit) over (partition by book_id) as any_hit, max(n) over (partition by book_id) as last_n from r),
        g as (select book_id, c, bool_or(any_hit = 1) as found, string_agg(line, chr(10) order by n) || case when max(n) < any_value(last_n) then chr(10) else '' end as content from s group by book_id, c)
        select book_id, chapter_index, title, content from sized600
        union all select book_id, cast(chapter_index as integer), title, content from {{chapters}} where book_id % 3 = 1
        union all select book_id, cast(row_number() over (partition by book_id order by c) - 1 as integer), case when not found then '全文' when c = 0 then '序章 / 前言' else trim(split_part(content, chr(10), 1)) end, content from g"""


def _speech_cut(size: int) -> str:
    """How much of ``rest`` the next piece takes: to a sentence's end, a clause's end or a blank."""
    low, wide = max(50, round(size * 0.1)), round(size * 0.1)
    high, enough = size + wide, int(size * 0.8)

    def marked(chars: str) -> str:
        return f"translate(rest, '{chars}', repeat(chr(1), {len(chars)}))"

    kinds = [f"{_first(m, str(enough), high - enough + 1, _MARK)}, {_last(m, str(low + 1), high - low, _MARK)}" for m in (marked("。！？!?."), marked("，,；;：:、"))]
    return f"case when length(rest) <= {round(size * 1.25)} then length(rest) else coalesce({', '.join(kinds)}, {_last(marked(' 　'), str(low + 1), size + 1 - low, _MARK)}, {size}) end"


def spoken(paragraphs: str, size: int) -> str:
    cut = _speech_cut(size)
    keys = "book_id, chapter_index, paragraph_index"
    return f"""with recursive {paragraphs}, cuts as (select {keys}, 0 as piece, text as rest, {cut} as upto from (select {keys}, text, text as rest from pars where text <> '')
          union all select {keys}, piece + 1, rest, {cut} from (select {keys}, piece, substring(rest, upto + 1) as rest from cuts where upto < length(rest)))
        select book_id, cast(chapter_index as integer) as chapter_index, cast(paragraph_index as integer) as paragraph_index, piece, substring(rest, 1, upto) as text from cuts"""


# Marks that count as none become signs of private use: those between digits, and hyphens with neither a blank nor a hyphen beside them.
_PLAIN = "text"
for _sign, _private in ((r"\.", "chr(57344)"), ("．", "chr(57345)"), (",", "chr(57346)"), ("，", "chr(57347)"), (":", "chr(57348)"), ("：", "chr(57349)")):
    for _ in range(2):
        _PLAIN = f"regexp_replace({_PLAIN}, '([0-9０-９]){_sign}([0-9０-９])', '\\1' || {_private} || '\\2', 'g')"
for _ in range(2):
    _PLAIN = rf"regexp_replace({_PLAIN}, '(^|[^-\s])-([^-\s]|$)', '\1' || chr(57350) || '\2', 'g')"
_ENDS, _CLAUSES = "[!?。！？｡….．]", r"(?:[—–―－-]+|,+|，+|:+|：+|、+|;+|；+|\r+|\n+)"
_ANY = r"!?。！？｡….．—–―－,，:：、;；\r\n-"
_CLOSERS = r"""["''”’)\]}）】》」』〕〗〉》〙〛]*"""


def sentences(source: str, keys: str) -> str:
    """Tables that cut ``source`` (keys, text) at sentences and clauses; the last is ``spans``."""
    return rf"""plain as (select {keys}, {_PLAIN} as text from {source}),
        found as (select {keys}, regexp_extract_all(text, '[^{_ANY}]*(?:{_ENDS}+|{_CLAUSES}){_CLOSERS}[ \t\f]*|[^{_ANY}]+$') as parts from plain),
        rows as (select {keys}, unnest(parts) as s, generate_subscripts(parts, 1) as i from found),
        placed as (select *, sum(length(s)) over (partition by {keys} order by i rows unbounded preceding) as upto from rows),
        spans as (select {keys}, cast(upto - length(s) as bigint) as start, cast(upto as bigint) as "end",
          case when regexp_matches(s, '{_ENDS}{_CLOSERS}\s*$') then 'sentence' when regexp_matches(s, '{_CLAUSES}{_CLOSERS}\s*$') then 'clause' end as boundary_type
          from placed where trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '')"""


SENTENCES = f"""with {sentences('(select book_id, chapter_index, content as text from {chapters})', 'book_id, chapter_index')} select book_id, cast(chapter_index as integer) as chapter_index, start, "end", boundary_type from spans"""


def excerpts(n: int) -> str:
    least = max(80, round(n * 0.45))
    return f"""with {sentences('(select doc_id as book_id, text from {documents})', 'book_id')},
        p as (select book_id, event_id as position_id, text, greatest(0, least(global_char_offset, coalesce(length(text), 0))) as position from {{positions}} left join {{documents}} on doc_id = book_id),
        e as (select *, coalesce((select max(s."end") from spans s where s.book_id = p.book_id and s."end" <= position and s.boundary_type is not null), position) as upto from p),
        w as (select *, greatest(0, upto - {n}) as raw from e),
        o as (select *, (select max(s."end") from spans s where s.book_id = w.book_id and s."end" <= raw) as before, (select min(s.start) from spans s where s.book_id = w.book_id and s.start >= raw) as next from w),
        f as (select *, case when raw <= 0 then 0 when next is null or next >= upto or upto - next < {least} then coalesce(before, raw) else next end as start from o)
        select book_id, position_id, cast(start as bigint) as start, cast(upto as bigint) as "end", coalesce(substring(text, cast(start as bigint) + 1, cast(upto - start as bigint)), '') as excerpt from f"""


LAYOUT = """with items as (select user_id as page_id, event_id as item_id, cast(event_id % 100 as double) as x, round(value * 2) as baseline, cast(8 + event_id % 5 as double) as font from {events}),
        m as (select *, case when lag(baseline) over o - baseline > font * 0.85 or lag(item_id) over o is null then 1 else 0 end as new from items window o as (partition by page_id order by baseline desc, x, item_id)),
        l as (select *, sum(new) over (partition by page_id order by baseline desc, x, item_id rows unbounded preceding) - 1 as line from m),
        r as (select *, count(*) over (partition by page_id, line) as n, row_number() over (partition by page_id, line order by font) as rf, row_number() over (partition by page_id, line order by baseline) as rb from l),
        t as (select *, max(case when rf = (n + 1) // 2 then font end) over (partition by page_id, line) as f, max(case when rb = (n + 1) // 2 then baseline end) over (partition by page_id, line) as b from r)
        select page_id, item_id, cast(line as bigint) as line, case when font < f * 0.85 and baseline > b + f * 0.15 then 'sup' when font < f * 0.85 and baseline < b - f * 0.1 then 'sub' else 'base' end as role from t"""

_USABLE = r"x <> '' and not regexp_matches(x, '^\d+$') and not regexp_matches(x, '(?i)table\s+of\s+contents|目\s*录') and length(x) <= 36"
#: For books without a table of contents among their chapters: every title here is a placeholder.
TITLES = rf"""select book_id, cast(chapter_index as integer) as chapter_index, coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '\s*[·•–—-]?\s*\d\d?\d?\d?\d?\s*$', '')), '(?i)^chapter\s+\d+\s*[:：.-]?\s*', ''))),
        lambda x: {_USABLE})[1], title) as title, content from {{chapters}}"""


def _attribute(name: str) -> str:
    return rf"""nullif(trim(regexp_replace(regexp_extract(tag, '(?i)\s{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1), '^["'']|["'']$', '', 'g')), '')"""


def _pixels(name: str) -> str:
    own = rf"coalesce({_attribute(name)}, nullif(regexp_extract({_attribute('style')}, '(?i)(?:^|;)\s*{name}\s*:\s*([^;]+)', 1), ''))"
    n = rf"try_cast(regexp_extract({own}, '^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:px)?\s*$', 1) as double)"
    return f"case when {n} > 0 then cast(round({n}) as integer) end"


def blocks(source: str, space: str, drop: str, line_break: str) -> str:
    """``source`` (page_id, html) cut at its images; ``space`` cleans a block, ``drop`` and ``line_break`` are patterns of the same meaning as the operator's."""
    image = r"(?i)<(?:img|image)\b[^>]*>"
    entities = "regexp_replace(regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '" + line_break + "', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, value in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&amp;", "'&'")):
        entities = f"replace({entities}, '{name}', {value})"
    sources = ", ".join(_attribute(a) for a in ("src", "data-src", "data-original", "href", "xlink:href"))
    return rf"""with body as (select page_id, regexp_replace(coalesce(html, ''), '{drop}', ' ', 'g') as h from ({source})),
        cutup as (select page_id, string_split_regex(h, '{image}') as ts, regexp_extract_all(h, '{image}') as tags from body),
        texts as (select page_id, unnest(ts) as t, generate_subscripts(ts, 1) * 2 as i from cutup),
        images as (select page_id, unnest(tags) as tag, generate_subscripts(tags, 1) * 2 + 1 as i from cutup),
        clean as (select page_id, i, {space.format(entities)} as text from texts),
        every as (select page_id, i, 'text' as type, text, null as tag from clean where text <> '' union all select page_id, i, 'image', null, tag from images),
        numbered as (select *, cast(row_number() over (partition by page_id order by i) - 1 as integer) as block_index from every),
        named as (select page_id, block_index, type, text, coalesce({sources}) as image_ref, {_attribute('alt')} as alt, {_attribute('title')} as title, {_pixels('width')} as width, {_pixels('height')} as height from numbered)
        select page_id, block_index, type, text, image_ref, alt, title, coalesce(width, 0) as width, coalesce(height, 0) as height from named where type = 'text' or image_ref is not null"""


_TAIL = r"""^["'')\]}）】」』》〉”’ \t\r.!?;。！？；｡．﹒…⋯︙]*\n*"""
_STOPS = "text"
for _sign, _private in ((r"\.", "chr(57344)"), ("．", "chr(57345)"), ("﹒", "chr(57346)")):
    for _ in range(2):
        _STOPS = f"regexp_replace({_STOPS}, '([0-9]){_sign}([0-9])', '\\1' || {_private} || '\\2', 'g')"
_STOPS = rf"regexp_replace({_STOPS}, '[\n!?;。！？；｡…⋯︙.．﹒]', chr(1), 'g')"


def passages(source: str, size: int = 512, overlap: int = 64, least: int = 20, forward: int = 120, backward: int = 180) -> str:
    """``source`` (book_id, chapter_index, text, clean_start) as overlapping passages that end where a sentence does, if one is near."""
    keys = "book_id, chapter_index, clean_start, text, m, n"
    hard, low = f"least(here + {size}, n)", f"least(n, here + {max(20, int(size * 0.35))})"
    ahead = _first("m", f"greatest(here, {hard} - 1) + 1", f"least(n, {hard} + {forward}) - greatest(here, {hard} - 1)", _MARK)
    floor = f"greatest({low} - 1, {hard} - {backward})"
    behind = _last("m", f"{floor} + 1", f"greatest(0, {hard} - {floor})", _MARK)
    # A place from 1 is the end of that mark from 0; what follows it is its tail.
    place = f"coalesce({ahead}, {behind})"
    near = f"least(n, {place} + length(regexp_extract(substring(text, cast({place} as bigint) + 1), '{_TAIL}')))"
    end = f"case when n - here <= {least} then n when {hard} > {low} and {place} is not null and {near} > {low} then {near} else {hard} end"
    step = f"select {keys}, here, case when upto - here < {least} then n else upto end as upto from (select {keys}, here, {end} as upto from "
    return f"""marked as (select book_id, chapter_index, clean_start, text, {_STOPS} as m, length(text) as n from {source}),
        cuts as ({step} (select *, 0 as here from marked where n > 0))
          union all {step} (select {keys}, case when upto - {overlap} > here then greatest(upto - {overlap}, 0) else here + {size - overlap} end as here from cuts where upto < n) where here < n))
        select book_id || '_ch' || chapter_index || '_' || here as chunk_id, book_id, cast(chapter_index as integer) as chapter_index, cast(clean_start + here as bigint) as start_offset,
          cast(clean_start + upto as bigint) as end_offset, substring(text, here + 1, cast(upto - here as bigint)) as text from cuts where upto - here >= {least}"""


#: The chapters' texts have no images and no blanks beside line breaks or at their ends but those that go here.
_CLEAN = r"""clean as (select book_id, chapter_index, trim(regexp_replace(regexp_replace(content, '\s+\n', chr(10), 'g'), '\n\s+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) as text from {chapters}),
        placed as (select *, coalesce(sum(length(text)) over (partition by book_id order by chapter_index rows between unbounded preceding and 1 preceding), 0) as clean_start from clean)"""
PASSAGES = f"with recursive {_CLEAN}, {passages('placed')}"
