"""Views of the driver's tables in the shape of the engine's entities.

Each view has one SQL text for Spark and one for DuckDB, mostly the same; ``{name}`` stands
for a table or another view. Instants are UTC.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.staging import spread

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Tables of texts, with their ids.
TEXTS = {"documents": "doc_id", "pages": "page_id"}

_PARAGRAPHS = "filter(split(text, '\\\\n'), x -> trim(x) <> '')"

#: name -> (Spark SQL, DuckDB SQL or None for the same text)
VIEWS: dict[str, tuple[str, str | None]] = {
    "books": (
        "select doc_id as book_id, source as title, lang as author, array(lang, source) as tags, text as full_text, n_chars as full_text_length from {documents}",
        "select doc_id as book_id, source as title, lang as author, [lang, source] as tags, text as full_text, n_chars as full_text_length from {documents}",
    ),
    "chapters": (
        "select book_id, c.pos as chapter_index, concat('Chapter ', c.pos + 1) as title, c.col as content from ("
        f"select doc_id as book_id, {_PARAGRAPHS} as l from {{documents}}) lateral view posexplode(if(size(l) > 0, "
        "transform(sequence(0, cast(ceil(size(l) / 5) as int) - 1), i -> array_join(slice(l, i * 5 + 1, 5), '\\n')), array())) c",
        "select book_id, i as chapter_index, 'Chapter ' || (i + 1) as title, array_to_string(l[i * 5 + 1 : i * 5 + 5], chr(10)) as content from ("
        "select book_id, l, unnest(range(cast(ceil(len(l) / 5) as bigint))) as i from ("
        "select doc_id as book_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from {documents}))",
    ),
    "chunks": (
        "select e.vec_id as chunk_id, e.label as book_id, cast(e.vec_id % 50 * 448 as bigint) as start_offset, cast(e.vec_id % 50 * 448 + 512 as bigint) as end_offset, "
        "d.text, e.embedding from {embeddings} e left join {documents} d on d.doc_id = e.vec_id",
        None,
    ),
    "queries": ("select e.vec_id as query_id, e.embedding as query_vec, d.text as query_text from {embeddings} e left join {documents} d on d.doc_id = e.vec_id where e.vec_id % 50 = 0", None),
    "reader_progress": ("select distinct label as book_id, cast(5000 + 1000 * label as bigint) as safe_offset from {embeddings}", None),
    "sessions": (
        "select user_id, event_id % 40 as book_id, ts as start, timestamp_micros(unix_micros(ts) + cast(round(value * 60000) as bigint) * 1000) as end from {events} where value > 0",
        'select user_id, event_id % 40 as book_id, ts as start, make_timestamp(epoch_us(ts) + cast(round(value * 60000) as bigint) * 1000) as "end" from {events} where value > 0',
    ),
    "progress_events": ("select event_id, user_id, event_id % 40 as book_id, ts, least(100, cast(round(value) as bigint)) as progress from {events}", None),
    "goals": ("select distinct user_id, event_id % 40 as book_id from {events} where (user_id + event_id % 40) % 7 = 0", None),
    "highlights": (
        "select user_id as book_id, concat('chapter-', event_id % 5) as chapter_key, event_id as range_id, cast(floor(value * 10) as bigint) as start, "
        "cast(floor(value * 10) as bigint) + event_id % 40 as end, event_type as color from {events}",
        "select user_id as book_id, 'chapter-' || (event_id % 5) as chapter_key, event_id as range_id, cast(floor(value * 10) as bigint) as start, "
        'cast(floor(value * 10) as bigint) + event_id % 40 as "end", event_type as color from {events}',
    ),
    "bookmarks": ("select user_id as book_id, event_id as bookmark_id, cast(floor(value * 10) as bigint) as global_char_offset, ts as created_at from {events} where event_type = 'purchase'", None),
    "positions": ("select user_id, user_id as book_id, event_id, cast(floor(value * 20) as bigint) as global_char_offset from {events} where event_type = 'view'", None),
    "messages": (
        "select conv_id as conversation_key, turn as msg_index, case when role = 'user' then 'user' else 'character' end as sender, text as content, turn % 2 = 0 as sent_to_ai, "
        "concat('g', cast(floor(turn / 2) as bigint)) as generation_id from {conversations}",
        None,
    ),
    "timed_messages": ("select user_id as conversation_key, event_id as id, event_type as sender, props as content, ts from {events}", None),
    "buckets": (
        "select o_orderkey as ordinal, concat('book:', o_custkey % 20, '::persona:', o_orderpriority, '::character:', o_orderstatus) as conversation_key, o_custkey % 20 as book_id, "
        "o_orderpriority as persona_name, o_orderstatus as character_name, o_orderdate as updated_at, o_orderkey % 9 as message_count from {orders}",
        None,
    ),
    "summary_cards": (
        "select o_custkey as owner_id, o_orderkey as card_id, concat(o_orderstatus, ' ', o_orderpriority) as content, o_orderkey % 50 * 100 as start, "
        "o_orderkey % 50 * 100 + 99 as end, o_orderdate as created_at from {orders}",
        "select o_custkey as owner_id, o_orderkey as card_id, concat(o_orderstatus, ' ', o_orderpriority) as content, o_orderkey % 50 * 100 as start, "
        'o_orderkey % 50 * 100 + 99 as "end", o_orderdate as created_at from {orders}',
    ),
    "quiz_answers": ("select l_orderkey as session_id, l_linenumber as question_id, l_suppkey % 4 as answer, l_partkey % 4 as correct from {lineitem}", None),
    "lore_entries": (
        "select p_partkey as entry_id, p_name as title, p_brand as category, concat(p_type, ' ', p_size) as content, case when p_partkey % 2 = 0 then 'BEFORE' else 'AFTER' end as position from {part}",
        None,
    ),
    "storage_records": (
        "select 'content' as store, cast(doc_id as string) as key, text as value, cast(doc_id % 50 as string) as book_id from {documents} union all "
        "select 'chat', concat(conv_id, '-', turn), text, cast(conv_id % 50 as string) from {conversations} union all "
        "select 'pages', cast(page_id as string), html, cast(page_id % 50 as string) from {pages}",
        "select 'content' as store, cast(doc_id as varchar) as key, text as value, cast(doc_id % 50 as varchar) as book_id from {documents} union all "
        "select 'chat', concat(conv_id, '-', turn), text, cast(conv_id % 50 as varchar) from {conversations} union all "
        "select 'pages', cast(page_id as varchar), html, cast(page_id % 50 as varchar) from {pages}",
    ),
    "ticks": (
        "select event_id, user_id, event_type, ts as planned, timestamp_micros(unix_micros(ts) + cast(round(value * 100) as bigint) * 1000) as actual from {events}",
        "select event_id, user_id, event_type, ts as planned, make_timestamp(epoch_us(ts) + cast(round(value * 100) as bigint) * 1000) as actual from {events}",
    ),
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its zoneless instants become instants in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = spread(df, TEXTS[name]) if name in TEXTS else df
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return base(spark, sf_dir, name)
    text = VIEWS[name][0]
    needs = {n: view(spark, sf_dir, n) for n in _names(text)}
    return spark.sql(text, **needs)


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def oracle(text: str) -> str:
    """DuckDB SQL with the views that ``text`` names in braces put in front as a WITH list."""
    done: dict[str, str] = {}

    def need(sql: str) -> str:
        for n in _names(sql):
            if n in VIEWS and n not in done:
                own = VIEWS[n][1] or VIEWS[n][0]
                done[n] = need(own)
        return re.sub(r"\{(\w+)\}", r"\1", sql)

    body = need(text).strip()
    if not done:
        return body
    # A view is put down after those that it reads, as each is entered when its text is complete.
    parts = ", ".join(f"{n} as ({s})" for n, s in done.items())
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"{start}{parts}, {body[len(start):]}"
    return f"with {parts} {body}"
