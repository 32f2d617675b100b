"""Queries over messages, conversation buckets, summary cards and lore."""

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import chat as C
from folio.operators.intervals import chapter_offsets  # noqa: F401
from folio.plans.registry import query


def _longs(df):
    return df.select(*[F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes])


@query(
    "pending_messages",
    """with m as (select *, sender = 'user' and not sent_to_ai as p, max(case when sender = 'user' and not sent_to_ai then 1 else 0 end) over w as s, max(msg_index) over w as l from {messages} window w as (partition by conversation_key))
       select conversation_key, msg_index, sender, content from m where p or (s = 0 and msg_index = l and sender = 'user')""",
)
def pending_messages(t):
    return C.pending_messages(t.messages).select("conversation_key", "msg_index", "sender", "content")


@query(
    "time_gaps",
    """select conversation_key, id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by conversation_key order by ts, id)) >= 3600000000, false) as separated from {timed_messages}""",
)
def time_gaps(t):
    return C.time_gaps(t.timed_messages).select("conversation_key", "id", "separated")


@query("last_n", "select conversation_key, msg_index, content from (select *, row_number() over (partition by conversation_key order by msg_index desc) as r from {messages}) where r <= 3")
def last_n(t):
    return C.last_n(t.messages, 3).select("conversation_key", "msg_index", "content")


_TOTALS = "totals as (select conversation_key, count(*) as total, conversation_key % 5 as cursor from {timed_messages} group by all)"


@query(
    "summary_ranges",
    f"""with {_TOTALS} select conversation_key, cursor + i * 10 + 1 as start, cursor + (i + 1) * 10 as "end"
        from (select *, unnest(range(cast(floor((total - cursor) / 10) as bigint))) as i from totals)""",
)
def summary_ranges(t):
    totals = t.timed_messages.groupBy("conversation_key").agg(F.count("*").alias("total")).withColumn("cursor", F.col("conversation_key") % 5)
    return C.summary_ranges(totals, 10)


@query(
    "tail_appended",
    """with new as (select conversation_key, msg_index, content as id from {messages}),
       old as (select conversation_key, msg_index, case when conversation_key % 7 = 0 and msg_index = 0 then 'changed' else id end as id from new where msg_index < 2),
       s as (select n.*, o.id as old, min(case when o.id is not null then case when o.id = n.id then 1 else 0 end end) over (partition by n.conversation_key) as same from new n left join old o on o.conversation_key = n.conversation_key and o.msg_index = n.msg_index)
       select conversation_key, msg_index, id from s where old is null and coalesce(same, 1) = 1""",
)
def tail_appended(t):
    new = t.messages.select("conversation_key", "msg_index", F.col("content").alias("id"))
    old = new.where("msg_index < 2").withColumn("id", F.expr("case when conversation_key % 7 = 0 and msg_index = 0 then 'changed' else id end"))
    return C.tail_appended(old, new)


@query(
    "strip_last_generation",
    """with m as (select *, last_value(generation_id) over w as g from {messages} window w as (partition by conversation_key order by msg_index rows between unbounded preceding and unbounded following)),
       r as (select *, min(case when sender = 'character' and (g is null or generation_id = g) then 1 else 0 end) over (partition by conversation_key order by msg_index desc rows unbounded preceding) as run from m)
       select conversation_key, msg_index, sender from r where run = 0""",
)
def strip_last_generation(t):
    return C.strip_last_generation(t.messages).select("conversation_key", "msg_index", "sender")


_ID = """case when trim(persona_name) <> '' and trim(character_name) <> '' then concat('book:', book_id, '::', lower(persona_name), '::', lower(character_name)) end"""


#: Orders as whole conversations, with lists, texts that may be missing and maps by book.
_NESTED = """nested as (select ordinal, book_id, conversation_key, persona_name, case when ordinal % 5 = 0 then upper(character_name) else character_name end as character_name, updated_at,
      list_transform(range(message_count), lambda i: ordinal || '-' || i) as messages, list_transform(range(ordinal % 4), lambda i: 'c' || ordinal || '-' || i) as summary_cards,
      case when ordinal % 3 = 0 then '' else 's' || ordinal end as chat_summary, ordinal % 100 as auto_summary_last_end,
      map_from_entries([('b' || (ordinal % 3), 'p' || ordinal), ('c' || (ordinal % 2), 'q' || ordinal)]) as reading_prefix_summary from {buckets})"""
#: Two conversations as one: x is what was there before. A score tie is x's.
_SCORE = "len({0}.messages) * 1000000 + len({0}.summary_cards) * 1000 + {0}.ms"
_FIRST = f"({_SCORE.format('x')} >= {_SCORE.format('y')})"
_PAIR = f"""struct_pack(key := case when {_FIRST} then x.key else y.key end, ms := greatest(x.ms, y.ms), n := x.n + 1, cursor := greatest(x.cursor, y.cursor),
    messages := case when len(x.messages) > len(y.messages) or len(x.messages) = len(y.messages) and {_FIRST} then x.messages else y.messages end,
    summary_cards := case when len(x.summary_cards) > len(y.summary_cards) or len(x.summary_cards) = len(y.summary_cards) and {_FIRST} then x.summary_cards else y.summary_cards end,
    chat_summary := case when {_FIRST} then coalesce(nullif(x.chat_summary, ''), y.chat_summary) else coalesce(nullif(y.chat_summary, ''), x.chat_summary) end,
    name := case when {_FIRST} then x.name else y.name end,
    prefix := case when {_FIRST} then map_concat(y.prefix, x.prefix) else map_concat(x.prefix, y.prefix) end)"""


def _nested(t):
    n = F.col("message_count").cast("int")
    numbered = lambda count, name: F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), name)).otherwise(F.array().cast("array<string>"))
    o = F.col("ordinal").cast("string")
    return t.buckets.withColumns({
        "character_name": F.when(F.col("ordinal") % 5 == 0, F.upper("character_name")).otherwise(F.col("character_name")),
        "messages": numbered(n, lambda i: F.concat(o, F.lit("-"), i.cast("string"))),
        "summary_cards": numbered((F.col("ordinal") % 4).cast("int"), lambda i: F.concat(F.lit("c"), o, F.lit("-"), i.cast("string"))),
        "chat_summary": F.when(F.col("ordinal") % 3 == 0, "").otherwise(F.concat(F.lit("s"), o)),
        "auto_summary_last_end": F.col("ordinal") % 100,
        "reading_prefix_summary": F.expr("map(concat('b', ordinal % 3), concat('p', ordinal), concat('c', ordinal % 2), concat('q', ordinal))"),
    })


@query(
    "merge_conversations",
    f"""with {_NESTED}, g as (select {_ID} as ident, list(struct_pack(key := conversation_key, ms := epoch_us(updated_at) // 1000, n := 1, cursor := auto_summary_last_end, messages := messages,
          summary_cards := summary_cards, chat_summary := chat_summary, name := character_name, prefix := reading_prefix_summary) order by ordinal) as l from nested group by 1),
        m as (select list_reduce(l, lambda x, y: {_PAIR}) as m from g)
        select m.key as conversation_key, m.name as character_name, len(m.messages) as message_count, m.ms as updated_ms, m.n as merged, m.cursor as auto_summary_last_end, m.chat_summary as chat_summary,
          array_to_string(m.messages, ',') as messages, array_to_string(m.summary_cards, ',') as summary_cards,
          array_to_string(list_sort(list_transform(map_entries(m.prefix), lambda e: e.key || '=' || e.value)), ',') as prefix from m""",
)
def merge_conversations(t):
    got = C.merge_conversations(_nested(t))
    entries = F.array_sort(F.transform(F.map_entries("reading_prefix_summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return got.select(
        "conversation_key", "character_name", "message_count", "updated_ms", "merged", "auto_summary_last_end", "chat_summary",
        F.array_join("messages", ",").alias("messages"), F.array_join("summary_cards", ",").alias("summary_cards"), F.array_join(entries, ",").alias("prefix"),
    )


@query(
    "archive_options",
    f"""select ordinal, conversation_key from (select *, row_number() over (partition by {_ID} order by case when conversation_key = 'book:3::persona:1-URGENT::character:F' then 1 else 0 end desc, updated_at desc, ordinal) as r from {{buckets}}) where r = 1""",
)
def archive_options(t):
    return C.archive_options(t.buckets, "book:3::persona:1-URGENT::character:F").select("ordinal", "conversation_key")


@query(
    "archive_validity",
    """select ordinal, persona_name in ('1-URGENT', '2-HIGH') and character_name in ('F', 'O') as valid, character_name as shown_name from {buckets}""",
)
def archive_validity(t):
    personas = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "name string")
    characters = t.spark.createDataFrame([("F",), ("O",)], "name string")
    msgs = t.messages.select(F.col("conversation_key").cast("string").alias("conversation_key"), "msg_index", F.col("sender").alias("sender_name"))
    return C.archive_validity(t.buckets, personas, characters, msgs).select("ordinal", "valid", "shown_name")


@query(
    "merge_cards",
    """with m as (select owner_id, string_agg(content, chr(10) || chr(10) order by start, "end", created_at, card_id) as content, min(start) as start, max("end") as "end" from {summary_cards} where card_id % 3 = 0 group by owner_id having count(*) > 1)
       select c.owner_id, card_id, c.content, c.start, c."end" from {summary_cards} c left join m on m.owner_id = c.owner_id where card_id % 3 <> 0 or m.owner_id is null
       union all select owner_id, null, content, start, "end" from m""",
)
def merge_cards(t):
    cards = t.summary_cards
    return C.merge_cards(cards, cards.where("card_id % 3 = 0").select("owner_id", "card_id"))


_CHARS = "chars as (select c_custkey as character_id, 'Brand#' || (11 + c_custkey % 5) as a, 'Brand#' || (21 + c_custkey % 5) as b from {customer})"


def _characters(t):
    return t.customer.select(F.col("c_custkey").alias("character_id"), F.expr("array(concat('Brand#', 11 + c_custkey % 5), concat(' Brand#', 21 + c_custkey % 5, ' '), '')").alias("categories"))


@query("bind_lore", f"with {_CHARS} select distinct character_id, entry_id, category, position from chars c join {{lore_entries}} l on l.category in (c.a, c.b)")
def bind_lore(t):
    return C.bind_lore(_characters(t), t.lore_entries).select("character_id", "entry_id", "category", "position")


@query(
    "order_lore",
    """select entry_id, category, position, row_number() over (partition by category, position order by try_cast(regexp_extract(concat_ws(' ', title, content), '([0-9]+(?:[.][0-9]+)?)', 1) as double) nulls last, entry_id) as rank from {lore_entries}""",
)
def order_lore(t):
    return _longs(C.order_lore(t.lore_entries, ["category", "position"]).select("entry_id", "category", "position", "rank"))


@query(
    "bind_persona",
    """select c_custkey as character_id, min(s_suppkey) as persona_id from {customer} join {supplier} on s_nationkey = c_nationkey group by 1""",
)
def bind_persona(t):
    characters = t.customer.select(F.col("c_custkey").alias("character_id"), F.col("c_nationkey").cast("string").alias("name"))
    personas = t.supplier.select(F.col("s_suppkey").alias("persona_id"), F.array(F.col("s_nationkey").cast("string")).alias("bound_roles"))
    return C.bind_persona(characters, personas)


@query("newest_first", "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from {orders}")
def newest_first(t):
    return _longs(C.newest_first(t.orders, "o_orderdate", ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey", "rank"))


_TASKS = """tasks as (select user_id % 50 as conversation_key, case when event_id % 2 = 0 then 'chat' else 'book' end as kind, case when event_id % 11 = 0 then 'manual' else 'auto' end as trigger,
   cast(floor(value) as bigint) as start, cast(floor(value) as bigint) + 9 as "end", ts as created_at from {events})"""


@query(
    "next_summary_task",
    f"""with {_TASKS}, kept as (select * from tasks x where not (trigger = 'auto' and exists (select 1 from tasks m where m.conversation_key = x.conversation_key and m.kind = x.kind and m.trigger = 'manual'))),
        f as (select conversation_key, kind, trigger, start, "end", min(created_at) as created_at from kept group by all),
        s as (select *, case when kind = 'chat' then 2 else 1 end + case when trigger = 'manual' then 10 else 0 end as score from f)
        select conversation_key, kind, trigger, start, "end", score from (select *, row_number() over (partition by conversation_key order by score desc, created_at, start) as r from s) where r = 1""",
)
def next_summary_task(t):
    tasks = t.events.select(
        F.expr("user_id % 50").alias("conversation_key"), F.expr("case when event_id % 2 = 0 then 'chat' else 'book' end").alias("kind"), F.expr("case when event_id % 11 = 0 then 'manual' else 'auto' end").alias("trigger"),
        F.floor("value").alias("start"), (F.floor("value") + 9).alias("end"), F.col("ts").alias("created_at"),
    )
    return _longs(C.next_summary_task(tasks).drop("created_at"))


_EST = "case when length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) = 0 then 0 else greatest(1, cast(ceil(length(regexp_replace(text, '\\s+', '', 'g')) / 4.0) as bigint)) end"


@query("token_estimate", f"select doc_id, {_EST} as tokens from {{documents}}")
def token_estimate(t):
    return t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    "estimate_tokens",
    f"""with l as (select conversation_key as prompt_id, msg_index as line_no, case when sender = 'user' then 'chatRaw' when msg_index = 0 then 'worldBook' else 'chatSummary' end as section, content as text from {{messages}}),
        x as (select prompt_id, section, string_agg(text, chr(10) order by line_no) as text from l where text <> '' group by all),
        s as (select unnest(['userPersona', 'characterPersona', 'worldBook', 'bookExcerpt', 'bookSummary', 'chatRaw', 'chatSummary', 'otherInstructions']) as section)
        select p.prompt_id, s.section, {_EST} as tokens from (select distinct prompt_id from l) p cross join s left join x on x.prompt_id = p.prompt_id and x.section = s.section""",
)
def estimate_tokens(t):
    lines = t.messages.select(
        F.col("conversation_key").alias("prompt_id"), F.col("msg_index").alias("line_no"),
        F.expr("case when sender = 'user' then 'chatRaw' when msg_index = 0 then 'worldBook' else 'chatSummary' end").alias("section"), F.col("content").alias("text"),
    )
    return C.estimate_tokens(lines)


@query(
    "assemble_context",
    """with c as (select owner_id, string_agg(content, chr(10) order by start, "end", card_id) as cards from {summary_cards} s join {reader_progress} p on p.book_id = s.owner_id % 10 where s."end" <= p.safe_offset group by 1),
       e as (select doc_id as owner_id, text as excerpt from {documents}),
       h as (select owner_id, string_agg(snippet, chr(10) order by start, range_id) as snippets from (
              select h.book_id as owner_id, h.start, h.range_id, trim(substr(d.text, cast(h.start + 1 as integer), cast(h."end" - h.start as integer))) as snippet
              from {highlights} h join {documents} d on d.doc_id = h.book_id) where snippet <> '' group by 1),
       k as (select book_id as owner_id, string_agg(content, chr(10) || '---' || chr(10) order by chapter_index) as passages from {chapters} group by 1)
       select coalesce(c.owner_id, e.owner_id, k.owner_id, h.owner_id) as owner_id, concat_ws(chr(10) || chr(10), nullif(cards, ''), nullif(excerpt, ''), nullif(snippets, ''), nullif(passages, '')) as context
       from c full join e on e.owner_id = c.owner_id full join h on h.owner_id = coalesce(c.owner_id, e.owner_id) full join k on k.owner_id = coalesce(c.owner_id, e.owner_id, h.owner_id)""",
)
def assemble_context(t):
    # A reader's place in a book, so that no card tells what comes after it.
    cards = t.summary_cards.join(t.reader_progress, F.col("owner_id") % 10 == F.col("book_id")).select(*t.summary_cards.columns, "safe_offset")
    marked = t.highlights.select(F.col("book_id").alias("owner_id"), "range_id", "start", "end").join(t.documents.select(F.col("doc_id").alias("owner_id"), "text"), "owner_id")
    snippet = F.trim(F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    return C.assemble_context(
        cards,
        t.documents.select(F.col("doc_id").alias("owner_id"), F.col("text").alias("excerpt")),
        t.chapters.select(F.col("book_id").alias("owner_id"), F.col("chapter_index").alias("rank"), F.col("content").alias("text")),
        marked.select("owner_id", "start", "range_id", snippet.alias("snippet")),
    )


@query(
    "export_transcripts",
    """select conversation_key, 'Conversation ' || conversation_key || chr(10) || chr(10) || string_agg(sender || ' (' || strftime(ts, '%Y-%m-%d %H:%M') || '):' || chr(10) || content || case when id % 3 = 0 then chr(10) || '> ' || left(content, 200) else '' end, chr(10) || chr(10) order by ts, id) as text
       from {timed_messages} group by 1""",
)
def export_transcripts(t):
    m = t.timed_messages.withColumn("quote", F.when(F.col("id") % 3 == 0, F.col("content")).otherwise(""))
    return C.export_transcripts(m)


@query("conversation_keys", "select ordinal, concat('book:', book_id, '::persona:', persona_name, '::character:', character_name) as built, cast(book_id as varchar) as book_id, persona_name as persona_id, character_name as character_id from {buckets}")
def conversation_keys(t):
    p = T.parse_key(F.col("conversation_key"))
    built = T.conversation_key(F.col("book_id"), F.col("persona_name"), F.col("character_name"))
    return t.buckets.select("ordinal", built.alias("built"), p["book_id"].alias("book_id"), p["persona_id"].alias("persona_id"), p["character_id"].alias("character_id"))


_SQUEEZED = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"


@query(
    "prompt_records",
    f"""select id, '[发送者:' || sender || '][' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || {_SQUEEZED} ||
          case when id % 3 = 0 then ' [引用:发送者=Q' || id || ';时间=' || strftime(ts - interval 90 minute, '%Y-%m-%d %H:%M') || ';内容=' || {_SQUEEZED} || ']' else '' end as record, sender as name from {{timed_messages}}""",
)
def prompt_records(t):
    quote = F.concat(F.lit("Q"), F.col("id")), F.col("ts") - F.expr("interval 90 minutes"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(" \n"), F.col("content"), F.lit("\t")))
    record = T.prompt_record(F.col("sender"), F.col("ts"), F.concat(F.lit("  "), F.col("content"), F.lit("\n")), quote)
    return t.timed_messages.select("id", record.alias("record"), T.sender_name(record).alias("name"))


@query("migrate_prompt_records", f"""select id, '[发送者:' || sender || '][' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || {_SQUEEZED} as record from {{timed_messages}}""")
def migrate_prompt_records(t):
    role = F.when(F.col("sender") == "click", "[用户消息]").when(F.col("sender") == "view", "[角色消息]").otherwise("")
    old = F.concat(role, F.format_string("[发送者:%s][时间:%s]  ", F.col("sender"), T.minute_stamp(F.col("ts"))), F.col("content"))
    return t.timed_messages.select("id", T.migrate_prompt_record(old).alias("record"))


@query(
    "fill_placeholders",
    """select conversation_key, msg_index, 'Hi ' || '$1 A' || ', I am ' || sender || '. ' || '$1 A' || content as text from {messages}""",
)
def fill_placeholders(t):
    template = F.concat(F.lit("Hi {{char}}, I am {{USER}}. {{Char}}"), F.col("content"))
    return t.messages.select("conversation_key", "msg_index", T.fill_placeholders(template, F.lit("$1 A"), F.col("sender")).alias("text"))


@query(
    "identity_values",
    r"""select distinct lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as identity, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) as compact_length from {conversations}""",
)
def identity_values(t):
    return _longs(t.conversations.select(T.identity_value(F.col("text")).alias("identity"), F.length(T.compact(F.col("text"))).alias("compact_length")).distinct())
