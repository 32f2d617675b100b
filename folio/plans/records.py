"""Queries over sources, sinks, validated records and replies."""

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import replies as P
from folio.plans.registry import query
from folio.plans.texts import BLOCK_SPACE
from folio.sources import corpus as S


def _longs(df):
    return df.select(*[F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes])


@query("decode_text", f"select doc_id, {BLOCK_SPACE.format('text')} as text from {{documents}}")
def decode_text(t):
    d = t.documents
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.encode("text", "UTF-8"))
    return S.decode_text(d.select("doc_id", raw.alias("content")), ["doc_id"], "content")


@query("read_lore_cards", """select p_partkey as card, 'N' as name, p_name as title, p_type as content, case when p_partkey % 2 = 0 then 'BEFORE' else 'AFTER' end as position, cast(p_size as double) as sort_order, 0 as entry_index from {part} where p_partkey % 10 <> 3""")
def read_lore_cards(t):
    entry = F.struct(F.col("p_name").alias("comment"), F.col("p_type").alias("content"), F.expr("if(p_partkey % 2 = 0, 'before_char', 'after_char')").alias("position"), F.col("p_size").alias("insertion_order"))
    card = F.to_json(F.struct(F.struct(F.lit("N").alias("name"), F.struct(F.array(entry).alias("entries")).alias("character_book")).alias("data")))
    return _longs(S.read_lore_cards(t.part.select(F.col("p_partkey").alias("card"), F.when(F.col("p_partkey") % 10 == 3, F.lit("{broken")).otherwise(card).alias("json")), ["card"]))


@query("normalize_cards", """select owner_id, card_id, content, greatest(0, start - 1000) as start, greatest(greatest(0, start - 1000), "end" - 2000) as "end" from {summary_cards} where card_id % 5 <> 0""")
def normalize_cards(t):
    c = t.summary_cards.select("owner_id", "card_id", F.expr("case when card_id % 5 = 0 then ' ' else concat(content, ' ') end").alias("content"), (F.col("start") - 1000).alias("start"), (F.col("end") - 2000).alias("end"))
    return S.normalize_cards(c)[0]


@query("normalize_chapters", "select book_id, chapter_index, case when chapter_index % 2 = 0 then '未命名章节' else title end as title, content from {chapters}")
def normalize_chapters(t):
    c = t.chapters.withColumn("title", F.expr("case when chapter_index % 2 = 0 then '  ' else title end"))
    return _longs(S.normalize_chapters(c)[0])


@query("normalize_messages", r"""select conversation_key, msg_index, sender, trim(regexp_replace(content, '\s+', ' ', 'g')) as content from {messages} where msg_index % 4 <> 3""")
def normalize_messages(t):
    m = t.messages.withColumn("sender", F.expr("case when msg_index % 4 = 3 then 'system' else sender end"))
    return S.normalize_messages(m)[0].select("conversation_key", "msg_index", "sender", "content")


@query("normalize_embeddings", "select chunk_id, cast(book_id as bigint) as book_id from {chunks} where text is not null and chunk_id % 9 <> 0")
def normalize_embeddings(t):
    c = t.chunks.withColumn("end_offset", F.expr("case when chunk_id % 9 = 0 then start_offset - 1 else end_offset end"))
    return S.normalize_embeddings(c)[0].select("chunk_id", F.col("book_id").cast("long").alias("book_id"))


@query("normalize_bookmarks", "select book_id, bookmark_id, global_char_offset - 100 as global_char_offset from {bookmarks} where global_char_offset >= 100")
def normalize_bookmarks(t):
    return S.normalize_bookmarks(t.bookmarks.withColumn("global_char_offset", F.col("global_char_offset") - 100))[0].select("book_id", "bookmark_id", "global_char_offset")


@query("normalize_buckets", "select ordinal, conversation_key, persona_name from {buckets} where ordinal % 6 <> 0")
def normalize_buckets(t):
    b = t.buckets.withColumn("conversation_key", F.expr("case when ordinal % 6 = 0 then '' else conversation_key end")).withColumn("persona_name", F.concat(F.lit("  "), "persona_name"))
    return S.normalize_buckets(b)[0].select("ordinal", "conversation_key", "persona_name")


@query("normalize_blocks", "select p_partkey as book_id, case when p_partkey % 3 = 0 then 'image' else 'text' end as type, case when p_partkey % 3 = 0 then p_size end as width from {part} where p_partkey % 3 <> 0 or p_partkey % 2 = 0")
def normalize_blocks(t):
    b = t.part.select(
        F.col("p_partkey").alias("book_id"), F.expr("case when p_partkey % 3 = 0 then 'image' else 'text' end").alias("type"), F.expr("case when p_partkey % 3 <> 0 then p_name end").alias("text"),
        F.expr("case when p_partkey % 6 = 0 then p_type end").alias("image_ref"), F.expr("case when p_partkey % 3 = 0 then p_size end").alias("width"),
    )
    return _longs(S.normalize_blocks(b)[0].select("book_id", "type", "width"))


@query("normalize_index_meta", "select cast(book_id as bigint) as book_id, count(*) - 49 as chunk_count from {chunks} group by book_id having count(*) >= 49")
def normalize_index_meta(t):
    m = t.chunks.groupBy("book_id").agg((F.count("*") - 49).alias("chunk_count"), F.max("end_offset").alias("indexed_up_to")).withColumn("content_signature", F.lit(" "))
    return S.normalize_index_meta(m)[0].select(F.col("book_id").cast("long").alias("book_id"), "chunk_count")


@query("archive_round_trip", "select 'customer' as name, count(*) as records, cast(sum(c_custkey) as bigint) as keys from {customer} union all select 'orders', count(*), cast(sum(o_orderkey) as bigint) from {orders}")
def archive_round_trip(t):
    from folio.streaming.streams import _folder

    path = _folder(t.spark, "archive")
    S.export_archive(t.spark, {"customer": t.customer, "orders": t.orders}, path, "2024-01-01T00:00:00Z")
    back = S.restore_archive(t.spark, path)
    total = lambda n, k: back[n].agg(F.lit(n).alias("name"), F.count("*").alias("records"), F.sum(k).alias("keys"))
    return total("customer", "c_custkey").unionByName(total("orders", "o_orderkey"))


@query("parse_replies", r"""select conversation_key, msg_index, case when n = 0 then 0 else least(3, greatest(2, n)) end as n, 'quoted' as underline
      from (select *, len(list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')) as n from {messages})""")
def parse_replies(t):
    m = t.messages.select("conversation_key", "msg_index", F.concat(F.coalesce("content", F.lit("")), F.lit("\n<underline> quoted </underline>")).alias("reply"))
    return P.parse_replies(m, ["conversation_key", "msg_index"], 2, 3).select("conversation_key", "msg_index", F.size("bubbles").cast("long").alias("n"), "underline")


@query(
    "restore_old_archive",
    r"""select conv_id as conversation_key, count(*) as messages, cast(sum(len(text)) as bigint) as characters from {conversations} group by conv_id""",
)
def restore_old_archive(t):
    """Each conversation as a JSON object in the settings, as archives of old have it, restored in place of other tables."""
    from folio.streaming.streams import _folder

    talks = t.conversations.groupBy(F.col("conv_id").cast("string").alias("k")).agg(F.collect_list(F.struct("turn", "text")).alias("messages"))
    settings = talks.select(F.lit("chat_history").alias("key"), F.to_json(F.create_map("k", F.struct("messages"))).alias("value"))
    path, live = _folder(t.spark, "archive"), _folder(t.spark, "live")
    S.export_archive(t.spark, {"settings": settings}, path, "2024-01-01T00:00:00Z")
    S.replace_all(S.restore_archive(t.spark, path), live, {"images": "image_ref string, data_url string"})
    kind = "messages array<struct<turn:long,text:string>>"
    back = S.live_tables(t.spark, live)["conversations"].select("conversation_key", F.from_json("bucket", kind)["messages"].alias("m"))
    characters = F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
    return back.select(F.col("conversation_key").cast(t.conversations.schema["conv_id"].dataType).alias("conversation_key"), F.size("m").cast("long").alias("messages"), characters.alias("characters"))


@query(
    "parse_comments",
    r"""with m as (select *, trim(content, e' \n\r\t') as bare from {messages} where content <> '')
       select conversation_key, msg_index, case when msg_index % 3 = 0 then trim(split_part(bare, chr(10), 1), e' \n\r\t') || chr(10) || 'end' else bare end as comment from m""",
)
def parse_comments(t):
    content = F.when(F.col("msg_index") % 3 == 0, F.concat(F.lit("[评论] "), T.strip(F.col("content")), F.lit("\n【评论】end "))).otherwise(F.col("content"))
    m = t.messages.where("content <> ''").select("conversation_key", "msg_index", content.alias("reply"))
    return P.parse_replies(m, ["conversation_key", "msg_index"], 1, 1).select("conversation_key", "msg_index", "comment")


@query(
    "parse_sticky_notes",
    r"""select conversation_key, msg_index, regexp_replace(trim(content, e' \n\r\t'), '\n\n\n+', chr(10) || chr(10), 'g') as sticky_note from {messages} where content <> ''""",
)
def parse_sticky_notes(t):
    k = F.col("msg_index") % 3
    wrapped = F.when(k == 0, F.concat(F.lit("Here:\n<Sticky_Note>\n"), "content", F.lit("</sticky_note> done"))).when(k == 1, F.concat(F.lit("so\n```markdown\n"), "content", F.lit("\n```"))).otherwise(F.col("content"))
    m = t.messages.where("content <> ''").select("conversation_key", "msg_index", wrapped.alias("reply"))
    return P.parse_replies(m, ["conversation_key", "msg_index"], 1, 1).select("conversation_key", "msg_index", "sticky_note")


@query("parse_quiz_json", "select p_partkey, case when p_partkey % 4 = 0 then 0 when p_partkey % 4 = 1 then 1 else 2 end as questions from {part}")
def parse_quiz_json(t):
    q = lambda correct: F.struct(F.col("p_name").alias("question"), F.array("p_type", "p_brand").alias("options"), F.array(correct).alias("correct"), F.lit("single").alias("type"))
    two = F.to_json(F.array(q(F.lit(0)), q(F.when(F.col("p_partkey") % 4 == 1, 7).otherwise(1))))
    text = F.concat(F.lit("Here:\n```json\n"), F.when(F.col("p_partkey") % 4 == 0, F.lit("[{oops]")).otherwise(two), F.lit("\n```"))
    return _longs(t.part.select("p_partkey", F.size(P.parse_quiz_json(text)).alias("questions")))


@query("position_from_progress", "select o_orderkey, cast(case when o_orderkey % 3 = 0 then 1 else least(floor(o_orderkey % 101 / 100.0 * 10), 9) end as bigint) as chapter_index, cast(floor(o_orderkey % 101 / 100.0 * 5000) as bigint) as global_char_offset from {orders}")
def position_from_progress(t):
    b = t.orders.select("o_orderkey", F.expr("cast(o_orderkey % 101 as double)").alias("progress"), F.expr("case when o_orderkey % 3 = 0 then cast(1 as bigint) end").alias("chapter_index"), F.lit(None).cast("long").alias("global_char_offset"), F.lit(10).alias("chapter_count"), F.lit(5000).alias("full_text_length"))
    return P.position_from_progress(b).select("o_orderkey", F.col("chapter_index").cast("long").alias("chapter_index"), F.col("global_char_offset").cast("long").alias("global_char_offset"))


@query("image_types", "select p_partkey, case p_partkey % 4 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'image/gif' end as mime from {part}")
def image_types(t):
    head = F.expr("case p_partkey % 4 when 0 then '89504E470D0A1A0A' when 1 then 'FFD8FFE0' when 2 then '474946383961' else '00' end")
    return t.part.select("p_partkey", T.image_mime(F.concat(F.unhex(head), F.encode("p_name", "UTF-8"))).alias("mime"))
