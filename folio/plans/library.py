"""Queries over books, storage, quizzes and entries."""

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import library as L
from folio.plans.registry import query


def _longs(df):
    return df.select(*[F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes])


@query("search_books", "select book_id, title, author from {books} where (contains(lower(title), 'src1') or contains(lower(author), 'src1')) and list_has_all(tags, ['en', 'src1'])")
def search_books(t):
    return L.search_books(t.books, "SRC1", ["en", "src1"]).select("book_id", "title", "author")


@query("search_goals", "select book_id from {books} where contains(lower(concat_ws(' ', title, title, author, array_to_string(tags, ' '))), 'src7 fr')")
def search_goals(t):
    return L.search_goals(t.books.withColumn("label", F.col("title")), "Src7 FR").select("book_id")


@query("all_tags", "select distinct tag from (select trim(unnest(tags)) as tag from {books}) where tag <> ''")
def all_tags(t):
    return L.all_tags(t.books)


@query("label_books", "select book_id, case when row_number() over (partition by title order by book_id) > 1 then title || ' (' || right(cast(book_id as varchar), 4) || ')' else title end as label from {books}")
def label_books(t):
    return L.label_books(t.books)


@query("sort_books", "select book_id, full_text_length from {books} order by full_text_length desc, book_id")
def sort_books(t):
    return L.sort_books(t.books, "full_text_length", ascending=False).select("book_id", "full_text_length")


@query(
    "storage_breakdown",
    """with s as (select store, sum(strlen(key) + strlen(value)) as bytes from {storage_records} group by 1),
       c as (select unnest(range(9)) as ordinal, unnest(['content', 'chat', 'pages', 'embeddings', 'notebooks', 'quizzes', 'quotes', 'audio', 'other']) as category)
       select ordinal, category, cast(coalesce(bytes, 0) as bigint) as bytes, round(100.0 * coalesce(bytes, 0) / (select sum(bytes) from s), 6) as percent from c left join s on s.store = c.category""",
)
def storage_breakdown(t):
    return _longs(L.storage_breakdown(t.storage_records).withColumn("percent", F.round("percent", 6)))


@query("bytes_by", "select store, book_id, cast(sum(strlen(value)) as bigint) as bytes, count(*) as records from {storage_records} group by rollup (store, book_id)")
def bytes_by(t):
    return L.bytes_by(t.storage_records, ["store", "book_id"])


@query("format_bytes", """select store, key, case when n <= 0 then '0 B' when n < 1024 then n || ' B' else
   case when n / 1024.0 >= 100 then printf('%.0f', floor(n / 1024.0 * 1 + 0.5) / 1) when n / 1024.0 >= 10 then printf('%.1f', floor(n / 1024.0 * 10 + 0.5) / 10) else printf('%.2f', floor(n / 1024.0 * 100 + 0.5) / 100) end || ' KB' end as size from (select store, key, strlen(value) as n from {storage_records})""")
def format_bytes(t):
    return t.storage_records.select("store", "key", T.format_bytes(F.octet_length("value")).alias("size"))


@query(
    "categorise_resources",
    """with o as (select ps as resource_id, arg_min(category, priority) as category from (
         select l_partkey as ps, case l_linenumber % 3 when 0 then 'covers' when 1 then 'avatars' else 'backgrounds' end as category, l_orderkey * 10 + l_linenumber as priority from {lineitem} where l_returnflag = 'R') group by 1)
       select p_partkey as resource_id, coalesce(category, 'other') as category from {part} left join o on o.resource_id = p_partkey""",
)
def categorise_resources(t):
    owners = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("resource_id"), F.expr("case l_linenumber % 3 when 0 then 'covers' when 1 then 'avatars' else 'backgrounds' end").alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("priority")
    )
    return L.categorise_resources(t.part.select(F.col("p_partkey").alias("resource_id")), owners)


@query(
    "score_quizzes",
    """select session_id, count(*) as questions, sum(case when answer = correct then 1 else 0 end) as correct, count(*) as answered, cast(round(100.0 * sum(case when answer = correct then 1 else 0 end) / count(*)) as bigint) as percent, false as incomplete
       from {quiz_answers} group by 1""",
)
def score_quizzes(t):
    a = t.quiz_answers.select("session_id", "question_id", F.array("answer").alias("answer"), F.array("correct").alias("correct"))
    return _longs(L.score_quizzes(a))


@query("count_entries", "select category, count(*) as entries from {lore_entries} group by 1")
def count_entries(t):
    return L.count_by(t.lore_entries, "category", "entries")


@query("count_comments", "select conversation_key, count(*) as comments from {messages} where sender = 'user' group by 1")
def count_comments(t):
    return L.count_by(t.messages.where("sender = 'user'"), "conversation_key", "comments")


@query(
    "move_entry",
    """with r as (select *, row_number() over (partition by category, position order by entry_id) * 2 as r from {lore_entries}),
       m as (select *, case when entry_id = 41 and max(case when entry_id = (select max(entry_id) from r x where x.category = (select category from r where entry_id = 41) and x.position = (select position from r where entry_id = 41)) then r end) over (partition by category, position) is not null
             then max(case when entry_id = (select max(entry_id) from r x where x.category = (select category from r where entry_id = 41) and x.position = (select position from r where entry_id = 41)) then r end) over (partition by category, position) - 1 else r end as m from r)
       select entry_id, category, position, row_number() over (partition by category, position order by m, entry_id) as rank from m""",
)
def move_entry(t):
    entries = t.lore_entries
    own = entries.where("entry_id = 41").select("category", "position")
    target = entries.join(own, ["category", "position"]).agg(F.max("entry_id")).first()[0]
    return _longs(L.move_entry(entries, 41, target).select("entry_id", "category", "position", "rank"))


@query(
    "unique_names",
    """with e as (select distinct source as name from {documents} where lang = 'de'),
       r as (select doc_id as id, source as name, row_number() over (partition by source order by doc_id) - 1 + case when source in (select name from e) then 1 else 0 end as i from {documents})
       select id, case when i = 0 then name else name || ' (' || (i + 1) || ')' end as name from r""",
)
def unique_names(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    return L.unique_names(d, t.documents.where("lang = 'de'").select(F.col("source").alias("name")))


@query(
    "upsert",
    """select c_custkey, c_name, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from {customer}
       union all select c_custkey + 1000000, c_name, c_acctbal from {customer} where c_acctbal < 0""",
)
def upsert(t):
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    changed = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return L.upsert(c, changed.unionByName(c.where("c_acctbal < 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)), ["c_custkey"])


@query("delete_by_book", "select chunk_id, cast(book_id as bigint) as book_id from {chunks} where book_id % 3 <> 0")
def delete_by_book(t):
    gone = t.chunks.where("book_id % 3 = 0").select("book_id").distinct()
    return L.delete_by_book(t.chunks, gone).select("chunk_id", F.col("book_id").cast("long").alias("book_id"))
