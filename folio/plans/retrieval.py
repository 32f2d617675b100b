"""Queries over passages, query vectors and the index."""

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import retrieval as R
from folio.plans.registry import query

_CLEAN_Q = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(query_text, '\s+\n', chr(10), 'g'), '\n\s+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')))"""
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, '\s+\n', chr(10), 'g'), '\n\s+', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), ' ' || chr(10))"""
_TERMS = f"""found as (select query_id, query_vec, regexp_extract_all({_CLEAN_Q}, '[a-z0-9][a-z0-9]+') as f from {{queries}}),
  named as (select query_id, list_slice(list(term order by i), 1, 12) as terms from (
     select query_id, term, min(i) as i from (select query_id, unnest(f) as term, generate_subscripts(f, 1) as i from found) group by all) group by query_id),
  terms as (select f.query_id, f.query_vec, coalesce(n.terms, []) as terms from found f left join named n on n.query_id = f.query_id)"""
_SCORED = f"""{_TERMS}, scored as (
  select query_id, chunk_id, book_id, start_offset, end_offset, text,
    round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: cast(embedding[i] as double) * cast(query_vec[i] as double)))
      + 0.08 * coalesce(list_sum(list_transform(list_filter(terms, lambda w: contains(lower(coalesce(text, '')), w)), lambda w: case when len(w) >= 6 then 1.2 when len(w) >= 4 then 1.0 else 0.7 end)), 0), 6) as score
  from {{chunks}} cross join terms)"""
_SAFE = "safe as (select s.* from scored s join {reader_progress} p on p.book_id = s.book_id and s.end_offset <= p.safe_offset)"


def _top(src, name, k):
    return f"""{name} as (select * from (select *, row_number() over (partition by query_id, book_id order by score desc, chunk_id) as rank_in_book from {src}) where rank_in_book <= {k})"""


def _robin(src, name, k):
    return f"""{name}_b as (select *, max(score) over (partition by query_id, book_id) as best from {src}),
      {name}_r as (select *, dense_rank() over (partition by query_id order by best desc, book_id) as book_rank from {name}_b),
      {name} as (select * from (select *, row_number() over (partition by query_id order by rank_in_book, book_rank) as rank from {name}_r) where rank <= {k})"""


_COLS = ["query_id", "chunk_id", "book_id", "score", "rank"]


def _out(df, cols=_COLS):
    return df.select(*[F.col(c).cast("long").alias(c) if c != "score" else F.col(c) for c in cols])


_LIST = "query_id, chunk_id, cast(book_id as bigint) as book_id, score, rank"


@query("retrieval_spoiler_safe", f"with {_SCORED}, {_SAFE}, {_top('safe', 'top', 2)}, {_robin('top', 'got', 5)} select {_LIST} from got")
def retrieval_spoiler_safe(t):
    return _out(R.retrieve(t.queries, t.chunks, t.reader_progress))


@query("retrieval_all_books", f"with {_SCORED}, {_top('scored', 'top', 2)}, {_robin('top', 'got', 5)} select {_LIST} from got")
def retrieval_all_books(t):
    return _out(R.retrieve(t.queries, t.chunks))


@query("retrieve_safe", f"with {_SCORED}, {_SAFE}, {_top('safe', 'top', 5)} select query_id, chunk_id, cast(book_id as bigint) as book_id, score, rank_in_book as rank from top")
def retrieve_safe(t):
    return _out(R.retrieve_safe(t.queries, t.chunks, t.reader_progress))


@query(
    "retrieve_safe_global",
    f"""with {_SCORED}, {_SAFE}, {_top('scored', 'wide', 8)}, {_robin('wide', 'fetched', 80)},
        first as (select * exclude (rank, n), n as rank from (select f.*, row_number() over (partition by query_id order by rank) as n from fetched f join {{reader_progress}} p on p.book_id = f.book_id and f.end_offset <= p.safe_offset) where n <= 5),
        {_top('safe', 'top2', 2)}, {_robin('top2', 'fill', 5)},
        pool as (select query_id, chunk_id, book_id, score, rank, 1 as pass from first union all
                 select query_id, chunk_id, book_id, score, rank, 2 from fill f where not exists (select 1 from first x where x.query_id = f.query_id and x.chunk_id = f.chunk_id))
        select query_id, chunk_id, cast(book_id as bigint) as book_id, score, n as rank from (select *, row_number() over (partition by query_id order by pass, rank) as n from pool) where n <= 5""",
)
def retrieve_safe_global(t):
    return _out(R.retrieve_safe_global(t.queries, t.chunks, t.reader_progress))


@query("within_progress", "select chunk_id, cast(c.book_id as bigint) as book_id, start_offset, end_offset from {chunks} c join {reader_progress} p on p.book_id = c.book_id and c.end_offset <= p.safe_offset")
def within_progress(t):
    return R.within_progress(t.chunks, t.reader_progress).select("chunk_id", F.col("book_id").cast("long").alias("book_id"), "start_offset", "end_offset")


@query("query_terms", f"with {_TERMS} select query_id, array_to_string(terms, ',') as terms from terms")
def query_terms(t):
    return t.queries.select("query_id", F.array_join(T.query_terms(F.col("query_text")), ",").alias("terms"))


@query(
    "cosine",
    """select q.query_id, c.chunk_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: cast(embedding[i] as double) * cast(query_vec[i] as double))), 6) as cosine
       from {queries} q cross join {chunks} c""",
)
def cosine(t):
    return R.score_pairs(t.queries.select("query_id", "query_vec"), t.chunks).select("query_id", "chunk_id", F.col("score").alias("cosine"))


@query(
    "hybrid_score",
    f"with {_SCORED} select query_id, chunk_id, score from scored",
)
def hybrid_score(t):
    return R.score_pairs(t.queries, t.chunks).select("query_id", "chunk_id", "score")


@query("topk_per_book", f"with {_SCORED}, {_top('scored', 'top', 3)} select query_id, chunk_id, cast(book_id as bigint) as book_id, score, rank_in_book from top")
def topk_per_book(t):
    return _out(R.topk_per_book(R.best_pairs(t.queries, t.chunks, 3), 3), ["query_id", "chunk_id", "book_id", "score", "rank_in_book"])


_META = """meta as (select book_id, count(*) as chunk_count, cast(max(end_offset) as bigint) as indexed_up_to, case when book_id % 3 = 0 then 'old' else 'sig' end as content_signature,
   'm' || (book_id % 2) as model_id from {chunks} group by book_id)"""
#: Books with a multiple of four passages count as not indexed yet.
_SOME = "indexed as (select * from meta where chunk_count % 4 <> 0)"


def _meta(t):
    m = t.chunks.groupBy("book_id").agg(F.count("*").alias("chunk_count"), F.max("end_offset").alias("indexed_up_to"))
    return m.withColumn("content_signature", F.expr("case when book_id % 3 = 0 then 'old' else 'sig' end")).withColumn("model_id", F.expr("concat('m', book_id % 2)"))


def _targets(t):
    return t.reader_progress.select("book_id", F.lit("sig").alias("content_signature"), (F.col("safe_offset") * 2).alias("target"))


_NEED = """need as (select p.book_id, p.safe_offset * 2 as target, m.book_id is null or chunk_count <= 0 or content_signature <> 'sig' or p.safe_offset * 2 > indexed_up_to as needs_index
   from {reader_progress} p left join indexed m on m.book_id = p.book_id)"""


@query("needs_index", f"with {_META}, {_SOME}, {_NEED} select cast(book_id as bigint) as book_id, needs_index from need")
def needs_index(t):
    return R.needs_index(_targets(t), _meta(t).where("chunk_count % 4 <> 0")).select(F.col("book_id").cast("long").alias("book_id"), "needs_index")


@query("index_backlog", f"with {_META}, {_SOME}, {_NEED} select cast(book_id as bigint) as book_id, row_number() over (order by book_id = 5 desc, target desc, book_id) as rank from need where needs_index")
def index_backlog(t):
    books = _targets(t).withColumn("last_read_at", F.col("target"))
    return _out(R.index_backlog(books, _meta(t).where("chunk_count % 4 <> 0"), F.col("book_id") == 5), ["book_id", "rank"])


@query("build_index_meta", f"""select cast(book_id as bigint) as book_id, count(*) as chunk_count, greatest(max(end_offset), any_value(5000 + 1000 * book_id)) as indexed_up_to, 's' as content_signature from {{chunks}} group by book_id""")
def build_index_meta(t):
    signed = t.chunks.select("book_id", F.lit("s").alias("content_signature")).distinct()
    got = R.build_index_meta(t.chunks, signed, t.reader_progress.select("book_id", F.col("safe_offset").alias("target")))
    return got.withColumn("book_id", F.col("book_id").cast("long"))


@query(
    "route_by_model",
    f"""with {_META} select c.chunk_id, m.model_id, q.query_id from {{chunks}} c join meta m on m.book_id = c.book_id
        join (select query_id, 'm' || (query_id % 2) as model_id from {{queries}}) q on q.model_id = m.model_id""",
)
def route_by_model(t):
    vectors = t.queries.select("query_id", F.expr("concat('m', query_id % 2)").alias("model_id"), "query_vec")
    return R.route_by_model(t.chunks, _meta(t), vectors).select("chunk_id", "model_id", "query_id")


@query(
    "build_query_text",
    """with m as (select *, row_number() over (partition by conversation_key order by msg_index desc) as r, sender = 'user' and not sent_to_ai as p from {messages}),
       s as (select *, max(case when p then 1 else 0 end) over (partition by conversation_key) as s from m)
       select conversation_key, right(string_agg(content, chr(10) order by msg_index), 1200) as query_text from s where s = 1 and p or s = 0 and r <= 6 group by 1""",
)
def build_query_text(t):
    return R.build_query_text(t.messages)


@query(
    "note_query_text",
    f"""select doc_id, right(case when reply <> '' and note <> '' then reply || chr(10) || note when reply <> '' then reply else note end, 1200) as query_text
        from (select doc_id, {_CLEAN.format("text")} as note, case when doc_id % 3 = 0 then '' else 'Tell me about ' || source end as reply from {{documents}})""",
)
def note_query_text(t):
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("Tell me about "), "source"))
    return t.documents.select("doc_id", R.note_query_text(F.col("text"), reply).alias("query_text"))


@query(
    "content_signature",
    f"""with c as (select book_id, chapter_index, title, {_CLEAN.format("content")} as t from {{chapters}}),
        b as (select book_id, 'sentence-v1' || count(*) || string_agg(chapter_index || '|' || title || '|' || length(t) || '|' || left(t, 80) || '|' || right(t, 80), '' order by chapter_index) as fed from c group by 1)
        select book_id, printf('%x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(fed, ''), lambda c: cast(ord(c) as bigint))), lambda h, x: (xor(h, x) * 16777619) & 4294967295)) as content_signature from b""",
)
def content_signature(t):
    return R.content_signature(t.chapters)


@query("embed")
def embed(t):
    got = R.embed(t.chunks.select("chunk_id", "text"), "text")
    return got.select("chunk_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm2"))
