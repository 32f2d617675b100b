"""Passage retrieval: hybrid scores, top-k by book, round-robin fusion, and the index's life cycle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import fnv1a32_value, let, sanitize
from folio.operators.scoring import score_blocks
from folio.operators.staging import cut, numbered

TOP_K = 5
PER_BOOK = 2


def score_pairs(queries: DataFrame, chunks: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Hybrid score of each query with each chunk in its scope (query_id, book_id); without a scope, with every chunk.

    For rankings take ``best_pairs``, which puts out no more than they need. Without a query_text a score is the cosine alone.
    """
    return score_blocks(queries, chunks, None, scope).drop("safe")


def best_pairs(queries: DataFrame, chunks: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """The pairs of which a ranking of ``k`` for each query and book needs no more."""
    return score_blocks(queries, chunks, [(k, False)], scope).drop("safe")


def with_passages(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``found`` with the text of its passages."""
    return found.join(chunks.select("book_id", "chunk_id", "text"), ["book_id", "chunk_id"])


def within_progress(df: DataFrame, safe: DataFrame) -> DataFrame:
    """Rows that end at or before the reader's safe offset in their book."""
    return df.join(safe.select("book_id", "safe_offset"), "book_id").where("end_offset <= safe_offset").drop("safe_offset")


def topk_per_book(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query and book; equal scores keep the earlier chunk id."""
    order = Window.partitionBy("query_id", "book_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank_in_book", F.row_number().over(order)).where(F.col("rank_in_book") <= k)


def round_robin(ranked: DataFrame, k: int = TOP_K) -> DataFrame:
    """First of each book, best book first, then seconds, and so on: k for each query."""
    best = F.max("score").over(Window.partitionBy("query_id", "book_id"))
    books = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "book_id"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("rank_in_book", "book_rank"))
    return ranked.withColumn("best", best).withColumn("book_rank", books).withColumn("rank", turn).where(F.col("rank") <= k).drop("best", "book_rank")


def retrieve(queries: DataFrame, chunks: DataFrame, safe: DataFrame | None = None, k: int = TOP_K, per_book: int = PER_BOOK) -> DataFrame:
    scored = best_pairs(queries, chunks if safe is None else within_progress(chunks, safe), per_book)
    return round_robin(topk_per_book(scored, per_book), k)


def retrieve_safe(queries: DataFrame, chunks: DataFrame, safe: DataFrame, k: int = TOP_K) -> DataFrame:
    """Book by book: filtering first gives what over-fetching, filtering and refilling gives."""
    ranked = topk_per_book(best_pairs(queries, within_progress(chunks, safe), k), k)
    return ranked.withColumnRenamed("rank_in_book", "rank")


def fill_unseen(selected: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The selected rows, then candidates that are not among them, up to k for each query."""
    new = candidates.join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = selected.withColumn("pass", F.lit(1)).unionByName(new.withColumn("pass", F.lit(2)))
    order = Window.partitionBy("query_id").orderBy("pass", "rank")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("pass")


def retrieve_safe_global(queries: DataFrame, chunks: DataFrame, safe: DataFrame, k: int = TOP_K) -> DataFrame:
    """Over all books: over-fetch, keep the safe ones, fill up from the safe scope. Both passes rank one scoring."""
    n = max(1, safe.select("book_id").distinct().count())
    wide, each, fill = max(6 * k, 8 * n), 8, 2
    if n == 1:
        each, fill = wide, k
    known = chunks.join(safe.select("book_id", "safe_offset"), "book_id").withColumn("safe", F.col("end_offset") <= F.col("safe_offset"))
    scored = cut(score_blocks(queries, known, [(each, False), (fill, True)]))
    fetched = round_robin(topk_per_book(scored, each), wide)
    order = Window.partitionBy("query_id").orderBy("rank")
    first = fetched.where("safe").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return fill_unseen(first, round_robin(topk_per_book(scored.where("safe"), fill), k), k).drop("safe")


def route_by_model(chunks: DataFrame, meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each chunk beside the query vectors of its own book's model: ``vectors`` (query_id, model_id, query_vec)."""
    return chunks.join(meta.select("book_id", "model_id"), "book_id").join(vectors, "model_id")


def build_query_text(messages: DataFrame, last: int = 6, size: int = 1200) -> DataFrame:
    """For each conversation the pending user messages, else its last ones, joined; the last ``size`` characters."""
    rank = F.row_number().over(Window.partitionBy("conversation_key").orderBy(F.desc("msg_index")))
    pending = (F.col("sender") == "user") & ~F.col("sent_to_ai")
    some = F.max(pending.cast("int")).over(Window.partitionBy("conversation_key"))
    used = messages.withColumn("_r", rank).withColumn("_p", pending).withColumn("_s", some).where((F.col("_s") == 1) & F.col("_p") | (F.col("_s") == 0) & (F.col("_r") <= last))
    # Only a conversation's own few last or pending messages are gathered.
    parts = F.transform(F.array_sort(F.collect_list(F.struct("msg_index", "content"))), lambda m: m["content"])
    return used.groupBy("conversation_key").agg(F.array_join(parts, "\n").alias("text")).select("conversation_key", F.expr(f"right(text, {size})").alias("query_text"))


def note_query_text(note: Column, reply: Column, size: int = 1200) -> Column:
    """The query for a note: the user's last reply, then the note, both sanitised; the last ``size`` characters."""
    parts = [F.nullif(sanitize(F.coalesce(x, F.lit(""))), F.lit("")) for x in (reply, note)]
    return F.right(F.concat_ws("\n", *parts), F.lit(size))


def content_signature(chapters: DataFrame, strategy: str = "sentence-v1") -> DataFrame:
    """A hash of each book's chapters, from counts, titles, lengths, heads and tails; changes when the text does."""
    return _signed(chapters, strategy).drop("_total")


def _signed(chapters: DataFrame, strategy: str = "sentence-v1") -> DataFrame:
    """Signature and clean length of each book, from one pass in which each text is cleaned once."""
    said = lambda text: F.struct(F.length(text).alias("n"), F.substring(text, 1, 80).alias("head"), F.right(text, F.lit(80)).alias("tail"))
    chapters = chapters.select("book_id", "chapter_index", "title", let(sanitize(F.col("content")), said).alias("_s"))
    part = F.concat_ws("|", F.col("chapter_index"), F.coalesce("title", F.lit("")), F.col("_s.n"), F.col("_s.head"), F.col("_s.tail"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", part.alias("p")))), lambda s: s["p"])
    fed = F.concat(F.lit(strategy), F.count("*").cast("string"), F.array_join(parts, ""))
    return chapters.groupBy("book_id").agg(F.lower(F.hex(fnv1a32_value(fed))).alias("content_signature"), F.sum(F.col("_s.n").cast("long")).alias("_total"))


def build_index_meta(chunks: DataFrame, signatures: DataFrame, targets: DataFrame) -> DataFrame:
    counts = chunks.groupBy("book_id").agg(F.count("*").alias("chunk_count"), F.max("end_offset").alias("last_end"))
    met = counts.join(signatures, "book_id").join(targets.select("book_id", "target"), "book_id", "left")
    return met.select("book_id", "chunk_count", F.greatest("last_end", F.coalesce("target", "last_end")).alias("indexed_up_to"), "content_signature")


def needs_index(books: DataFrame, meta: DataFrame) -> DataFrame:
    """``books`` (book_id, content_signature, target) with ``needs_index``."""
    m = meta.select("book_id", "chunk_count", "indexed_up_to", F.col("content_signature").alias("_old"))
    met = books.join(m, "book_id", "left")
    need = (
        F.col("chunk_count").isNull()
        | (F.col("chunk_count") <= 0)
        | ~F.col("_old").eqNullSafe(F.col("content_signature"))
        | (F.col("target") > F.coalesce("indexed_up_to", F.lit(0)))
    )
    return met.select(*books.columns, ((F.col("target") > 0) & need).alias("needs_index"))


def index_backlog(books: DataFrame, meta: DataFrame, active: Column) -> DataFrame:
    """Books that need indexing: the active one first, then those read last."""
    todo = needs_index(books, meta).where("needs_index").drop("needs_index")
    return numbered(todo, "rank", F.desc(active.cast("int")), F.desc("last_read_at"), F.asc("book_id"))


def embed(df: DataFrame, text_col: str, fn: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 8, prefix: str = "passage: ") -> DataFrame:
    """``df`` with ``embedding``: ``fn`` over batches of prefixed texts, or hashed term counts of unit length."""
    if fn is None:
        from pyspark.ml.feature import HashingTF, Normalizer
        from pyspark.ml.functions import vector_to_array

        words = df.withColumn("_words", F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\W+"))
        counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=256).transform(words)
        unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
        return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list = []
            for i in range(0, len(texts), batch):
                out += fn([prefix + (t or "") for t in texts.iloc[i : i + batch]])
            yield pd.Series(out)

    return df.withColumn("embedding", run(F.col(text_col)))


def planned_refresh(books: DataFrame, chapters: DataFrame, meta: DataFrame) -> DataFrame:
    """What is to be done for ``books`` (book_id, target): ``(book_id, target, content_signature, indexed, rebuild)``, without those that need nothing."""
    asked = chapters.join(books.select("book_id").distinct(), "book_id", "left_semi")
    wanted = books.groupBy("book_id").agg(F.max("target").alias("target")).join(_signed(asked), "book_id")
    wanted = cut(wanted.select("book_id", F.least("target", "_total").cast("long").alias("target"), "content_signature"))
    old = meta.select("book_id", "chunk_count", "indexed_up_to", F.col("content_signature").alias("_old"))
    met = needs_index(wanted, meta).where("needs_index").join(old, "book_id", "left")
    rebuild = F.coalesce(F.col("chunk_count") <= 0, F.lit(True)) | ~F.col("_old").eqNullSafe(F.col("content_signature"))
    return cut(met.select("book_id", "target", "content_signature", F.when(rebuild, F.lit(0)).otherwise(F.col("indexed_up_to")).cast("long").alias("indexed"), rebuild.alias("rebuild")))


def fresh_chunks(state: DataFrame, chapters: DataFrame, chunker: Callable[..., DataFrame]) -> DataFrame:
    """The passages that a planned refresh adds: those that end beyond what is indexed, up to the target."""
    bounds = state.select("book_id", F.col("indexed").alias("min_offset"), F.col("target").alias("max_offset"))
    return chunker(chapters.join(bounds.select("book_id"), "book_id", "left_semi"), bounds)


def refreshed_meta(state: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(book_id, chunk_count, indexed_up_to, content_signature)`` of the planned books, of which ``chunks`` has all passages."""
    counts = chunks.groupBy("book_id").agg(F.count("*").alias("chunk_count"))
    met = state.join(counts, "book_id", "left")
    return met.select("book_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.greatest("indexed", "target").alias("indexed_up_to"), "content_signature")


def refresh_index(books: DataFrame, chapters: DataFrame, chunks: DataFrame, meta: DataFrame, chunker: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    """New ``(chunks, meta)`` after bringing each book of ``books`` (book_id, target) up to its target.

    New and changed books are rebuilt; for others only chunks that end beyond what was indexed are added.
    For an index on disk take ``sources.index_store``, which writes the touched books alone.
    """
    state = planned_refresh(books, chapters, meta)
    fresh = cut(fresh_chunks(state, chapters, chunker))
    kept = chunks.join(state.where("rebuild").select("book_id"), "book_id", "left_anti").join(fresh.select("chunk_id"), "chunk_id", "left_anti")
    merged = kept.unionByName(fresh, allowMissingColumns=True)
    new_meta = refreshed_meta(state, merged.join(state.select("book_id"), "book_id", "left_semi"))
    return merged, meta.join(new_meta.select("book_id"), "book_id", "left_anti").unionByName(new_meta, allowMissingColumns=True)
