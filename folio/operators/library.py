"""Library, storage and study queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _has(text: Column, term: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(term.lower()))


def search_books(books: DataFrame, term: str = "", tags: list[str] | None = None) -> DataFrame:
    """Books with ``term`` in title or author, in any case, and with all of ``tags``."""
    hit = _has(F.col("title"), term) | _has(F.col("author"), term)
    return books.where(hit & (F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)) if tags else books.where(hit)


def search_goals(books: DataFrame, term: str) -> DataFrame:
    return books.where(_has(F.concat_ws(" ", "label", "title", "author", F.array_join("tags", " ")), term))


def all_tags(books: DataFrame) -> DataFrame:
    return books.select(F.explode("tags").alias("tag")).select(F.trim("tag").alias("tag")).where("tag <> ''").distinct()


def label_books(books: DataFrame) -> DataFrame:
    """Titles that repeat get the last four characters of their id from the second on."""
    n = F.row_number().over(Window.partitionBy("title").orderBy("book_id"))
    tail = F.concat(F.col("title"), F.lit(" ("), F.right(F.col("book_id").cast("string"), F.lit(4)), F.lit(")"))
    return books.withColumn("_n", n).select("book_id", F.when(F.col("_n") > 1, tail).otherwise(F.col("title")).alias("label"))


def sort_books(books: DataFrame, field: str, ascending: bool = True) -> DataFrame:
    """Titles and authors by Chinese collation; ids that are numbers as numbers; ties by id."""
    key = F.expr(f"collate({field}, 'zh')") if field in ("title", "author") else F.expr(f"try_cast({field} as bigint)") if field == "book_id" else F.col(field)
    return books.orderBy(key.asc() if ascending else key.desc(), "book_id")


#: Categories of the storage report in their order.
CATEGORIES = ("content", "chat", "pages", "embeddings", "notebooks", "quizzes", "quotes", "audio", "other")


def storage_breakdown(records: DataFrame) -> DataFrame:
    """Bytes and share of each category, all nine in order; records of unknown stores are ``other``."""
    size = F.octet_length(F.coalesce("key", F.lit(""))) + F.octet_length(F.coalesce("value", F.lit("")))
    known = F.when(F.col("store").isin(*CATEGORIES), F.col("store")).otherwise("other")
    sums = records.groupBy(known.alias("category")).agg(F.sum(size.cast("long")).alias("bytes"))
    spine = records.sparkSession.createDataFrame(list(enumerate(CATEGORIES)), "ordinal int, category string")
    total = F.sum("bytes").over(Window.partitionBy())
    full = spine.join(sums, "category", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    return full.select("ordinal", "category", "bytes", F.when(total > 0, F.col("bytes") / total * 100).otherwise(0.0).alias("percent"))


def bytes_by(records: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes at every level of ``keys`` in one pass."""
    size = F.octet_length(F.coalesce("value", F.lit(""))).cast("long")
    return records.rollup(*keys).agg(F.sum(size).alias("bytes"), F.count("*").alias("records"))


def categorise_resources(resources: DataFrame, owners: DataFrame) -> DataFrame:
    """The category of a resource's first owner, else ``other``."""
    first = owners.groupBy("resource_id").agg(F.min_by("category", "priority").alias("category"))
    return resources.join(first, "resource_id", "left").withColumn("category", F.coalesce("category", F.lit("other")))


def orphaned_refs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Image references of the old version that the new one lacks."""
    return old.select("book_id", "ref").where("ref is not null").distinct().join(new.select("book_id", "ref"), ["book_id", "ref"], "left_anti")


def score_quizzes(answers: DataFrame) -> DataFrame:
    """``(session_id, question_id, answer array, correct array)`` -> correct, answered and percent of each session."""
    given = F.coalesce("answer", F.array())
    right = (F.size(given) == F.size("correct")) & F.forall(given, lambda a: F.array_contains(F.col("correct"), a))
    rows = answers.select("session_id", right.cast("int").alias("r"), (F.size(given) > 0).cast("int").alias("a"))
    out = rows.groupBy("session_id").agg(F.count("*").alias("questions"), F.sum("r").alias("correct"), F.sum("a").alias("answered"))
    return out.withColumn("percent", F.round(F.col("correct") / F.col("questions") * 100).cast("long")).withColumn("incomplete", F.col("answered") < F.col("questions"))


def count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def move_entry(entries: DataFrame, dragged, target) -> DataFrame:
    """Put one entry in front of another of its (category, position); others keep their order."""
    order = Window.partitionBy("category", "position").orderBy("entry_id")
    ranked = entries.withColumn("_r", F.row_number().over(order) * 2)
    spot = F.max(F.when(F.col("entry_id") == target, F.col("_r"))).over(Window.partitionBy("category", "position"))
    moved = F.when((F.col("entry_id") == dragged) & spot.isNotNull(), spot - 1).otherwise(F.col("_r"))
    placed = ranked.withColumn("_m", moved)
    again = Window.partitionBy("category", "position").orderBy("_m", "entry_id")
    return placed.withColumn("rank", F.row_number().over(again)).drop("_r", "_m")


def unique_names(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Names that are taken, or come twice, get `` (n)`` with the least free n from 2."""
    taken = existing.select("name").distinct().withColumn("_taken", F.lit(1))
    order = Window.partitionBy("name").orderBy("id")
    ranked = new.join(taken, "name", "left").withColumn("_i", F.row_number().over(order) - 1 + F.coalesce("_taken", F.lit(0)))
    used = existing.select(F.regexp_extract("name", r"^(.*) \((\d+)\)$", 1).alias("name"), F.expr(r"try_cast(regexp_extract(name, '^(.*) [(]([0-9]+)[)]$', 2) as int)").alias("n")).where("n >= 2").groupBy("name").agg(F.sort_array(F.collect_set("n")).alias("_used"))
    met = ranked.join(used, "name", "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    # The i-th free number: those below it that are used push it on.
    free = F.aggregate("_used", F.col("_i") + 1, lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    return met.select("id", F.when(F.col("_i") == 0, F.col("name")).otherwise(F.concat("name", F.lit(" ("), free.cast("string"), F.lit(")"))).alias("name"))


def upsert(target: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``updates`` in place of those with their keys, and the others."""
    return target.join(updates.select(*key), key, "left_anti").unionByName(updates)


def delete_by_book(target: DataFrame, books: DataFrame) -> DataFrame:
    return target.join(books.select("book_id"), "book_id", "left_anti")
