"""Mixing sources to target weights by Efraimidis-Spirakis sampling. Native.

A document's key is an exponential variate, from a hash of the row, over its quality weight;
within a source the documents in order of their keys are a weighted sample without
replacement. A source's target is served by whole epochs first; what is left goes to the
documents with the least keys, by prefix sums of their sizes.

No source is sorted whole. Keys fall into buckets that keep their order; sums by source and
bucket (partial sums first) say in which bucket the budget ends, and only that bucket's
keys are sorted. The outcome is one row for each source: epochs, the key at which its target
ends and how many of the rows with that key come in, so the documents themselves are never
shuffled (but for rows that are wholly alike and stand just at that key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import HOT_SHARE, WORD, cut, numbered, table, text_or_empty, wrapped

#: Weights of the sources by code point, repeating; all targets' share of all sizes; epochs at most.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
BUCKETS = 65_536
#: Rows of the plan (one for each source) that may be broadcast; beyond it the documents are shuffled by source.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.5 to 1: the share of letters, digits and white space in the text."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.lit(0.5) + plain / 2


def _measured(docs: DataFrame) -> DataFrame:
    """``_size`` and ``_key`` beside the columns of ``docs``."""
    text = text_or_empty()
    spread = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text)), 11)
    uniform = (spread + F.lit(0.5)) / F.lit(float(1 << 53))
    return docs.withColumns({"_size": word_count(text), "_key": -F.log(uniform) / quality_weight(text), "_source": F.col("source").cast("string")})


def _bucket() -> Column:
    # With weights from 0.5 to 1 no bucket gets over twice the mean of a source's documents.
    return F.least(F.floor((1 - F.exp(F.col("_key") * -0.5)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def source_targets(totals: DataFrame) -> DataFrame:
    """``(_source, source_size)`` -> ``target``: shares by weight, filled up to EPOCHS times the size.

    Each round shares out what the full sources leave; those whose share is above their cap are
    full from then on. A round is one sum over the sources, and no task holds all of them.
    """
    ranked = numbered(totals, "place", F.asc_nulls_last("_source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    open_to = cut(ranked.withColumns({"weight": weight, "cap": F.col("source_size") * float(EPOCHS)}))
    share, full = 0.0, -1
    while True:
        is_full = F.col("cap") < share * F.col("weight")
        sums = [F.sum("source_size"), F.sum(F.when(is_full, F.col("cap"))), F.sum(F.when(~is_full, F.col("weight"))), F.count_if(is_full)]
        sizes, filled, weights, now = open_to.agg(*sums).first()
        if now == full or not weights:
            return open_to.select("_source", "source_size", F.least(F.col("cap"), share * F.col("weight")).alias("target"))
        share, full = (sizes * SHARE - (filled or 0.0)) / weights, now


def _beside(rows: DataFrame, plan: DataFrame, total: int) -> DataFrame:
    """Each row beside its source's row of ``plan`` (columns s, n_rows and others).

    A plan of many sources is not broadcast; then only sources with a large share of all rows are.
    """
    same = F.col("_source").eqNullSafe(F.col("s"))
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), same)
    is_hot = F.col("n_rows") * HOT_SHARE > total
    hot = F.broadcast(plan.where(is_hot))
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(plan.where(~is_hot), same))


def _border(sums: DataFrame, part: str, goals: DataFrame) -> DataFrame:
    """``sums`` (_source, part, words) against ``goals`` (s, n_rows, rest): the part in which rest is reached, and what rest is there."""
    running = Window.partitionBy("_source").orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = sums.withColumn("upto", F.sum("words").over(running)).join(goals, F.col("_source").eqNullSafe(F.col("s")))
    here = met.where("upto - words < rest and upto >= rest")
    first = here.groupBy("s", "n_rows").agg(F.min(F.struct(part, (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))).alias("b"))
    return first.select("s", "n_rows", f"b.{part}", "b.rest")


def mixing_plan(measured: DataFrame, total: int) -> DataFrame:
    """A row for each source: documents whose key is below ``edge_key`` come once more than ``epochs``.

    Of the ``tied`` rows that have edge_key itself, ``ties`` do. Sums by bucket are looked through in
    two steps of 256, so a window holds 256 rows; the last one holds the distinct keys of one
    bucket, one 65,536th of a source.
    """
    sums = cut(measured.groupBy("_source", _bucket().alias("bucket")).agg(F.sum("_size").alias("words"), F.count("*").alias("n")))
    sources = sums.groupBy("_source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_rows"))
    targets = source_targets(sources.select("_source", "source_size")).withColumnRenamed("_source", "s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rows_of = sources.select(F.col("_source").alias("r"), "n_rows")
    planned = targets.join(rows_of, F.col("s").eqNullSafe(F.col("r"))).drop("r").withColumn("epochs", whole)
    planned = cut(planned.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    wide = sums.withColumn("part", F.shiftright("bucket", 8))
    coarse = cut(_border(wide.groupBy("_source", "part").agg(F.sum("words").alias("words")), "part", planned.select("s", "n_rows", "rest")))
    at = coarse.select(F.col("s").alias("cs"), F.col("part").alias("cp"))
    fine = wide.join(at, F.col("_source").eqNullSafe(F.col("cs")) & (F.col("part") == F.col("cp")))
    last = cut(_border(fine.select("_source", "bucket", "words"), "bucket", coarse.drop("part")).withColumnRenamed("bucket", "last_bucket"))
    # The keys of that bucket, rows with one key together.
    edge = _beside(measured.withColumn("bucket", _bucket()), last, total).where("bucket = last_bucket")
    keys = edge.groupBy("_source", "last_bucket", "rest", "_key").agg(F.max("_size").alias("z"), F.count("*").alias("m"))
    by_key = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum(F.col("z") * F.col("m")).over(by_key), F.lit(0))
    # A document at the border comes in if that leaves the sum nearer to the target.
    fit = F.when(F.col("z") > 0, F.floor(left / F.col("z") + 0.5)).otherwise(F.col("m"))
    counted = keys.withColumn("ties", F.greatest(F.lit(0), F.least("m", fit)).cast("long")).where("ties < m")
    ends = counted.groupBy(F.col("_source").alias("es")).agg(F.min(F.struct("_key", "ties", "m")).alias("e"))
    found = last.select(F.col("s").alias("ls"), "last_bucket").join(ends, F.col("ls").eqNullSafe(F.col("es")), "left")
    none, every = F.lit(-1.0), F.lit(float("inf"))
    edge_key = F.when(F.col("last_bucket").isNull(), none).otherwise(F.coalesce("e._key", every))
    return cut(
        planned.join(found, F.col("s").eqNullSafe(F.col("ls")), "left").select(
            "s", "n_rows", "source_size", "target", "epochs", F.coalesce("last_bucket", F.lit(-1)).alias("last_bucket"),
            edge_key.alias("edge_key"), F.coalesce("e.ties", F.lit(0)).alias("ties"), F.coalesce("e.m", F.lit(0)).alias("tied"),
        )
    )


def _turns(tied: DataFrame) -> DataFrame:
    """``tied`` with ``_turn``: rows of one source numbered from 1, partition by partition side by side."""
    held = cut(tied.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = held.groupBy(F.col("s").alias("ts"), F.col("_part").alias("tp")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("ts").orderBy("tp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("ts", "tp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("s", "_part").orderBy("_at"))
    met = held.withColumn("_own", own).join(offsets, F.col("s").eqNullSafe(F.col("ts")) & (F.col("_part") == F.col("tp")))
    return met.withColumn("_turn", F.col("first") + F.col("_own")).drop("_at", "_part", "_own", "ts", "tp", "first")


def _with_copies(measured: DataFrame, plan: DataFrame, total: int) -> DataFrame:
    bucket = _bucket()
    at_edge = (bucket == F.col("last_bucket")) & (F.col("_key") == F.col("edge_key"))
    more = (bucket < F.col("last_bucket")) | ((bucket == F.col("last_bucket")) & (F.col("_key") < F.col("edge_key")))
    copies = lambda one_more: F.least(F.col("epochs") + one_more.cast("int"), F.lit(EPOCHS))
    joined = _beside(measured, plan, total)
    if not plan.where("ties > 0").limit(1).count():
        return joined.withColumn("_copies", copies(more))
    tied = _turns(joined.where(at_edge & (F.col("ties") > 0)))
    tied = tied.withColumn("_copies", copies(F.col("_turn") <= F.col("ties"))).drop("_turn")
    return joined.where(~(at_edge & (F.col("ties") > 0))).withColumn("_copies", copies(more)).unionByName(tied)


def mix_sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row; reruns agree.

    Null texts have size 0; null sources are one source of their own, last in order. Rows that
    repeat another one wholly share its key; where a target ends among them, as many of them are
    taken as it needs. No row is taken more than EPOCHS times. Other columns, whatever their
    names, are ignored. Very long texts are one document like any other, so a source may end half
    of one away from its target. An empty table gives no rows.
    """
    measured = cut(_measured(docs.select("doc_id", "text", "source")).select("doc_id", "_source", "_size", "_key"))
    total = measured.count()
    mixed = _with_copies(measured, mixing_plan(measured, total), total)
    return mixed.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken; columns unchanged.

    Nulls, ties and empty tables as with ``mix_sizes``.
    """
    measured = _measured(wrapped(docs, "doc_id", "text", "source"))
    narrow = cut(measured.select("_source", "_size", "_key"))
    total = narrow.count()
    mixed = _with_copies(measured, mixing_plan(narrow, total), total).where("_copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))
