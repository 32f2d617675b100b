"""Exact dedup against a persistent digest index, bucketed and sorted by hash. Native.

The index is a table of one row for each distinct text: its digest (32 bytes), the doc_id of
the row that stays, how many rows had it and the batch that brought it. A batch of new documents is
reduced to one row for each digest (partial sums before the shuffle, so a text with millions of
copies costs one row a task), anti-joined with the index by sort-merge and appended. The index is
bucketed by digest, so its side of a join is not shuffled; as Spark does not rely on the order of
bucketed files, each task sorts its bucket again. There is a bucket for each ROWS_A_BUCKET rows of
the first batch, so that the tasks grow in number and not in size.

Rows that ask for a text's keeper are joined by digest too. Texts with over a thousandth of all
rows (of which there are fewer than a thousand) are broadcast instead, so that none of them
makes one task long.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import HOT_SHARE, cut, shared_dir, staged, table, text_or_empty

#: Rows of the first batch for each bucket of the index (48 bytes each), and buckets at least.
ROWS_A_BUCKET = 2_000_000
LEAST_BUCKETS = 32


def digest(text: Column) -> Column:
    # Marked as never null, so that joins on it need no filter that would compute it twice.
    return F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b""))


class DigestIndex:
    """A digest table under ``path``, made by the first batch; a later session opens it again by the same path.

    Without a path it lies in a folder of its own in the shared folder. ``forget`` takes the table
    out of the session's catalog; the files stay for the next one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, f"digest_index_{uuid.uuid4().hex}"
        self.path = (path or f"{shared_dir(spark)}/{self.name}").rstrip("/")
        self.buckets, self._open = buckets, False

    def open(self, rows: int) -> DigestIndex:
        """Open what is there, else make an empty table for batches like one of ``rows`` rows."""
        if not self._open:
            # The folder's name tells how many buckets it has, as files of another number would not fit.
            there = self._folders()
            if not there:
                there = [f"buckets_{self.buckets or max(LEAST_BUCKETS, math.ceil(rows / ROWS_A_BUCKET))}"]
            self.spark.sql(
                f"CREATE TABLE {self.name} (digest binary, keep_id bigint, group_size bigint, batch string) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(there[0].removeprefix('buckets_'))} BUCKETS LOCATION '{self.path}/{there[0]}'"
            )
            self._open = True
        return self

    def _folders(self) -> list[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(conf)
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return [n for n in names if n.startswith("buckets_")]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, counted: DataFrame, batch: str) -> None:
        """Add the groups (digest, keep_id, group_size) that the index lacks.

        Texts that it has stay as they are: their first keeper was handed out already. So a
        batch that is added again, after a failure, changes nothing.
        """
        new = counted.join(self.rows().hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")).write.insertInto(self.name)

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _counted(docs: DataFrame, *more: Column) -> DataFrame:
    """A row for each digest and doc_id with the number of rows that have both, laid aside: the texts are read once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text_or_empty()).alias("digest"), _whole(docs).alias("own"))
    return staged(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"), *more))


def _whole(docs: DataFrame) -> Column:
    """A hash of the whole row (maps cannot be hashed)."""
    return F.xxhash64(F.struct(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]))


def _open(index: DigestIndex, counted: DataFrame, *more: Column) -> tuple[DataFrame, int]:
    """A row for each digest, and the number of all rows; the index is open."""
    groups = staged(counted.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), *more))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    index.open(total)
    return groups, total


def exact_groups(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``, after adding it to ``index``.

    Null texts count as empty; very long ones are digested whole. Of equal texts the largest doc_id
    stays (null doc_ids are the smallest); of rows that repeat it one stays. A text that another
    batch brought before has the keeper and size recorded there, and none of its rows stays. A job
    that runs again under the same ``batch`` name gives the same rows. Columns other than doc_id and
    text, whatever their names, do not matter. An empty table gives no rows and adds none.
    """
    batch = batch or uuid.uuid4().hex
    counted = _counted(docs)
    groups, total = _open(index, counted)
    index.append(groups, batch)
    # Fewer than HOT_SHARE texts have so many rows.
    hot = F.broadcast(cut(groups.where(F.col("group_size") * HOT_SHARE > total).select("digest")))
    of_hot = F.broadcast(cut(index.rows().join(hot, "digest", "left_semi")))
    found = counted.join(of_hot, "digest").unionByName(counted.join(hot, "digest", "left_anti").join(index.rows().hint("merge"), "digest"))
    stays = (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    each = found.select("doc_id", "keep_id", "group_size", stays.alias("stays"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"), "digest")
    return each.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_unique(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The documents of which ``exact_groups`` says that they stay; columns unchanged.

    Of rows that share text and doc_id but differ elsewhere the one with the largest hash of the whole row stays.
    """
    batch = batch or uuid.uuid4().hex
    counted = _counted(docs, F.max("own").alias("own"))
    groups, total = _open(index, counted, F.max(F.struct("doc_id", "own"))["own"].alias("own"))
    index.append(groups, batch)
    ours = index.rows().where(F.col("batch") == batch).select("digest", F.col("keep_id").alias("recorded"))
    # The ids are compared after the join, so that its only key is the digest and the index stays where it is.
    met = groups.join(ours.hint("merge"), "digest").where(F.col("keep_id").eqNullSafe(F.col("recorded")))
    keepers = staged(met.select(F.col("digest").alias("_digest"), F.col("own").alias("_own"), "group_size"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), digest(text_or_empty()).alias("_digest"), _whole(docs).alias("_own"))
    # Of texts with many rows all but the keeper go before anything is shuffled.
    hot = F.broadcast(cut(keepers.where(F.col("group_size") * HOT_SHARE > total).select("_digest", F.col("_own").alias("_keeper"))))
    left = marked.join(hot, "_digest", "left").where("_keeper is null or _keeper = _own")
    return left.join(keepers.select("_digest", "_own"), ["_digest", "_own"], "left_semi").dropDuplicates(["_digest"]).select("_row.*")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), DigestIndex(spark))


ORACLE = {
    "op10_exact": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
