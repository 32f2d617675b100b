"""Shared helpers: table reading, lineage cutting, Arrow batch size, text regexes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.staging import cut, numbered, shared_dir, spread  # noqa: F401

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch sent to Python; texts of 1 MB then make batches of 256 MB at most.
BATCH_ROWS = 256


#: A key with over 1 / HOT_SHARE of all rows is hot. There are fewer than HOT_SHARE such keys, so they may be broadcast.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.columns[0]) if "text" in df.columns or "url" in df.columns else df


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: documents may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` of ``docs`` beside the whole row as ``_row``, so that no other column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *names)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str], times: str, total: int, keep_times: bool = False) -> DataFrame:
    """The rows whose key (columns ``on``) is in ``keys``; ``times`` says how many of the ``total`` rows have it.

    Rows of hot keys stay where they are, as these few keys are broadcast; only the others are
    shuffled, so that no task gets more than 1 / HOT_SHARE of the rows by one key. With
    ``keep_times`` the other columns of ``keys``, which is unique by key, come with the rows.
    """
    is_hot = F.col(times) * HOT_SHARE > total
    keys = keys if keep_times else keys.select(*on, times)
    hot = F.broadcast(cut(keys.where(is_hot)))
    if not keep_times:
        hot, cold = hot.select(*on), keys.where(~is_hot).select(*on)
    else:
        cold = keys.where(~is_hot)
    how = "inner" if keep_times else "left_semi"
    rest = rows.join(hot.select(*on), on, "left_anti").join(cold, on, how)
    return rows.join(hot, on, how).unionByName(rest)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet to the shared folder and read it back.

    Like ``cut``, for wide or large tables: columns are compressed, and readers take only those
    they need. The folder keeps the files until ``drop_staged``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


_STAGED: list[str] = []


def drop_staged(spark: SparkSession) -> None:
    """Delete what ``staged`` has written in this process; frames that read it end with it."""
    jvm = spark.sparkContext._jvm
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
