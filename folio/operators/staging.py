"""Lineage cuts and row numbers that no single task has to make."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in this one process is a temporary folder made; on a
    cluster executors could not see it.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folio-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that a lost executor costs only its running tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``: 1 for the first row of the whole order, and so on.

    Ranges of the order are sorted side by side; the driver sees one count for each range.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    range_of = F.shiftright("_at", 33).cast("int")
    counts = {r["p"]: r["n"] for r in ranged.groupBy(range_of.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [0] * (max(counts, default=-1) + 1), 0
    for p in range(len(before)):
        before[p] = total
        total += counts.get(p, 0)
    first = F.get(F.lit(before or [0]), range_of)
    return ranged.withColumn(name, (first + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_at")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over all cores where its files have fewer splits than there are cores; larger tables stay as they are.

    For tables of texts, on which the work of a row is large: one Parquet row group is one task otherwise.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
