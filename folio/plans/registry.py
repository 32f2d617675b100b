"""The registered queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.plans.fixtures import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables and views by attribute: ``t.sessions``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def __getattr__(self, name: str) -> DataFrame:
        return view(self._spark, self._dir, name)


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``, with the DuckDB text of the same result."""

    def put(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = oracle(sql)
        return build

    return put


def load() -> None:
    from folio.plans import chat, intervals, library, reading, records, retrieval, streams, texts  # noqa: F401


load()
