"""The passage index on disk: passages partitioned by book, of which a refresh rewrites only the books that it touches.

    path/chunks/book_id=.../   passages
    path/meta/shard=.../       one row a book, in a fixed number of shards, as files of one row would be too many
    path/batches/              an empty file for each batch that is done

A batch writes its passages, then what is known of its books, then its mark. Each write replaces whole partitions by what
follows from the batch's own input, so a batch that is repeated, after a failure at any point or by a
stream that starts again, leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import retrieval
from folio.operators.staging import cut

CHUNK_FIELDS = "chunk_id string, chapter_index int, start_offset long, end_offset long, text string, embedding array<float>"
META_FIELDS = "chunk_count long, indexed_up_to long, content_signature string"
SHARDS = 16


class IndexStore:
    """``book_type``: the type of book ids; ``chunk_fields``: columns of a passage besides book_id."""

    def __init__(self, spark: SparkSession, path: str, book_type: str = "long", chunk_fields: str = CHUNK_FIELDS, shards: int = SHARDS):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        self.chunk_schema, self.meta_schema = f"{chunk_fields}, book_id {book_type}", f"book_id {book_type}, {META_FIELDS}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str) -> DataFrame:
        p, fs = self._fs(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(p.toString()) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{name}")

    def chunks(self) -> DataFrame:
        return self._read("chunks", self.chunk_schema)

    def meta(self) -> DataFrame:
        return self._sharded().drop("shard")

    def _sharded(self) -> DataFrame:
        return self._read("meta", f"{self.meta_schema}, shard int")

    def done(self, batch: str) -> bool:
        p, fs = self._fs(f"{self.path}/batches/{batch}")
        return fs.exists(p)

    def replace_books(self, chunks: DataFrame) -> None:
        """Put ``chunks`` in place of all passages of their books; other books' files are not touched."""
        names = [f.split()[0] for f in self.chunk_schema.split(", ")]
        lacking = [F.lit(None).alias(c) for c in names if c not in chunks.columns]
        rows = chunks.select("*", *lacking).selectExpr(*[f"cast({f.split()[0]} as {f.split(' ', 1)[1]}) as {f.split()[0]}" for f in self.chunk_schema.split(", ")])
        # A book with very many passages is cut into several files.
        self._write(cut(rows).repartitionByRange("book_id", "start_offset"), "chunks", "book_id")

    def delete_books(self, books: DataFrame) -> None:
        """Take out all passages of ``books`` (book_id), and what is known of these books."""
        self._drop_folders(books)
        ids = cut(books.select("book_id").distinct())
        self._replace_meta(ids.join(self.meta().limit(0), "book_id", "left"), ids, gone=True)

    def _drop_folders(self, books: DataFrame) -> None:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for r in books.select(F.col("book_id").cast("string").alias("b")).distinct().toLocalIterator():
            p, fs = self._fs(f"{self.path}/chunks/book_id={escape(r['b']) if r['b'] else '__HIVE_DEFAULT_PARTITION__'}")
            fs.delete(p, True)

    def _shard(self):
        return F.pmod(F.xxhash64("book_id"), F.lit(self.shards)).cast("int")

    def _replace_meta(self, rows: DataFrame, books: DataFrame, gone: bool = False) -> None:
        shards = books.select(self._shard().alias("shard")).distinct()
        kept = self._sharded().join(F.broadcast(shards), "shard", "left_semi").join(books.select("book_id"), "book_id", "left_anti")
        if gone:
            # A shard that loses its last book has no rows to be replaced by.
            left = cut(kept)
            empty = shards.join(left.select("shard").distinct(), "shard", "left_anti")
            self._write(left, "meta", "shard")
            for r in empty.collect():  # SHARDS rows at most
                p, fs = self._fs(f"{self.path}/meta/shard={r['shard']}")
                fs.delete(p, True)
            return
        self._write(cut(kept.unionByName(rows.withColumn("shard", self._shard()))), "meta", "shard")

    def refresh(self, books: DataFrame, chapters: DataFrame, chunker: Callable[..., DataFrame], batch: str | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Bring each of ``books`` (book_id, target) up to its target, as ``retrieval.refresh_index`` does; False if ``batch`` was done before.

        ``embed`` gives new passages their embedding. Books that need nothing are neither read nor written; a changed book without any passage left loses its folder.
        """
        if batch is not None and self.done(batch):
            return False
        state = retrieval.planned_refresh(books, chapters, self.meta())
        fresh = retrieval.fresh_chunks(state, chapters, chunker)
        fresh = cut(embed(fresh) if embed else fresh)
        known = self.chunks().join(state.where("not rebuild").select("book_id"), "book_id", "left_semi")
        merged = cut(known.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh, allowMissingColumns=True))
        self.replace_books(merged)
        self._drop_folders(state.where("rebuild").join(merged.select("book_id").distinct(), "book_id", "left_anti"))
        self._replace_meta(cut(retrieval.refreshed_meta(state, merged)), state)
        if batch is not None:
            p, fs = self._fs(f"{self.path}/batches/{batch}")
            fs.create(p, True).close()
        return True
