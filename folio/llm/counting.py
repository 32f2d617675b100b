"""Token counts through a digest cache: each distinct text is encoded once for each version of a tokenizer.

The cache is a Parquet table of (digest of the normalised text, tokens), in a folder for each digest of the
tokenizer (its file and the library that reads it). A batch of documents is reduced to the digests
of its texts, joined with the stored counts, and only what is missing is encoded and appended. Texts
of the missing digests are shuffled once, compressed, copies falling together before the shuffle
(a text with millions of copies costs one row a task); while the misses are few, the others'
texts are not shuffled at all.

Encoding is the tokenizer's library. Where its pre-tokenizer is byte-level without a normalizer, a text is the
sum of the pieces that begin with white space, as no pre-token has white space after anything else;
their counts are kept in a bounded table in each task, so that a common word is encoded once there.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import cut, shared_dir, small_batches, staged, table, text_or_empty, with_keys

LIMIT = 512

#: Missing digests (40 bytes each) that are broadcast, so that texts with stored counts stay where they are.
BROADCAST_MISSES = 100_000

#: Pieces whose counts a task keeps, and the longest of them in characters; others are encoded each time.
KEPT_PIECES = 300_000
LONGEST_KEPT = 64

#: Characters of a text that are cut into pieces at once.
STRETCH = 1_000_000

_PIECE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
_EDGE = re.compile(r"(?<=[^ \t\r\n])(?=[ \t\r\n])")
#: White space for which libraries differ, or that takes part in longer runs: such texts are encoded whole.
_ODD_SPACE = re.compile(r"[^\S \t\r\n]|[\x1c-\x1f\x85\u180e\u200b\ufeff]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library} {__import__(library).__version__}".encode()).hexdigest()


class Counter:
    """Counts tokens of texts: no added special tokens, truncation or padding; special strings inside texts as the library has it."""

    def __init__(self, path: str, content: bytes):
        self.whole, self.known = True, {}
        if path.endswith(".model"):
            import sentencepiece

            spm = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encode = lambda texts: [len(x) for x in spm.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_buffer(content)
            library.no_truncation()
            library.no_padding()
            form = json.loads(content)
            pre = form.get("pre_tokenizer") or {}
            self.whole = not (form.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True))
            # Special strings with white space in or around them could cross the edge of a piece.
            self.whole |= any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in form.get("added_tokens") or [])
            self.encode = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if self.whole:
            return [self.encode([t])[0] for t in texts]
        return [self.encode([t])[0] if _ODD_SPACE.search(t) else sum(self._of_pieces(_PIECE.findall(s)) for s in _stretches(t)) for t in texts]

    def _of_pieces(self, pieces: list[str]) -> int:
        known = self.known
        new = list({p for p in pieces if p not in known})
        if new:
            if len(known) + len(new) > KEPT_PIECES:
                known.clear()
                new = list(set(pieces))
            counts = dict(zip(new, self.encode(new), strict=True))
            self.known |= {p: n for p, n in counts.items() if len(p) <= LONGEST_KEPT}
            return sum(known[p] if p in known else counts[p] for p in pieces)
        return sum(map(known.__getitem__, pieces))


def _stretches(text: str) -> Iterator[str]:
    """``text`` in parts of about STRETCH characters, cut where a piece ends."""
    at = 0
    while at + STRETCH < len(text):
        edge = _EDGE.search(text, at + STRETCH)
        if not edge:
            break
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


class CountCache:
    """Stored counts under ``path``, by tokenizer version; without a path, in a folder of its own in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/token_counts_{uuid.uuid4().hex}").rstrip("/")

    def _folder(self, version: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={version}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def rows(self, version: str) -> DataFrame:
        """``(digest, n_tokens)``, one row for each digest, even where two jobs stored the same text at once."""
        path, fs = self._folder(version)
        if not fs.exists(path):
            return self.spark.createDataFrame([], "digest binary, n_tokens long")
        return self.spark.read.schema("digest binary, n_tokens long").parquet(path.toString()).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, counted: DataFrame, version: str) -> None:
        counted.select("digest", "n_tokens").write.mode("append").parquet(self._folder(version)[0].toString())

    def forget(self) -> None:
        """Delete the cache's files."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _digest(text: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b""))


def _packed(texts: DataFrame) -> DataFrame:
    """(digest, text) with the text as a zstd blob, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press(t) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["digest", "z"])

    return texts.mapInArrow(run, "digest binary, z binary")


def encode_counts(packed: DataFrame, tokenizer: str) -> DataFrame:
    """``(digest, n_tokens)`` of packed texts; the tokenizer's file travels with the function."""
    with open(tokenizer, "rb") as f:
        content = packed.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import zstandard

        count, unpack = Counter(tokenizer, content.value), zstandard.ZstdDecompressor().decompress
        for b in batches:
            counts = [count([unpack(z).decode()])[0] for z in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return packed.mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, cache: CountCache, tokenizer: str | None = None, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for every row of ``docs``, from ``cache`` where it has the text; what it lacks is encoded and added.

    ``normalise`` is applied to the text before it is digested and encoded; n_bytes is of that. Null texts are empty,
    with 0 tokens; very long ones are encoded whole. Repeated rows and equal texts share one count; null and repeated
    doc_ids stay as they are. Columns other than doc_id and text do not matter. An empty table gives no rows and stores none.
    A job that runs again encodes only what the first run didn't store.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    version = tokenizer_version(tokenizer)
    text = normalise(text_or_empty()) if normalise else text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), _digest(text).alias("digest"))
    laid = staged(rows)
    times = staged(laid.groupBy("digest").agg(F.count("*").alias("times")))
    misses = times.join(cache.rows(version), "digest", "left_anti").select("digest")
    missing = misses.count()
    if missing:
        texts = docs.select(_digest(text).alias("digest"), text.alias("text"))
        if missing <= BROADCAST_MISSES:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        distinct = _packed(texts).groupBy("digest").agg(F.first("z").alias("z"))
        cache.append(encode_counts(distinct.join(cache.rows(version), "digest", "left_anti"), tokenizer), version)
    counts = times.join(cache.rows(version), "digest")
    return with_keys(laid, counts, ["digest"], "times", laid.count(), keep_times=True).select("doc_id", "n_bytes", "n_tokens")


def op12_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = CountCache(spark)
    found = count_tokens(table(spark, sf_dir, "documents"), cache)
    out = cut(found.withColumn("over_limit", F.col("n_tokens") > LIMIT))
    cache.forget()
    return out
