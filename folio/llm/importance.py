r"""Importance resampling towards a target: hashed n-gram counts of two corpora weigh every document.

Counting is done by segments. Newlines cut texts into lines, and as no word holds a newline, the n-grams
inside a line depend on that line alone. Equal lines are brought together with the number of their
occurrences (partial counts before the shuffle, so a line that a third of all documents share costs
one row a task); each distinct line is cut into n-grams once, and its counts are multiplied. n-grams
across lines are counted apart, text by text; single words never cross one.

Counts are kept for a fixed number of buckets (a parameter), so what the driver gathers and sends
out again has that size however large the corpora are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import cut, numbered, small_batches, table, text_or_empty

#: A word: letters and digits of ASCII, and anything beyond ASCII. Newlines are no part of it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BUCKETS = 10_000
ORDER = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20

#: Bytes of a text that are cut into words at once, features that are counted at once, and features whose bucket a task keeps.
STRETCH = 1 << 20
TOGETHER = 1 << 20
KEPT = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of UTF-8 to bytes: A-Z to a-z, what is in no word (ASCII after lower-casing but for letters and digits) to a blank.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


class Known(dict):
    """Values of features, computed when first asked for; emptied when it holds KEPT of them."""

    def __init__(self, of: Callable[[bytes], int]):
        self.of = of

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[feature] = value = self.of(feature)
        return value


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in order, in lists of bounded size."""
    folded, at = text.translate(_FOLD), 0
    while len(folded) - at > STRETCH and (blank := folded.find(b" ", at + STRETCH)) > 0:
        yield folded[at:blank].split()
        at = blank
    yield folded[at:].split()


def runs_of(words: list[bytes], order: int, old: int = 0) -> list[bytes]:
    """All runs of 1 to ``order`` words, joined by a blank, that end after the first ``old`` words."""
    found = words[old:]
    for g in range(2, order + 1):
        found += [b" ".join(words[i : i + g]) for i in range(max(0, old - g + 1), len(words) - g + 1)]
    return found


def features(text: bytes, order: int) -> Iterator[list[bytes]]:
    """The features of a whole text, in lists of bounded size."""
    carried: list[bytes] = []
    for words in word_lists(text):
        yield runs_of(carried + words, order, len(carried))
        carried = (carried + words)[len(carried) + len(words) - order + 1 :] if order > 1 else []


def crossing(text: bytes, order: int) -> list[bytes]:
    """The runs of 2 to ``order`` words that begin in one line and end in another."""
    tail, found = [], []
    for line in text.split(b"\n"):
        words = line.translate(_FOLD).split()
        near = tail + words[: order - 1]
        found += [b" ".join(near[i : i + g]) for i in range(len(tail)) for g in range(2, order + 1) if len(tail) < i + g <= len(near)]
        tail = (tail + words)[-(order - 1) :]
    return found


def _counts(rows: DataFrame, pieces: Callable[[bytes], Iterator[list[bytes]]], buckets: int) -> DataFrame:
    """``(bucket, n)`` of each task: features of ``rows`` (text, times), ``times`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, sums = Known(lambda f: zlib.crc32(f) % buckets), np.zeros(buckets, dtype=np.int64)
        found, sizes, weights = [], [], []

        def add() -> None:
            at = np.fromiter(map(bucket_of.__getitem__, found), dtype=np.int64, count=len(found))
            np.add.at(sums, at, np.repeat(np.array(weights, dtype=np.int64), sizes))
            for x in (found, sizes, weights):
                x.clear()

        for batch in batches:
            for text, times in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for some in pieces(text):
                    found.extend(some)
                    sizes.append(len(some))
                    weights.append(times)
                    if len(found) >= TOGETHER:
                        add()
        add()
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(sums[full])], names=["bucket", "n"])

    return rows.mapInArrow(run, "bucket int, n long")


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: how many features of the whole texts fall into each bucket; empty buckets are left out.

    A feature's bucket is the crc32 of its UTF-8 bytes modulo ``buckets``. Null and empty texts have no features; a text
    without a newline is one line, however long; repeated rows count as often as they occur. Columns other than text
    do not matter. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(text_or_empty().alias("text"))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    found = _counts(lines, lambda line: features(line, order), buckets)
    if order > 1:
        found = found.unionByName(_counts(texts.withColumn("times", F.lit(1).cast("long")), lambda text: iter([crossing(text, order)]), buckets))
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> list[int]:
    """For each bucket, 1000 times the logarithm of its share in ``target`` over that in ``corpus``, floored; add-one smoothing."""
    # A row for each bucket at most: a size set by the parameter.
    s, t = ({r["bucket"]: r["n"] for r in bucket_counts(x, order, buckets).collect()} for x in (corpus, target))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * all_s / ((s.get(b, 0) + 1) * all_t))) for b in range(buckets)]


def score_documents(docs: DataFrame, of_bucket: list[int], order: int = ORDER, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` for every row of ``docs``.

    weight: the floored mean gain of the document's features (none: 0). score: weight plus Gumbel noise in thousandths,
    drawn by a hash of seed and doc_id, so that the largest scores are a sample without replacement by weight.
    Texts are read whole; null ones are empty; a null doc_id hashes as an empty one. Repeated rows are scored each.
    """
    small_batches(docs.sparkSession)
    buckets = len(of_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = Known(lambda f: of_bucket[zlib.crc32(f) % buckets])
        for batch in batches:
            n_words, n_features, total = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                n = s = w = 0
                for some in features(text, order):
                    n += len(some)
                    s += sum(map(gain.__getitem__, some))
                    w += len(some) if order == 1 else sum(b" " not in f for f in some)
                n_words.append(w)
                n_features.append(n)
                total.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, total))], names=["doc_id", "n_words", "n_features", "total"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, total long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the ``percent`` of the documents of at least ``least_words`` words with the highest scores.

    Equal scores go to smaller doc_ids (null last; repeated rows in any order, as they are alike). Undrawn rows have no rank.
    Ranges of the order are sorted side by side; no task sees the whole of it.
    """
    long_enough = F.col("n_words") >= least_words
    laid = cut(scored.withColumn("_in", long_enough))
    drawn = percent * laid.where("_in").count() // 100
    ranked = numbered(laid, "_at_rank", F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id"))
    return ranked.withColumn("rank", F.when(F.col("_in") & (F.col("_at_rank") <= drawn), F.col("_at_rank"))).drop("_in", "_at_rank")


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document's ``(doc_id, n_words, n_features, weight, score, rank)``; those with a rank are the sample."""
    return draw(score_documents(docs, gains(docs, target, order, buckets), order, seed), percent, least_words)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h) // 2 + 1), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::bigint)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

ORACLE = {
    "op13_importance": rf"""
        WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
        tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM documents),
        e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM benchmark),
        dw AS (SELECT doc_id, unnest(ws) AS w FROM d), ew AS (SELECT unnest(ws) AS w FROM e),
        kinds AS (SELECT w, {_CRC} % {BUCKETS} AS b FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM ew)), tab),
        s AS (SELECT b, count(*) AS s FROM dw JOIN kinds USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM ew JOIN kinds USING (w) GROUP BY b),
        g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::double
                / ((coalesce(s, 0) + 1)::double * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::double)))::bigint AS gain
              FROM range({BUCKETS}) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
        m AS (SELECT doc_id, sum(gain) AS total FROM dw JOIN kinds USING (w) JOIN g USING (b) GROUP BY doc_id),
        x AS (SELECT d.doc_id, len(ws)::bigint AS n_features, CASE WHEN len(ws) > 0 THEN floor(total::double / len(ws)) ELSE 0 END::bigint AS weight,
                floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS noise
              FROM d LEFT JOIN m USING (doc_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY weight + noise DESC, doc_id) AS n FROM x)
        SELECT doc_id, n_features, weight, weight + noise AS score,
               CASE WHEN n_features >= {LEAST_WORDS} AND n <= (SELECT {PERCENT} * count(*) // 100 FROM x WHERE n_features >= {LEAST_WORDS}) THEN n END AS rank
        FROM r
    """
}
