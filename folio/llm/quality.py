"""Quality classifier: random-indexing word vectors, pooled, and a two-layer numpy network.

Each word has a fixed sparse random index vector; its word vector is the sum of the index
vectors of the words around it, over all documents. Words share BUCKETS hash buckets,
so the vectors are a table of fixed size. A document is the mean of its vectors: of its words,
and, as index vectors, of their shapes (letters, capitals, digits, symbols) and of marks that say whether a word
triple was seen before in the text. The network is fitted on at most LABELLED_ROWS labelled
rows; its logits are divided by a temperature, chosen on rows that it was not fitted on. Every
document is then scored on its own, with the tables broadcast (under 8 MB).

Index vectors are whole numbers, so their sums are the same in whatever order they are added.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import cut, small_batches, table, text_or_empty

DIM = 64
BUCKETS = 16_384
NONZERO = 6
AROUND = 2
LABELLED_ROWS = 20_000
PARTS = 8
HIDDEN = 32
THRESHOLD = 0.3
#: Words whose contexts are added at once.
TOGETHER = 200_000
#: Rows of the vector table in one message between tasks; they are added up one by one.
_CHUNK = 64

_SEEN, _NEW = 0, 1  # buckets of the two marks; others start at 2


class _Codes(dict):
    """Word -> bucket of the word and bucket of its shape, in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
        own = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "replace"), 11) % (BUCKETS - 2) + 2
        of_shape = xxhash.xxh64_intdigest(shape.encode("utf-8", "replace"), 12) % (BUCKETS - 2) + 2
        code = self[word] = own << 32 | of_shape
        return code


def _codes() -> _Codes:
    # Functions reach the workers by value, so a worker's own dictionary hangs on a module that is there anyway.
    return sys.__dict__.setdefault("_folio_codes", _Codes())


def buckets(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of the words and of their shapes, and how many word triples stand before in the text."""
    words = text.split()
    both = np.fromiter(map(_codes().__getitem__, words), dtype=np.int64, count=len(words))
    own, shape = both >> 32, both & 0xFFFFFFFF
    if len(words) < 3:
        return own, shape, 0
    triple = np.sort((own[:-2] * BUCKETS + own[1:-1]) * BUCKETS + own[2:])
    return own, shape, int(np.count_nonzero(triple[1:] == triple[:-1]))


def index_places() -> np.ndarray:
    """Where each bucket's index vector has its ones (first half) and minus ones, from a fixed seed; a last row that cancels out."""
    order = np.random.default_rng(20240101).random((BUCKETS, DIM)).argsort(axis=1)[:, :NONZERO]
    return np.vstack([order, np.zeros((1, NONZERO), np.int64)]).astype(np.int32)


def index_vectors() -> np.ndarray:
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    signs = np.repeat(np.array([1, -1], dtype=np.float32), NONZERO // 2)
    np.put_along_axis(out, index_places()[:BUCKETS], np.broadcast_to(signs, (BUCKETS, NONZERO)), axis=1)
    return out


def word_buckets(text: str) -> np.ndarray:
    """Buckets of the words alone."""
    words = text.split()
    return np.fromiter(map(_codes().__getitem__, words), dtype=np.int64, count=len(words)) >> 32


def add_contexts(sums: np.ndarray, places: np.ndarray, texts: list[np.ndarray]) -> None:
    """Add the index vectors of the words around each word to its row of ``sums`` (flat), for the word buckets of some texts."""
    # The texts are laid end to end with AROUND places between them that cancel out.
    gap = np.full(AROUND, BUCKETS, dtype=np.int32)
    rows = np.concatenate([gap, *[x for t in texts for x in (t.astype(np.int32), gap)]])
    n = len(rows) - 2 * AROUND
    own = (rows[AROUND : AROUND + n] * DIM)[:, None]
    half = NONZERO // 2
    for sign, part in ((1, places[:, :half]), (-1, places[:, half:])):
        near = np.ascontiguousarray(part)[rows]
        at = np.concatenate([(own + near[k : k + n]).ravel() for k in range(2 * AROUND + 1) if k != AROUND])
        sums += sign * np.bincount(at, minlength=len(sums))


def train_vectors(texts: DataFrame) -> np.ndarray:
    """The word vectors over ``texts``: partial tables by task, summed by chunk of rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, places = np.zeros((BUCKETS + 1) * DIM, dtype=np.int64), index_places()
        held: list = []
        size = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(word_buckets(t or ""))
                size += len(held[-1])
                if size >= TOGETHER:
                    add_contexts(sums, places, held)
                    held, size = [], 0
        if held:
            add_contexts(sums, places, held)
        press = zstandard.ZstdCompressor(level=1).compress
        chunks = [press(sums[i * DIM : (i + _CHUNK) * DIM].astype("<i8").tobytes()) for i in range(0, BUCKETS, _CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros(_CHUNK * DIM, dtype=np.int64)
        for b in batches:
            for x in b.column("sums").to_pylist():
                total += np.frombuffer(unpack(x), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "sums"])

    parts = texts.select("text").mapInArrow(partial, "chunk int, sums binary")
    out = np.zeros((BUCKETS, DIM), dtype=np.float64)
    for r in parts.groupBy("chunk").applyInArrow(add, "chunk int, sums binary").collect():
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["sums"], dtype=np.int64).reshape(-1, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    # A bucket that no word has keeps its own index vector.
    return np.where(norm > 0, out / np.maximum(norm, 1e-9) + index_vectors() / NONZERO, index_vectors() / NONZERO).astype(np.float32)


def pooled(vectors: np.ndarray, text: str) -> np.ndarray:
    """Means of the text's word, shape and mark vectors; zeros for a text without words."""
    own, shape, seen = buckets(text)
    n = len(own)
    out = np.zeros((3, DIM), dtype=np.float64)
    for i, rows in enumerate((own, shape)):
        for at in range(0, n, 8192):
            out[i] += np.add.reduce(vectors.take(rows[at : at + 8192], axis=0), axis=0)
    out[2] = seen * vectors[_SEEN].astype(np.float64) + (n - seen) * vectors[_NEW].astype(np.float64)
    return (out / max(n, 1)).ravel()


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> Network:
    """Two layers by Adam on three quarters of the rows; the temperature on the rest."""
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the share of ones for all
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    check, train = order[: len(y) // 4], order[len(y) // 4 :]
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-3
    d = x.shape[1]
    net = Network(mean, scale, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (x - mean) / scale
    moments: list = [[0.0, 0.0] for _ in range(4)]
    step = 0
    for _ in range(rounds):
        for own in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            if not len(own):
                continue
            step += 1
            h = np.tanh(z[own] @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40)))
            out = (p - y[own]) / len(own)
            back = np.outer(out, net.w2) * (1 - h * h)
            grads = [z[own].T @ back + 1e-4 * net.w1, back.sum(0), h.T @ out + 1e-4 * net.w2, out.sum()]
            for i, (name, g) in enumerate(zip(("w1", "b1", "w2", "b2"), grads, strict=True)):
                moments[i] = [0.9 * moments[i][0] + 0.1 * g, 0.999 * moments[i][1] + 0.001 * g * g]
                m, v = moments[i][0] / (1 - 0.9**step), moments[i][1] / (1 - 0.999**step)
                setattr(net, name, getattr(net, name) - 3e-3 * m / (np.sqrt(v) + 1e-8))
    held = check if len(check) else train
    logits, truth = net.logits(x[held]), y[held]
    loss = lambda t: np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and a network from the labelled rows that are not held out, a hash sample of ``rows`` at most.

    Null labels and labels of unknown documents are left out; of several for one doc_id the lowest
    counts. Without labels of both kinds every document gets the share of ones (one half without any).
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    sample = known.where(draw < min(1_000_000, 1_000_000 * rows // max(n, 1)))
    # The sample is bounded by a parameter, so it may be broadcast and its texts laid aside.
    joined = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    train = cut(joined.select("text", (F.col("label") > 0).cast("double").alias("label"), F.xxhash64("doc_id").alias("at")).repartition(PARTS, "at"))
    vectors = train_vectors(docs.select(F.col("text").cast("string").alias("text")))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pooled(sent.value, t).astype(np.float32).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(x, pa.binary())], names=["at", "label", "x"])

    got = sorted(train.select("text", "label", "at").mapInArrow(run, "at long, label double, x binary").collect())
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in got], dtype=np.float64).reshape(-1, 3 * DIM)
    return vectors, fit_network(x, np.array([r["label"] for r in got], dtype=np.float64))


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """``(doc_id, score)`` of every row's whole text; null texts are scored as empty ones.

    Repeated rows each give a row, columns other than doc_id and text, whatever their names, are
    ignored, very long texts are pooled in pieces, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, vars(net)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, network = sent.value[0], Network(**sent.value[1])
        for b in batches:
            x = np.array([pooled(own, t or "") for t in b.column(1).to_pylist()]).reshape(-1, 3 * DIM)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(network.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from rows that are not held out; held_out and predicted for every document, repeated rows each."""
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    scored = score(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
