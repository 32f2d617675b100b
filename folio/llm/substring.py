"""Substring dedup: words in windows that occur again anywhere are removed.

Every window of ``WINDOW`` words gets a Rabin-Karp hash (rolling polynomials). Shipping all
windows would move several times the corpus, so they are counted in runs:

1. The anchor of a window is the least hash of its ``GRAM``-word grams. Equal windows have
   equal anchors, and neighbouring windows mostly share one, so a text falls into runs of
   windows with one anchor, about one for 16 windows. Runs whose anchor occurs once in the
   corpus hold no repeat and are dropped. The others are counted by anchor and by the run's
   own Rabin-Karp hash, partial sums first: the windows of a run that occurs twice all
   occur twice.
2. Two unequal runs can share windows only if they share an anchor. So for anchors that have
   several distinct runs, and for these alone, each distinct run's windows are hashed
   one by one and counted, again partial sums first.
3. Windows that occur twice in one text are found in that text.

Each count is of every window that could be equal, so no repeat is lost; repeated windows
merge to maximal intervals, which are cut out of the text. Texts are shuffled compressed.
Anchors, runs and windows with over a thousandth of all rows are broadcast where rows are
looked up by them, so that a passage of very many documents makes no task long.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import small_batches, staged, table, with_keys

WINDOW = 35
GRAM = 8
#: Words of the texts that are hashed at once.
TOGETHER = 200_000

_U = np.uint64
#: Odd multipliers of the two polynomials (fixed values).
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 7)
        return found


def word_hashes(words: list[bytes]) -> np.ndarray:
    kept = sys.__dict__.setdefault("_folio_word_hashes", _WordHashes())
    return np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(values: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of each ``size`` consecutive values, by doubling."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done = np.zeros(len(values), dtype=np.uint64), 0
    power, span, factor = values, 1, base  # hashes of 2**k values, and base**(2**k)
    rest = size
    while rest:
        if rest & 1:
            head = out[: len(values) - done - span + 1] * factor if done else np.zeros(len(values) - span + 1, dtype=np.uint64)
            out = head + power[done : done + len(head)]
            done += span
        rest >>= 1
        if rest:
            power = power[:-span] * factor + power[span:]
            factor = _U(int(factor) ** 2 % (1 << 64))
            span *= 2
    return _mix(out[:n])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(29))


def least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    over = size - span
    return np.minimum(values[: len(values) - over], values[over:]) if over else values


def intervals(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as intervals: first place and length."""
    cuts = np.flatnonzero(np.diff(places) != 1) + 1
    first = places[np.r_[0, cuts]]
    return first, np.diff(np.r_[0, cuts, len(places)])


class Runs:
    """Runs and own repeats of many texts at once, laid end to end."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, window: int, gram: int):
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.start = np.r_[0, np.cumsum(sizes)[:-1]]
        last = len(words) - window + 1
        inside = self.doc[:last] == self.doc[window - 1 :]
        anchors = least(rolling(words, gram, _BASES[0]), window - gram + 1)
        new = np.r_[True, (anchors[1:] != anchors[:-1]) | (self.doc[1:last] != self.doc[: last - 1]) | (inside[1:] != inside[:-1])]
        at = np.flatnonzero(new)
        n = np.diff(np.r_[at, last])
        at, n = at[inside[at]], n[inside[at]]
        self.anchor, self.n = anchors[at], n
        # A run's content is words[at : at + n + window - 1], of any length: prefix sums.
        powers = np.cumprod(np.r_[_U(1), np.full(len(words), _BASES[1])])
        back = np.cumprod(np.r_[_U(1), np.full(len(words), _U(pow(int(_BASES[1]), -1, 1 << 64)))])
        sums = np.r_[_U(0), np.cumsum(words * powers[:-1])]
        self.hash = _mix((sums[at + n + window - 1] - sums[at]) * back[at] + n.astype(np.uint64))
        self.which, self.at = self.doc[at], at - self.start[self.doc[at]]
        # Windows that stand twice in their own text.
        own = rolling(words, window, _BASES[1]) + self.doc[:last].astype(np.uint64) * _BASES[0]
        every = np.flatnonzero(inside)
        order = every[np.argsort(own[every])]
        same = own[order][1:] == own[order][:-1]
        twice = np.unique(np.r_[order[1:][same], order[:-1][same]])
        self.own_at, self.own_n = intervals(twice) if len(twice) else (twice, twice)
        self.own_which = self.doc[self.own_at]
        self.own_at = self.own_at - self.start[self.own_which]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id and its text's hash, so that repeated ids do no harm."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def window_runs(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each run; rows without an anchor are intervals of windows that repeat in their own text."""

    def flush(texts: list[list[bytes]], docs: list, hashes: list) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts])
        r = Runs(word_hashes([w for t in texts for w in t]), sizes, window, gram)
        which = np.r_[r.which, r.own_which]
        blank = np.r_[np.zeros(len(r.which), bool), np.ones(len(r.own_which), bool)]
        pad = np.zeros(len(r.own_which), dtype=np.uint64)
        rows = pa.array(which)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[r.anchor, pad].view(np.int64), mask=blank),
                pa.array(np.r_[r.hash, pad].view(np.int64), mask=blank),
                pa.array(docs, pa.int64()).take(rows),
                pa.array(hashes, pa.int64()).take(rows),
                _ints(np.r_[r.at, r.own_at]),
                _ints(np.r_[r.n, r.own_n]),
            ],
            names=["anchor", "h", "doc_id", "th", "at", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, docs, hashes, held = [], [], [], 0
        for batch in batches:
            for doc, th, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words = t.split()
                if len(words) >= window:
                    texts.append(words)
                    docs.append(doc)
                    hashes.append(th)
                    held += len(words)
                    if held >= TOGETHER:
                        yield flush(texts, docs, hashes)
                        texts, docs, hashes, held = [], [], [], 0
        if texts:
            yield flush(texts, docs, hashes)

    return keyed.mapInArrow(run, "anchor long, h long, doc_id long, th long, at int, n int")


def _packed(keyed: DataFrame) -> DataFrame:
    """The texts as zstd blobs, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press(t) for t in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "th", "z"])

    return keyed.mapInArrow(run, "doc_id long, th long, z binary")


def requested_windows(packed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The windows, hashed one by one, of the runs in ``wanted`` (doc_id, th, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for z, doc, th, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = word_hashes(unpack(z).split())
                w1, w2 = (rolling(words, window, b) for b in _BASES)
                at = np.concatenate([np.arange(s["at"], s["at"] + s["n"]) for s in spans])
                once = np.concatenate([np.full(s["n"], s["once"]) for s in spans])
                for lo in range(0, len(at), 50_000):
                    own = at[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [_longs(w1[own]), _ints((w2[own] >> _U(32)).view(np.int64)), pa.array([doc] * len(own), pa.int64()), pa.array([th] * len(own), pa.int64()), _ints(own), pa.array(once[lo : lo + 50_000])],
                        names=["w1", "w2", "doc_id", "th", "at", "once"],
                    )

    same = packed["doc_id"].eqNullSafe(wanted["doc_id"]) & (packed["th"] == wanted["th"])
    rows = packed.join(wanted, same).select("z", packed["doc_id"], packed["th"], "spans")
    return rows.mapInArrow(run, "w1 long, w2 int, doc_id long, th long, at int, once boolean")


def repeated_spans(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, th, spans)``: for each text, intervals of windows that occur elsewhere, (at, n)."""
    every = staged(window_runs(keyed, window, gram))
    own = every.where("anchor is null").select("doc_id", "th", "at", "n")
    runs = every.where("anchor is not null")
    often = runs.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1")
    near = staged(with_keys(runs, often, ["anchor"], "times", runs.count()))
    one = [F.first(c).alias(c) for c in ("doc_id", "th", "at", "n")]
    distinct = staged(near.groupBy("anchor", "h").agg(F.count("*").alias("copies"), *one))
    # Anchors under which some run stands alone beside another one: only there can a window be shared by unequal runs.
    shared = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 and fewest = 1")
    asked = with_keys(distinct, shared, ["anchor"], "kinds", distinct.count())
    # What is gathered here is one text's own runs.
    span = F.struct("at", "n", (F.col("copies") == 1).alias("once"))
    wanted = asked.groupBy("doc_id", "th").agg(F.collect_list(span).alias("spans"))
    windows = staged(requested_windows(_packed(keyed), wanted, window))
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1")
    single = with_keys(windows.where("once"), again, ["w1", "w2"], "times", windows.count()).select("doc_id", "th", "at", F.lit(1).alias("n"))
    whole = with_keys(near, distinct.where("copies > 1"), ["anchor", "h"], "copies", near.count()).select("doc_id", "th", "at", "n")
    return whole.union(single).union(own).groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: each row's text without the words of repeated windows.

    Kept words are joined by one space. Null and blank texts have no words; texts shorter
    than a window lose nothing. Repeated rows are occurrences of their own: two equal rows
    of a window's length or more lose all their words. Very long texts are read whole. Columns other
    than doc_id and text, whatever their names, are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n, removed, kept = [], [], []
            for z, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = unpack(z).split()
                n.append(len(words))
                if found:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.array([s["at"] for s in found])
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + np.array([s["n"] for s in found]) + window - 1, -1)
                    stay = np.cumsum(edges[:-1]) == 0
                    words = list(compress(words, stay.tolist()))
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    packed = _packed(keyed)
    same = packed["doc_id"].eqNullSafe(spans["doc_id"]) & (packed["th"] == spans["th"])
    return packed.join(spans, same, "left").select(packed["doc_id"], "z", "spans").mapInArrow(run, SCHEMA)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """The same result by a dictionary of all windows; for tests."""
    split = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


ORACLE = {
    "op3_substring": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        k AS (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS words
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS i FROM w)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY words) AS n FROM k) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM again),
        every AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.p) AS t FROM every e
                 LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
    """
}
