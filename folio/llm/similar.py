"""Links between near copies by Jaccard similarity of word shingles, for SimHash near-dedup of a corpus.

Texts that are at 0.8 in five-word shingles differ in about ten fingerprint bits of 64, sometimes in
twenty, and no index over bits finds all of those without comparing nearly everything. So here
fingerprints make the first links and others complete them:

1. MinHash bands (32 of 4 rows; a pair at 0.8 shares none once in 20 million times) say which
   texts could be near copies. In a band, all are held against two of them, the hubs, if their
   fingerprints are near; together with the links of the Gray-order index this joins dense groups
   at a cost that is linear in their size.
2. Texts that share a band but are still in different groups go through an exact prefix filter:
   shingles are ordered by frequency, rare ones first, and two texts can only be similar if they share
   one of their first few. A passage that many texts share comes last in that order, so it
   makes no pairs. Places and sizes rule out whole classes of texts before any pair is made.

Every pair named is decided by whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import cut, small_batches, staged, with_keys
from folio.llm.components import connected_components

#: Pairs at this many tenths of similarity or more are near copies.
TENTHS = 8
BANDS, ROWS = 32, 4
SEED = 42
#: Fingerprint bits up to which a text is held against a hub; what is missed so is left to the prefix filter.
HUB_BITS = 16
#: Members of a hub in one task.
DEALT = 512

_STEP = 512


def shingles(raw: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles of UTF-8 text; a shorter text is one shingle."""
    words = raw.lower().split()
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return np.array([hashed(joined, SEED)], dtype=np.uint64)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    return np.unique(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n - shingle + 1))


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash signature."""
    made = np.random.default_rng(SEED).integers(0, 2**64, (3, BANDS * ROWS), dtype=np.uint64)
    flip, times = made[0][:, None], made[1][:, None] | np.uint64(1)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(values), _STEP):
        least = np.minimum(least, ((values[None, at : at + _STEP] ^ flip) * times).min(axis=1))
    mixed = (least ^ (least >> np.uint64(29))) * (made[2] | np.uint64(1))
    mixed ^= mixed >> np.uint64(32)
    return mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def signatures(texts: DataFrame, shingle: int, fingerprint) -> DataFrame:
    """``(doc_id, node, size, fp, keys)`` of ``(doc_id, node, text)``: number of shingles, ``fingerprint`` of their hashes, band keys."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            keys = np.concatenate([band_keys(v) for v in sets] or [np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            fps = np.fromiter((fingerprint(v) for v in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(fps), lists], names=["doc_id", "node", "size", "fp", "keys"])

    return texts.mapInArrow(run, "doc_id long, node long, size long, fp long, keys array<long>")


def packed(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, z)``: each text of ``nodes`` once, as a zstd blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press(t) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["node", "z"])

    blobs = texts.select("node", "text").mapInArrow(run, "node long, z binary")
    return staged(blobs.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def verified(pairs: DataFrame, blobs: DataFrame, shingle: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose shingle sets are similar enough; a's set is built once for up to DEALT b's."""
    members = pairs.groupBy("a").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("b"), F.floor(F.col("n") / DEALT).cast("long") + 1)
    dealt = cut(pairs.join(members, "a").select("a", "b", part.alias("part")))
    hubs = dealt.select("a", "part").distinct().select("a", "part", F.lit(0).alias("place"), F.col("a").alias("node"))
    rows = hubs.union(dealt.select("a", "part", F.lit(1).alias("place"), F.col("b").alias("node"))).join(blobs, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            a, place, node, z = (c.to_pylist() for c in batch.columns)
            for i, blob in enumerate(z):
                own = shingles(unpack(blob), shingle)
                if not place[i]:
                    hub = own
                    continue
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if 10 * both >= TENTHS * (len(hub) + len(own) - both):
                    out.append((a[i], node[i]))
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    # A hub's row comes before its members'.
    sorted_rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "place")
    return sorted_rows.select("a", "place", "node", "z").mapInArrow(run, "a long, b long")


def _alike(a: str, b: str) -> Column:
    """Sizes that allow the similarity."""
    return 10 * F.least(a, b) >= TENTHS * F.greatest(a, b)


def prefix_pairs(blobs: DataFrame, groups: DataFrame, shingle: int) -> DataFrame:
    """``(a, b)``: every pair over ``groups`` (node, root) that can be similar and is of two roots, and some that are not similar.

    No similar pair is left out: it shares one of each text's first ``size - need + 1`` shingles, in
    one order of all shingles, and after that place enough are left in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for node, root, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(unpack(z), shingle)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, node)), pa.array(np.full(n, root)), pa.array(np.full(n, n)), pa.array(own.view(np.int64))], names=["node", "root", "size", "token"]
                )

    tokens = staged(blobs.join(groups, "node").select("node", "root", "z").mapInArrow(run, "node long, root long, size long, token long"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    shared = with_keys(tokens, counts, ["token"], "times", tokens.count(), keep_times=True)
    of_node = Window.partitionBy("node")
    # Tokens of one text only come first in the order and make no pair.
    rank = F.row_number().over(of_node.orderBy("times", "token"))
    placed = shared.withColumn("place", F.col("size") - F.count("*").over(of_node) + rank)
    need = F.ceil(F.col("size") * TENTHS / 10)
    prefix = cut(placed.where(F.col("place") <= F.col("size") - need + 1).select("token", "node", "root", "size", "place"))
    # Classes first: texts of one root, size and place are alike for all filters.
    key = ["token", "root", "size", "place"]
    classes = prefix.select(*key).distinct()
    other = classes.select("token", *[F.col(c).alias(f"{c}_b") for c in key[1:]])
    left = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b")) + 1
    fits = _alike("size", "size_b") & ((10 + TENTHS) * left >= TENTHS * (F.col("size") + F.col("size_b")))
    open_pairs = classes.join(other, "token").where((F.col("root") < F.col("root_b")) & fits)
    a = prefix.withColumnRenamed("node", "a")
    b = prefix.select("token", *[F.col(c).alias(f"{c}_b") for c in key[1:]], F.col("node").alias("b"))
    return open_pairs.join(a, key).join(b, ["token", "root_b", "size_b", "place_b"]).select("a", "b").distinct()


def links(nodes: DataFrame, texts: DataFrame, near: DataFrame, shingle: int) -> DataFrame:
    """``(a, b)`` over ``nodes`` (node, size, fp, keys): links whose closure is that of all similar pairs that share a band.

    ``near`` (a, b) are pairs that fingerprints have found.
    """
    banded = nodes.select("node", "size", "fp", F.explode("keys").alias("k"))
    own = F.struct("node", "size", "fp")
    hubs = banded.groupBy("k").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.count("*").alias("times")).where("lo.node <> hi.node")
    shared = staged(with_keys(banded, hubs, ["k"], "times", nodes.count() * BANDS, keep_times=True))
    stars = shared.select("node", "size", "fp", F.explode(F.array("lo", "hi")).alias("h")).where("node <> h.node").select("node", "size", "fp", "h.*")
    stars = stars.toDF("node", "size", "fp", "hub", "hub_size", "hub_fp")
    close = _alike("size", "hub_size") & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) <= HUB_BITS)
    first = cut(stars.where(close).select(F.col("hub").alias("a"), F.col("node").alias("b")).union(near.select("a", "b")).distinct())
    blobs = packed(texts, shared.select("node").union(near.select("a")).union(near.select("b")).distinct())
    linked = cut(verified(first, blobs, shingle))
    roots = connected_components(linked)
    grouped = shared.select("k", "node").join(roots, "node", "left").select("k", "node", F.coalesce("root", "node").alias("root"))
    apart = grouped.groupBy("k").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("times")).where("r0 <> r1")
    open_rows = with_keys(grouped, apart.select("k", "times"), ["k"], "times", nodes.count() * BANDS).select("node", "root").distinct()
    late = prefix_pairs(blobs, cut(open_rows), shingle)
    return linked.union(cut(verified(cut(late), blobs, shingle)))
