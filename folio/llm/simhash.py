"""SimHash near-duplicate groups by a Gray-order hierarchical index.

Fingerprints are 64 bits over word shingles. All pairs of distinct fingerprints within
``MAX_BITS`` bits are found, none of them lost:

* The 64 bits are cut into four blocks of 16. Two fingerprints within two bits agree on
  at least two whole blocks, so each fingerprint goes to six groups, keyed by two blocks.
  That is the top level of the index: the members of a group share a mask and its bits.
* A group that is larger than ``HOT`` is split again by two of the four 8-bit blocks of
  the bits that are still free; such a group has 65,536 distinct members at the very most.
* In a group the fingerprints are sorted by Gray rank, so that neighbours differ little.
  Runs of them form nodes which hold the bits that all below share; each level keeps only
  the bits that its parent does not have. A search adds the differences up from level to
  level and drops a whole node as soon as they exceed the limit.

Each group hands on a spanning forest of its links, not the pairs, so the output stays
linear however dense a group is; ``connected_components`` joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import similar
from folio.llm.common import cut, small_batches, staged, table, text_or_empty, wrapped
from folio.llm.components import connected_components

SHINGLE = 3
#: Words of a shingle where near copies are to be removed, not only linked by fingerprint.
STAGE_SHINGLE = 5
MAX_BITS = 2
SEED = 42
#: Members from which a group is split again. It bounds a task's work; no pair is lost by it.
HOT = 2048
FANOUT = 16

_CHUNK = 8192


def majority(values: np.ndarray) -> int:
    """The 64 bits that are set in over half the values."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), _CHUNK):
        bits = np.unpackbits(values[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    set_bits = np.packbits((2 * ones > len(values)).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of UTF-8 text; 0 for a text without words."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= shingle:
        return majority(np.array([hashed(joined, SEED)], dtype=np.uint64))
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    return majority(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n - shingle + 1))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every whole text; null texts count as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchy over fingerprints in Gray order; nodes hold the bits that all below them share."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        mask, bits = np.full(len(codes), ~np.uint64(0)), self.codes
        levels = [(mask, bits)]
        while len(bits) > 1:
            cuts = np.arange(0, len(bits), fanout)
            all_on = np.bitwise_and.reduceat(bits, cuts)
            any_on = np.bitwise_or.reduceat(bits, cuts)
            mask = np.bitwise_and.reduceat(mask, cuts) & ~(all_on ^ any_on)
            bits = all_on & mask
            levels.append((mask, bits))
        self.fanout = fanout
        self.levels = []  # root first: (bits that the level adds, their values)
        above = np.zeros(1, dtype=np.uint64)
        for mask, bits in reversed(levels):
            seen = np.repeat(above, fanout)[: len(mask)] if self.levels else np.zeros(len(mask), dtype=np.uint64)
            self.levels.append((mask & ~seen, bits))
            above = mask

    def near(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and of stored codes within ``limit`` bits of each other."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), dtype=np.int64)
        gone = np.zeros(len(queries), dtype=np.int64)
        for depth, (mask, bits) in enumerate(self.levels):
            if depth:
                q, gone = np.repeat(q, self.fanout), np.repeat(gone, self.fanout)
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                there = node < len(mask)
                q, gone, node = q[there], gone[there], node[there]
            gone = gone + np.bitwise_count((queries[q] ^ bits[node]) & mask[node])
            close = gone <= limit
            q, gone, node = q[close], gone[close], node[close]
        return q, node


def forest(codes: np.ndarray, limit: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning links of one group of distinct fingerprints; each is a pair within ``limit`` bits."""
    if len(codes) == 2:
        a, b = codes
        return [(int(b), int(a))] if int(a ^ b).bit_count() <= limit else []
    index = GrayIndex(codes)
    parent = np.arange(len(codes))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for at in range(0, len(codes), 256):
        q, hit = index.near(index.codes[at : at + 256], limit)
        q = q + at
        ends = np.stack([parent[q], parent[hit]])
        apart = np.flatnonzero(ends[0] != ends[1])
        for i in apart[np.unique(ends[:, apart], axis=1, return_index=True)[1]].tolist():
            x, y = find(q[i]), find(hit[i])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(index.codes[q[i]]), int(index.codes[hit[i]])))
    return out


def _blocks(code: Column, width: int, count: int, shift: int = 0) -> list[Column]:
    low = F.lit((1 << width) - 1)
    return [F.shiftrightunsigned(code, shift + width * i).bitwiseAND(low) for i in range(count)]


def _pairs(parts: list[Column], width: int) -> list[Column]:
    """A key for each two of four parts, with the number of the choice above their bits."""
    return [
        F.shiftleft(F.lit(n).cast("long"), 2 * width).bitwiseOR(F.shiftleft(parts[i], width)).bitwiseOR(parts[j])
        for n, (i, j) in enumerate(combinations(range(4), 2))
    ]


def link_forest(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct ``fp`` -> ``(a, b)``: links whose closure is that of all pairs within MAX_BITS."""
    keyed = fps.select("fp", F.explode(F.array(*_pairs(_blocks(F.col("fp"), 16, 4), 16))).alias("k"))
    hot_keys = cut(keyed.groupBy("k").count().where(F.col("count") > hot).select("k", F.lit(True).alias("hot")))
    # The 32 bits that a hot group leaves free, put side by side: the two blocks not in its key.
    sixteen = _blocks(F.col("fp"), 16, 4)
    which = F.shiftrightunsigned("k", 32).cast("int")
    rest = F.coalesce(
        *[
            F.when(which == n, F.shiftleft(sixteen[r[0]], 16).bitwiseOR(sixteen[r[1]]))
            for n, c in enumerate(combinations(range(4), 2))
            if (r := [i for i in range(4) if i not in c])
        ]
    )
    dealt = (
        keyed.join(hot_keys, "k", "left")
        .withColumn("rest", rest)
        .select("fp", "k", F.explode(F.when(F.col("hot"), F.array(*[x + 1 for x in _pairs(_blocks(F.col("rest"), 8, 4), 8)])).otherwise(F.array(F.lit(0).cast("long")))).alias("k2"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the group that may go on in the next batch
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, k, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (k2[1:] != k2[:-1])) + 1
            starts, stops = np.r_[0, cuts], np.r_[cuts, len(fp)]
            out = []
            first = (k[0], k2[0])
            if last is not None and first != last:
                out += forest(np.concatenate(held).view(np.uint64)) if sum(map(len, held)) > 1 else []
                held = []
            held.append(fp[: stops[0]].copy())
            if len(starts) > 1:
                out += forest(np.concatenate(held).view(np.uint64)) if sum(map(len, held)) > 1 else []
                for i in np.flatnonzero(stops[1:-1] - starts[1:-1] > 1) + 1:
                    out += forest(fp[starts[i] : stops[i]].view(np.uint64))
                held = [fp[starts[-1] :].copy()]
            last = (k[-1], k2[-1])
            yield _edges(out)
        if held and sum(map(len, held)) > 1:
            yield _edges(forest(np.concatenate(held).view(np.uint64)))

    groups = dealt.repartition("k", "k2").sortWithinPartitions("k", "k2")
    return groups.mapInArrow(run, "a long, b long").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.uint64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs`` (columns doc_id and text; others are ignored).

    Null and blank texts have fingerprint zero and link like any other. Repeated rows each
    give a row. component_id is the smallest doc_id of the group (null doc_ids count last;
    a group with none but null has null). An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(link_forest(distinct))
    linked = roots.withColumnRenamed("node", "fp").join(distinct, "fp")
    ids = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = distinct.join(linked.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id")
    )
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """The documents less all but one of each group of near copies; columns unchanged.

    Near copies are texts whose sets of ``shingle`` words in a row, A-Z in lower case, are at 0.8 of each
    other or more (similar.TENTHS), and all that are joined by such pairs. The index links the
    fingerprints of the sets; ``similar.links`` completes and decides the links.

    Of a group the row with the smallest doc_id stays; null doc_ids come last, and of rows with
    the same doc_id one stays. Null and blank texts are copies of each other; texts of up to
    ``shingle`` words are near copies only if they are equal. Very long texts are compared whole. An
    empty table gives no rows.
    """
    text = text_or_empty()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    marked = staged(similar.signatures(texts, shingle, majority))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    first = [F.first(c).alias(c) for c in ("size", "fp", "keys")]
    nodes = staged(marked.groupBy("node").agg(F.min(row).alias("row"), F.count("*").alias("n"), *first))
    # Fingerprint links as pairs of texts: each of a fingerprint's texts with its first one, and the first ones of linked fingerprints.
    of_fp = staged(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    same = nodes.select("fp", F.col("node").alias("b")).join(of_fp.where("n > 1").select("fp", F.col("node").alias("a")), "fp").where("a <> b")
    ends = [of_fp.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node")) for c in ("a", "b")]
    near = link_forest(of_fp).join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    roots = connected_components(similar.links(nodes, texts, cut(same.select("a", "b").union(near)), shingle))
    grouped = nodes.select("node", "row").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    kept = grouped.groupBy("group").agg(F.min("row").alias("row")).select(F.xxhash64("row.node", "row.doc_id").alias("_key"))
    keyed = wrapped(docs, "doc_id", "text").select("_row", F.xxhash64(F.xxhash64(text), F.col("doc_id").cast("long")).alias("_key"))
    left = keyed.join(kept, "_key", "left_semi")
    repeated = nodes.where("n > 1").limit(1).count()
    return (left.dropDuplicates(["_key"]) if repeated else left).select("_row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
