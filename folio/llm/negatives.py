"""Hard-negative mining by a multiway hyperplane tree with distance ranges (GNAT), exact at its leaves.

Vectors are whole numbers, and a score is their inner product. One added component makes all rows
equally long, so that a window of scores is an annulus around a query: squared distance falls as the
score rises. Each node of the tree has split points; a row belongs to the nearest one, and each split point keeps
the least and largest distance to the rows of every sibling. A query with its annulus knows, from its distance
to a split point, between which distances any hit must lie from there; a sibling whose range lies apart is
left out with all that is below it, and so is one that the bisecting hyperplane shows to be too far. Scores at
the leaves are computed in whole, so pruning costs no hit.

In Spark the root has up to SPLITS split points, chosen from SAMPLE rows; every row is indexed. Rows are sorted by
cell and distance from its split point into blocks of BLOCK rows (so a cell, or a vector with any number
of copies, is as many blocks as it needs), and a block holds the tree below. Queries travel in packs
to the blocks that the root leaves over. Before that each asks its own block, which narrows its
annulus to what may still come among the k best. Vectors are never sent to the driver, but for the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import cut, small_batches, staged

#: Split points of the root at most, rows from which they are chosen, rows of a block, queries of a pack.
SPLITS = 256
SAMPLE = 2048
BLOCK = 1024
PACK = 512

#: Split points of an inner node below the root, rows of a leaf at most.
WAYS = 8
LEAF = 64

#: Hits that a search gathers before it keeps the best of each query.
GATHER = 1 << 18

#: Components are held to this size, so that sums of products are exact.
LARGEST = 1 << 22

#: Blocks (20 bytes each) that are listed in a broadcast.
BROADCAST_BLOCKS = 500_000

POSITIVES = 5
NEGATIVES = 3
SCALE = 256


def whole_vector(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, as whole numbers."""
    of = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(scale * x.cast("double")))).cast("int")
    return F.transform(vector, of)


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _dense(lists: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, shorter ones filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim).astype(np.int32)
    out = np.zeros((len(sizes), dim), dtype=np.int32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """Rows with one component more, so that all have the length of the longest; queries, stretched to that length, have none there.

    Stretching a query changes no order of scores, and brings it as near to its hits as it can be.
    """

    def __init__(self, dim: int, longest: int):
        self.dim, self.square = dim, float(longest)
        #: What rounding may add to a distance.
        self.slack = 1e-6 * (math.sqrt(self.square) + 1)

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        return np.column_stack([v, np.sqrt(np.maximum(0, self.square - (v * v).sum(1)))])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows."""
        return np.sqrt(np.maximum(0, 2 * (self.square - a @ b.T)))

    def reach(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance from a stretched query, whose squared length was ``norms``, to a row with ``scores``."""
        stretch = np.sqrt(np.divide(self.square, norms, out=np.zeros_like(norms), where=norms > 0))
        return np.sqrt(np.maximum(0, 2 * (self.square - stretch * scores)))


def choose(points: np.ndarray, count: int, space: Space) -> np.ndarray:
    """Indexes of ``count`` rows, each the farthest from those before it; fewer where the rest are copies."""
    picked = [0]
    far = space.between(points, points[:1])[:, 0]
    while len(picked) < count and far.max(initial=0) > space.slack:
        picked.append(int(far.argmax()))
        far = np.minimum(far, space.between(points, points[picked[-1:]])[:, 0])
    return np.array(picked)


def apart(at: np.ndarray, near: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """For queries at distances ``at`` (query, split point) with annuli ``near`` to ``far``: which siblings can hold no hit (query, sibling).

    ``low`` and ``high`` (split point, sibling) are the ranges of distances. An empty sibling has low over high.
    """
    least = np.maximum(at - far[:, None], near[:, None] - at) - slack
    most = at + far[:, None] + slack
    out = np.zeros((len(at), low.shape[1]), dtype=bool)
    for i in range(at.shape[1]):
        out |= (least[:, i, None] > high[i]) | (most[:, i, None] < low[i])
    return out


class Tree:
    """The tree of one block: nodes in one array, rows in its order."""

    def __init__(self, nodes: np.ndarray, ranges: np.ndarray, splits: np.ndarray):
        self.nodes, self.ranges, self.splits = nodes, ranges, splits

    @staticmethod
    def build(points: np.ndarray, space: Space) -> tuple[Tree, np.ndarray]:
        """The tree and the order of its rows. A node: first row, rows, first child, children."""
        order = np.arange(len(points))
        nodes, ranges, splits, todo = [[0, len(points), -1, 0]], [], [], [0]
        empty = np.zeros((WAYS, WAYS, 2)), np.full(WAYS, -1)
        while todo:
            at = todo.pop()
            first, n = nodes[at][:2]
            own = order[first : first + n]
            picked = choose(points[own], WAYS, space) if n > LEAF else own[:0]
            if len(picked) < 2:
                continue
            d = space.between(points[own], points[own[picked]])
            cell = d.argmin(1)
            ways = len(picked)
            span, split = empty[0].copy(), empty[1].copy()
            split[:ways] = own[picked]
            span[:, :, 0], span[:, :, 1] = np.inf, -np.inf
            nodes[at][2:] = [len(nodes), ways]
            begin = first
            for j in range(ways):
                inside = cell == j
                span[:ways, j, 0], span[:ways, j, 1] = d[inside].min(0), d[inside].max(0)
                todo.append(len(nodes))
                nodes.append([begin, int(inside.sum()), -1, 0])
                begin += int(inside.sum())
            order[first : first + n] = own[np.argsort(cell, kind="stable")]
            nodes[at].append(len(ranges))
            ranges.append(span)
            splits.append(split)
        place = np.empty(len(points), dtype=np.int64)
        place[order] = np.arange(len(points))
        where = np.array([x + [-1] * (5 - len(x)) for x in nodes], dtype=np.int32)
        rows = np.array(splits, dtype=np.int64).reshape(-1, WAYS)
        return Tree(where, np.array(ranges).reshape(-1, WAYS, WAYS, 2), np.where(rows < 0, -1, place[np.maximum(rows, 0)]).astype(np.int32)), order

    def to_bytes(self) -> tuple[bytes, bytes, bytes]:
        return _bytes(self.nodes), _bytes(self.ranges.astype(np.float64)), _bytes(self.splits)

    @staticmethod
    def of_bytes(nodes: bytes, ranges: bytes, splits: bytes) -> Tree:
        return Tree(np.frombuffer(nodes, np.int32).reshape(-1, 5), np.frombuffer(ranges, np.float64).reshape(-1, WAYS, WAYS, 2), np.frombuffer(splits, np.int32).reshape(-1, WAYS))


class Asked:
    """Requests of one pack: each asks for rows with a score from low to high, of its label or of any other, but not for itself."""

    def __init__(self, query: np.ndarray, slot: np.ndarray, label: np.ndarray, same: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, vectors: np.ndarray):
        self.query, self.slot, self.label, self.same, self.low, self.high, self.of = query, slot, label, same, low.copy(), high, of
        self.vectors = vectors.astype(np.float64)
        self.norms = (self.vectors * self.vectors).sum(1)

    def annulus(self, space: Space, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.norms[self.of[which]]
        return space.reach(n, self.high[which]), space.reach(n, self.low[which])


def search(tree: Tree, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, asked: Asked, space: Space, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each request in a block: (request, score, id) arrays."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, s, i = (np.concatenate([x[c] for x in found]) for c in range(3))
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        start = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        keep = rank < k
        last = rank == k - 1
        # What is below the k-th best so far can no longer be among the k best.
        asked.low[r[last]] = np.maximum(asked.low[r[last]], s[last])
        return r[keep], s[keep], i[keep]

    todo = [(0, np.arange(len(asked.query)))]
    while todo:
        at, active = todo.pop()
        first, n, child, ways, inner = tree.nodes[at]
        if not n or not len(active):
            continue
        if child < 0:
            own, back = np.unique(asked.of[active], return_inverse=True)
            scores = (asked.vectors[own] @ points[first : first + n, : space.dim].T)[back]
            here = slice(first, first + n)
            fits = (scores >= asked.low[active, None]) & (scores <= asked.high[active, None])
            fits &= (labels[here] == asked.label[active, None]) == asked.same[active, None]
            fits &= ids[here] != asked.query[active, None]
            r, c = np.nonzero(fits)
            if len(r):
                found.append((active[r], scores[r, c].astype(np.int64), ids[first + c]))
                held += len(r)
                if held > GATHER:
                    found = [best()]
                    held = min(len(found[0][0]), GATHER // 2)
            continue
        split = points[tree.splits[inner, :ways], : space.dim]
        own, back = np.unique(asked.of[active], return_inverse=True)
        at_split = space.reach(asked.norms[own][:, None], asked.vectors[own] @ split.T)[back]
        near, far = asked.annulus(space, active)
        span = tree.ranges[inner, :ways, :ways]
        out = apart(at_split, near, far, span[:, :, 0], span[:, :, 1], space.slack)
        # A row of a cell is nearer to its split point than to any other.
        out |= at_split - at_split.min(1, keepdims=True) > 2 * (far[:, None] + space.slack)
        todo += [(child + j, active[~out[:, j]]) for j in range(ways)]
    return best() if found else (np.empty(0, np.int64),) * 3


class Index:
    """Blocks of rows and the ranges of the root: see ``build_index``."""

    def __init__(self, blocks: DataFrame, space: Space, splits: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.blocks, self.space, self.splits, self.low, self.high = blocks, space, splits, low, high


_ROW = "vec_id long, label int, asks boolean, v array<int>, cell int, d double"
_BLOCK = "cell int, n int, ids binary, labels binary, asks binary, points binary, nodes binary, ranges binary, splits binary, low array<double>, high array<double>"


def build_index(rows: DataFrame) -> Index | None:
    """Index all of ``rows`` (vec_id, label, asks, v): whole vectors, of any lengths (shorter ones are filled up with zeros). None if there are none."""
    size = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    total, dim, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(size)).first()
    if not total:
        return None
    space = Space(dim, longest)
    order = F.xxhash64("vec_id")
    sample = np.array([r["v"] + [0] * (dim - len(r["v"])) for r in rows.select("v", order.alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).collect()], dtype=np.int64).reshape(-1, dim)
    points = space.rows(sample)
    splits = points[choose(points, max(1, min(SPLITS, math.ceil(total / BLOCK))), space)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = space.between(space.rows(_dense(b.column(3), dim)), splits)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "label", "asks", "v", "cell", "d"])

    def block(ids: np.ndarray, labels: np.ndarray, asks: np.ndarray, vectors: np.ndarray, cell: int) -> dict:
        points = space.rows(vectors)
        tree, order = Tree.build(points, space)
        d = space.between(points, splits)
        nodes, ranges, places = tree.to_bytes()
        return {"cell": cell, "n": len(ids), "ids": _bytes(ids[order]), "labels": _bytes(labels[order]), "asks": _bytes(asks[order]), "points": _bytes(vectors[order]), "nodes": nodes, "ranges": ranges, "splits": places, "low": d.min(0).tolist(), "high": d.max(0).tolist()}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "asks", "points", "nodes", "ranges", "splits")), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            ids, labels, asks, vectors, cells = (np.concatenate([p[i] for p in parts]) for i in range(5))
            made = [block(*(x[i : i + BLOCK] for x in (ids, labels, asks, vectors)), int(cells[0])) for i in range(0, len(ids), BLOCK)]
            parts.clear()
            return pa.RecordBatch.from_pylist(made, schema)

        for b in batches:
            cells = b.column(4).to_numpy()
            vectors = _dense(b.column(3), dim)
            cols = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool), vectors, cells
            edges = np.r_[0, np.flatnonzero(np.diff(cells)) + 1, len(cells)]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if parts and (parts[0][4][0] != cells[lo] or held >= BLOCK):
                    yield flush()
                    held = 0
                parts.append(tuple(x[lo:hi] for x in cols))
                held += hi - lo
        if parts:
            yield flush()

    placed = cut(rows.select("vec_id", "label", "asks", "v").mapInArrow(assign, _ROW))
    made = placed.repartitionByRange("cell", "d", "vec_id").sortWithinPartitions("cell", "d", "vec_id").mapInArrow(blocks, _BLOCK)
    kept = staged(made.withColumn("block", F.monotonically_increasing_id()))
    # A row for each pair of the root's split points.
    spans = kept.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("i", "s")).groupBy("cell", "i").agg(F.min("s.low").alias("low"), F.max("s.high").alias("high")).collect()
    low, high = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
    for r in spans:
        low[r["i"], r["cell"]], high[r["i"], r["cell"]] = r["low"], r["high"]
    return Index(kept, space, splits, low, high)


_REQUEST = "query long, slot int, label int, same boolean, low long, high long, home long, v binary"
_PACK = "home long, query binary, slot binary, label binary, same binary, low binary, high binary, of binary, vectors binary"
_TYPES = (np.int64, np.int32, np.int32, np.bool_, np.int64, np.int64, np.int32, np.int32)


def _asked(pack: dict, dim: int) -> Asked:
    names = ("query", "slot", "label", "same", "low", "high", "of", "vectors")
    parts = [np.frombuffer(pack[n], t) for n, t in zip(names, _TYPES, strict=True)]
    return Asked(*parts[:4], parts[4].astype(np.float64), parts[5].astype(np.float64), parts[6], parts[7].reshape(-1, dim))


def _packs(requests: DataFrame, at_home: bool) -> DataFrame:
    """Requests in packs of up to PACK, those of near homes together; ``at_home``: none with two homes."""

    def pack(rows: list[dict]) -> dict:
        place: dict[int, int] = {}
        of = [place.setdefault(r["query"], len(place)) for r in rows]
        vectors = {r["query"]: r["v"] for r in rows}
        out = {n: _bytes(np.array([r[n] for r in rows], dtype=t)) for n, t in zip(("query", "slot", "label", "same", "low", "high"), _TYPES, strict=False)}
        return out | {"home": rows[0]["home"], "of": _bytes(np.array(of, dtype=np.int32)), "vectors": b"".join(vectors[q] for q in place)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("home", pa.int64()), *((n.split()[0], pa.binary()) for n in _PACK.split(", ")[1:])])
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) >= PACK or at_home and r["home"] != held[0]["home"]):
                    yield pa.RecordBatch.from_pylist([pack(held)], schema)
                    held = []
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pylist([pack(held)], schema)

    near = requests.repartitionByRange("home", "query").sortWithinPartitions("home", "query", "slot")
    return cut(near.mapInArrow(run, _PACK))


def _routed(packs: DataFrame, index: Index) -> DataFrame:
    """Each pack with each block of the cells that the root's ranges leave over for any of its requests."""
    space, splits, low, high = index.space, index.splits, index.low, index.high
    names = [n.split()[0] for n in _PACK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, pack in enumerate(b.to_pylist()):
                asked = _asked(pack, space.dim)
                every = np.arange(len(asked.query))
                near, far = asked.annulus(space, every)
                at = space.reach(asked.norms[:, None], asked.vectors @ splits[:, : space.dim].T)[asked.of]
                out = apart(at, near, far, low, high, space.slack) | (at - at.min(1, keepdims=True) > 2 * (far[:, None] + space.slack))
                cells = np.flatnonzero(~out.all(0))
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array([i] * len(cells), pa.int64())) for n in names), pa.array(cells, pa.int32())], names=[*names, "cell"])

    listed = index.blocks.select("cell", "block")
    listed = F.broadcast(listed) if index.blocks.count() <= BROADCAST_BLOCKS else listed
    return packs.mapInArrow(run, f"{_PACK}, cell int").join(listed, "cell").drop("cell")


def _probe(routed: DataFrame, index: Index, k: int) -> DataFrame:
    """``(query, slot, score, id)``: the k best hits of each request in each block that its pack has come to."""
    space, splits = index.space, index.splits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                asked = _asked(row, space.dim)
                # The root once more, by the ranges of this block alone.
                near, far = asked.annulus(space, np.arange(len(asked.query)))
                at = space.reach(asked.norms[:, None], asked.vectors @ splits[:, : space.dim].T)[asked.of]
                gone = apart(at, near, far, np.array(row["b_low"])[:, None], np.array(row["b_high"])[:, None], space.slack)[:, 0]
                asked.low[gone] = 1e18  # beyond any score
                if gone.all():
                    continue
                points = np.frombuffer(row["points"], np.int32).reshape(-1, space.dim).astype(np.float64)
                tree = Tree.of_bytes(row["nodes"], row["ranges"], row["splits"])
                r, s, ids = search(tree, points, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int32), asked, space, k)
                yield pa.RecordBatch.from_arrays([pa.array(asked.query[r]), pa.array(asked.slot[r]), pa.array(s), pa.array(ids)], names=["query", "slot", "score", "id"])

    blocks = index.blocks.select("block", "ids", "labels", "points", "nodes", "ranges", "splits", F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    return routed.join(blocks, "block").drop("block", "home").mapInArrow(run, "query long, slot int, score long, id long")


def window_search(index: Index, requests: DataFrame, k: int) -> DataFrame:
    """``(query, slot, rank, score, id)``: for each request (_REQUEST) the k rows with the highest scores in its window, ties by smaller id.

    ``home`` is the block in which a request looks first; what it finds there raises the lower end of its window.
    """
    laid = cut(requests)
    first = _probe(_packs(laid, at_home=True).withColumn("block", F.col("home")), index, k)
    enough = first.groupBy("query", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    narrowed = laid.join(enough, ["query", "slot"], "left").withColumn("low", F.greatest("low", F.coalesce("least", "low")))
    hits = _probe(_routed(_packs(narrowed.select(*laid.columns), at_home=False), index), index, k)
    best = F.row_number().over(Window.partitionBy("query", "slot").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", best).where(F.col("rank") <= k)


def _queries(index: Index) -> DataFrame:
    """Rows that ask, with the block in which they lie."""
    dim = index.space.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, labels, asks, points in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                at = np.flatnonzero(np.frombuffer(asks, np.bool_))
                v = np.frombuffer(points, np.int32).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(ids, np.int64)[at]), pa.array(np.frombuffer(labels, np.int32)[at]), pa.array([block] * len(at), pa.int64()), pa.array([_bytes(v[i]) for i in at], pa.binary())],
                    names=["query", "label", "home", "v"],
                )

    return index.blocks.select("block", "ids", "labels", "asks", "points").mapInArrow(run, "query long, label int, home long, v binary")


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 50, most: int = 95) -> DataFrame:
    """Hard negatives of the rows that ask: for each of their first ``positives`` rows of the same label, the first ``negatives``
    rows of another label whose score is ``least`` to ``most`` percent of the positive's.

    ``rows`` (vec_id, label, asks, vector) may have other columns of any names. Rows with a null vec_id, label or vector, or a null or non-finite component, take no
    part. Rows that repeat a vec_id count once, as the one with the smallest label and vector. Higher scores come first,
    ties by smaller vec_id; copies of a vector are ranked each. Shorter vectors, empty ones included, are filled up with zeros; components
    beyond LARGEST / SCALE count as that. Anchors without a positive, or with none in the window, give no rows, as does an empty table.
    """
    small_batches(rows.sparkSession)
    asks = F.coalesce(F.col("asks"), F.lit(False))
    part = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    one = F.struct(F.col("label").cast("int").alias("label"), whole_vector(F.col("vector")).alias("v"), asks.alias("asks"))
    laid = cut(part.select(F.col("vec_id").cast("long").alias("vec_id"), one.alias("r")).groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.asks", "r.v"))
    index = build_index(laid)
    if not index:
        return rows.sparkSession.createDataFrame([], _MINED)
    all_scores = [F.lit(x).cast("long") for x in (-(1 << 53), 1 << 53)]
    asking = cut(_queries(index))
    columns = [c.split()[0] for c in _REQUEST.split(", ")]
    near = asking.select("query", F.lit(0).alias("slot"), "label", F.lit(True).alias("same"), all_scores[0].alias("low"), all_scores[1].alias("high"), "home", "v").select(*columns)
    positive = cut(window_search(index, near, positives).select("query", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    low, high = F.ceil(F.col("positive_score") * least / 100).cast("long"), F.floor(F.col("positive_score") * most / 100).cast("long")
    windows = positive.join(asking, "query").select("query", "slot", "label", F.lit(False).alias("same"), low.alias("low"), high.alias("high"), "home", "v").where("low <= high")
    found = window_search(index, windows.select(*columns), negatives)
    out = found.join(positive, ["query", "slot"])
    return out.select(F.col("query").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: Anchors are the rows whose id is divisible by EVERY.
EVERY = 50


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", label.alias("label"), (F.col("vec_id") % EVERY == 0).alias("asks"), F.col("embedding").alias("vector")))


ORACLE = {
    "op11_negatives": f"""
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS v FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint AS score
              FROM e a JOIN e b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= {POSITIVES}),
        m AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::int AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM m WHERE rank <= {NEGATIVES}
    """
}
