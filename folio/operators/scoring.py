"""Scores of queries and passages in blocks: matrix products and one search for all keywords of a block of queries.

Passages are sorted by book and taken in slices; for each slice and block of queries the best of each book are
put out, so that what is ranked afterwards is a small part of all pairs. Every passage is read and its text lowered
once. One block of queries goes to all tasks as it is; more of them are packed into rows, of which
each group of passages gets a copy, and meet the packed passages of that group in an equality join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from folio.functions.text import query_terms
from folio.operators.staging import cut

#: Share of the keyword boost in a score.
BOOST = 0.08

#: Queries of a block (of which the driver gathers one at most), passages of a slice, queries of a packed row.
QUERY_BLOCK = 4096
SLICE = 512
AT_ONCE = 512

#: Terms of a block from which they are looked up by one automaton instead of one by one.
MANY_TERMS = 1000

#: Weights of a keyword by its length: fixed values.
WEIGHTS = ((6, 1.2), (4, 1.0), (0, 0.7))

_QUERY = ["query_id", "query_vec", "terms", "model_id"]
_SHOWN = ["chunk_id", "book_id", "start_offset", "end_offset", "safe"]
_CHUNK = [*_SHOWN, "hay", "embedding", "model_id"]


def _queries(queries: DataFrame) -> DataFrame:
    terms = query_terms(F.col("query_text")) if "query_text" in queries.columns else F.array().cast("array<string>")
    model = F.col("model_id").cast("string") if "model_id" in queries.columns else F.lit(None).cast("string")
    return queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"), terms.alias("terms"), model.alias("model_id"))


def _chunks(chunks: DataFrame) -> DataFrame:
    """Passages with a lowered text, sorted by book; a book with any number of them is as many partitions as it needs."""
    spark = chunks.sparkSession
    here = lambda c, kind: F.col(c).cast(kind) if c in chunks.columns else F.lit(None).cast(kind)
    own = chunks.select("chunk_id", "book_id", here("start_offset", "long").alias("start_offset"), here("end_offset", "long").alias("end_offset"), here("safe", "boolean").alias("safe"), here("text", "string").alias("text"), F.col("embedding").cast("array<float>").alias("embedding"), here("model_id", "string").alias("model_id"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = own.repartitionByRange(tasks, "book_id", "chunk_id").sortWithinPartitions("book_id", "chunk_id")
    return dealt.withColumn("hay", F.lower(F.coalesce("text", F.lit("")))).select(*_CHUNK)


def _vectors(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and sizes of a column of vectors; a null one has size 0, a null component is no number."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], dtype=np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes, sizes


class QueryBlock:
    """A bounded number of queries: vectors by dimension, and for each distinct term the queries that have it."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, terms: list[list[str] | None], models: list[str | None]):
        self.ids, self.models = ids, np.array(models, dtype=object)
        values, starts, sizes = _vectors(vectors)
        self.by_size = {}
        for d in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == d)
            self.by_size[d] = own, values[starts[own][:, None] + np.arange(d)]
        place: dict[str, list[int]] = {}
        for i, own in enumerate(terms):
            for t in own or ():
                place.setdefault(t, []).append(i)
        self.terms = list(place)
        self.having = [np.array(x) for x in place.values()]
        self.weight = [next(w for n, w in WEIGHTS if len(t) >= n) for t in self.terms]
        self.find = self._finder()

    def _finder(self):
        if len(self.terms) > MANY_TERMS:
            try:
                import ahocorasick
            except ImportError:
                pass
            else:
                automaton = ahocorasick.Automaton()
                for i, t in enumerate(self.terms):
                    automaton.add_word(t, i)
                automaton.make_automaton()
                return lambda hay: sorted({i for _, i in automaton.iter(hay)})
        return lambda hay: [i for i, t in enumerate(self.terms) if t in hay]

    def boosts(self, hays: list[str]) -> np.ndarray:
        out = np.zeros((len(hays), len(self.ids)))
        for row, hay in zip(out, hays, strict=True):
            hits = self.find(hay) if hay else []
            if hits:
                having = [self.having[i] for i in hits]
                row += np.bincount(np.concatenate(having), np.repeat([self.weight[i] for i in hits], [len(x) for x in having]), len(row))
        return out


def block_scores(q: QueryBlock, vectors: pa.Array, hays: list[str], models: list[str | None]) -> np.ndarray:
    """Rounded scores (passage, query): -inf where a vector is missing, its size or the model differs."""
    values, starts, sizes = _vectors(vectors)
    out = np.full((len(sizes), len(q.ids)), -np.inf)
    for d, (own, matrix) in q.by_size.items():
        rows = np.flatnonzero(sizes == d)
        if len(rows):
            out[np.ix_(rows, own)] = values[starts[rows][:, None] + np.arange(d)] @ matrix.T
    if q.terms:
        out += BOOST * q.boosts(hays)
    m = np.array(models, dtype=object)
    if any(x is not None for x in q.models) and any(x is not None for x in m):
        out[m[:, None] != q.models[None, :]] = -np.inf
    # Half up away from zero, so that engines and partitions agree on ties.
    rounded = np.sign(out) * np.floor(np.abs(out) * 1e6 + 0.5) / 1e6
    return np.where(np.isfinite(out), rounded, -np.inf)


class Best:
    """The best scores so far of the book that is being read: (rank, query) for each of the rankings that are asked for."""

    def __init__(self, tops: list[tuple[int, bool]], queries: int):
        self.tops, self.queries, self.book = tops, queries, object()

    def of(self, book: object) -> None:
        if book != self.book:
            self.book, self.scores = book, [np.full((k, self.queries), -np.inf) for k, _ in self.tops]

    def mark(self, scores: np.ndarray, safe: np.ndarray, keep: np.ndarray) -> None:
        """Mark in ``keep`` what may be among the best: a later passage of a book loses a tie, so it must beat the k-th before it."""
        for i, (k, only) in enumerate(self.tops):
            rows = np.flatnonzero(safe) if only else np.arange(len(scores))
            order = np.argsort(-scores[rows], axis=0, kind="stable")[:k]
            found = np.take_along_axis(scores[rows], order, axis=0)
            at, of = np.nonzero(found > self.scores[i][-1])
            keep[rows[order[at, of]], of] = True
            self.scores[i] = -np.sort(-np.vstack([self.scores[i], found]), axis=0)[:k]


def _scored(q: QueryBlock, chunk: dict[str, pa.Array], tops: list[tuple[int, bool]] | None, best: Best | None = None) -> Iterator[pa.RecordBatch]:
    """Scores of passages, of which those of a book stand together; by id, if ``best`` is carried from one call to the next."""
    best = best or Best(tops or [], len(q.ids))
    codes = pc.dictionary_encode(chunk["book_id"], null_encoding="encode").indices.to_numpy()
    safe = np.array([bool(x) for x in chunk["safe"].to_pylist()], dtype=bool)
    for lo in range(0, len(codes), SLICE):
        part = {c: x.slice(lo, SLICE) for c, x in chunk.items()}
        scores = block_scores(q, part["embedding"], part["hay"].to_pylist(), part["model_id"].to_pylist())
        keep = scores > -np.inf
        if tops is not None:
            keep = np.zeros(scores.shape, dtype=bool)
            own = codes[lo : lo + SLICE]
            edges = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)].tolist()
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                best.of(part["book_id"][first].as_py())
                best.mark(scores[first:end], safe[lo + first : lo + end], keep[first:end])
        at, of = np.nonzero(keep)
        if len(at):
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(of)), *(part[c].take(rows) for c in _SHOWN), pa.array(scores[at, of])], names=["query_id", *_SHOWN, "score"])


def packed(df: DataFrame, size: int, by: str | None = None) -> DataFrame:
    """Up to ``size`` consecutive rows of a partition as one row of arrays; with ``by``, rows of one value only, which stays as it is."""
    names = df.columns
    schema = S.StructType([S.StructField(f.name, f.dataType if f.name == by else S.ArrayType(f.dataType)) for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = {*range(0, b.num_rows, size), b.num_rows}
            if by and b.num_rows:
                codes = pc.dictionary_encode(b.column(by), null_encoding="encode").indices.to_numpy()
                edges |= set((np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist())
            at = sorted(edges)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi > lo:
                    cols = [b.column(c).slice(lo, 1) if c == by else pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), b.column(c).slice(lo, hi - lo)) for c in names]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)


def _result(queries: DataFrame, chunks: DataFrame) -> S.StructType:
    kind = {f.name: f.dataType for f in chunks.schema.fields}
    return S.StructType([S.StructField("query_id", queries.schema["query_id"].dataType), *(S.StructField(c, kind[c]) for c in _SHOWN), S.StructField("score", S.DoubleType())])


def _of_packs(pairs: DataFrame, book: bool, tops: list[tuple[int, bool]] | None, schema: S.StructType) -> DataFrame:
    """Scores of rows that hold a pack of queries (columns q_...) beside a pack of passages (c_...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = {c: b.column(c).slice(i, 1) for c in b.schema.names}
                flat = {c: x if c == "c_book_id" and book else x.flatten() for c, x in one.items()}
                if book:
                    flat["c_book_id"] = flat["c_book_id"].take(pa.array([0] * len(flat["c_chunk_id"]), pa.int32()))
                q = QueryBlock(flat["q_query_id"], flat["q_query_vec"], flat["q_terms"].to_pylist(), flat["q_model_id"].to_pylist())
                yield from _scored(q, {c: flat[f"c_{c}"] for c in _CHUNK}, tops)

    return pairs.mapInArrow(run, schema)


def _named(df: DataFrame, mark: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{mark}_{c}") for c in df.columns])


def score_blocks(queries: DataFrame, chunks: DataFrame, tops: list[tuple[int, bool]] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """``(query_id, chunk_id, book_id, start_offset, end_offset, safe, score)``.

    With ``tops`` only pairs that may be among the best k of a query and book, for each (k, among safe passages only);
    without, all pairs. ``scope`` (query_id, book_id): a query meets the passages of its books alone. Where queries and
    passages have a model_id, only equal ones meet. Pairs that lack a vector, or whose vectors differ in size, have no score.
    """
    own, asking = _chunks(chunks), _queries(queries)
    schema = _result(asking, own)
    if scope is not None:
        asked = asking.join(scope.select("query_id", "book_id").distinct(), "query_id").select(*_QUERY, "book_id")
        near = asked.repartitionByRange("book_id", "query_id").sortWithinPartitions("book_id", "query_id")
        q = _named(packed(near, AT_ONCE, "book_id"), "q")
        c = _named(packed(own, SLICE, "book_id"), "c")
        return _of_packs(c.join(q, F.col("c_book_id") == F.col("q_book_id")).drop("q_book_id"), True, tops, schema)
    # One row more than a block tells whether there are more queries.
    arrow = asking.limit(QUERY_BLOCK + 1).toArrow().combine_chunks()
    if arrow.num_rows <= QUERY_BLOCK:
        block = own.sparkSession.sparkContext.broadcast([arrow.column(c).to_pylist() if c in ("terms", "model_id") else pa.concat_arrays(arrow.column(c).chunks or [pa.array([], arrow.column(c).type)]) for c in _QUERY])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = QueryBlock(*block.value)
            best = Best(tops or [], len(q.ids))
            for b in batches:
                yield from _scored(q, {c: b.column(c) for c in _CHUNK}, tops, best)

        return own.mapInArrow(run, schema)
    groups = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = _named(packed(own, SLICE), "c").withColumn("_group", F.pmod(F.xxhash64(F.element_at("c_chunk_id", 1)), F.lit(groups)))
    q = _named(packed(cut(asking), AT_ONCE), "q").withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return _of_packs(c.join(q.hint("merge"), "_group").drop("_group"), False, tops, schema)
