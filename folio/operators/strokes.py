"""Highlight strokes in the order in which they were drawn.

Each chapter's ranges and strokes are read in order by one task, which holds the chapter's interval set alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Range = tuple[int, int, str | None]


class IntervalSet:
    """The ranges of one chapter, by start. Until the first stroke they stay as they came."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges
        self.merged = False
        #: No range is longer, so none that starts earlier than that before a stroke reaches it.
        self.longest = 0

    def stroke(self, start: int, end: int, color: str | None) -> None:
        """Take the stroke out of all ranges; paint it unless they covered it whole; join equal colours that touch."""
        a, b = min(start, end), max(start, end)
        if b <= a:
            return
        rows = self.ranges
        lo, hi = 0, len(rows)
        if self.merged:
            lo = bisect_left(rows, a - self.longest, key=lambda r: r[0])
            hi = bisect_left(rows, b, lo=lo, key=lambda r: r[0])
        near = rows[lo:hi]
        reach, pieces = a, []
        for s, e, c in near:
            if e <= a or s >= b:
                pieces.append((s, e, c))
                continue
            if max(s, a) < min(e, b) and s <= reach:
                reach = max(reach, e)
            pieces += [(s, a, c)] * (s < a) + [(b, e, c)] * (e > b)
        if reach < b:
            pieces.append((a, b, color))
        pieces.sort(key=lambda r: r[0])
        # Beside the stroke only its neighbours can change: the one before, and those after as long as they join.
        at = max(lo - 1, 0)
        out = rows[at:lo]
        for p in pieces:
            self._add(out, p)
        while hi < len(rows) and out and self._joins(out[-1], rows[hi]):
            self._add(out, rows[hi])
            hi += 1
        rows[at:hi] = out
        self.longest = max(self.longest, max((e - s for s, e, _ in out), default=0))
        self.merged = True

    @staticmethod
    def _joins(last: Range, r: Range) -> bool:
        return last[2] == r[2] and last[1] >= r[0]

    def _add(self, out: list[Range], r: Range) -> None:
        if r[1] <= r[0]:
            return
        if out and self._joins(out[-1], r):
            out[-1] = (out[-1][0], max(out[-1][1], r[1]), r[2])
        else:
            out.append(r)


def apply_strokes(ranges: DataFrame, strokes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``(keys, start, end, color)`` after all ``strokes`` of each key, drawn by ``order`` (columns of theirs; else by place and colour).

    A stroke is taken out of all ranges and painted, unless the ranges covered it whole: then it erases. After each
    stroke the key's ranges are merged as by ``merge_ranges``. Empty strokes do nothing; keys without another one keep
    their rows as they are, and keys without ranges get those that are painted. Places may be given end first.
    """
    parts = ["start", "end", "color"]
    kinds = {f.name: f.dataType for f in ranges.schema.fields}
    old = ranges.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "color", F.lit(0).alias("_drawn"))
    by = strokes.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("color").cast(kinds["color"]).alias("color"), F.lit(1).alias("_drawn"), F.struct(*(order or parts)).alias("_order"))
    both = old.unionByName(by, allowMissingColumns=True)
    sorted_ = both.repartition(*keys).sortWithinPartitions(*keys, "_drawn", "_order", *parts).drop("_order")
    out = ranges.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "color").schema
    names = [*keys, *parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def rows() -> pa.RecordBatch:
            own = [pa.array([k] * len(held.ranges), kind) for k, kind in zip(key, key_types, strict=True)]
            cols = [pa.array([r[i] for r in held.ranges], kind) for i, kind in enumerate((pa.int64(), pa.int64(), color_type))]
            return pa.RecordBatch.from_arrays([*own, *cols], names=names)

        for b in batches:
            key_types, color_type = [b.schema.field(k).type for k in keys], b.schema.field("color").type
            keyed = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            for k, s, e, c, drawn in zip(keyed, *(b.column(x).to_pylist() for x in [*parts, "_drawn"]), strict=True):
                if k != key:
                    if held and held.ranges:
                        yield rows()
                    key, held = k, IntervalSet([])
                if s is None or e is None:
                    continue
                if drawn:
                    held.stroke(s, e, c)
                else:
                    held.ranges.append((s, e, c))
        if held and held.ranges:
            yield rows()

    return sorted_.mapInArrow(run, out)
