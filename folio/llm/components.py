"""Connected components over an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges of longs -> ``(node, root)``, root being the smallest node reachable.

    Each round takes the smallest root among a node's neighbours, then jumps to that
    root's own root, so that chains halve. Roots only ever fall; the rounds end when
    none does. The driver sees one count a round. Null ends and empty tables give no row.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    both = cut(e.select("a", "b").union(e.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("heard"))
        )
        near = labels.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("near"))
        new = cut(
            near.join(labels.select(F.col("node").alias("near"), F.col("root").alias("jump")), "near", "left").select(
                "node", "was", F.least("near", F.coalesce("jump", "near")).alias("root")
            )
        )
        moved = new.where("root <> was").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels
