"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestsignal.llm.shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node to the least of them and itself.

    Large: the larger neighbours; small: the smaller ones and the node itself.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.filter("b < a")
    least = near.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's least node) for all nodes of edges (a, b), both bigint.

    Each round is written to the shared folder; the rounds end when an edge table repeats,
    which is when each node hangs on its component's least node.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(ordered.filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        summary = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        seen = tuple(summary.first())
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = stored(_star(_star(now, large=True), large=False), "edges")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return nodes.unionByName(roots)
