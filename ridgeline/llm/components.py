"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a min-aggregate and a join, so no node's neighbours are ever collected into one row,
and the rows of hubs stay where they are (join_hot). Edges, labels and counts stay in tables; the
driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, join_hot, materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, root) for every node with an edge, root the least node.

    Self-loops, repeats and null ends are ignored. No edges: an empty result.
    """
    current = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = _mark(current)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        after = materialise(_small_star(_large_star(current, 2 * seen[0]), seen[0]), "edges")
        now = _mark(after)
        drop_table(current)
        current = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free checksum: equal when a round changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link each larger neighbour to the least of the node and its neighbours; total: rows both ways."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(both, least, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link each node and its smaller neighbours to the least of these neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_hot(edges, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
