"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rooftally.workspace import write_and_read


def _forest_roots(parents: DataFrame) -> DataFrame:
    """Follow (a, p) with p < a to the root, doubling the step each time."""
    while True:
        up = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jumped = write_and_read(parents.join(up, "p", "left").select(
            "a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "roots")
        if not jumped.filter("moved").head(1):
            return jumped.select("a", "p")
        parents = jumped.select("a", "p")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (src, dst); the root is one of its component's nodes.

    Every round hooks each node to its smallest neighbour if that is smaller than itself, follows the hooks to their
    roots, and goes on with the edges between different roots. The minimum is a partial aggregate, so a node with very many
    edges costs one row per task; each round is a written table, so lost executors repeat one round at most.
    NULL ends are left out; loops make a component of their own.
    """
    edges = edges.filter("src is not null and dst is not null")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    links = write_and_read(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
                           .distinct(), "links")
    labels = nodes.withColumn("root", F.col("node"))
    while links.head(1):
        roots = _forest_roots(links.groupBy("a").agg(F.min("b").alias("p")))
        other = roots.select(F.col("a").alias("b"), F.col("p").alias("q"))
        moved = links.join(roots, "a").join(other, "b", "left").select("p", F.coalesce("q", "b").alias("q"))
        links = write_and_read(moved.filter("p <> q").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b"))
                               .distinct(), "links")
        labels = write_and_read(labels.join(roots.select(F.col("a").alias("root"), "p"), "root", "left")
                                .select("node", F.coalesce("p", "root").alias("root")), "labels")
    return labels
