"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node that has an edge; the component is its least node.

    Large-star and small-star rounds: each node hands its neighbours to the least of
    them, until nothing moves. A round is two grouped minima and two joins on the
    edges, so a hub's edges are combined before they are shuffled and AQE can split its join. Rounds grow with the
    logarithm of the nodes. Each round is a written table; older ones are deleted. Self loops and
    edges with a null end are left out.
    """
    prints = {"n": F.count("*"), "h": F.bit_xor(F.xxhash64("a", "b"))}
    one = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    one = one.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    table, seen = materialize(one, "edges", **prints)
    while seen["n"]:
        larger, before = materialize(_large_star(table).distinct(), "large-star"), seen
        smaller, seen = materialize(_small_star(larger).distinct(), "small-star", **prints)
        discard(table, larger)
        table = smaller
        if seen == before:
            break
    roots = table.select(F.col("b").alias("node")).distinct()
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node, tied to the least of the node and all its neighbours."""
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("other")).unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("other")))
    least = ends.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    return edges.join(least, edges["b"] == least["node"]).select("a", F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b")))
