"""Connected components of an edge table, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapgrid.llm.frames import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node with a link: the same root within a component.

    In each round every node points to its smallest neighbour if that is smaller, pointers are
    followed twice, and links are drawn between what they end at; links within one node go.
    Aggregates take the smallest neighbour, so that no neighbour list is gathered, and joins on
    a node with many links are left to adaptive execution. Ends when no link is left.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a)))
    edges = stored(both.where("u <> v").distinct(), "cc-edges")
    roots = stored(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct(), "cc-roots")
    while not edges.isEmpty():
        up = edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        up = stored(up, "cc-up")
        for _ in range(2):
            over = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            up = up.join(over, "p").select("u", F.col("q").alias("p"))
        up = stored(up, "cc-jump")
        moved = up.select(F.col("u").alias("root"), "p")
        roots = stored(roots.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-roots")
        ends = edges.join(up.withColumnRenamed("p", "pu"), "u").join(up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        edges = stored(ends.where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "cc-edges")
    return roots
