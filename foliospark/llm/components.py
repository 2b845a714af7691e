"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import reliable


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a long, b long) -> (node, root): every linked node and one node of its component.

    Each round points every node at its least neighbour, follows the pointers
    to their end, and replaces the ends of each link by it; links inside one
    node vanish, and half the nodes at least. Only aggregates and equi-joins
    move data, so no component is ever gathered in one task. Nulls and
    self-links are left out.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    edges = reliable(links)
    found = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        point = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        point = reliable(point)
        while True:  # each turn doubles how far a pointer reaches, until all reach the end of their chain
            after = point.select(F.col("a").alias("p"), F.col("p").alias("q"))
            further = reliable(point.join(after, "p").select("a", "q", (F.col("p") != F.col("q")).alias("moved")))
            point = further.select("a", F.col("q").alias("p"))
            if further.where("moved").isEmpty():
                break
        to = point.select(F.col("a").alias("root"), "p")
        found = reliable(found.join(to, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        ends = edges.join(point, "a").select(F.col("p").alias("x"), "b")
        ends = ends.join(point.select(F.col("a").alias("b"), F.col("p").alias("y")), "b").select("x", "y")
        edges = reliable(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return found
