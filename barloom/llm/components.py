"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b: long): nodes have the same root
    if links join them; the root is one of them.

    Each round every node points to its smallest neighbour or itself, pointers
    are followed twice, and links are drawn anew between what they lead to. Every
    connected pair of at least two nodes shrinks, so rounds grow with the
    logarithm of the longest chain. Tables are written between rounds."""
    edges = written(_tidy(links.select("a", "b")), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), "parents")
        for _ in range(2):
            ahead = to.select(F.col("node").alias("to"), F.col("to").alias("then"))
            to = to.join(ahead, "to").select("node", F.col("then").alias("to"))
        to = written(to, "parents")
        steps.append(to)
        for end in ("a", "b"):
            edges = edges.join(to, edges[end] == to["node"]).drop("node", end).withColumnRenamed("to", end)
        edges = written(_tidy(edges), "links")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    found = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("root"), F.col("to").alias("then"))
        found = found.join(onward, "root", "left").select("node", F.coalesce("then", "root").alias("root"))
    return found


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
