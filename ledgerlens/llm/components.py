"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """The smallest reachable node for every node of the links (u, v): rows of (node, root).

    In every round each node points to its smallest neighbour, or to itself; pointers are followed, doubling the way
    each time, to the root of their tree; links are renamed to the roots and counted once.  Each round at least halves
    the roots that still have links, so a long path needs a logarithmic number of steps.  A minimum per node is formed
    in every task before the shuffle, so a node with very many links moves one row per task.  Links of a node with
    itself and repeated links change nothing.
    """
    links = cut_lineage(links.filter("u <> v").select("u", "v").distinct())
    roots: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("v"), F.col("u")))
        merged = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("into")))
        while True:
            following = merged.select(F.col("node").alias("into"), F.col("into").alias("next"))
            jumped = cut_lineage(merged.join(following, "into").select("node", "into", "next"))
            merged = jumped.select("node", F.col("next").alias("into"))
            if jumped.filter("into <> next").isEmpty():
                break
        if roots is None:
            roots = merged.withColumnRenamed("into", "root")
        else:
            renamed = roots.join(merged, roots["root"] == merged["node"], "left")
            roots = renamed.select(roots["node"], F.coalesce("into", "root").alias("root"))
        left = merged.select(F.col("node").alias("u"), F.col("into").alias("new_u"))
        right = merged.select(F.col("node").alias("v"), F.col("into").alias("new_v"))
        links = links.join(left, "u").join(right, "v").select(F.col("new_u").alias("u"), F.col("new_v").alias("v"))
        links = cut_lineage(links.filter("u <> v").distinct())
        roots = cut_lineage(roots)
    return links.selectExpr("u as node", "v as root") if roots is None else roots
