"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(u, v) -> (node, component): for each node of a link the smallest node it reaches.

    Each round every node hooks onto its smallest neighbour, chains of two hooks are shortened, and the links
    are contracted to links between the nodes hooked onto. Every round at least halves the nodes that still
    have links, so long chains end as well. Rows shuffled a round: the links and labels that remain.
    """
    links = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    labels = cut(links.select(F.col("u").alias("node")).union(links.select("v")).distinct().withColumn("component", F.col("node")))
    for _ in range(rounds):
        if links.isEmpty():
            return labels
        both = links.union(links.select("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        hook = cut(
            hook.alias("a").join(hook.alias("b"), F.col("a.p") == F.col("b.u"), "left")
            .select(F.col("a.u").alias("u"), F.coalesce("b.p", "a.p").alias("p"))
        )
        labels = cut(labels.join(hook, labels.component == hook.u, "left").select("node", F.coalesce("p", "component").alias("component")))
        far, near = hook.select(F.col("u").alias("v"), F.col("p").alias("q")), hook
        links = cut(
            links.join(near, "u").join(far, "v").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).where("u < v").distinct()
        )
    raise RuntimeError("links remain after all rounds")


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links (u, v); only components that links touch are worked on."""
    links = cut(links)
    new = links.select(F.col("u").alias("node")).union(links.select("v")).distinct().join(labels, "node", "left_anti")
    labels = cut(labels.union(new.select("node", F.col("node").alias("component"))))
    of_u, of_v = labels.select(F.col("node").alias("u"), F.col("component").alias("cu")), labels.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    between = links.join(of_u, "u").join(of_v, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return cut(labels.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
