"""Clusters of a maximum-similarity spanning forest cut below each component's upper median weight.

Cutting the forest below t leaves the components of all edges of weight t or more, so only the
forest's weights are needed. They come from Borůvka rounds: each component takes its heaviest edge, under a
strict order, and joins over it. Once few edges are left they are finished in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.components import connected_components, min_labels
from threadloom.operators.ranking import at_ranks
from threadloom.runtime import Stage

#: Edges that one task may finish.
AT_ONCE = 200_000


def _kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    keep = []
    for r in pdf.sort_values(["w", "src", "dst"], ascending=False).itertuples(index=False):
        a, b = find(r.a), find(r.b)
        if a != b:
            root[a] = b
            keep.append((r.src, r.dst, r.w))
    return pd.DataFrame(keep, columns=["src", "dst", "w"])


def forest(edges: DataFrame) -> DataFrame:
    """(src, dst, w): a maximum spanning forest of canonical edges; equal weights are told apart by the ends' ids."""
    stage = Stage(edges.sparkSession, "forest")
    left = stage.put(edges.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")))
    chosen = None
    while (count := left.count()) > AT_ONCE:
        edge = F.struct("w", "src", "dst", "a", "b")
        best = left.select(F.col("a").alias("c"), edge.alias("e")).union(left.select(F.col("b"), edge)).groupBy("c").agg(F.max("e").alias("e"))
        new = stage.put(best.select("e.*").distinct())
        chosen = new.select("src", "dst", "w") if chosen is None else chosen.union(new.select("src", "dst", "w"))
        labels = min_labels(new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), stage)
        at = left.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
        left = stage.put(at.select("src", "dst", "w", F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b"))
    if count:
        last = left.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_kruskal, "src string, dst string, w double")
        chosen = last if chosen is None else chosen.union(last)
    return stage.put(chosen if chosen is not None else left.select("src", "dst", "w"))


def median_cuts(tree: DataFrame, components: DataFrame) -> DataFrame:
    """(label, threshold, tree_edges): upper median of the forest's weights in each component.

    Components of more than ``AT_ONCE`` distinct weights, of which there are few, are ranked one by one
    over range partitions; the others by a window each.
    """
    stage = Stage(tree.sparkSession, "cuts")
    at = stage.put(tree.join(components, F.col("src") == F.col("id")).groupBy("label", "w").agg(F.count(F.lit(1)).alias("c")))
    totals = at.groupBy("label").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("distinct"))
    large = [r.label for r in totals.where(F.col("distinct") > AT_ONCE).select("label").collect()]
    rest = at.join(totals.where(F.col("distinct") <= AT_ONCE), "label")
    upto = F.sum("c").over(Window.partitionBy("label").orderBy("w"))
    hit = rest.withColumn("upto", upto).where("upto > m div 2 and upto - c <= m div 2")
    cuts = hit.select("label", F.col("w").alias("threshold"), F.col("m").alias("tree_edges"))
    for label in large:
        m, value = at_ranks(tree.join(components.where(F.col("label") == label), F.col("src") == F.col("id")), "w", lambda n: [n // 2], stage)
        cuts = cuts.union(tree.sparkSession.createDataFrame([(label, value[m // 2], m)], "label string, threshold double, tree_edges bigint"))
    return cuts


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, user_id) of every id in nodes(id) and every end of canonical edges(src, dst, w).

    cluster_id is the cluster's smallest member. An isolated node is its own cluster.
    """
    stage = Stage(nodes.sparkSession, "clusters")
    edges = stage.put(edges.select("src", "dst", "w"))
    ends = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"))
    comps = stage.put(connected_components(nodes, ends))
    cuts = median_cuts(forest(edges), comps)
    strong = edges.join(comps, F.col("src") == F.col("id")).join(cuts, "label").where("w >= threshold").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return connected_components(comps.select("id"), strong).select(F.col("label").alias("cluster_id"), F.col("id").alias("user_id"))


def reduction(n_nodes: int, n_components: int, n_clusters: int, n_edges: int) -> dict[str, float]:
    """How far the cut forest reduces the graph: kept forest edges are nodes minus clusters."""
    tree, kept = n_nodes - n_components, n_nodes - n_clusters
    return {"mst_edges": tree, "kept_edges": kept, "edges_before": n_edges, "reduction_ratio": 1 - kept / n_edges if n_edges else 0.0}
