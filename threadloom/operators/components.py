"""Connected components of an edge table by minimum hooking and pointer doubling.

A round lets every vertex point to its smallest neighbour (or itself), follows the pointers to
their ends by doubling, and contracts the edges to those ends. Ends only ever decrease, so a
component ends up labelled by its smallest vertex. The number of vertices left falls by a large
factor each round whatever the diameter; plain propagation would need a round per step of it.
Once few edges are left, they are finished in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranking import global_rank
from threadloom.runtime import Stage


def undirected(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Distinct (a, b) with a < b; null ends and self-edges are dropped."""
    s, t = F.col(source).cast("string"), F.col(target).cast("string")
    return edges.where(s.isNotNull() & t.isNotNull() & (s != t)).select(F.least(s, t).alias("a"), F.greatest(s, t).alias("b")).distinct()


#: Edges that one task may finish.
AT_ONCE = 200_000


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(pdf["a"], pdf["b"]):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return pd.DataFrame({"v": list(root), "to": [find(x) for x in list(root)]})


def min_labels(pairs: DataFrame, stage: Stage, at_once: int | None = None) -> DataFrame:
    """(id, label) of every vertex of ``pairs(a, b)``; label is the smallest id of its component.

    With ``at_once`` 0 the rounds go on to the end.
    """
    at_once = AT_ONCE if at_once is None else at_once
    size = F.count(F.lit(1))
    edges = stage.put(pairs.select("a", "b"), rows=size)
    left = stage.seen["rows"]
    labels = stage.put(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("label", F.col("id")))
    while left:
        if left <= at_once:
            ends = edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_ends, "v string, to string")
            return stage.put(labels.join(ends, F.col("label") == F.col("v"), "left").select("id", F.coalesce("to", "label").alias("label")))
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        hook = stage.put(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("to")))
        while True:
            q = hook.select(F.col("v").alias("q"), F.col("to").alias("q_to"))
            step = hook.join(q, F.col("to") == F.col("q")).select("v", F.col("q_to").alias("to"), (F.col("q_to") != F.col("to")).alias("moved"))
            step = stage.put(step, moved=F.count(F.when(F.col("moved"), 1)))
            stage.drop(hook)
            hook = step
            if not stage.seen["moved"]:
                break
        ends = hook.select("v", "to")
        joined = (
            edges.join(ends, F.col("a") == F.col("v")).select(F.col("to").alias("a"), "b").join(ends, F.col("b") == F.col("v")).select("a", F.col("to").alias("b"))
        )
        smaller = stage.put(joined.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows=size)
        left = stage.seen["rows"]
        relabelled = stage.put(labels.join(ends, F.col("label") == F.col("v"), "left").select("id", F.coalesce("to", "label").alias("label")))
        for old in (edges, labels, hook):
            stage.drop(old)
        edges, labels = smaller, relabelled
    return labels


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) of each id in ``nodes(id)`` and each end of ``edges(source, target)``.

    Null ids are left out, repeats count once, an unlinked node is its own component.
    """
    stage = Stage(nodes.sparkSession, "components")
    labels = min_labels(undirected(edges), stage)
    ids = nodes.select(F.col("id").cast("string").alias("id")).union(edges.select(F.col("source").cast("string"))).union(edges.select(F.col("target").cast("string")))
    return ids.where("id is not null").distinct().join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def numbered(labels: DataFrame) -> DataFrame:
    """(component_id, component_size, id): components numbered from 0 by falling size, then smallest member."""
    stage = Stage(labels.sparkSession, "numbered")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("component_size"))
    ranked = global_rank(sizes, [F.desc("component_size"), F.col("label")], stage, "component_id")
    return labels.join(ranked, "label").select(F.col("component_id").cast("long").alias("component_id"), "component_size", "id")
