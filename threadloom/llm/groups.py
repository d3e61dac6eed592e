"""Consolidating pairwise matches into groups.

Match graphs tend to have one giant component and a multitude of small ones. The giant one is
peeled off by a breadth-first search from the vertex of highest degree, one join a level; its
vertices are anti-joined away and the rest is labelled by minimum propagation. A giant with a long
tail would need a join per step of it, so after ``levels`` joins what has been reached is contracted
to a single vertex and the tail is left to the propagation, which handles any diameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.components import min_labels, undirected
from threadloom.runtime import Stage


def star_links(members: DataFrame, group: str, node: str) -> DataFrame:
    """Links of each member to the smallest member of its group: m - 1 links for m members."""
    pairs = members.select(F.col(group).alias("g"), F.col(node).cast("string").alias("n")).where("g is not null and n is not null")
    low = pairs.groupBy("g").agg(F.min("n").alias("source"))
    return pairs.join(low, "g").select("source", F.col("n").alias("target"))


def consolidate(ids: DataFrame, links: DataFrame, levels: int = 12) -> DataFrame:
    """(node_id, group_id) of every id in ``ids(id)`` and every end of ``links(source, target)``.

    group_id is the smallest node_id linked directly or through others. Null ends are no node,
    self-links and repeats in either direction change nothing, an id without links is its own
    group, and empty tables give no rows.
    """
    stage = Stage(ids.sparkSession, "groups")
    pairs = stage.put(undirected(links))
    both = pairs.union(pairs.select("b", "a"))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    top = degree.orderBy(F.desc("n"), "id").limit(1).select("id").collect()
    rest, giant = pairs, None
    if top:
        spark = ids.sparkSession
        frontiers, grown = [stage.put(spark.createDataFrame([(top[0].id,)], "id string"))], 1
        while grown and len(frontiers) <= levels:
            # a link leads to the level before, the same or the next, so no other has to be looked at
            step = both.join(frontiers[-1], F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct()
            for seen in frontiers[-2:]:
                step = step.join(seen, "id", "left_anti")
            frontiers.append(stage.put(step, rows=F.count(F.lit(1))))
            grown = stage.seen["rows"]
        reached = reduce(DataFrame.union, frontiers)
        low = reached.agg(F.min("id")).collect()[0][0]
        giant = reached.select("id", F.lit(low).alias("label"))
        if not grown:
            rest = pairs.join(reached.select(F.col("id").alias("a")), "a", "left_anti")
        else:
            at = reached.select(F.col("id").alias("r"))
            swap = (
                pairs.join(at, F.col("a") == F.col("r"), "left").select(F.when(F.col("r").isNotNull(), F.lit(low)).otherwise(F.col("a")).alias("a"), "b")
                .join(at, F.col("b") == F.col("r"), "left").select("a", F.when(F.col("r").isNotNull(), F.lit(low)).otherwise(F.col("b")).alias("b"))
            )
            rest = swap.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = min_labels(rest, stage, at_once=0)
    if giant is not None:
        # the contracted vertex may itself have got a smaller label
        lower = labels.where(F.col("id") == F.lit(low)).select("label").collect()
        giant = giant.select("id", F.lit(lower[0].label if lower else low).alias("label"))
        labels = giant.union(labels.where(F.col("id") != F.lit(low)))
    ends = links.select(F.col("source").cast("string").alias("id")).union(links.select(F.col("target").cast("string")))
    every = ids.select(F.col("id").cast("string").alias("id")).union(ends).where("id is not null").distinct()
    return every.join(labels, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("label", "id").alias("group_id"))
