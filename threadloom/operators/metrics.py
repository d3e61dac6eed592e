"""Graph-quality metrics of a clustering, and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.layers import symmetric
from threadloom.operators.scoring import inner_edges


def modularity(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modularity at resolution 1; 0 for a graph without weight."""
    inner = inner_edges(clusters, edges).groupBy("cluster_id").agg(F.sum("w").alias("lc"))
    whole = symmetric(edges).join(clusters.select(F.col("user_id").alias("u"), "cluster_id"), "u").groupBy("cluster_id").agg(F.sum("w").alias("dc"))
    m = edges.agg(F.sum("w")).first()[0] or 0.0
    if not m:
        return clusters.agg(F.lit(0.0).alias("modularity"))
    part = F.coalesce("lc", F.lit(0.0)) / m - (F.col("dc") / (2 * m)) * (F.col("dc") / (2 * m))
    return whole.join(inner, "cluster_id", "left").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("modularity"))


def conductance(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, conductance): cut over the smaller side's volume, inner weight counted once.

    Clusters of one, or of all but at most one node, and those without any weight are left out.
    """
    total = edges.agg(F.sum("w")).first()[0] or 0.0
    nodes = clusters.count()
    a = clusters.select(F.col("cluster_id").alias("ca"), F.col("user_id").alias("src"))
    b = clusters.select(F.col("cluster_id").alias("cb"), F.col("user_id").alias("dst"))
    at = edges.join(a, "src").join(b, "dst")
    inner = at.where("ca = cb").groupBy(F.col("ca").alias("cluster_id")).agg(F.sum("w").alias("inner_w"))
    apart = at.where("ca <> cb")
    cut = apart.select(F.col("ca").alias("cluster_id"), "w").union(apart.select("cb", "w")).groupBy("cluster_id").agg(F.sum("w").alias("cut_w"))
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & (F.col("n") < nodes - 1))
    i, c = F.coalesce("inner_w", F.lit(0.0)), F.coalesce("cut_w", F.lit(0.0))
    low = F.least(i + c, F.lit(total) - i)
    return sizes.join(inner, "cluster_id", "left").join(cut, "cluster_id", "left").where(low > 0).select("cluster_id", (c / low).alias("conductance"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: num_nodes, num_edges, avg_degree, density, isolated_nodes, avg_weight, max_weight of nodes(id) and edges."""
    n = nodes.distinct().agg(F.count(F.lit(1)).alias("num_nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("num_edges"), F.coalesce(F.avg("w"), F.lit(0.0)).alias("avg_weight"), F.coalesce(F.max("w"), F.lit(0.0)).alias("max_weight"))
    alone = isolated(nodes, edges).agg(F.count(F.lit(1)).alias("isolated_nodes"))
    one = n.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").join(alone.withColumn("k", F.lit(1)), "k").drop("k")
    v, m = F.col("num_nodes").cast("double"), F.col("num_edges").cast("double")
    return one.select(
        "num_nodes", "num_edges", F.when(v > 0, 2 * m / v).otherwise(0.0).alias("avg_degree"), F.when(v > 1, 2 * m / (v * (v - 1))).otherwise(0.0).alias("density"), "isolated_nodes", "avg_weight", "max_weight"
    )


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.select("id").distinct().join(symmetric(edges).select(F.col("u").alias("id")).distinct(), "id", "left_anti")


def group_sizes(groups: DataFrame, key: str) -> DataFrame:
    """One row: num_groups, avg_size, max_size, singletons."""
    return groups.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("num_groups"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_size"), F.coalesce(F.max("n"), F.lit(0)).alias("max_size"), F.count_if(F.col("n") == 1).alias("singletons"))


def intra_canopy_ratio(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row: share of edge weight between accounts of one canopy; null for a graph without weight."""
    a = assignment.select(F.col("user_id").alias("src"), F.col("canopy").alias("ca"))
    b = assignment.select(F.col("user_id").alias("dst"), F.col("canopy").alias("cb"))
    j = edges.join(a, "src", "left").join(b, "dst", "left")
    return j.agg(F.try_divide(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)), F.sum("w")).alias("intra_canopy_edge_ratio"))


def risk_tier(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.55, "medium").otherwise("low")


def suspicion_label(score: Column) -> Column:
    """The fixed label of a report, from 0.5 up; not the adaptive is_suspicious."""
    return F.when(score >= 0.5, "suspicious").otherwise("normal")


def quality(modularity: Column, silhouette: Column, conductance: Column) -> Column:
    """Words for the three metrics; a null one is left out."""
    return F.concat_ws(
        "; ",
        F.when(modularity >= 0.30, "strong communities").when(modularity >= 0.10, "moderate communities").when(modularity.isNotNull(), "weak communities"),
        F.when(silhouette >= 0.50, "clear separation").when(silhouette >= 0.25, "fair separation").when(silhouette >= 0, "overlapping groups").when(silhouette.isNotNull(), "misplaced members"),
        F.when(conductance <= 0.35, "well isolated").when(conductance <= 0.60, "partly isolated").when(conductance.isNotNull(), "poorly isolated"),
    )


def main_indicators(reasons: Column, size: Column, signals: dict[str, Column]) -> Column:
    """Up to three indicators of a cluster: its reasons; a large repetitive one; signals from 0.3; else any signal."""
    ordered = F.array_sort(F.array(*[F.struct((-v).alias("neg"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(signals.items())]))
    strong = F.transform(F.filter(ordered, lambda r: r["neg"] <= -0.3), lambda r: r["k"])
    some = F.transform(F.filter(ordered, lambda r: r["neg"] < 0), lambda r: r["k"])
    large = F.when((size >= 10) & (signals["content_repetition"] >= 0.35), F.array(F.lit("large repetitive group"))).otherwise(F.array().cast("array<string>"))
    best = F.array_distinct(F.concat(reasons, large))
    best = F.when(F.size(best) < 3, F.array_distinct(F.concat(best, strong))).otherwise(best)
    return F.slice(F.when(F.size(best) > 0, best).otherwise(some), 1, 3)


def averages(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means by group, nulls ignored, in the groups' order."""
    return rows.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values]).orderBy(*by)
