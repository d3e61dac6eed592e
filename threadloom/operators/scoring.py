"""Cluster and account scores, the suspicion cutoff and its reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scores import clamp01, inverse_span, relative_excess
from threadloom.operators.layers import symmetric
from threadloom.operators.ranking import quantiles
from threadloom.operators.tfidf import mean_pairwise
from threadloom.runtime import Stage

# Component weights, reason labels and the score from which they count.
WEIGHTS = {"cluster_density": 0.25, "content_repetition": 0.25, "temporal_burst": 0.20, "account_age": 0.15, "high_frequency": 0.15}
REASONS = {
    "cluster_density": "kepadatan cluster tinggi",
    "content_repetition": "repetisi konten tinggi",
    "temporal_burst": "aktivitas temporal sinkron",
    "high_frequency": "frekuensi komentar tinggi",
    "account_age": "proporsi akun baru tinggi",
}
REASON_FLOOR = 0.45


@dataclass(frozen=True)
class Globals:
    """Rates of the whole data set that cluster signals are held against."""

    span: float
    rate: float
    median_count: float
    p90_excess: float
    p90_weight: float


def global_rates(summary: DataFrame, edges: DataFrame) -> Globals:
    stage = Stage(summary.sparkSession, "rates")
    total, low, high, stamps = summary.agg(F.sum("comment_count"), F.min("first_timestamp"), F.max("last_timestamp"), F.sum("stamps")).first()
    span = max(1.0, float(high - low) if (stamps or 0) >= 2 else 1.0)
    (median,) = quantiles(summary, "comment_count", [0.5], stage)
    (excess,) = quantiles(summary.select(F.greatest(F.col("comment_count") - 1, F.lit(0)).alias("x")), "x", [0.9], stage)
    (weight,) = quantiles(edges, "w", [0.9], stage)
    return Globals(span, max(1.0, float(total or 0)) / span, 1.0 if median is None else median, max(1.0, 1.0 if excess is None else excess), max(1.0, 1.0 if weight is None else weight))


def weighted_mean(columns: dict[str, Column]) -> Column:
    """Mean of the components that are not null, weights renormalised; 0 if none is."""
    have = sum((F.when(c.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, c in columns.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(sum((F.coalesce(clamp01(c), F.lit(0.0)) * WEIGHTS[k] for k, c in columns.items()), F.lit(0.0)), have), F.lit(0.0))


def inner_edges(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, src, dst, w) of edges with both ends in one cluster."""
    a = clusters.select(F.col("cluster_id").alias("ca"), F.col("user_id").alias("src"))
    b = clusters.select(F.col("cluster_id").alias("cb"), F.col("user_id").alias("dst"))
    return edges.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("ca").alias("cluster_id"), "src", "dst", "w")


def density(clusters: DataFrame, edges: DataFrame, p90_weight: float) -> DataFrame:
    """Per cluster: size, density signals, average weight, degree concentration."""
    inner = inner_edges(clusters, edges)
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    weights = inner.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("e"), F.avg("w").alias("avg_weight"))
    both = inner.select("cluster_id", F.col("src").alias("u")).union(inner.select("cluster_id", "dst"))
    top = both.groupBy("cluster_id", "u").agg(F.count(F.lit(1)).alias("d")).groupBy("cluster_id").agg(F.max("d").alias("max_degree"))
    n = F.col("cluster_size").cast("double")
    e = F.coalesce("e", F.lit(0)).cast("double")
    j = sizes.join(weights, "cluster_id", "left").join(top, "cluster_id", "left")
    j = j.withColumn("avg_weight", F.coalesce("avg_weight", F.lit(0.0)))
    structural = F.when(n > 1, clamp01(2 * e / (n * (n - 1)))).otherwise(0.0)
    weighted = F.when(n > 1, clamp01(F.col("avg_weight") / p90_weight)).otherwise(0.0)
    raw = F.when((n > 1) & (e > 0), F.col("max_degree") / (2 * e / n)).otherwise(0.0)
    return j.select(
        "cluster_id", "cluster_size", structural.alias("structural_density"), weighted.alias("weighted_density"), "avg_weight",
        raw.alias("deg_conc_raw"), F.when(raw > 0, clamp01((raw - 1.0) / 3.0)).otherwise(0.0).alias("deg_conc"),
    ).withColumn("cluster_density", F.when(F.col("cluster_size") > 1, clamp01(0.55 * F.col("structural_density") + 0.45 * F.col("weighted_density"))).otherwise(0.0))


def temporal(clusters: DataFrame, summary: DataFrame, g: Globals) -> DataFrame:
    """Per cluster: burst score, rate pressure, compactness, alignment, span. Needs only each account's first and last time."""
    center = (F.col("first_timestamp") + F.col("last_timestamp")) / 2.0
    j = clusters.join(summary, "user_id", "left").groupBy("cluster_id").agg(
        F.sum("comment_count").cast("double").alias("total"), F.sum("stamps").alias("n"), F.min("first_timestamp").alias("lo"), F.max("last_timestamp").alias("hi"),
        F.min(center).alias("c_lo"), F.max(center).alias("c_hi"), F.count(center).alias("c_n"), F.count(F.lit(1)).alias("members"),
    )
    span = F.when(F.col("n") >= 2, F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo")).cast("double"))).otherwise(F.lit(1.0))
    j = j.withColumn("span", span)
    pressure = relative_excess(F.coalesce("total", F.lit(0.0)) / F.col("span"), F.lit(g.rate), 3.0)
    compact = inverse_span(F.col("span"), F.lit(g.span))
    align = F.when(F.col("c_n") >= 2, inverse_span(F.col("c_hi") - F.col("c_lo"), F.lit(g.span))).when(F.col("c_n") == 1, compact).otherwise(0.0)
    timed = (F.coalesce("n", F.lit(0)) > 0) & (F.col("members") > 1)
    j = j.select("cluster_id", *[F.when(timed, c).otherwise(0.0).alias(k) for k, c in (("temporal_rate_pressure", pressure), ("temporal_compactness", compact), ("temporal_alignment", align), ("cluster_span_sec", F.col("span")))])
    return j.withColumn("temporal_burst", clamp01(0.45 * F.col("temporal_rate_pressure") + 0.30 * F.col("temporal_compactness") + 0.25 * F.col("temporal_alignment")))


def frequency(clusters: DataFrame, summary: DataFrame, g: Globals) -> DataFrame:
    """Per cluster: high-frequency score, share of repeaters, excess; new-account mean and coverage."""
    threshold = max(1.0, g.median_count)
    count = F.coalesce("comment_count", F.lit(0)).cast("double")
    j = clusters.join(summary, "user_id", "left").groupBy("cluster_id").agg(
        F.avg((count > threshold).cast("double")).alias("repeat"), F.avg(F.greatest(F.lit(0.0), count - threshold)).alias("over"),
        F.avg(clamp01(F.col("new_account_signal"))).alias("age"), (F.count("new_account_signal") / F.count(F.lit(1))).alias("coverage"), F.count(F.lit(1)).alias("members"),
    )
    several = F.col("members") > 1
    excess = clamp01(F.col("over") / max(1.0, g.p90_excess))
    return j.select(
        "cluster_id", F.when(several, clamp01(0.5 * F.col("repeat") + 0.5 * excess)).otherwise(0.0).alias("high_frequency"), F.when(several, F.col("repeat")).otherwise(0.0).alias("high_frequency_repeat_ratio"),
        F.when(several, excess).otherwise(0.0).alias("high_frequency_excess"), F.when(several, F.col("age")).alias("account_age"), F.when(several, F.col("coverage")).otherwise(0.0).alias("account_age_coverage"),
    )


def top_reasons() -> Column:
    """Up to three reasons of at least ``REASON_FLOOR``, by value; equal ones in the listed order."""
    rows = F.array(*[F.struct((-F.coalesce(k, F.lit(0.0))).alias("neg"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, (k, label) in enumerate(REASONS.items())])
    kept = F.filter(F.array_sort(rows), lambda r: r["neg"] <= -REASON_FLOOR)
    return F.transform(F.slice(kept, 1, 3), lambda r: r["label"])


def cluster_stats(clusters: DataFrame, edges: DataFrame, summary: DataFrame, weights: DataFrame | None, g: Globals | None = None) -> DataFrame:
    """One row per cluster with its signals, score and reasons; a single account scores 0 with null age.

    ``weights`` are TF-IDF weights (doc, term, w) of the accounts; without them content counts 0.
    """
    g = g or global_rates(summary, edges)
    out = density(clusters, edges, g.p90_weight).join(temporal(clusters, summary, g), "cluster_id").join(frequency(clusters, summary, g), "cluster_id")
    if weights is not None:
        content = mean_pairwise(weights, clusters).select("cluster_id", F.col("similarity").alias("content_repetition"))
        out = out.join(content, "cluster_id", "left").withColumn("content_repetition", F.coalesce("content_repetition", F.lit(0.0)))
    else:
        out = out.withColumn("content_repetition", F.lit(0.0))
    score = F.when(F.col("cluster_size") > 1, weighted_mean({k: F.col(k) for k in WEIGHTS})).otherwise(0.0)
    return out.withColumn("score", score).withColumn("reasons", F.when(F.col("cluster_size") > 1, top_reasons()).otherwise(F.array().cast("array<string>")))


def suspicion(stats: DataFrame) -> tuple[DataFrame, float]:
    """Stats with is_suspicious, and the cutoff: max(0.5, 80th percentile of positive scores), else the top cluster from 0.35."""
    stage = Stage(stats.sparkSession, "suspicion")
    stats = stage.put(stats)
    (p80,) = quantiles(stats.where("score > 0"), "score", [0.8], stage)
    if p80 is None:
        return stats.withColumn("is_suspicious", F.lit(False)), 0.0
    cutoff = max(0.5, p80)
    if not stats.where(F.col("score") >= cutoff).limit(1).count():
        top = stats.orderBy(F.desc("score"), "cluster_id").select("cluster_id", "score").first()
        if top.score >= 0.35:
            return stats.withColumn("is_suspicious", F.col("cluster_id") == top.cluster_id), top.score
        return stats.withColumn("is_suspicious", F.lit(False)), cutoff
    return stats.withColumn("is_suspicious", F.col("score") >= cutoff), cutoff


def node_scores(clusters: DataFrame, edges: DataFrame, summary: DataFrame, stats: DataFrame) -> DataFrame:
    """(user_id, cluster_id, strength, prominence, score) of every account; 0 in single-account clusters."""
    inner = inner_edges(clusters, edges)
    strength = inner.select(F.col("src").alias("user_id"), "w").union(inner.select("dst", "w")).groupBy("user_id").agg(F.sum("w").alias("strength"))
    j = clusters.join(strength, "user_id", "left").join(summary.select("user_id", F.col("comment_count").cast("double").alias("c")), "user_id", "left")
    j = j.withColumn("strength", F.coalesce("strength", F.lit(0.0))).withColumn("c", F.coalesce("c", F.lit(0.0)))
    tops = j.groupBy("cluster_id").agg(F.greatest(F.lit(1.0), F.max("strength")).alias("ms"), F.greatest(F.lit(1.0), F.max("c")).alias("mc"))
    j = j.join(tops, "cluster_id").join(stats.select("cluster_id", "cluster_size", F.col("score").alias("cs")), "cluster_id")
    prominence = F.when(F.col("cluster_size") > 1, clamp01(0.6 * clamp01(F.col("strength") / F.col("ms")) + 0.4 * clamp01(F.col("c") / F.col("mc")))).otherwise(0.0)
    j = j.withColumn("prominence", prominence)
    return j.select("user_id", "cluster_id", "strength", "prominence", F.when(F.col("cluster_size") > 1, clamp01(0.7 * F.col("cs") + 0.3 * F.col("prominence"))).otherwise(0.0).alias("score"))


def top_edges(edges: DataFrame, users: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """(user_id, top_edges): up to k heaviest edges of each of users(user_id), as an array of (peer_id, peer_label, weight)."""
    near = symmetric(edges).join(users.select(F.col("user_id").alias("u")).distinct(), "u", "left_semi")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc(F.round("w", 12)), "v"))
    top = near.withColumn("r", rank).where(F.col("r") <= k).join(labels.select(F.col("user_id").alias("v"), F.col("label").alias("peer_label")), "v", "left")
    return top.groupBy(F.col("u").alias("user_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", F.col("v").alias("peer_id"), F.coalesce("peer_label", "v").alias("peer_label"), F.col("w").alias("weight")))), lambda x: F.struct(x["peer_id"], x["peer_label"], x["weight"])).alias("top_edges")
    )


def suspicious_details(clusters: DataFrame, edges: DataFrame, summary: DataFrame, stats: DataFrame, scores: DataFrame, assignment: DataFrame | None) -> DataFrame:
    """One row per account of a suspicious cluster: its scores, its cluster's signals, degree and heaviest edges."""
    labels = summary.select("user_id", F.coalesce(F.nullif("username", F.lit("")), "user_id").alias("label"))
    hot = stats.where("is_suspicious")
    who = clusters.join(hot.select("cluster_id"), "cluster_id", "left_semi")
    both = symmetric(edges).groupBy(F.col("u").alias("user_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))
    signals = hot.select("cluster_id", "cluster_size", F.col("is_suspicious").alias("cluster_is_suspicious"), F.col("score").alias("cluster_score"), F.col("account_age").alias("account_age_ratio"),
                         *[c for c in hot.columns if c not in ("cluster_id", "cluster_size", "is_suspicious", "score", "account_age")])
    out = who.join(signals, "cluster_id").join(scores.select("user_id", "score", F.col("prominence").alias("node_prominence")), "user_id").join(labels.withColumnRenamed("label", "username"), "user_id", "left")
    out = out.join(both, "user_id", "left").join(top_edges(edges, who, labels), "user_id", "left")
    out = out.withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("strength", F.coalesce("strength", F.lit(0.0))).withColumn("username", F.coalesce("username", "user_id"))
    if assignment is None:
        return out.withColumn("canopy_id", F.lit(None).cast("string"))
    return out.join(assignment.select("user_id", F.col("canopy").alias("canopy_id")), "user_id", "left")
