"""Reports on a finished analysis: the cluster table, sample comments, a graph's visible part, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import metrics
from threadloom.operators.scoring import WEIGHTS
from threadloom.plans.pipeline import RunResult
from threadloom.sinks.files import write_markdown

# The columns of the cluster table.
CLUSTER_COLUMNS = (
    "cluster_id", "jumlah_akun", "jumlah_akun_suspicious", "suspicious_score", "kategori", "density", "content_similarity", "temporal_sync", "high_frequency", "account_age", "indikator_utama", "akun_dominan", "sampel_komentar",
)
SIGNALS = ("content_repetition", "cluster_density", "temporal_burst", "high_frequency", "account_age")


def sample_comments(clusters: DataFrame, recs: DataFrame, count: int = 2, length: int = 140) -> DataFrame:
    """(cluster_id, samples): the first distinct comments of each cluster by arrival, cut at ``length``."""
    text = F.trim("text")
    cut = F.when(F.length(text) > length, F.concat(F.rtrim(F.substring(text, 1, length)), F.lit("..."))).otherwise(text)
    at = recs.where(text != "").select("user_id", "pos", cut.alias("t")).join(clusters, "user_id").groupBy("cluster_id", "t").agg(F.min("pos").alias("pos"))
    first = at.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos"))).where(F.col("r") <= count)
    return first.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("samples"))


def top_accounts(clusters: DataFrame, nodes: DataFrame, count: int = 4) -> DataFrame:
    """(cluster_id, accounts): labels of each cluster's first accounts, suspicious ones first, then by comments."""
    at = clusters.join(nodes.select(F.col("id").alias("user_id"), "label", "comment_count", "suspicious_flag"), "user_id")
    order = [F.desc("suspicious_flag"), F.desc("comment_count"), F.col("user_id")]
    top = at.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).where(F.col("r") <= count)
    return top.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("accounts"))


def cluster_report(result: RunResult) -> DataFrame:
    """The cluster table, by score, suspicious accounts, size and id. Numbers have four decimals, null is empty."""
    flagged = result.clusters.join(result.nodes.where("suspicious_flag").select(F.col("id").alias("user_id")), "user_id", "left_semi").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("flagged"))
    rows = result.cluster_stats.join(flagged, "cluster_id", "left").join(top_accounts(result.clusters, result.nodes), "cluster_id", "left").join(sample_comments(result.clusters, result.parsed.records), "cluster_id", "left")
    rows = rows.withColumn("flagged", F.coalesce("flagged", F.lit(0))).orderBy(F.desc("score"), F.desc("flagged"), F.desc("cluster_size"), "cluster_id")
    number = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.4f", c))
    shown = [F.col("cluster_id"), F.col("cluster_size"), F.col("flagged"), number("score"), metrics.suspicion_label(F.col("score")), *[number(c) for c in ("cluster_density", "content_repetition", "temporal_burst", "high_frequency", "account_age")]]
    shown += [F.array_join(metrics.main_indicators(F.col("reasons"), F.col("cluster_size"), {c: F.coalesce(c, F.lit(0.0)) for c in SIGNALS}), "; "), F.array_join("accounts", " | "), F.array_join("samples", " | ")]
    return rows.select(*[c.alias(name) for c, name in zip(shown, CLUSTER_COLUMNS)])


def listed_accounts(result: RunResult, clusters: int = 8, each: int = 2) -> DataFrame:
    """(user_id, username, cluster_id, score, comment_count, text_sample) of the suspicious accounts, one row each, by score.

    Without any, the first accounts of the first clusters stand in, with their cluster's score. An
    account that appears more than once keeps its highest score.
    """
    rows = result.details.select("user_id", "username", "cluster_id", "score")
    if not rows.limit(1).count():
        size = result.clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
        first = result.cluster_stats.join(size, "cluster_id").orderBy(F.desc("score"), F.desc("n"), "cluster_id").limit(clusters).select("cluster_id", "score")
        at = result.clusters.join(F.broadcast(first), "cluster_id").join(result.nodes.select(F.col("id").alias("user_id"), F.col("label").alias("username"), "comment_count"), "user_id")  # `clusters` rows
        order = Window.partitionBy("cluster_id").orderBy(F.desc("comment_count"), "user_id")
        rows = at.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("user_id", "username", "cluster_id", "score")
    one = rows.groupBy("user_id").agg(F.max_by(F.struct("username", "cluster_id", "score"), "score").alias("x")).select("user_id", "x.*")
    return one.join(result.nodes.select(F.col("id").alias("user_id"), "comment_count", "text_sample"), "user_id", "left").orderBy(F.desc("score"), "user_id")


def markdown_report(rows: list[dict], title: str, path: str) -> str:
    """The comparison of methods as Markdown: means by method and size, quality, and time."""
    mean = benchmarks_mean(rows)
    quality = ["method", "requested_comments", "modularity", "silhouette", "conductance_mean", "num_clusters", "num_suspicious_users", "suspicious_user_ratio"]
    time_ = ["method", "requested_comments", "repeats", *sorted({k for r in mean for k in r if k.endswith("_sec")})]
    graph = ["method", "requested_comments", "num_nodes", "num_edges", "avg_degree", "density", "reduction_ratio"]
    return write_markdown({"Quality": (mean, quality), "Graph": (mean, graph), "Time": (mean, time_), "Runs": (rows, ["method", "requested_comments", "quality_interpretation", "total_sec"])}, title, path)


def benchmarks_mean(rows: list[dict]) -> list[dict]:
    from threadloom.plans.benchmarks import aggregate  # which imports this module

    return aggregate(rows, ("method", "requested_comments"))


def visible_graph(result: RunResult, cluster_id: str | None = None, suspicious_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of one cluster, or suspicious ones, and the edges between them."""
    nodes = result.nodes.where("suspicious_flag") if suspicious_only else result.nodes
    if cluster_id is not None:
        nodes = nodes.join(result.clusters.where(F.col("cluster_id") == cluster_id).select(F.col("user_id").alias("id")), "id", "left_semi")
    ids = nodes.select("id")
    edges = result.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, edges


def quality_row(result: RunResult) -> dict:
    """The metrics with suspicious ratios, detail scores and their interpretation."""
    m = dict(result.metrics)
    mean, top, users = result.details.agg(F.coalesce(F.avg("score"), F.lit(0.0)), F.coalesce(F.max("score"), F.lit(0.0)), F.count(F.lit(1))).first()
    m |= {"mean_suspicious_score": mean, "max_suspicious_score": top}
    m["suspicious_cluster_ratio"] = m["num_suspicious_clusters"] / m["num_clusters"] if m["num_clusters"] else 0.0
    m["suspicious_user_ratio"] = users / m["num_nodes"] if m["num_nodes"] else 0.0
    spark = result.nodes.sparkSession
    one = spark.createDataFrame([(m.get("modularity"), m.get("silhouette"), m.get("conductance_mean"))], "m double, s double, c double")
    m["quality_interpretation"] = one.select(metrics.quality(F.col("m"), F.col("s"), F.col("c"))).first()[0]
    return m


def top_driver(stats: DataFrame) -> DataFrame:
    """(cluster_id, driver, contribution): the signal that adds most to each cluster's score."""
    rows = F.array_sort(F.array(*[F.struct((-F.coalesce(F.col(k), F.lit(0.0)) * w).alias("neg"), F.lit(k).alias("k")) for k, w in WEIGHTS.items()]))
    return stats.select("cluster_id", rows[0]["k"].alias("driver"), (-rows[0]["neg"]).alias("contribution"))
