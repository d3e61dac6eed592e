"""The whole analysis: comments to graph, clusters, scores and metrics."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import canopy as canopies_
from threadloom.operators import components, layers, metrics, mst, parse, scoring, tfidf, vectors
from threadloom.operators.ranking import global_rank
from threadloom.runtime import Stage
from threadloom.schema import Params

#: Share of the work done when a stage begins, for progress reports.
STAGES = {"fetching": 0.05, "parsing": 0.30, "canopy": 0.45, "graph": 0.60, "clustering": 0.75, "scoring": 0.90, "finalizing": 0.97}
Progress = Callable[[str, float], None]


@dataclass
class Parsed:
    records: DataFrame
    members: DataFrame
    summary: DataFrame


@dataclass
class RunResult:
    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame
    canopies: canopies_.Canopies | None
    cluster_stats: DataFrame
    node_scores: DataFrame
    details: DataFrame
    metrics: dict[str, float]
    timings: dict[str, float] = field(default_factory=dict)
    parsed: Parsed | None = None


class _Timer:
    def __init__(self, progress: Progress | None):
        self.progress, self.seconds, self._at, self._name = progress, {}, 0.0, ""

    def __call__(self, name: str) -> None:
        now = time.monotonic()
        if self._name:
            self.seconds[f"{self._name}_sec"] = now - self._at
        self._name, self._at = name, now
        if self.progress and name:
            self.progress(name, STAGES[name])


def parse_comments(comments: DataFrame, stage: Stage, arrays: bool = False) -> Parsed:
    recs = stage.put(parse.records(comments))
    members = stage.put(parse.thread_members(recs))
    return Parsed(recs, members, stage.put(parse.user_summary(recs, members, arrays)))


def fit_texts(recs: DataFrame) -> tfidf.Fitted | None:
    """TF-IDF of the accounts' texts, fitted once for canopies, content edges and scores."""
    rows = recs.select("user_id", "pos", F.array_join("fragments", " ").alias("text"))
    return tfidf.fit(tfidf.token_rows(rows, "user_id", "pos", "text"))


def content_vectors(fitted: tfidf.Fitted, stage: Stage) -> DataFrame:
    return stage.put(tfidf.vectors(fitted.weights))


def embed(fitted: tfidf.Fitted, sparse: DataFrame, stage: Stage) -> DataFrame:
    return stage.put(vectors.reduce(sparse, fitted.n_features))


def user_order(summary: DataFrame) -> DataFrame:
    """(id, ord): accounts by their first comment."""
    return summary.select(F.col("user_id").alias("id"), F.col("first_pos").alias("ord"))


def build_graph(parsed: Parsed, sparse: DataFrame | None, n_features: int, params: Params, assignment: DataFrame | None, stage: Stage) -> DataFrame:
    """Canonical pruned edges (src, dst, w) of the fused layers; sparse is None for fewer than two texts."""
    d = params.delta_thread
    parts = [
        (layers.normalize_layer(stage.put(parse.mention_edges(parsed.records))), params.alpha_mention),
        (layers.normalize_layer(stage.put(parse.reply_edges(parsed.records))), params.beta_reply),
        (layers.normalize_layer(stage.put(parse.co_thread_edges(parsed.members))), d * 0.7),
        (layers.normalize_layer(stage.put(layers.temporal_edges(parsed.summary, params.k_neighbors))), d * 0.3),
    ]
    if sparse is not None:
        parts.append((stage.put(layers.content_edges(sparse, params.k_neighbors, n_features)), params.gamma_content))
    fused = layers.fuse(parts)
    if assignment is not None:
        fused = layers.penalize(fused, assignment, params.cross_canopy_penalty)
    return stage.put(layers.prune(stage.put(fused), params.k_neighbors))


def nodes_of(parsed: Parsed, assignment: DataFrame | None, texts: DataFrame | None = None) -> DataFrame:
    """Node rows; text_sample is the first 280 characters of the account's text."""
    s = parsed.summary
    label = F.coalesce(F.nullif("username", F.lit("")), "user_id")
    canopy = assignment.select(F.col("user_id").alias("cu"), "canopy") if assignment is not None else None
    out = s.join(canopy, F.col("user_id") == F.col("cu"), "left") if canopy is not None else s.withColumn("canopy", F.lit(None).cast("string"))
    sample = text_samples(parsed.records) if texts is None else texts.select("user_id", F.substring("corpus", 1, 280).alias("text_sample"))
    out = out.join(sample.select(F.col("user_id").alias("tu"), "text_sample"), F.col("user_id") == F.col("tu"), "left")
    extra = ["threads"] if "threads" in s.columns else []
    return out.select(
        F.col("user_id").alias("id"), label.alias("label"), "canopy", "comment_count", "reply_count", "mention_count", "thread_count", "total_likes", "avg_likes", "first_timestamp", "last_timestamp", *extra,
        F.coalesce("text_sample", F.lit("")).alias("text_sample"),
    )


def text_samples(recs: DataFrame, length: int = 280) -> DataFrame:
    """(user_id, text_sample): the beginning of an account's text.

    Only the first comments that can matter are kept: at most ``length`` by position, found by
    chunk so that no account's comments all meet in one task.
    """
    has = recs.where(F.size("fragments") > 0).select("user_id", "pos", F.array_join("fragments", " ").alias("t"), F.expr(f"pos div {tfidf.CHUNK}").alias("chunk"))
    first = has.withColumn("r", F.row_number().over(Window.partitionBy("user_id", "chunk").orderBy("pos"))).where(F.col("r") <= length)
    some = first.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("pos"))).where(F.col("r") <= length)
    joined = some.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("p"))
    return joined.select("user_id", F.substring(F.array_join(F.transform("p", lambda x: x["t"]), " "), 1, length).alias("text_sample"))


def analyze(
    comments: DataFrame, params: Params | None = None, progress: Progress | None = None, arrays: bool = False, use_canopies: bool = True, cluster: Callable[[DataFrame, DataFrame], DataFrame] = mst.clusters
) -> RunResult:
    """The full analysis of the first ``max_comments`` comments. No comments are a ValueError.

    ``arrays`` keeps each account's timestamps and threads, whose length has no bound, in the nodes.
    Without ``use_canopies`` they are found but neither penalise edges nor count in the metrics.
    ``cluster`` makes (cluster_id, user_id) of nodes and edges.
    """
    params = params or Params()
    stage, timer = Stage(comments.sparkSession, "analysis"), _Timer(progress)
    timer("parsing")
    if params.max_comments is not None:
        comments = parse.prefix(comments, params.max_comments)
    if not comments.limit(1).count():
        raise ValueError("comments: there are none")
    parsed = parse_comments(comments, stage, arrays)
    timer("canopy")
    fitted = fit_texts(parsed.records)
    found, sparse = None, None
    if fitted:
        sparse = content_vectors(fitted, stage)
        found = canopies_.build(embedded := embed(fitted, sparse, stage), user_order(parsed.summary), params.canopy_t1, params.canopy_t2, params.auto_tune_canopy)
    assignment = stage.put(found.assignment) if found and use_canopies else None
    timer("graph")
    edges = build_graph(parsed, sparse if fitted and fitted.n_docs >= 2 else None, fitted.n_features if fitted else 0, params, assignment, stage)
    ids = parsed.summary.select(F.col("user_id").alias("id"))
    timer("clustering")
    clusters = stage.put(cluster(ids, edges))
    timer("scoring")
    weights = fitted.weights.select("doc", "term", "w") if fitted and fitted.n_docs >= 2 else None
    stats, cutoff = scoring.suspicion(scoring.cluster_stats(clusters, edges, parsed.summary, weights))
    stats = stage.put(stats)
    scores = stage.put(scoring.node_scores(clusters, edges, parsed.summary, stats))
    details = scoring.suspicious_details(clusters, edges, parsed.summary, stats, scores, assignment)
    timer("finalizing")
    values = run_metrics(ids, edges, clusters, stats, cutoff, assignment)
    if found:
        labels = clusters.select(F.col("user_id").alias("id"), F.col("cluster_id").alias("label"))
        values["silhouette"] = vectors.silhouette(embedded, labels)
        values |= {f"canopy_{k}": v for k, v in metrics.group_sizes(found.members, "canopy").first().asDict().items()}
    flags = scores.select(F.col("user_id").alias("su"), F.col("score").alias("suspicious_score")).join(stats.where("is_suspicious").join(clusters, "cluster_id").select(F.col("user_id").alias("fu"), F.lit(True).alias("flag")), F.col("su") == F.col("fu"), "left")
    nodes = nodes_of(parsed, assignment).join(flags, F.col("id") == F.col("su"), "left").drop("su", "fu")
    nodes = nodes.withColumn("suspicious_score", F.coalesce("suspicious_score", F.lit(0.0))).withColumn("suspicious_flag", F.coalesce("flag", F.lit(False))).drop("flag")
    timer("")
    return RunResult(nodes, edges, clusters, found, stats, scores, details, values, timer.seconds, parsed)


def run_metrics(ids: DataFrame, edges: DataFrame, clusters: DataFrame, stats: DataFrame, cutoff: float, assignment: DataFrame | None) -> dict[str, float]:
    out = metrics.graph_stats(ids, edges).first().asDict()
    out["num_components"] = components.connected_components(ids, edges.select(F.col("src").alias("source"), F.col("dst").alias("target"))).select("label").distinct().count()
    out |= metrics.modularity(clusters, edges).first().asDict()
    out["conductance_mean"] = metrics.conductance(clusters, edges).agg(F.coalesce(F.avg("conductance"), F.lit(0.0))).first()[0]
    hot = F.col("is_suspicious")
    out |= (
        stats.agg(
            F.count(F.lit(1)).alias("num_clusters"), F.count_if(hot).alias("num_suspicious_clusters"), F.coalesce(F.sum(F.when(hot, F.col("cluster_size"))), F.lit(0)).alias("num_suspicious_users"),
            *[F.avg(c).alias(f"avg_{c}") for c in ("cluster_density", "content_repetition", "temporal_burst", "high_frequency")], F.avg("account_age_coverage").alias("account_age_coverage"), F.avg("account_age").alias("avg_account_age_ratio"),
        ).first().asDict()
    )
    out["suspicious_score_cutoff"] = cutoff
    if assignment is not None:
        out |= metrics.intra_canopy_ratio(edges, assignment).first().asDict()
    return out


def canopies(texts: DataFrame, t1: float = 0.6, t2: float = 0.8, auto_tune: bool = True) -> canopies_.Canopies:
    """Canopies of texts(user_id, corpus), in the order of user_id. No usable text is a ValueError."""
    stage = Stage(texts.sparkSession, "canopies")
    fitted = tfidf.fit(tfidf.token_rows(texts.withColumn("_at", F.lit(0)), "user_id", "_at", "corpus"))
    if not fitted:
        raise ValueError("user_texts: no text has a usable token")
    embedded = embed(fitted, content_vectors(fitted, stage), stage)
    order = components_order(embedded.select("id"), stage)
    return canopies_.build(embedded, order, t1, t2, auto_tune)


def components_order(ids: DataFrame, stage: Stage) -> DataFrame:
    return global_rank(ids.distinct(), ["id"], stage, "ord")


def mst_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, user_id) of nodes(id) and canonical edges(src, dst, w)."""
    return mst.clusters(nodes.select("id"), edges)


def export_graph(result: RunResult) -> dict[str, DataFrame]:
    """The five tables of a graph export."""
    edges = result.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("w").alias("weight"))
    at = components.numbered(components.connected_components(result.nodes.select("id"), edges.select("source", "target")))
    comps = at.join(result.nodes.select("id", "label"), "id").select("component_id", "component_size", F.col("id").alias("node_id"), "label")
    summary = component_summary(comps)
    sizes = comps.agg(F.count(F.lit(1)).alias("n_nodes"), F.max("component_size").alias("largest_component_size"), F.count_if(F.col("component_size") == 1).alias("isolated_nodes"), F.count_distinct("component_id").alias("n_components"))
    c = result.canopies
    graph = sizes.withColumn("n_edges", F.lit(edges.count())).withColumn("canopy_t1", F.lit(c.t1 if c else None).cast("double")).withColumn("canopy_t2", F.lit(c.t2 if c else None).cast("double")).withColumn("used_canopy_overlay", F.lit(c is not None))
    return {"nodes": result.nodes, "edges": edges, "components": comps, "component_summary": summary, "graph_summary": graph}


def component_summary(comps: DataFrame) -> DataFrame:
    """(component_id, component_size, node_ids, labels) with JSON lists in the order of node_id. A list is as long as its component."""
    e = F.sort_array(F.collect_list(F.struct("node_id", "label")))
    rolled = comps.groupBy("component_id", "component_size").agg(e.alias("e"))
    return rolled.select("component_id", "component_size", F.to_json(F.transform("e", lambda x: x["node_id"])).alias("node_ids"), F.to_json(F.transform("e", lambda x: x["label"])).alias("labels"))


@dataclass
class Job:
    id: str
    status: str = "queued"
    stage: str = ""
    progress: float = 0.0
    result: RunResult | None = None
    error: str | None = None


class Runs:
    """Analyses in the background of the driver, with their progress. The last ``keep`` finished ones are remembered."""

    def __init__(self, keep: int = 20):
        self.keep = keep
        self._jobs: dict[str, Job] = {}
        self._lock = threading.Lock()

    def start(self, comments: DataFrame, params: Params | None = None) -> str:
        job = Job(uuid.uuid4().hex)
        with self._lock:
            ended = [k for k, j in self._jobs.items() if j.status in ("done", "failed")]
            for k in ended[: max(0, len(ended) - self.keep + 1)]:
                del self._jobs[k]
            self._jobs[job.id] = job

        def report(stage: str, share: float) -> None:
            with self._lock:
                job.stage, job.progress = stage, share

        def work() -> None:
            job.status = "running"
            try:
                job.result = analyze(comments, params, report)
                job.status, job.progress = "done", 1.0
            except Exception as e:
                job.status, job.error = "failed", str(e)

        threading.Thread(target=work, daemon=True).start()
        return job.id

    def status(self, job_id: str) -> Job:
        """The job; an unknown id is a KeyError."""
        with self._lock:
            return self._jobs[job_id]
