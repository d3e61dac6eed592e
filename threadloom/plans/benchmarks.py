"""Timed runs: sizes by mode, and the spanning-forest clusters against Louvain's."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import louvain, mst
from threadloom.plans import pipeline, reports
from threadloom.runtime import Stage
from threadloom.schema import Params

SIZES = (100, 200, 500, 1000)
MODES = ("pipeline", "canopy_only", "kruskal_only")


def run_once(comments: DataFrame, size: int, mode: str, params: Params | None = None) -> dict:
    """One timed run over the first ``size`` comments: the whole, canopies alone, or without their effect."""
    params = replace(params or Params(), max_comments=size)
    start = time.monotonic()
    if mode == "canopy_only":
        stage = Stage(comments.sparkSession, "bench")
        parsed = pipeline.parse_comments(comments.where(F.col("pos") < size), stage)
        fitted = pipeline.fit_texts(parsed.records)
        row = {"n_canopies": 0}
        if fitted:
            sparse = pipeline.content_vectors(fitted, stage)
            found = pipeline.canopies_.build(pipeline.embed(fitted, sparse, stage), pipeline.user_order(parsed.summary), params.canopy_t1, params.canopy_t2, params.auto_tune_canopy)
            row = {"n_canopies": found.members.select("canopy").distinct().count(), "canopy_t1": found.t1, "canopy_t2": found.t2, "threshold_silhouette": found.silhouette}
    elif mode in MODES:
        result = pipeline.analyze(comments, params, use_canopies=mode == "pipeline")
        row = reports.quality_row(result) | result.timings
    else:
        raise ValueError(f"mode: {mode} is none of {', '.join(MODES)}")
    return {"mode": mode, "requested_comments": size, **row, "total_sec": time.monotonic() - start}


def run_all(comments: DataFrame, sizes: tuple[int, ...] = SIZES, modes: tuple[str, ...] = MODES, repeats: int = 2) -> list[dict]:
    return [run_once(comments, size, mode) | {"repeat": i + 1} for size in sizes for mode in modes for i in range(repeats)]


def compare_methods(comments: DataFrame, size: int, params: Params | None = None) -> list[dict]:
    """A row for the canopy and spanning-forest method, and one for Louvain without canopies."""
    params = replace(params or Params(), max_comments=size)
    rows = []
    for method, canopies, cluster in (("canopy_mst", True, mst.clusters), ("louvain", False, louvain.clusters)):
        start = time.monotonic()
        result = pipeline.analyze(comments, params, use_canopies=canopies, cluster=cluster)
        row = {"method": method, "requested_comments": size, **reports.quality_row(result), **result.timings, "total_sec": time.monotonic() - start}
        if method == "canopy_mst":
            row |= mst.reduction(int(row["num_nodes"]), int(row["num_components"]), int(row["num_clusters"]), int(row["num_edges"]))
        rows.append(row)
    return rows


def aggregate(rows: list[dict], by: tuple[str, str]) -> list[dict]:
    """Means by group in the order of size, then method; nulls ignored, words left out."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in by), []).append(r)
    out = []
    for key in sorted(groups, key=lambda k: (k[1], k[0])):
        part = groups[key]
        row = dict(zip(by, key)) | {"repeats": len(part)}
        for name in dict.fromkeys(k for r in part for k in r if k not in by):
            values = [r[name] for r in part if isinstance(r.get(name), (int, float))]
            if values or all(r.get(name) is None for r in part):
                row[name] = sum(values) / len(values) if values else None
        out.append(row)
    return out


def export_sizes(comments: DataFrame, sizes: tuple[int, ...] = SIZES, params: Params | None = None) -> dict[int, dict[str, DataFrame]]:
    """The graph export of each size."""
    return {n: pipeline.export_graph(pipeline.analyze(comments, replace(params or Params(), max_comments=n))) for n in sizes}
