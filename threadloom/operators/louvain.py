"""Louvain communities, the baseline that clusters are compared with.

Local moving is sequential, so it runs on the driver, on graphs whose size is checked first.
"""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import DataFrame

#: Edges the driver takes; a larger graph is refused rather than sampled.
MAX_EDGES = 2_000_000


def _one_level(graph: dict, loops: dict, total: float, resolution: float, rng: random.Random) -> dict:
    where = {v: v for v in graph}
    degree = {v: sum(graph[v].values()) + 2 * loops.get(v, 0.0) for v in graph}
    weight = dict(degree)
    order = sorted(graph)
    rng.shuffle(order)
    moved = True
    while moved:
        moved = False
        for v in order:
            near: dict = defaultdict(float)
            for u, w in graph[v].items():
                near[where[u]] += w
            home = where[v]
            weight[home] -= degree[v]
            best, gain = home, near.get(home, 0.0) - resolution * weight[home] * degree[v] / (2 * total)
            for c in sorted(near):
                g = near[c] - resolution * weight[c] * degree[v] / (2 * total)
                if g > gain + 1e-12:
                    best, gain = c, g
            weight[best] += degree[v]
            if best != home:
                where[v], moved = best, True
    return where


def communities(edges: list[tuple[str, str, float]], nodes: list[str], resolution: float = 1.0, seed: int = 42) -> dict[str, str]:
    """Node -> community, named by its smallest member."""
    rng = random.Random(seed)
    graph: dict = {v: {} for v in nodes}
    for a, b, w in edges:
        graph.setdefault(a, {})[b] = w
        graph.setdefault(b, {})[a] = w
    own = {v: v for v in graph}
    loops: dict = {}
    total = sum(w for v in graph for w in graph[v].values()) / 2
    while total > 0:
        where = _one_level(graph, loops, total, resolution, rng)
        if len(set(where.values())) == len(graph):
            break
        own = {v: where[c] for v, c in own.items()}
        merged: dict = {c: defaultdict(float) for c in set(where.values())}
        inner: dict = defaultdict(float)
        for v, w in loops.items():
            inner[where[v]] += w
        for a in graph:
            for b, w in graph[a].items():
                if where[a] == where[b]:
                    inner[where[a]] += w / 2
                else:
                    merged[where[a]][where[b]] += w
        graph, loops = {c: dict(n) for c, n in merged.items()}, dict(inner)
    least: dict = {}
    for v, c in own.items():
        least[c] = min(v, least.get(c, v))
    return {v: least[c] for v, c in own.items()}


def clusters(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """(cluster_id, user_id) of nodes(id) by edges(src, dst, w). More than ``MAX_EDGES`` edges are a ValueError."""
    count = edges.count()
    if count > MAX_EDGES:
        raise ValueError(f"louvain: {count} edges; the driver takes at most {MAX_EDGES}")
    rows = edges.select("src", "dst", "w").orderBy("src", "dst").collect()
    ids = [r.id for r in nodes.select("id").distinct().orderBy("id").collect()]
    found = communities([(r.src, r.dst, r.w) for r in rows], ids, resolution, seed)
    return nodes.sparkSession.createDataFrame(sorted((c, v) for v, c in found.items()), "cluster_id string, user_id string")
