"""Canopy clustering by cosine similarity, and the choice of its thresholds.

Pivots are taken in ordinal order; a pivot removes what is at least t2 similar. So an item is a pivot
exactly if no earlier pivot is that similar, which rounds over the pair table settle for all items at
once: an item whose earlier neighbours are all removed becomes a pivot, an item with an earlier
pivot neighbour is removed. No task walks through all items.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranking import global_rank
from threadloom.operators.vectors import cosine_pairs
from threadloom.runtime import Stage

#: Rows that thresholds are tuned on, at most: those with the smallest hash of their id.
TUNING_ROWS = 1_500
GRID = tuple(round(0.60 + 0.05 * i, 2) for i in range(8))


def ordered_thresholds(t1: float, t2: float) -> tuple[float, float]:
    """(outer, inner) with outer <= inner; a threshold of 0 or less is a ValueError."""
    if t1 <= 0 or t2 <= 0:
        raise ValueError("canopy thresholds must be greater than 0")
    return (t1, t2) if t1 <= t2 else (t2, t1)


@dataclass
class Canopies:
    """assignment(user_id, canopy): first canopy of each; members(canopy, user_id): they may overlap."""

    assignment: DataFrame
    members: DataFrame
    t1: float
    t2: float
    silhouette: float | None = None
    candidates: int = 0
    timings: dict[str, float] = field(default_factory=dict)


def from_pairs(items: DataFrame, pairs: DataFrame, t1: float, t2: float) -> Canopies:
    """Canopies of items(id, ord), ord unique, by similarity pairs(u, v, w) of at least t1; pairs missing are less similar.

    canopy_000 has the first pivot. No items give no canopies.
    """
    t1, t2 = ordered_thresholds(t1, t2)
    stage = Stage(items.sparkSession, "canopy")
    items = stage.put(items.select("id", "ord"))
    a, b = items.select(F.col("id").alias("u"), F.col("ord").alias("ou")), items.select(F.col("id").alias("v"), F.col("ord").alias("ov"))
    known = stage.put(pairs.where((F.col("w") >= t1) & (F.col("u") != F.col("v"))).join(a, "u").join(b, "v").select(F.least("ou", "ov").alias("lo"), F.greatest("ou", "ov").alias("hi"), "w"))
    close = stage.put(known.where(F.col("w") >= t2).select("lo", "hi").distinct())
    open_ = stage.put(items.select("ord"))
    pivots = None
    while open_.limit(1).count():
        # nobody open stands before it: a pivot
        waiting = close.select(F.col("hi").alias("ord")).distinct()
        new = stage.put(open_.join(waiting, "ord", "left_anti"))
        pivots = new if pivots is None else pivots.union(new)
        gone = stage.put(close.join(new.select(F.col("ord").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("ord")).distinct())
        rest = stage.put(open_.join(new, "ord", "left_anti").join(gone, "ord", "left_anti"))
        # what is decided holds nobody back any more
        live, old = rest.select(F.col("ord").alias("o")), (open_, close, gone)
        close = stage.put(close.join(live, F.col("lo") == F.col("o"), "left_semi").join(live, F.col("hi") == F.col("o"), "left_semi"))
        open_ = rest
        for table in old:
            stage.drop(table)
    if pivots is None:
        none = items.select(F.col("id").alias("user_id"), F.lit("").alias("canopy"))
        return Canopies(none, none.select("canopy", "user_id"), t1, t2)
    named = stage.put(global_rank(pivots, ["ord"], stage, "k").select(F.col("ord").alias("pivot"), F.concat(F.lit("canopy_"), F.when(F.col("k") < 1000, F.lpad(F.col("k").cast("string"), 3, "0")).otherwise(F.col("k").cast("string"))).alias("canopy"), "k"))
    around = known.select(F.col("lo").alias("pivot"), F.col("hi").alias("ord")).union(known.select("hi", "lo"))
    of = named.select("canopy", "k", F.col("pivot").alias("ord")).union(around.join(named, "pivot").select("canopy", "k", "ord")).distinct()
    members = stage.put(of.join(items, "ord").select("canopy", "k", F.col("id").alias("user_id")))
    return Canopies(members.groupBy("user_id").agg(F.min_by("canopy", "k").alias("canopy")), members.select("canopy", "user_id"), t1, t2)


def _greedy(sims: np.ndarray, t1: float, t2: float) -> tuple[np.ndarray, int]:
    """First canopy of each row of a similarity matrix, and how many there are."""
    n = len(sims)
    label, removed, count = np.full(n, -1), np.zeros(n, bool), 0
    for i in range(n):
        if removed[i]:
            continue
        members = sims[i] >= t1
        members[i] = True
        label[members & (label < 0)] = count
        removed |= sims[i] >= t2
        removed[i] = True
        count += 1
    return label, count


def _silhouette(sims: np.ndarray, label: np.ndarray) -> float | None:
    kinds, own = np.unique(label, return_inverse=True)
    n = len(label)
    if n < 3 or len(kinds) < 2 or len(kinds) >= n:
        return None
    one = np.zeros((n, len(kinds)))
    one[np.arange(n), own] = 1
    size = one.sum(axis=0)
    far = (1 - sims) @ one
    i = np.arange(n)
    a = far[i, own] / np.maximum(size[own] - 1, 1)
    far = far / size
    far[i, own] = np.inf
    b = far.min(axis=1)
    top = np.maximum(a, b)
    s = np.where((size[own] < 2) | (top <= 0), 0.0, (b - a) / np.where(top > 0, top, 1))
    return float(s.mean())


def tune(vectors: np.ndarray, t1: float, t2: float) -> tuple[float, float, float | None, int, list[tuple]]:
    """(t1, t2, silhouette, candidates, grid rows) best by silhouette, then nearness to the given ones, then to sqrt(n) canopies."""
    if len(vectors) < 3:
        return t1, t2, None, 0, []
    sims = np.clip(vectors @ vectors.T, -1, 1)
    np.fill_diagonal(sims, 1.0)
    values = sorted({*GRID, round(float(t1), 2), round(float(t2), 2)})
    best, rows = None, []
    for outer in values:
        for inner in values:
            if outer > inner:
                continue
            label, count = _greedy(sims, outer, inner)
            score = _silhouette(sims, label)
            rows.append((outer, inner, count, score))
            if score is not None:
                key = (score, -(abs(outer - t1) + abs(inner - t2)), -abs(count - math.sqrt(len(vectors))))
                if best is None or key > best[0]:
                    best = (key, outer, inner)
    if best is None:
        return t1, t2, None, len(rows), rows
    return best[1], best[2], best[0][0], len(rows), rows


def tuning_sample(vectors: DataFrame) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(TUNING_ROWS).orderBy("id").select("v").toPandas()["v"]
    return np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, 1))


def build(vectors: DataFrame, order: DataFrame, t1: float, t2: float, auto_tune: bool = True) -> Canopies:
    """Canopies of unit vectors (id, v) in the order of order(id, ord), thresholds tuned if asked for."""
    t1, t2 = ordered_thresholds(t1, t2)
    score, candidates = None, 0
    if auto_tune:
        t1, t2, score, candidates, _ = tune(tuning_sample(vectors), t1, t2)
    out = from_pairs(vectors.select("id").join(order, "id"), cosine_pairs(vectors, t1), t1, t2)
    out.silhouette, out.candidates = score, candidates
    return out
