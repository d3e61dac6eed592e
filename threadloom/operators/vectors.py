"""Dense embeddings: truncated SVD, cosine pairs and neighbours, silhouette."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.layers import top_neighbours
from threadloom.runtime import Stage

DIM = 256
#: Rows of a block that meets other blocks.
BLOCK_ROWS = 4_096


def _times(idx: list, val: list, m: np.ndarray) -> np.ndarray:
    """Rows of a sparse block times a dense matrix."""
    out = np.zeros((len(idx), m.shape[1]))
    for i, (j, v) in enumerate(zip(idx, val)):
        if len(j):
            out[i] = np.asarray(v) @ m[np.asarray(j)]
    return out


def reduce(rows: DataFrame, features: int, target: int = DIM, rounds: int = 3, seed: int = 42) -> DataFrame:
    """(id, v): unit-length embeddings of sparse vectors (id, idx, val).

    Up to ``target`` features they are the vectors themselves; beyond, the leading singular directions
    by randomised subspace iteration. Only feature-by-direction matrices (the feature count is bounded)
    come to the driver, never a row of the data. A zero vector stays zero.
    """
    stage = Stage(rows.sparkSession, "svd")
    spark = rows.sparkSession
    rows = stage.put(rows.select("id", "idx", "val"))
    n = rows.count()
    # each part gives a matrix, so parts are few
    rows = stage.put(rows.repartition(max(1, math.ceil(n / BLOCK_ROWS))))
    dim = features if features <= target else min(target, features - 1, n - 1 if n > 1 else target)
    if features <= target or dim < 2:
        return _projected(rows, np.eye(features), spark)

    def gram(m: np.ndarray) -> np.ndarray:
        """A' A m, summed over partitions."""
        shared = spark.sparkContext.broadcast(m)

        def part(batches):
            acc = np.zeros_like(shared.value)
            for b in batches:
                idx, val = b.column(1).to_pylist(), b.column(2).to_pylist()
                y = _times(idx, val, shared.value)
                for i, (j, v) in enumerate(zip(idx, val)):
                    acc[j] += np.asarray(v)[:, None] * y[i]
            yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], names=["m"])

        parts = rows.mapInArrow(part, "m binary").rdd.map(lambda r: np.frombuffer(r.m).reshape(m.shape))
        return parts.treeReduce(lambda a, b: a + b)

    width = min(dim + 10, features)
    q = _orthonormal(np.random.default_rng(seed).standard_normal((features, width)))
    for _ in range(rounds):
        q = _orthonormal(gram(q))
    small = q.T @ gram(q)
    _, v = np.linalg.eigh((small + small.T) / 2)
    return _projected(rows, q @ v[:, ::-1][:, :dim], spark)


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """Orthonormal columns of the same span, by way of the small Gram matrix; twice, for accuracy. Directions lost to rounding become zero."""
    for _ in range(2):
        w, v = np.linalg.eigh(z.T @ z)
        z = z @ (v / np.sqrt(np.where(w > w[-1] * 1e-14, w, np.inf)))
    return z


def _projected(rows: DataFrame, m: np.ndarray, spark) -> DataFrame:
    shared = spark.sparkContext.broadcast(m)

    def part(batches):
        for b in batches:
            y = _times(b.column(1).to_pylist(), b.column(2).to_pylist(), shared.value)
            norm = np.linalg.norm(y, axis=1, keepdims=True)
            y = y / np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["id", "v"])

    return rows.mapInArrow(part, "id string, v array<double>")


def _block_pairs(vectors: DataFrame, stage: Stage, work, schema: str, both_ways: bool) -> DataFrame:
    """``work(q ids, q, x ids, x)`` over all pairs of bounded blocks of unit vectors (id, v)."""
    rows = stage.put(vectors)
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    own = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    ask = own.select(F.col("blk").alias("qb"), F.explode(F.expr(f"sequence({'0' if both_ways else 'blk'}, {blocks - 1})")).alias("xb"), F.lit(False).alias("as_x"), "id", "v")
    held = own.select(F.explode(F.expr(f"sequence(0, {blocks - 1 if both_ways else 'blk'})")).alias("qb"), F.col("blk").alias("xb"), F.lit(True).alias("as_x"), "id", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, q = pdf[pdf["as_x"]].sort_values("id"), pdf[~pdf["as_x"]].sort_values("id")
        out = list(work(q["id"].to_numpy(), np.stack(q["v"].to_numpy()), x["id"].to_numpy(), np.stack(x["v"].to_numpy()))) if len(x) and len(q) else []
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": [], "w": []})

    return ask.unionByName(held).groupBy("qb", "xb").applyInPandas(run, schema)


def cosine_pairs(vectors: DataFrame, floor: float) -> DataFrame:
    """(u, v, w), u < v, of unit vectors (id, v) with an inner product of at least ``floor``. Exact, in bounded blocks."""
    stage = Stage(vectors.sparkSession, "cosine")

    def work(q_ids, q, x_ids, x):
        for a in range(0, len(q), 512):
            sims = q[a : a + 512] @ x.T
            i, j = np.nonzero(sims >= floor)
            u, v = q_ids[a + i], x_ids[j]
            keep = u != v
            lo, hi = np.where(u < v, u, v)[keep], np.where(u < v, v, u)[keep]
            yield pd.DataFrame({"u": lo, "v": hi, "w": sims[i, j][keep]})

    return _block_pairs(vectors, stage, work, "u string, v string, w double", False).groupBy("u", "v").agg(F.max("w").alias("w"))


def cosine_neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """(u, v, w): the k most similar others of each unit vector; equal ones, to nine decimals, rank by id."""
    stage = Stage(vectors.sparkSession, "cosine")

    def work(q_ids, q, x_ids, x):
        for a in range(0, len(q), 512):
            sims = q[a : a + 512] @ x.T
            key = np.where(q_ids[a : a + 512, None] == x_ids[None, :], -2, np.round(sims, 9))
            best = np.argsort(-key, axis=1, kind="stable")[:, :k]
            i = np.repeat(np.arange(len(best)), best.shape[1])
            j = best.ravel()
            keep = key[i, j] > -2
            yield pd.DataFrame({"u": q_ids[a + i[keep]], "v": x_ids[j[keep]], "w": sims[i[keep], j[keep]]})

    return top_neighbours(_block_pairs(vectors, stage, work, "u string, v string, w double", True), k, [F.desc(F.round("w", 9)), F.col("v")])


def unit(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of unit length; null, empty and zero vectors and null keys are left out."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).cast("string").alias("id"), v.alias("v")).where("id is not null and v is not null")
    rows = rows.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("n > 0 and not isnan(n)")
    return rows.select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def silhouette(vectors: DataFrame, labels: DataFrame) -> float | None:
    """Mean cosine silhouette of unit vectors (id, v) with labels (id, label); null unless 3 <= rows and 2 <= labels < rows.

    The mean distance to a cluster is one minus the inner product with the cluster's mean, so a row
    meets the label sums, not the other rows. Rows of single-member labels count 0.
    """
    stage = Stage(vectors.sparkSession, "silhouette")
    at = stage.put(vectors.join(labels, "id").select("id", "label", "v"))
    sums = at.select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.sum("x").alias("s"))
    sizes = at.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sums = stage.put(sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda e: e["s"]).alias("s")).join(sizes, "label"))
    rows, groups = at.count(), sizes.count()
    if rows < 3 or groups < 2 or groups >= rows:
        return None
    # a task holds one block of label sums at a time
    blocks = max(1, math.ceil(groups / LABELS_AT_ONCE))
    part_of = F.pmod(F.xxhash64("label"), F.lit(blocks))
    seen = None
    for k in range(blocks):
        table = sums.where(part_of == k).select("label", "n", "s").toPandas()
        if len(table):
            one = at.select("id", "label", "v").mapInPandas(_to_labels(table), "id string, own double, n bigint, other double")
            seen = one if seen is None else seen.unionByName(one)
    best = seen.groupBy("id").agg(F.max("own").alias("a"), F.max("n").alias("n"), F.min("other").alias("b"))
    score = F.when(F.col("n") < 2, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300)))
    return best.agg(F.avg(score)).first()[0]


LABELS_AT_ONCE = 4_096


def _to_labels(table: pd.DataFrame):
    """Per row of (id, label, v): mean distance to its own label and its size, if in ``table``, and to the nearest other one."""
    m, n = np.stack(table["s"].to_numpy()), table["n"].to_numpy().astype(float)
    number = {k: i for i, k in enumerate(table["label"])}

    def part(batches):
        for pdf in batches:
            dots = np.stack(pdf["v"].to_numpy()) @ m.T
            far = 1 - dots / n
            own, size = np.full(len(pdf), np.nan), np.zeros(len(pdf), np.int64)
            at = pdf["label"].map(number)
            i = np.flatnonzero(at.notna().to_numpy())
            j = at.to_numpy()[i].astype(int)
            own[i] = 1 - (dots[i, j] - 1) / np.maximum(n[j] - 1, 1)
            size[i] = n[j]
            far[i, j] = np.inf
            out = pd.DataFrame({"id": pdf["id"].to_numpy(), "own": own, "n": size, "other": far.min(axis=1)})
            yield out.astype({"own": object}).where(out.notna(), None)

    return part
