"""Graph layers: degree normalisation, temporal and content neighbours, fusion, penalty, pruning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scores import clamp01
from threadloom.operators.ranking import global_rank
from threadloom.runtime import Stage

EDGE = ("src", "dst", "w")
TEMPORAL_FLOOR = 0.18


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, as (u, v, w)."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w").union(edges.select("dst", "src", "w"))


def degrees(edges: DataFrame) -> DataFrame:
    """(u, degree, strength): number and weight of an account's edges."""
    return symmetric(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def normalize_layer(edges: DataFrame) -> DataFrame:
    """w / ln(2 + max(1, product of the ends' strengths))."""
    s = degrees(edges).select("u", "strength")
    a, b = s.select(F.col("u").alias("src"), F.col("strength").alias("sa")), s.select(F.col("u").alias("dst"), F.col("strength").alias("sb"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / F.ln(2.0 + F.greatest(F.lit(1.0), F.col("sa") * F.col("sb")))).alias("w"))


def max_merge(pairs: DataFrame) -> DataFrame:
    """(src, dst, w) with the largest weight among directed pairs (u, v, w) of the same ends."""
    return pairs.groupBy(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.max("w").alias("w"))


def top_neighbours(pairs: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each u by ``order``."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("u").orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def activity_windows(summary: DataFrame) -> DataFrame:
    """(user_id, first, last, center, rate, first_pos) of accounts with a time."""
    first, last = F.col("first_timestamp").cast("double"), F.col("last_timestamp").cast("double")
    count = F.greatest(F.lit(1.0), F.col("comment_count").cast("double"))
    return summary.where("first_timestamp is not null").select(
        "user_id", first.alias("first"), last.alias("last"), ((first + last) / 2).alias("center"), (count / F.greatest(F.lit(1.0), last - first)).alias("rate"), "first_pos"
    )


def temporal_score(a: str, b: str, scale: float) -> Column:
    """Closeness of two activity windows (columns of structs a and b): centres, overlap and rates."""
    l, r = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    gap = F.abs(l("center") - r("center"))
    near = F.greatest(F.lit(0.0), 1.0 - gap / max(1.0, scale))
    both = F.greatest(F.lit(0.0), F.least(l("last"), r("last")) - F.greatest(l("first"), r("first")))
    whole = F.greatest(F.lit(1.0), F.greatest(l("last"), r("last")) - F.least(l("first"), r("first")))
    overlap = F.when((l("last") <= l("first")) & (r("last") <= r("first")), near).when(both > 0, both / whole).otherwise(F.greatest(F.lit(0.0), 1.0 - gap / max(1.0, scale * 1.5)))
    rates = F.greatest(F.lit(0.0), 1.0 - F.abs(F.log1p(l("rate")) - F.log1p(r("rate"))) / math.log1p(5.0))
    return clamp01(0.55 * near + 0.25 * overlap + 0.20 * rates)


def temporal_scale(low: float | None, high: float | None) -> float:
    """Time scale from the smallest and largest centre."""
    whole = max(1.0, (high or 0.0) - (low or 0.0))
    return max(120.0, min(whole, max(180.0, whole * 0.12)))


def temporal_edges(summary: DataFrame, k: int) -> DataFrame:
    """Up to k most synchronous accounts of each, among those within max(6, 3k) ranks by centre.

    The band is an equi-join on rank buckets: a row meets its own bucket and the two beside it.
    """
    stage = Stage(summary.sparkSession, "temporal")
    windows = stage.put(activity_windows(summary))
    low, high = windows.agg(F.min("center"), F.max("center")).first()
    band = max(6, 3 * k)
    ranked = stage.put(global_rank(windows, ["center", "first_pos"], stage).select("rank", "user_id", F.struct("first", "last", "center", "rate").alias("s")))
    left = ranked.select(F.expr(f"rank div {band}").alias("bucket"), F.col("rank").alias("ru"), F.col("user_id").alias("u"), F.col("s").alias("a"))
    right = ranked.select(
        F.explode(F.expr(f"array(rank div {band} - 1, rank div {band}, rank div {band} + 1)")).alias("bucket"), F.col("rank").alias("rv"), F.col("user_id").alias("v"), F.col("s").alias("b")
    )
    near = left.join(right, "bucket").where(F.abs(F.col("ru") - F.col("rv")).between(1, band))
    scored = near.select("u", "v", "rv", temporal_score("a", "b", temporal_scale(low, high)).alias("w")).where(F.col("w") > TEMPORAL_FLOOR)
    # equal scores up to the twelfth decimal rank by position
    return max_merge(top_neighbours(scored, k, [F.desc(F.round("w", 12)), F.col("rv")]))


#: Rows of a block of sparse vectors, the most rows of a searching task, and those of them that meet a block at once.
BLOCK_ROWS = 8_192
STRIP_ROWS = 16_384
SEARCHING = 512
#: Share of the rows from which a term is multiplied in full rather than by lists, at most so many terms, and the error of single precision.
HEAVY = 0.04
HEAVY_TERMS = 2_048
SINGLE = 1e-4


def sparse_neighbours(vectors: DataFrame, k: int, features: int) -> DataFrame:
    """(u, v, w): the k most similar others by inner product of sparse vectors (id, idx, val), if above 0.

    Exact. The rows are written once in order of id. A task has a strip of them and reads all others block by block from the
    shared folder, so no row is copied. Frequent terms are multiplied as matrices, the rest by inverted lists, in single
    precision; pairs that may be among the k best so far are then computed in double. Sums are compared to nine decimals,
    equal ones rank by id.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "content")
    vectors = vectors.select("id", F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val")).where(F.size("idx") > 0)
    rows = stage.put(vectors.orderBy("id"))
    # a file's name has the number of its part, and parts are in the order of the sort
    files = sorted((f, n) for f, n in rows.groupBy(F.input_file_name()).count().collect())
    count, workers = sum(n for _, n in files), spark.sparkContext.defaultParallelism
    size = max(1, min(STRIP_ROWS, max(SEARCHING, math.ceil(count / (8 * workers)))))
    strips = [(f, a, min(size, n - a)) for f, n in files for a in range(0, n, size)]
    if not strips:
        return spark.createDataFrame([], "u string, v string, w double")
    often = rows.select(F.explode("idx").alias("idx")).groupBy("idx").count().where(F.col("count") >= HEAVY * count)
    heavy = [r.idx for r in often.orderBy(F.desc("count"), "idx").limit(HEAVY_TERMS).collect()]
    paths, block, together = [f for f, _ in files], BLOCK_ROWS, SEARCHING

    def search(batches):
        column = np.full(features, -1)
        column[heavy] = np.arange(len(heavy))
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield _search_strip(strips[i], paths, k, column, block, together)

    return spark.range(0, len(strips), 1, len(strips)).mapInArrow(search, "u string, v string, w double")


class _Block:
    """Sparse rows, those of their terms that have a ``column`` in full, the others as inverted lists; ``first`` is the place of the first row in the order of all."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, first: int, column: np.ndarray):
        idx, val = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (batch.column("idx"), batch.column("val")))
        self.first, self.rows = first, len(idx)
        self.length = idx.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.idx, self.val = idx.flatten().to_numpy(), val.flatten().to_numpy()
        self.norm = np.sqrt(np.bincount(np.repeat(np.arange(self.rows), self.length), self.val * self.val, self.rows))
        self.positive = not (self.val < 0).any()
        row, at = np.repeat(np.arange(self.rows), self.length), column[self.idx]
        self.full = np.zeros((self.rows, int(column.max()) + 1), np.float32)
        self.full[row[at >= 0], at[at >= 0]] = self.val[at >= 0]
        light = np.flatnonzero(at < 0)
        light = light[np.argsort(self.idx[light], kind="stable")]
        self.list_row, self.list_val = row[light], self.val[light].astype(np.float32)
        self.list_end = np.cumsum(np.bincount(self.idx[light], minlength=len(column)))
        self.key, self.key_val = row * len(column) + self.idx, self.val
        if (np.diff(self.key) < 0).any():
            order = np.argsort(self.key, kind="stable")
            self.key, self.key_val = self.key[order], self.val[order]

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows, and which of ``rows`` each belongs to."""
        n = self.length[rows]
        ends = np.cumsum(n)
        return np.arange(ends[-1] if len(n) else 0) + np.repeat(self.start[rows] - (ends - n), n), np.repeat(np.arange(len(rows)), n)


def _blocks(paths: list[str], rows: int, names: list[str]):
    """Batches of at most ``rows`` rows of Parquet files."""
    for path in paths:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=names)


def _rows_of(path: str, start: int, n: int, block: int) -> pa.Table:
    """``n`` rows of a Parquet file from ``start`` on."""
    kept, at = [], 0
    for batch in _blocks([path], block, ["id", "idx", "val"]):
        if at >= start + n:
            break
        if at + len(batch) > start:
            kept.append(batch.slice(max(0, start - at), min(len(batch), start + n - at) - max(0, start - at)))
        at += len(batch)
    return pa.Table.from_batches(kept)


def _search_strip(strip: tuple[str, int, int], paths: list[str], k: int, column: np.ndarray, block: int, together: int) -> pa.RecordBatch:
    """(u, v, w) of a strip's rows."""
    table = _rows_of(*strip, block)
    first = 0
    for path in paths[: paths.index(strip[0])]:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            first += pq.ParquetFile(f).metadata.num_rows
    q = _Block(table, first + strip[1], column)
    best = _Best(q.rows, k)
    parts = [_Part(q, a, min(q.rows, a + together), column) for a in range(0, q.rows, together)]
    place = 0
    for batch in _blocks(paths, block, ["idx", "val"]):
        x = _Block(batch, place, column)
        for part in parts:
            part.meet(x, best)
        place += x.rows
    row, at = np.nonzero(best.place >= 0)
    wanted, back = np.unique(best.place[row, at], return_inverse=True)
    named, place = [], 0
    for batch in _blocks(paths, block, ["id"]):
        some = wanted[np.searchsorted(wanted, place) : np.searchsorted(wanted, place + len(batch))]
        named.append(batch.column(0).take(pa.array(some - place)))
        place += len(batch)
    ids = pa.chunked_array(named, pa.string()).combine_chunks()
    own = table.column("id").combine_chunks()
    return pa.RecordBatch.from_arrays([own.take(pa.array(row)), ids.take(pa.array(back)), pa.array(best.w[row, at])], names=["u", "v", "w"])


class _Best:
    """The k best of each row so far, by rounded weight and place; ``floor`` is the k-th one's rounded weight, 0 before there are k."""

    def __init__(self, rows: int, k: int):
        self.k, self.floor = k, np.zeros(rows)
        self.w, self.place = np.zeros((rows, k)), np.full((rows, k), -1)

    def add(self, row: np.ndarray, place: np.ndarray, w: np.ndarray) -> None:
        """Pairs of places beyond all there are, so an equal weight comes after those."""
        keep = np.round(w, 9) > self.floor[row]
        row, place, w = row[keep], place[keep], w[keep]
        if not len(row):
            return
        changed = np.unique(row)
        r, c = np.nonzero(self.place[changed] >= 0)
        row, place, w = np.concatenate([changed[r], row]), np.concatenate([self.place[changed][r, c], place]), np.concatenate([self.w[changed][r, c], w])
        order = np.lexsort((place, -np.round(w, 9), row))
        row, place, w = row[order], place[order], w[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        row, place, w, rank = row[keep], place[keep], w[keep], rank[keep]
        self.place[row, rank], self.w[row, rank] = place, w
        full = row[rank == self.k - 1]
        self.floor[full] = np.round(self.w[full, -1], 9)


class _Part:
    """Some rows of a strip."""

    def __init__(self, q: _Block, start: int, end: int, column: np.ndarray):
        self.q, self.features = q, len(column)
        self.rows, self.full, self.norm = np.arange(start, end), q.full[start:end], q.norm[start:end]
        at, who = q.entries(self.rows)
        light = column[q.idx[at]] < 0
        self.lists = (who[light], q.idx[at][light], q.val[at][light].astype(np.float32))

    def about(self, x: _Block) -> np.ndarray:
        """Inner products with a block's rows in single precision."""
        out = self.full @ x.full.T if self.full.shape[1] else np.zeros((len(self.rows), x.rows), np.float32)
        who, term, val = self.lists
        start = np.where(term > 0, x.list_end[term - 1], 0)
        met = x.list_end[term] - start
        some = np.flatnonzero(met)
        who, val, start, met = who[some], val[some], start[some], met[some]
        ends = np.cumsum(met)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, 1_000_000)))
        for a, b in zip(cuts, [*cuts[1:], len(met)]):
            n = met[a:b]
            at = np.arange(n.sum()) + np.repeat(start[a:b] - (np.cumsum(n) - n), n)
            np.add.at(out.reshape(-1), x.list_row[at] + np.repeat(who[a:b] * x.rows, n), x.list_val[at] * np.repeat(val[a:b], n))
        return out

    def weights(self, x: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Inner products of pairs of a row of the strip and one of a block, which is searched for the former's terms."""
        out = [np.zeros(0)]
        ends = np.cumsum(self.q.length[i])
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, 500_000)))
        for a, b in zip(cuts, [*cuts[1:], len(i)]):
            at, pair = self.q.entries(i[a:b])
            key = j[a:b][pair] * self.features + self.q.idx[at]
            found = np.minimum(np.searchsorted(x.key, key), len(x.key) - 1)
            out.append(np.bincount(pair, np.where(x.key[found] == key, self.q.val[at] * x.key_val[found], 0), b - a))
        return np.concatenate(out)

    def meet(self, x: _Block, best: _Best) -> None:
        about = self.about(x)
        floor = best.floor[self.rows]
        error = SINGLE * self.norm * x.norm.max() + 1e-8
        fresh = np.flatnonzero(floor == 0)
        if len(fresh) and x.rows > best.k:
            # the block itself has k others, with the row itself k + 1, at least about this good
            seen = np.partition(about[fresh], x.rows - best.k - 1, axis=1)[:, x.rows - best.k - 1]
            floor[fresh] = np.maximum(0, seen - error[fresh])
        least = floor - error
        if self.q.positive and x.positive:
            least = np.maximum(least, 1e-12)  # no term in common, no weight
        i, j = np.nonzero(about >= least.astype(np.float32)[:, None])
        i = self.rows[i]
        other = self.q.first + i != x.first + j
        i, j = i[other], j[other]
        best.add(i, x.first + j, self.weights(x, i, j))


def content_edges(vectors: DataFrame, k: int, features: int) -> DataFrame:
    """Content layer: symmetric union of each account's k most similar ones."""
    return max_merge(sparse_neighbours(vectors, k, features))


def fuse(layers: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of layers (edges, weight) by pair."""
    rows = None
    for edges, weight in layers:
        part = edges.select("src", "dst", (F.col("w") * float(weight)).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w > 0")


def penalize(edges: DataFrame, assignment: DataFrame, penalty: float) -> DataFrame:
    """Edges between two different canopies times max(0, penalty); without effect from 1 up."""
    if penalty >= 1:
        return edges
    a = assignment.select(F.col("user_id").alias("src"), F.col("canopy").alias("ca"))
    b = assignment.select(F.col("user_id").alias("dst"), F.col("canopy").alias("cb"))
    apart = F.col("ca").isNotNull() & F.col("cb").isNotNull() & (F.col("ca") != F.col("cb"))
    return edges.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", F.when(apart, F.col("w") * max(0.0, penalty)).otherwise(F.col("w")).alias("w"))


def prune(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the k heaviest of either end; equal weights, to twelve decimals, rank by the other end's id."""
    top = top_neighbours(symmetric(edges), k, [F.desc(F.round("w", 12)), F.col("v")])
    return max_merge(top)
