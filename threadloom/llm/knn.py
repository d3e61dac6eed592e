"""The k most similar vectors of every vector, by randomly rotated one-bit codes.

Centroids fitted on a bounded sample cut the space into cells; a vector is stored in its nearest cell
and searches every cell whose centroid is not more than a margin farther than its nearest one. The margin is
measured: exact neighbours of sample vectors, found against all rows, tell how wide it must be for the
wanted recall, up to all cells where the data has no structure. In a cell a vector is the signs of
its rotated residual, one packed bit a dimension, and a few scalars. Inner products with a searching
vector's residual in four bits are estimated from the packed bits and the scalars, with the error bound the
rotation gives; for pairs whose upper bound reaches the floor and the k-th best lower bound, residuals in
eight bits narrow the bounds. Only codes and scalars travel; the vectors themselves are fetched once for
each cell with pairs left, to rerank these exactly.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from threadloom.runtime import Stage

log = logging.getLogger(__name__)

#: Rows the centroids are fitted on, at most.
FIT_ROWS = 65_536
CELL_ROWS = 1_000
MAX_CELLS = 4_096
#: Share of exact neighbours whose cell must be searched, and the sample vectors it is measured with.
TARGET, SAMPLE = 0.995, 512
#: Stored and searching rows that a task compares at once.
STORED, SEARCHING = 4_096, 16_384
#: Error bounds hold with about this many standard deviations.
EPSILON = 1.9
QUERY_BITS = 4


def _sortable(x: np.ndarray) -> np.ndarray:
    """Floats as unsigned numbers, most significant byte first, that sort as they do."""
    bits = np.dtype(f"u{x.itemsize}")
    u, top = (x + 0.0).view(bits), bits.type(1 << (8 * x.itemsize - 1))
    return (u ^ np.where(u & top, ~bits.type(0), top)).astype(bits.newbyteorder(">"))


def _floats(column, dim: int) -> np.ndarray:
    """Rows of a binary column from ``usable``, as float64 of unit length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(flat.to_pylist())
    size = len(raw) // dim // max(1, len(flat))
    if not raw:
        return np.zeros((0, dim))
    bits = np.dtype(f"u{size}")
    u, top = np.frombuffer(raw, bits.newbyteorder(">")).astype(bits), bits.type(1 << (8 * size - 1))
    x = (u ^ np.where(u & top, top, ~bits.type(0))).view(f"f{size}").reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v) of one row per non-null key whose vector has ``dim`` finite values, not all zero; v has the values' bytes in sortable form.

    Of differing vectors under one key the smallest in array order counts.
    """
    kind = rows.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float32 if single else np.float64).reshape(-1, dim)  # null elements come as NaN
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            packed = pa.array([r.tobytes() for r in _sortable(x[good])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), packed], names=["id", "v"])

    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    full = rows.where(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("string").alias("id"), v.alias("v"))
    return full.mapInArrow(pack, "id string, v binary").groupBy("id").agg(F.min("v").alias("v"))


def centroids(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means, seeded by spread-out sample rows."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(sample)))]
    near = 1 - sample @ sample[at[0]]
    while len(at) < k:
        p = np.maximum(near, 0) ** 2
        at.append(int(rng.choice(len(sample), p=p / p.sum())) if p.sum() > 0 else int(rng.integers(len(sample))))
        near = np.minimum(near, 1 - sample @ sample[at[-1]])
    c = sample[at].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[i : i + 8192] @ c.T, axis=1) for i in range(0, len(sample), 8192)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
    return c


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _bits(on: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    packed = np.packbits(on, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def _fine(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals in eight bits a dimension, the step, and the length of what the rounding lost."""
    step = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-30)
    code = np.rint(rest / step[:, None]).astype(np.int8)
    return code, step, np.linalg.norm(rest - code * step[:, None], axis=1)


def _shift(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", x, center) - np.einsum("nd,nd->n", center, center) / 2


def coded(x: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes of ``x`` (rows of unit length, each with its row of ``center``), their fine codes, and scalars: set bits, two of the error bound, shift; length, step and loss."""
    rest = (x - center) @ turn.T
    length = np.linalg.norm(rest, axis=1)
    unit = rest / np.maximum(length, 1e-12)[:, None]
    words = _bits(unit > 0)
    dim = x.shape[1]
    along = np.maximum(np.abs(unit).sum(axis=1) / math.sqrt(dim), 1e-6)  # <code, vector>
    spread = EPSILON * np.sqrt(np.maximum(1 - along**2, 0)) / along / math.sqrt(max(dim - 1, 1))
    fine, step, loss = _fine(rest)
    return words, fine, np.stack((np.bitwise_count(words).sum(axis=1), length / along, length * spread, _shift(x, center), length, step, loss), axis=1).astype(np.float32)


def asked(q: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fine codes of the residuals of ``q``, and scalars: length, step, loss, shift."""
    rest = (q - center) @ turn.T
    fine, step, loss = _fine(rest)
    return fine, np.stack((np.linalg.norm(rest, axis=1), step, loss, _shift(q, center)), axis=1).astype(np.float32)


def planes_of(fine: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of searching residuals in few bits, and scalars: length, lowest value, step, sum of levels, shift, loss."""
    length, step, loss, shift = ask.T
    unit = fine * (step / np.maximum(length, 1e-12))[:, None]
    low = unit.min(axis=1)
    step = np.maximum((unit.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-12)
    level = np.clip(np.rint((unit - low[:, None]) / step[:, None]), 0, 2**QUERY_BITS - 1).astype(np.uint8)
    return np.concatenate([_bits((level >> b) & 1) for b in range(QUERY_BITS)], axis=1), np.stack((length, low, step, level.sum(axis=1), shift, loss), axis=1).astype(np.float32)


def estimates(planes: np.ndarray, ask: np.ndarray, words: np.ndarray, held: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of all inner products from bits and scalars, and the bounds' distance from the estimates."""
    width = words.shape[1]
    total = np.zeros((len(planes), len(words)), np.uint16)
    both, count = np.empty(total.shape, np.uint64), np.empty(total.shape, np.uint8)
    for b in range(QUERY_BITS):
        for w in range(width):
            np.bitwise_and(planes[:, b * width + w, None], words[None, :, w], out=both)
            np.bitwise_count(both, out=count)
            total += count.astype(np.uint16) << np.uint16(b) if b else count
    ones, scale, reach, e, far = held.T[:5]
    length, low, step, levels, d, loss = ask.T
    root = np.float32(math.sqrt(dim))
    length = length / root
    one_q, one_x = np.ones_like(low), np.ones_like(ones)
    # everything but the counted bits is a sum of products of a searching and a stored scalar
    flat = np.stack((2 * low * length, -(low * dim + step * levels) * length, d, one_q), axis=1) @ np.stack((ones * scale, scale, one_x, e))
    bound = np.stack((length * root, length * step, loss), axis=1) @ np.stack((reach, scale, far))
    upper = total * (2 * step * length)[:, None]
    upper *= scale[None, :]
    upper += flat
    upper += bound
    return upper, bound


def candidates(q_id, fine_q, ask, x_id, words, fine_x, held, dim: int, k: int, floor: float):
    """(row of q, row of x, lower, upper bound) of the pairs that may be among the k best of this block.

    One-bit estimates choose pairs, whose bounds the fine codes then narrow.
    """
    scale_x, (e, far, step_x, loss_x) = fine_x * held[:, 5:6], held.T[3:]
    for a in range(0, len(fine_q), 256):
        part, own = slice(a, a + 256), ask[a : a + 256]
        upper, bound = estimates(*planes_of(fine_q[part], own), words, held, dim)
        # rows of equal number are the same vector
        i, j = np.nonzero((upper >= floor) & (q_id[part, None] != x_id[None, :]))
        many = np.flatnonzero(np.bincount(i, minlength=len(upper)) > 2 * k)
        if len(many):
            lower = upper[many] - 2 * bound[many]
            lower[q_id[a + many][:, None] == x_id[None, :]] = -2
            need = np.full(len(upper), floor, np.float32)
            need[many] = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
            keep = upper[i, j] >= need[i]
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        length, step_q, loss_q, d = own.T
        scale_q = fine_q[part] * step_q[:, None]
        dot = np.concatenate([np.einsum("nd,nd->n", scale_q[i[b : b + 65_536]], scale_x[j[b : b + 65_536]]) for b in range(0, len(i), 65_536)])
        middle = dot + d[i] + e[j]
        slack = length[i] * loss_x[j] + loss_q[i] * (far[j] + loss_x[j]) + 1e-5
        low, up = middle - slack, middle + slack
        order = np.lexsort((-low, i))
        first = np.concatenate(([True], i[order][1:] != i[order][:-1]))
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
        need = np.full(len(upper), floor, np.float32)
        kth = order[place == k - 1]
        need[i[kth]] = np.maximum(floor, low[kth])
        keep = up >= need[i]
        yield i[keep] + a, j[keep], low[keep], up[keep]


def _margin(rows: DataFrame, middle, dim: int, k: int, floor: float) -> float:
    """How much farther than the nearest centroid a neighbour's may be, for ``TARGET`` of the exact neighbours.

    Neighbours of ``SAMPLE`` rows are found among all rows, a running k best for each task. Half of the sample
    sets the margin, the other half says in the log what it does.
    """
    sample = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(SAMPLE).select("rid", "v").toArrow()
    if not len(sample):
        return 0.0
    q, q_id = _floats(sample.column("v"), dim), sample.column("rid").to_numpy()
    ahead = (near := q @ middle.value.T).max(axis=1)[:, None] - near

    def exact(batches):
        best = np.full((len(q), k), -2.0), np.zeros((len(q), k))
        for batch in batches:
            x, x_id = _floats(batch.column(1), dim), batch.column(0).to_numpy()
            sims = q @ x.T
            sims[q_id[:, None] == x_id[None, :]] = -2
            gap = ahead[:, np.argmax(x @ middle.value.T, axis=1)]
            sims, gap = np.concatenate((best[0], sims), axis=1), np.concatenate((best[1], gap), axis=1)
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(sims, top, 1), np.take_along_axis(gap, top, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), k)), pa.array(best[0].ravel()), pa.array(best[1].ravel())], names=["q", "sim", "gap"])

    found = rows.select("rid", "v").mapInArrow(exact, "q bigint, sim double, gap double").where(F.col("sim") >= max(floor, -1.5))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim")))
    gaps = found.withColumn("r", rank).where(F.col("r") <= k).select("q", "gap").toPandas()  # at most SAMPLE * k rows
    tune, held = (gaps["gap"][gaps["q"] % 2 == i].to_numpy() for i in (0, 1))
    if not len(tune):
        tune = held
    if not len(tune):
        return 0.0
    margin = float(np.quantile(tune, TARGET, method="higher"))
    log.info("cells within %.4f of the nearest hold %.4f of the exact neighbours of %d other vectors", margin, (held <= margin + 1e-9).mean() if len(held) else 1.0, SAMPLE // 2)
    return margin


def nearest(vectors: DataFrame, dim: int, k: int = 5, floor: float = -1.0, margin: float | None = None) -> DataFrame:
    """(id, neighbour, similarity) of up to k most similar other vectors with a cosine of ``floor`` or more.

    ``vectors(id, v)`` has one row per id (see ``usable``). Equal similarities rank by id. A single
    vector, or none, has no neighbours. Every vector is indexed and every vector searches; copies of a
    vector are searched once. With a ``margin`` of 2 all cells are searched.
    """
    stage = Stage(vectors.sparkSession, "knn")
    spark = vectors.sparkSession
    rows = stage.put(vectors.withColumn("h", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")).withColumn("rid", F.monotonically_increasing_id()))
    copies = stage.put(rows.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    several = copies.limit(1).count()
    one = stage.put(rows.join(copies.select("h", "h2", "rep"), ["h", "h2"], "left").where("rep is null or rep = id").drop("rep", "h", "h2")) if several else rows.drop("h", "h2")
    n = one.count()
    cells = max(1, min(MAX_CELLS, n // CELL_ROWS))
    sample = _floats(one.orderBy(F.xxhash64("id"), "id").limit(min(FIT_ROWS, 256 * cells)).select("v").toArrow().column("v"), dim)
    if not len(sample):
        return rows.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("similarity")).limit(0)
    middle = spark.sparkContext.broadcast(centroids(sample.astype(np.float32), cells).astype(np.float64))  # at most MAX_CELLS rows
    if margin is None:
        margin = _margin(one, middle, dim, k, floor) if cells > 1 else 2.0
    turn = rotation(dim)

    def settle(batches):
        for batch in batches:
            home = np.argmax(_floats(batch.column(2), dim) @ middle.value.T, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *batch.columns], names=["cell", "rid", "id", "v"])

    homes = stage.put(one.select("rid", "id", "v").mapInArrow(settle, "cell int, rid bigint, id string, v binary"))
    for old in (one, None if several else rows):
        stage.drop(old)

    def spread(batches):
        for batch in batches:
            rid, x = batch.column(1).to_numpy(), _floats(batch.column(2), dim)
            if not len(x):
                continue
            home = batch.column(0).to_numpy()
            near = x @ middle.value.T
            words, fine, scalars = coded(x, middle.value[home], turn)
            parts = [(home, rid, True, words, fine, scalars)]
            for a in range(0, len(x), 1024):
                i, c = np.nonzero(near[a : a + 1024] >= near[a : a + 1024].max(axis=1, keepdims=True) - margin - 1e-9)
                for b in range(0, len(i), 16_384):
                    r, at = i[b : b + 16_384] + a, c[b : b + 16_384]
                    parts.append((at, rid[r], False, *asked(x[r], middle.value[at], turn)))
            for cell, who, stored, *code in parts:
                code = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(who), -1) for c in code], axis=1)
                packed = pa.array([r.tobytes() for r in code], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.full(len(who), stored)), pa.array(who), packed], names=["cell", "stored", "rid", "code"])

    placed = stage.put(homes.select("cell", "rid", "v").mapInArrow(spread, "cell int, stored boolean, rid bigint, code binary"))
    sizes = placed.groupBy("cell").agg(F.count_if(~F.col("stored")).alias("q"), F.count_if("stored").alias("x"))  # at most MAX_CELLS rows
    sizes = F.broadcast(sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("q") / SEARCHING)).cast("int").alias("qs"), F.greatest(F.lit(1), F.ceil(F.col("x") / STORED)).cast("int").alias("xs")))

    def salted(df: DataFrame, name: str, of: str) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64("rid", F.lit(of)), of).cast("int"))

    def each(df: DataFrame, name: str, of: str) -> DataFrame:
        return df.withColumn(name, F.explode(F.expr(f"sequence(0, {of} - 1)")))

    at = placed.join(sizes, "cell")
    blocks = each(salted(at.where("stored"), "xb", "xs"), "qb", "qs").unionByName(each(salted(at.where("not stored"), "qb", "qs"), "xb", "xs")).drop("qs", "xs")
    width = -(-dim // 64)

    def search(key: tuple, table: pa.Table) -> pa.Table:
        stored, rid = table.column("stored").to_numpy(), table.column("rid").to_numpy()
        code = table.column("code").combine_chunks()
        sides = []
        for mine, kinds in ((~stored, ((dim, np.int8), (16, np.float32))), (stored, ((8 * width, np.uint64), (dim, np.int8), (28, np.float32)))):
            raw = np.frombuffer(b"".join(code.filter(pa.array(mine)).to_pylist()), np.uint8).reshape(-1, sum(n for n, _ in kinds))
            ends = np.cumsum([n for n, _ in kinds])
            sides += [rid[mine], *[np.ascontiguousarray(raw[:, end - n : end]).view(kind) for end, (n, kind) in zip(ends, kinds)]]
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),) * 2]
        if len(sides[0]) and len(sides[3]):
            out += [(sides[0][i], sides[3][j], lo, up) for i, j, lo, up in candidates(*sides, dim, k, floor)]
        q, x, lo, up = (np.concatenate(z) for z in zip(*out))
        cell, xb, qb = (pa.array(np.full(len(q), v.as_py(), np.int32)) for v in key)
        return pa.Table.from_arrays([cell, xb, qb, pa.array(q), pa.array(x), pa.array(lo), pa.array(up)], names=["cell", "xb", "qb", "q", "x", "lo", "up"])

    maybe = blocks.groupBy("cell", "xb", "qb").applyInArrow(search, "cell int, xb int, qb int, q bigint, x bigint, lo float, up float")
    # the k-th best lower bound over all blocks
    sure = F.nth_value("lo", k).over(Window.partitionBy("q").orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    open_ = maybe.withColumn("sure", sure).where("sure is null or up >= sure").groupBy("q", "cell", "xb", "qb").agg(F.collect_list("x").alias("xs"))  # at most STORED each
    asking = open_.join(homes.select(F.col("rid").alias("q"), F.col("id").alias("q_id"), F.col("v").alias("q_v")), "q").select("cell", "xb", "qb", "q_id", "q_v", "xs")
    kept = each(salted(homes.join(sizes, "cell"), "xb", "xs"), "qb", "qs").select("cell", "xb", "qb", "rid", "id", "v")

    def rerank(asks: pa.Table, held: pa.Table) -> pa.Table:
        q, x = _floats(asks.column("q_v"), dim), _floats(held.column("v"), dim)
        rid = held.column("rid").to_numpy()
        order = np.argsort(rid)
        lists = asks.column("xs").combine_chunks()
        count = np.diff(np.asarray(lists.offsets))
        i, j = np.repeat(np.arange(len(q)), count), order[np.searchsorted(rid, lists.flatten().to_numpy(), sorter=order)] if len(rid) else np.zeros(0, int)
        sim = np.concatenate([np.einsum("nd,nd->n", q[i[a : a + 65_536]], x[j[a : a + 65_536]]) for a in range(0, max(1, len(j)), 65_536)])
        names = held.column("id").to_numpy(zero_copy_only=False)
        by_name = np.empty(len(names), np.int64)
        by_name[np.argsort(names)] = np.arange(len(names))
        best = np.lexsort((by_name[j], -sim, i))
        best = best[sim[best] >= floor]
        i, j, sim = i[best], j[best], sim[best]
        first = np.concatenate(([True], i[1:] != i[:-1])) if len(i) else np.zeros(0, bool)
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0)) if len(i) else i
        i, j, sim = i[place < k], j[place < k], sim[place < k]
        return pa.Table.from_arrays([asks.column("q_id").take(pa.array(i)), pa.array(names[j], pa.string()), pa.array(sim)], names=["id", "neighbour", "similarity"])

    by = ["cell", "xb", "qb"]
    found = asking.groupBy(*by).cogroup(kept.groupBy(*by)).applyInArrow(rerank, "id string, neighbour string, similarity double")
    if several:
        found = _with_copies(stage.put(_top(found, k)), rows, copies, k, stage)
    return _top(found, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _with_copies(found: DataFrame, rows: DataFrame, copies: DataFrame, k: int, stage: Stage) -> DataFrame:
    """Candidates of every id from those of its vector's representative: the first k + 1 copies stand for a neighbour, and for the vector itself."""
    members = stage.put(rows.select("id", "h", "h2").join(copies, ["h", "h2"]).select("rep", "id"))
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("rep").alias("of"), F.col("id").alias("copy"))
    wide = found.join(few, F.col("neighbour") == F.col("of"), "left").select("id", F.coalesce("copy", "neighbour").alias("neighbour"), "similarity")
    wide = wide.unionByName(few.select(F.col("of").alias("id"), F.col("copy").alias("neighbour"), F.lit(1.0).alias("similarity")))
    list_ = stage.put(_top(wide, k + 1))  # k + 1 rows for each vector, from which a member leaves itself out
    own = list_.join(members.select(F.col("rep").alias("id"), F.col("id").alias("member")), "id", "left")
    return own.select(F.coalesce("member", "id").alias("id"), "neighbour", "similarity").where("id <> neighbour")
