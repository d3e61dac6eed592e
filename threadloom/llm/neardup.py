"""Groups of records whose word sets are similar despite edits, insertions or reordering.

Each word set is a fingerprint: a bitmap with a bit for each word's hash. A word that only one of two
sets has changes at most one bit, so sets of n and m words with a Jaccard similarity of t or more
differ in at most (1 - t) / (1 + t) * (n + m) bits, of which the n-word set lacks at most (1 - t) m and
the other at most (1 - t) n: a search by Hamming distance loses nothing.

At such distances one index over all fingerprints would visit nearly every leaf, so its top level is
keyed by masked patterns that similar sets must share: with words ordered from rare to frequent, two
similar sets share one of their first n - ceil(t n) + 1 words; below a frequent word the next shared
word too, as long as the similarity forces the sets to share that many. The pattern stands for the
first words that two sets share, so the words a set has before it are differences already, and only
those after it travel. Under each pattern lies a Gray-order hierarchical index: the fingerprints
sorted by Gray rank, consecutive ones in leaves, the bits all members agree on factored into the
parent, the rest left to the children. A search goes down from the root, adds up the differences
from each node's own bits, and leaves a whole group as soon as they exceed what any member could make up
for. Fingerprints are as wide as the size of the index demands for upper nodes to leave groups out.
What is left is compared word by word, and only a spanning forest of the matches leaves a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.components import min_labels
from threadloom.runtime import Stage

WORD = "[a-z0-9_]+"
#: Word counts are kept by hash in so many cells: a fixed size to broadcast, and exact enough to order by.
COUNT_CELLS = 1 << 18
#: A word in more sets than this is extended by the next shared word; above 64 times that, by two.
FREQUENT = 4096
MOST_WORDS = 3
#: Rows of one block that a task compares at once; larger blocks are compared in pairs of chunks.
BLOCK = 4096
FAN = 8
#: Shortest and longest fingerprint in 64-bit words.
NARROW64, WIDE64 = 4, 64
#: Rows that search together, and 64-bit words that meet at once.
SEARCHING, AT_ONCE = 2_048, 1 << 21
#: Sets of more words travel as a wide fingerprint, not as their words, and are compared in full at the end.
LONG = 512


def fingerprints(hashes: np.ndarray, ends: np.ndarray, words: int = NARROW64) -> np.ndarray:
    """(rows, words) bitmaps; row i has the hashes from ends[i] to ends[i + 1]. ``words`` is a power of two."""
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    bit = hashes.view(np.uint64) & np.uint64(64 * words - 1)
    on = np.zeros((len(ends) - 1, 64 * words), bool)
    on[rows, bit.astype(np.int64)] = True
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64)


def gray_ranks(prints: np.ndarray) -> list[np.ndarray]:
    """Each fingerprint's rank in the reflected Gray sequence, as words from the highest down."""
    rank, carry = [], np.zeros(len(prints), np.uint64)
    for w in range(prints.shape[1]):
        x = prints[:, w].copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        x ^= carry  # parity of the higher words flips all lower ranks
        carry = np.where(x & np.uint64(1), ~np.uint64(0), np.uint64(0))
        rank.append(x)
    return rank


def gray_order(prints: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """Row order by ``before``, then by Gray rank."""
    return np.lexsort([*gray_ranks(prints)[::-1], *before[::-1]])


class GrayIndex:
    """Hierarchical indexes of one or more blocks side by side.

    Rows must be in the order of block, role and Gray rank. ``sizes`` are the sets' numbers of words,
    ``lost`` those that no other set of the block can share and that the fingerprint leaves out. A
    ``role`` says who meets whom: bit 0 marks rows that need not meet each other, and rows of sides 0
    and 1 (bits 1 and up) meet only those of the other side; side 2 meets itself.
    """

    def __init__(self, prints: np.ndarray, sizes: np.ndarray, block: np.ndarray | None = None, lost: np.ndarray | None = None, role: np.ndarray | None = None):
        n = len(sizes)
        self.prints, self.sizes = prints, sizes.astype(np.float64)
        self.lost = np.zeros(n) if lost is None else lost.astype(np.float64)
        self.role = np.full(n, 4, np.int8) if role is None else role
        block = np.zeros(n, np.int64) if block is None else block
        # from the rows up: own bits' mask, values, smallest and largest size, fewest lost, roles, last row, first child
        mask, value = np.full_like(prints, ~np.uint64(0)), prints
        level = {"value": value, "low": self.sizes, "high": self.sizes, "lost": self.lost, "r0": self.role, "r1": self.role, "last": np.arange(n), "block": block}
        self.levels = [level]
        while True:
            own = level["block"]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            if len(first) == len(own):
                level["mask"] = np.zeros_like(mask)  # a root's bits are those of all its rows: no difference
                break
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            at = np.flatnonzero(place % FAN == 0)
            # bits that differ inside a group are those where AND and OR disagree, or a child already varies
            ones, any_ = np.bitwise_and.reduceat(value, at), np.bitwise_or.reduceat(value, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(ones ^ any_)
            up = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(own))))
            level["mask"] = mask & ~shared[up]
            mask, value = shared, ones & shared
            level = {
                "value": value, "low": np.minimum.reduceat(level["low"], at), "high": np.maximum.reduceat(level["high"], at), "lost": np.minimum.reduceat(level["lost"], at),
                "r0": np.minimum.reduceat(level["r0"], at), "r1": np.maximum.reduceat(level["r1"], at), "last": np.maximum.reduceat(level["last"], at), "block": own[at], "child": np.append(at, len(own)),
            }
            self.levels.append(level)
        self.root = np.searchsorted(level["block"], block)
        #: (row, node) pairs met and kept, by level from the rows up
        self.met, self.kept = np.zeros(len(self.levels), np.int64), np.zeros(len(self.levels), np.int64)

    def _meet(self, k: int, similarity: float, q, node, lacks, extra):
        """Of (row, node) pairs of level k, with the differences added up so far, those that may hold matches."""
        at = self.levels[k]
        self.met[k] += len(q)
        s, n = self.sizes, self.sizes[q]
        ok = (at["last"][node] > q) & (at["low"][node] <= n / similarity + 1e-9) & (at["high"][node] >= n * similarity - 1e-9)
        one = at["r0"][node] == at["r1"][node]
        a, b = self.role[q], at["r0"][node]
        ok &= ~(one & (((a & b & 1) == 1) | ((a >> 1 == b >> 1) & (a < 4))))
        q, node, lacks, extra = q[ok], node[ok], lacks[ok], extra[ok]
        mine = self.prints[q]
        apart = (mine ^ at["value"][node]) & at["mask"][node]
        lacking = np.bitwise_count(apart & mine).sum(axis=1, dtype=np.int64)  # words of the row that no member has
        lacks, extra = lacks + lacking, extra + np.bitwise_count(apart).sum(axis=1, dtype=np.int64) - lacking
        n, high = s[q], at["high"][node]
        a, b = lacks + self.lost[q], extra + at["lost"][node]
        ok = (a <= (1 - similarity) * n + 1e-9) & (b <= (1 - similarity) * high + 1e-9) & (a + b <= (1 - similarity) / (1 + similarity) * (n + high) + 1e-9)
        self.kept[k] += int(ok.sum())
        return q[ok], node[ok], lacks[ok], extra[ok]

    def search(self, similarity: float, linked=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of rows whose fingerprints and sizes allow the similarity, a limited number at a time.

        ``linked()`` gives a label of each row, equal for rows that are known to belong together; groups
        and rows with the searching row's label are left out.
        """
        most = max(64, AT_ONCE // self.prints.shape[1])
        top = len(self.levels) - 1
        for a in range(0, len(self.sizes), SEARCHING):
            label = linked() if linked else None
            q = np.arange(a, min(a + SEARCHING, len(self.sizes)))
            todo = [(top, q, self.root[q], np.zeros(len(q), np.int64), np.zeros(len(q), np.int64))]
            same = [label] if linked else None
            if linked:
                for up in self.levels[1:]:
                    lo, hi = np.minimum.reduceat(same[-1], up["child"][:-1]), np.maximum.reduceat(same[-1], up["child"][:-1])
                    same.append(np.where(lo == hi, lo, -1))
            while todo:
                k, q, node, lacks, extra = todo.pop()
                if not len(q):
                    continue
                if k == 0:
                    yield q, node
                    continue
                start = self.levels[k]["child"]
                count = start[node + 1] - start[node]
                total = np.cumsum(count)
                if total[-1] > most and len(q) > 1:  # in two halves
                    cut = min(max(1, int(np.searchsorted(total, total[-1] // 2))), len(q) - 1)
                    todo += [(k, q[cut:], node[cut:], lacks[cut:], extra[cut:]), (k, q[:cut], node[:cut], lacks[:cut], extra[:cut])]
                    continue
                from_ = np.repeat(np.arange(len(q)), count)
                child = start[node][from_] + np.arange(total[-1]) - (total - count)[from_]
                if linked:
                    open_ = same[k - 1][child] != label[q[from_]]
                    from_, child = from_[open_], child[open_]
                todo.append((k - 1, *self._meet(k - 1, similarity, q[from_], child, lacks[from_], extra[from_])))


def width64(rows: int, words: float) -> int:
    """Fingerprint length at which the groups of the second level below the root of so many rows still have mostly empty bits."""
    if rows <= FAN:
        return NARROW64
    members = FAN
    while members * FAN * FAN < rows:
        members *= FAN
    want = members * words * 3 / 64
    return int(min(WIDE64, max(NARROW64, 2 ** np.ceil(np.log2(max(1.0, want))))))


def common(codes: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes the rows of each pair share; a row's codes, from ends[i] to ends[i + 1], are distinct."""
    rows = np.concatenate((a, b))
    length = ends[rows + 1] - ends[rows]
    pair = np.repeat(np.concatenate((np.arange(len(a)),) * 2), length)
    at = np.repeat(ends[rows] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    key = np.sort(pair * (int(codes.max(initial=0)) + 1) + codes[at])
    return np.bincount(key[1:][key[1:] == key[:-1]] // (int(codes.max(initial=0)) + 1), minlength=len(a))


def matched(hashes: np.ndarray, ends: np.ndarray, sizes: np.ndarray, similarity: float, block: np.ndarray | None = None, lost: np.ndarray | None = None, role: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Matching pairs of rows, as many as a spanning forest of all matches within blocks has.

    ``hashes`` are each row's words after its block's pattern, distinct by row; the pattern's own are
    what is missing from ``sizes`` after them and the ``lost`` ones. A block's rows are consecutive.
    """
    n = len(sizes)
    block = np.zeros(n, np.int64) if block is None else block
    lost = np.zeros(n, np.int64) if lost is None else lost
    role = np.full(n, 4, np.int8) if role is None else role
    rest = np.diff(ends)
    pattern = sizes - lost - rest
    codes = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    counts = np.diff(np.append(starts, n))
    root = np.arange(n)
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def labels(rows: np.ndarray) -> np.ndarray:
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        return root[rows]

    # blocks of like size have trees of like depth, and fingerprints of like width
    depth = np.ceil(np.log(np.maximum(counts, 2)) / np.log(FAN) - 1e-9).astype(int)
    for d in np.unique(depth[counts > 1]):
        chosen = np.flatnonzero((depth == d) & (counts > 1))
        rows = np.repeat(starts[chosen] - (np.cumsum(counts[chosen]) - counts[chosen]), counts[chosen]) + np.arange(counts[chosen].sum())
        length = rest[rows]
        at = np.repeat(ends[rows] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        prints = fingerprints(hashes[at], np.concatenate(([0], np.cumsum(length))), width64(int(counts[chosen].max()), float(length.mean()) if len(length) else 0.0))
        order = gray_order(prints, block[rows], role[rows])
        rows = rows[order]
        index = GrayIndex(prints[order], sizes[rows], block[rows], lost[rows], role[rows])
        for i, j in index.search(similarity, lambda rows=rows: labels(rows)):
            for a in range(0, len(i), 20_000):
                left, right = rows[i[a : a + 20_000]], rows[j[a : a + 20_000]]
                apart = labels(left) != labels(right)
                left, right = left[apart], right[apart]
                both = common(codes, ends, left, right) + pattern[left]
                hit = both >= similarity * (sizes[left] + sizes[right] - both) - 1e-9
                for x, y in zip(left[hit].tolist(), right[hit].tolist()):
                    rx, ry = find(x), find(y)
                    if rx != ry:
                        root[rx] = ry
                        out.append((x, y))
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _forced(n: np.ndarray, similarity: float) -> np.ndarray:
    """Words that a set of n words shares with any set similar to it, at least."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _patterns(counts, similarity: float, wide: bool = False):
    """For rows (nid, coll, n, hs): a row for each masked pattern the set is filed under.

    A pattern of l words is extended if its first word is frequent and the set shares more than l words
    with any match. A set whose smallest possible partner is not bound to share that many is filed
    under the shorter pattern as well, to meet those that end there (role bit 0). With ``wide`` the row has the
    set's fingerprint in place of its words, and frequent words are not extended, as a long set has too many of them.
    """
    frequent = np.iinfo(np.int64).max // 64**MOST_WORDS if wide else FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            hs = batch.column(3)
            ends = np.asarray(hs.offsets, dtype=np.int64)
            flat = np.asarray(hs.values)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            n = np.diff(ends)
            row = np.repeat(np.arange(len(n)), n)
            if wide:
                body = pa.array([x.tobytes() for x in fingerprints(flat, ends, WIDE64)], pa.binary())
            often = table[flat & (COUNT_CELLS - 1)]
            order = np.lexsort((flat, often, row))
            flat, often = flat[order], often[order]
            at = np.arange(len(flat)) - ends[row]
            forced = _forced(n, similarity)
            partner = _forced(forced, similarity)  # what the smallest possible partner is bound to share
            reach = n - forced + 1  # places from the front that two similar sets share a word in
            key = _mixed(flat.view(np.uint64)) ^ _mixed(np.asarray(batch.column(1)).view(np.uint64) + np.uint64(7))[row]
            i = np.flatnonzero((at < reach[row]) & (often > 1))
            made, deep, files = key[i], often[i], []
            for level in range(1, MOST_WORDS + 1):
                r = row[i]
                more = (deep > frequent * 64 ** (level - 1)) & (forced[r] > level) & (level < MOST_WORDS)
                also = more & (partner[r] <= level)
                here = ~more | also
                files.append((i[here], made[here], np.where(also[here], 5, 4), np.full(int(here.sum()), level)))
                i, made, deep = i[more], made[more], deep[more]
                r = row[i]
                room = np.maximum(np.minimum(reach[r] + level, n[r]) - at[i] - 1, 0)
                j = np.repeat(i, room) + 1 + (np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room))
                made = _mixed(np.repeat(made, room) + np.uint64(level + 1)) ^ key[j]
                i, deep = j, np.repeat(deep, room)
            i, made, role, level = (np.concatenate(x) for x in zip(*files))
            for a in range(0, len(i), 20_000):
                part = i[a : a + 20_000]
                r = row[part]
                take = pa.array(r)
                if wide:
                    lost, rest = np.zeros(len(part)), body.take(take)
                else:  # what stands before the pattern's last word and isn't of it, no other set of the block shares
                    lost = at[part] + 1 - level[a : a + 20_000]
                    length = ends[r + 1] - part - 1
                    values = flat[np.repeat(part + 1 - (np.cumsum(length) - length), length) + np.arange(length.sum())]
                    rest = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[a : a + 20_000].view(np.int64)), batch.column(0).take(take), pa.array(n[r].astype(np.int32)), pa.array(lost.astype(np.int32)), pa.array(role[a : a + 20_000].astype(np.int8)), rest],
                    names=["sig", "nid", "n", "lost", "role", "hs"],
                )

    return run


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by sig, as tables that end where a block ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            sig = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))[-1])
            if held and held[-1].column(0)[-1].as_py() != sig[0]:
                yield pa.Table.from_batches(held)
                held = []
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table) -> tuple:
    """sig, nid, n, lost and role as arrays, hs as one chunk; rows alone in their block are left out."""
    sig = table.column(0).to_numpy()
    new = np.concatenate(([True], sig[1:] != sig[:-1], [True]))
    table = table.filter(pa.array(~(new[:-1] & new[1:])))
    hs = table.column(5).combine_chunks()
    return *(table.column(i).to_numpy() for i in range(5)), hs if not isinstance(hs, pa.ChunkedArray) else hs.chunk(0)


def _blocks(similarity: float):
    """For rows (sig, nid, n, lost, role, hs) sorted by sig: matching (a, b), a spanning forest of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            sig, nid, n, lost, role, hs = _columns(table)
            if len(sig):
                ends = np.asarray(hs.offsets, dtype=np.int64)
                found = matched(np.asarray(hs.values)[ends[0] : ends[-1]], ends - ends[0], n.astype(np.int64), similarity, sig, lost.astype(np.int64), role)
                pairs = np.array(found, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(nid[pairs[:, 0]]), pa.array(nid[pairs[:, 1]])], names=["a", "b"])

    return run


def _wide_blocks(similarity: float):
    """For rows (sig, nid, n, lost, role, hs) sorted by sig, hs a wide fingerprint: pairs a < b of a block that may match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            sig, nid, n, lost, role, hs = _columns(table)
            if len(sig):
                prints = np.frombuffer(b"".join(hs.to_pylist()), np.uint64).reshape(-1, WIDE64)
                order = gray_order(prints, sig, role)
                for i, j in GrayIndex(prints[order], n[order], sig[order], lost[order], role[order]).search(similarity):
                    i, j = nid[order[i]], nid[order[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    return run


def distinct_words(text: Column) -> Column:
    """The distinct runs of ``[a-z0-9_]`` in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def shingles(text: Column, k: int = 5) -> Column:
    """The distinct runs of k words; a shorter text is one shingle."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - k + 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.array_distinct(F.filter(runs, lambda s: s != ""))


def near_duplicate_groups(records: DataFrame, similarity: float = 0.8, min_words: int = 1, words=shingles) -> DataFrame:
    """(collection, record_id, group_id) of each record in a group of two or more.

    ``records(collection, record_id, text)`` has one row per record. ``words`` makes the text's set (text
    column to array of distinct strings): five-word shingles, or ``distinct_words``. Sets of fewer than ``min_words``,
    those of null and empty texts included, match nothing. Two records of a
    collection match if the words of both divided by the words of either reach ``similarity``; a
    group is what matches link directly or through others and is named by its smallest record_id.
    Records with equal word sets are one vertex until the end. A word is its 64-bit hash, a set that of its
    words' hashes (128 bits).
    """
    stage = Stage(records.sparkSession, "neardup")
    spark = records.sparkSession
    hashed = F.array_sort(F.array_distinct(F.transform("w", lambda x: F.xxhash64(x))))
    sets = (
        records.where("record_id is not null")
        .select(F.col("collection").cast("string").alias("collection"), F.col("record_id").cast("string").alias("record_id"), words(F.col("text")).alias("w"))
        .where(F.size("w") >= max(1, min_words))
        .select("collection", "record_id", hashed.alias("hs"))
        .select(F.xxhash64("collection", "hs").alias("s1"), F.xxhash64(F.lit(1), F.reverse("hs"), "collection").alias("s2"), "collection", "record_id", "hs")
    )
    sets = stage.put(sets)
    own = sets.groupBy("s1", "s2", "collection", "hs").agg(F.min("record_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    own = stage.put(own.withColumn("n", F.size("hs")).withColumn("nid", F.monotonically_increasing_id()))
    cells = own.select(F.explode("hs").alias("h")).groupBy(F.col("h").bitwiseAND(COUNT_CELLS - 1).alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    table = np.zeros(COUNT_CELLS, np.int64)
    for r in cells.toLocalIterator():  # at most COUNT_CELLS rows
        table[r.cell] = r.c
    counts = spark.sparkContext.broadcast(table)
    shape = own.select("nid", F.xxhash64("collection").alias("coll"), "n", "hs")
    filed = shape.where(F.col("n") <= LONG).mapInArrow(_patterns(counts, similarity), _FILED.format("array<bigint>"))
    blocks = _bounded(filed, stage)
    found = blocks.repartition("sig").sortWithinPartitions("sig").mapInArrow(_blocks(similarity), "a bigint, b bigint")
    # a long set and any it can match are both in here
    long_ = shape.where(F.col("n") >= similarity * LONG)
    if own.where(F.col("n") > LONG).limit(1).count():
        filed = long_.mapInArrow(_patterns(counts, similarity, True), _FILED.format("binary"))
        maybe = _bounded(filed, stage).repartition("sig").sortWithinPartitions("sig").mapInArrow(_wide_blocks(similarity), "a bigint, b bigint").distinct()
        a, b = own.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha")), own.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb"))
        both = F.size(F.array_intersect("ha", "hb"))
        found = found.union(maybe.join(a, "a").join(b, "b").where(both >= similarity * (F.col("na") + F.col("nb") - both) - 1e-9).select("a", "b"))
    pairs = stage.put(found.distinct())
    vertex = own.select("nid", F.concat_ws("|", "collection", "rep").alias("v"))
    named = (
        pairs.join(vertex.select(F.col("nid").alias("a"), F.col("v").alias("va")), "a").join(vertex.select(F.col("nid").alias("b"), F.col("v").alias("vb")), "b")
        .select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b")).distinct()
    )
    labels = min_labels(named, stage)
    group = F.coalesce(F.expr("substring(label, length(collection) + 2)"), F.col("rep"))
    groups = (
        own.select("s1", "s2", "collection", "rep", "copies", F.concat_ws("|", "collection", "rep").alias("id"))
        .join(labels, "id", "left").where("copies > 1 or label is not null").select("s1", "s2", group.alias("group_id"))
    )
    return sets.join(groups, ["s1", "s2"]).select("collection", "record_id", "group_id")


_FILED = "sig bigint, nid bigint, n int, lost int, role tinyint, hs {}"


def _bounded(filed: DataFrame, stage: Stage) -> DataFrame:
    """Blocks over BLOCK rows as pairs of chunks, so that no task holds more; the pairs cover all of the block's.

    A row meets the rows of its own chunk in one block and those of each other chunk in one more.
    """
    filed = stage.put(filed)
    large = stage.put(filed.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select("sig", F.ceil(F.col("c") * 2 / BLOCK).cast("int").alias("k")))
    if not large.limit(1).count():
        return filed
    chunk = F.pmod(F.xxhash64("nid"), F.col("k")).cast("int")
    split = filed.join(large, "sig").withColumn("i", chunk).withColumn("j", F.explode(F.expr("sequence(0, k - 1)")))
    side = F.when(F.col("i") == F.col("j"), 2).otherwise((F.col("i") > F.col("j")).cast("int"))
    role = (F.col("role").bitwiseAND(1) + 2 * side).cast("tinyint").alias("role")
    return filed.join(large, "sig", "left_anti").unionByName(split.select(F.xxhash64("sig", F.least("i", "j"), F.greatest("i", "j")).alias("sig"), "nid", "n", "lost", role, "hs"))
