"""Filling containers of fixed capacity with items of varying size, by minimum bin slack.

What fits together depends on sizes alone, and there are no more sizes than the capacity, so the
plan is made from the histogram of sizes, which stays that small for any number of items. Each bin
takes the largest size left and then the fullest feasible combination of the sizes still
available, found by subset-sum dynamic programming over a bitset; the combination is removed as
often as the counts allow. The plan becomes a table of slots by size, and items are matched to it by
their rank within their size, counted in salted parts so that a hot size is no one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.runtime import Stage

#: Items of one size that one task ranks.
RANKED_AT_ONCE = 200_000


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The combination {size: copies} of available sizes with the largest sum up to ``room``.

    ``reach`` has bit s set if sum s can be made of the sizes so far; the bits of each step are kept
    to walk back from the best sum. It stops at the first step that fills the room. Larger sizes go
    first, so among equal sums those of fewer, larger items win.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((s for s in counts if s <= room and counts[s] > 0), reverse=True):
        copies, lot = min(counts[size], room // size), 1
        while copies:
            take = min(lot, copies)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & full
            copies -= take
            lot *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[size] = chosen.get(size, 0) + take
            at -= size * take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(combination, number of bins)] holding every item of ``histogram`` (sizes 1 to capacity)."""
    left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    bins = []
    while left:
        largest = max(left)
        left[largest] -= 1
        combo = fullest(capacity - largest, left)
        left[largest] += 1
        combo[largest] = combo.get(largest, 0) + 1
        times = min(left[s] // k for s, k in combo.items())
        for s, k in combo.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        bins.append((combo, times))
    return bins


def _slots(bins: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Per size, ranges of item ranks [lo, hi) with the first container and the copies in each."""
    rows, base, next_rank = [], 0, {}
    for combo, times in bins:
        for size, copies in combo.items():
            lo = next_rank.get(size, 0)
            rows.append((size, lo, lo + copies * times, base, copies))
            next_rank[size] = lo + copies * times
        base += times
    return pd.DataFrame(rows, columns=["size", "lo", "hi", "base", "copies"], dtype="int64")


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(container_id, key, part, n) assigning every item of ``items(key, size)`` to a container.

    An item over the capacity is split into full parts, each alone in a container, and a rest that
    is packed like any other item; no other item is split (part 0). An item of size 0, or null,
    takes no room and goes to container 0. Rows are items, repeated keys included; their columns
    other than the two are ignored. No items give no rows.
    """
    stage = Stage(items.sparkSession, "packing")
    spark = items.sparkSession
    sized = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    cut = F.when(
        F.col("n") > capacity,
        F.transform(
            F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int")),
            lambda i: F.struct(i.alias("part"), F.least(F.lit(capacity), F.col("n") - i * capacity).cast("long").alias("n")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("n").alias("n"))))
    parts = stage.put(sized.select("key", F.explode(cut).alias("x")).select("key", "x.part", "x.n"))
    histogram = {r.n: r.m for r in parts.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}  # at most capacity + 1 rows
    slots = _slots(plan(histogram, capacity))
    salts = max(1, -(-max(histogram.values(), default=0) // RANKED_AT_ONCE))
    salted = parts.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("key", "part"), F.lit(salts)))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("n", "salt").orderBy("key", "part")) - 1)
    if salts > 1:
        sums = salted.groupBy("n", "salt").agg(F.count(F.lit(1)).alias("m"))
        offset = F.sum("m").over(Window.partitionBy("n").orderBy("salt")) - F.col("m")
        ranked = ranked.join(sums.select("n", "salt", offset.alias("offset")), ["n", "salt"]).withColumn("r", F.col("r") + F.col("offset"))
    by_size = {s: g.sort_values("lo") for s, g in slots.groupby("size")}
    table = {int(s): (g["lo"].to_numpy(), g["base"].to_numpy(), g["copies"].to_numpy()) for s, g in by_size.items()}
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacity, not by the items

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, r = batch["n"].to_numpy(), batch["r"].to_numpy()
            bins = np.zeros(len(batch), np.int64)
            for s in np.unique(n):
                lo, base, copies = shared.value[int(s)]
                mine = np.flatnonzero(n == s)
                at = np.searchsorted(lo, r[mine], side="right") - 1
                bins[mine] = base[at] + (r[mine] - lo[at]) // copies[at]
            yield pd.DataFrame({"container_id": bins, "key": batch["key"], "part": batch["part"], "n": n})

    kind = items.schema[key].dataType.simpleString()
    placed = ranked.select("key", "part", "n", "r").mapInPandas(place, f"container_id bigint, key {kind}, part int, n bigint")
    nothing = parts.where("n = 0").select(F.lit(0).cast("long").alias("container_id"), "key", "part", "n")
    return placed.union(nothing)
