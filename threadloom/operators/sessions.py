"""Sessions: an entity's events split at pauses longer than a gap.

Time is cut into chunks of a day. In each (entity, chunk) the occupied seconds are a bitmap; a
closing with a gap-long element, done by doubling shifts, fills pauses up to the gap, so the runs
of ones are that chunk's sessions. Runs of neighbouring chunks are then stitched where the pause
between them is short enough. A group never holds more than one entry per second of its chunk,
and an entity never has more runs than its time span divided by the gap, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 11
CHUNK_SECONDS = 86_400
#: Bits of one bitmap; a batch of more is worked on in parts.
BITMAP_BITS = 1 << 24


def close_runs(at: np.ndarray, gap: int) -> np.ndarray:
    """For sorted, distinct bit positions, the index of the run each is in after a closing.

    Two positions at most ``gap`` apart end up in one run. The dilation ORs the bitmap with itself
    shifted by 1, 2, 4, ... until each bit covers ``gap`` places; its runs start at the first and
    end ``gap - 1`` after the last event of a session, so no erosion is needed to find the events.
    """
    size = int(at[-1]) + gap + 2
    bits = np.zeros(size, np.uint8)
    bits[at] = 1
    bitmap, width = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), 1
    while width < gap:
        step = min(width, gap - width)
        bitmap |= bitmap << step
        width += step
    starts = bitmap & ~(bitmap << 1)
    flags = np.unpackbits(np.frombuffer(starts.to_bytes(size // 8 + 2, "little"), np.uint8), bitorder="little")
    return np.searchsorted(np.flatnonzero(flags), at, side="right") - 1


def _chunk_runs(gap: int):
    # a block with no event between two others is at least this long
    bits = max(BLOCK_BITS, int(gap).bit_length())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["_ts"].map(len).to_numpy()
            row = np.repeat(np.arange(len(batch)), sizes)
            ts = np.concatenate(batch["_ts"].to_numpy()).astype(np.int64)
            n = np.concatenate(batch["_n"].to_numpy()).astype(np.int64)
            order = np.lexsort((ts, row))
            row, ts, n = row[order], ts[order], n[order]
            block = ts >> bits
            jump = np.ones(len(ts), np.int64)
            same_row = row[1:] == row[:-1]
            # neighbouring blocks stay neighbours; anything farther gets one empty block between
            jump[1:] = np.where(same_row & (block[1:] - block[:-1] <= 1), block[1:] - block[:-1], 2)
            place = np.cumsum(jump)
            at = (place << bits) + (ts - (block << bits))
            run_id = np.empty(len(at), np.int64)
            part = at // max(BITMAP_BITS, 4 << bits)
            # a part may end only where an empty block follows
            cut = np.flatnonzero((jump == 2) & (part != np.concatenate(([-1], part[:-1]))))
            edges = np.unique(np.concatenate(([0], cut, [len(at)])))
            seen = 0
            for a, b in zip(edges[:-1], edges[1:]):
                runs = close_runs(at[a:b] - at[a], gap)
                run_id[a:b] = runs + seen
                seen += int(runs[-1]) + 1
            first = np.flatnonzero(np.concatenate(([True], run_id[1:] != run_id[:-1])))
            last = np.concatenate((first[1:], [len(at)])) - 1
            yield pd.DataFrame(
                {
                    "_entity": batch["_entity"].to_numpy()[row[first]],
                    "_s": ts[first],
                    "_e": ts[last],
                    "_n": np.add.reduceat(n, first),
                }
            )

    return run


def sessionize(events: DataFrame, entity: str | Column, ts: str | Column, gap: int) -> DataFrame:
    """One row per session: entity, session_start, session_end, duration, n_events.

    ``ts`` is whole seconds; an event more than ``gap`` (>= 1) seconds after the entity's previous
    one starts a session. Rows with a null entity or time are left out; rows at the same second
    count as so many events; an empty table gives no rows. Columns of ``events`` other than the two
    are ignored, so clashing names do no harm. The entity is compared as a string.
    """
    if gap < 1:
        raise ValueError("gap must be at least 1 second")
    entity = F.col(entity) if isinstance(entity, str) else entity
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = (
        events.select(entity.cast("string").alias("_entity"), ts.cast("long").alias("_t"))
        .where("_entity is not null and _t is not null")
        .groupBy("_entity", "_t")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    chunks = seconds.groupBy("_entity", F.floor(F.col("_t") / CHUNK_SECONDS).alias("_chunk")).agg(
        F.collect_list("_t").alias("_ts"), F.collect_list("_c").alias("_n")
    )
    runs = chunks.select("_entity", "_ts", "_n").mapInPandas(_chunk_runs(gap), "_entity string, _s long, _e long, _n long")
    order = Window.partitionBy("_entity").orderBy("_s")
    stitched = runs.withColumn("_new", (F.col("_s") - F.lag("_e").over(order) > gap).cast("long")).withColumn(
        "_session", F.sum(F.coalesce("_new", F.lit(1))).over(order)
    )
    return (
        stitched.groupBy("_entity", "_session")
        .agg(F.min("_s").alias("session_start"), F.max("_e").alias("session_end"), F.sum("_n").alias("n_events"))
        .select(
            F.col("_entity").alias("entity"),
            "session_start",
            "session_end",
            (F.col("session_end") - F.col("session_start")).alias("duration"),
            "n_events",
        )
    )
