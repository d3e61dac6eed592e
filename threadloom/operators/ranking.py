"""Global ranks and exact quantiles without a single-task sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.runtime import Stage


def global_rank(df: DataFrame, order: list, stage: Stage, name: str = "rank") -> DataFrame:
    """``df`` with a 0-based bigint rank by ``order``, whose columns together must be unique.

    Rows are range-partitioned and sorted; only the parts' row counts come together, one row each.
    """
    ranged = stage.put(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_row", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def at_ranks(df: DataFrame, column: str, pick, stage: Stage) -> tuple[int, dict[int, float]]:
    """(n, {i: i-th smallest value}) of a column's n non-null values, for the 0-based ranks ``pick(n)`` asks for.

    Distinct values are range-partitioned and their counts added up by part; few ranks, so few rows, come to the driver.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counted = stage.put(counted, n=F.sum("c"))
    n = stage.seen["n"] or 0
    wanted = sorted(set(pick(n))) if n else []
    if not wanted:
        return n, {}
    ranged = stage.put(counted.repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum("c").alias("s"))
    before = sums.select("_part", (F.sum("s").over(Window.orderBy("_part")) - F.col("s")).alias("_before"))
    upto = F.sum("c").over(Window.partitionBy("_part").orderBy("v")) + F.col("_before")
    ranked = ranged.join(F.broadcast(before), "_part").select("v", (upto - F.col("c")).alias("lo"), upto.alias("hi"))
    hit = F.lit(False)
    for i in wanted:
        hit = hit | ((F.col("lo") <= i) & (F.col("hi") > i))
    return n, {i: r.v for r in ranked.where(hit).collect() for i in wanted if r.lo <= i < r.hi}


def quantiles(df: DataFrame, column: str, qs: list[float], stage: Stage) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours; null for no values. Nulls are ignored."""
    n, at = at_ranks(df, column, lambda n: [f((n - 1) * q) for q in qs for f in (math.floor, math.ceil)], stage)
    if not n:
        return [None] * len(qs)
    out = []
    for q in qs:
        h = (n - 1) * q
        a, b = at[math.floor(h)], at[math.ceil(h)]
        out.append(a + (b - a) * (h - math.floor(h)))
    return out


def floor_quantile(df: DataFrame, group: str, column: str, q: float, name: str) -> DataFrame:
    """(group, name): the value at the floored index of each group's sorted non-null values, as a dashboard shows it.

    Equal values are counted before they are put in order, so no group's rows come together.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count(F.lit(1)).alias("_c"))
    ranked = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(group).orderBy(column))).withColumn("_n", F.sum("_c").over(Window.partitionBy(group)))
    at = F.floor((F.col("_n") - 1) * q)
    return ranked.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)).select(group, F.col(column).alias(name))
