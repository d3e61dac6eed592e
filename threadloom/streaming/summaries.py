"""Account summaries and activity over a stream of comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.functions.text import mentions
from threadloom.operators.parse import parent_of


def user_summary(comments: DataFrame) -> DataFrame:
    """Running counters of each account; the same values as the batch summary once all rows have come."""
    rows = comments.where("user_id is not null and user_id <> ''")
    return rows.groupBy("user_id").agg(
        F.min_by(F.coalesce("username", F.lit("")), "pos").alias("username"), F.count(F.lit(1)).alias("comment_count"), F.count(parent_of(F.col("raw"))).alias("reply_count"),
        F.sum(F.size(mentions(F.col("text"))).cast("long")).alias("mention_count"), F.sum(F.coalesce("likes", F.lit(0))).alias("total_likes"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
    )


def activity(comments: DataFrame, width: str = "10 minutes", late: str = "6 hours") -> DataFrame:
    """Comments and accounts (approximate) per window; rows later than ``late`` are dropped by the watermark."""
    at = comments.where("timestamp is not null").withColumn("at", F.timestamp_seconds("timestamp"))
    windows = at.withWatermark("at", late).groupBy(F.window("at", width)).agg(F.count(F.lit(1)).alias("n_comments"), F.approx_count_distinct("user_id").alias("accounts"))
    return windows.select(F.col("window.start").alias("window_start"), "n_comments", "accounts")


def run_to_table(stream: DataFrame, path: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """The stream as a Parquet table: each batch's full result replaces the last one ("complete"), or new rows are added ("append")."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
