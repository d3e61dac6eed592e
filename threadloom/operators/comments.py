"""Comment rows: their identity, and one row for each comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comment_key(comment_id: str = "comment_id", raw: str = "raw") -> Column:
    """comment_id, or ``cid`` of the raw JSON where it is null or empty (null if both are)."""
    cid = F.get_json_object(F.col(raw), "$.cid")
    return F.coalesce(F.nullif(F.col(comment_id), F.lit("")), F.nullif(cid, F.lit("")))


def one_row_per_comment(comments: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the first row (by pos) of each comment; a row without any id is its own comment.

    Only the named columns are shuffled. Adds ``cid`` (null for rows without an id).
    """
    cid = comment_key()
    keyed = comments.select(
        F.coalesce(F.concat(F.lit("c"), cid), F.concat(F.lit("p"), F.col("pos").cast("string"))).alias("_key"),
        cid.alias("cid"),
        F.struct("pos", *[c for c in columns if c != "pos"]).alias("_row"),
    )
    first = keyed.groupBy("_key").agg(F.min_by("cid", "_row.pos").alias("cid"), F.min_by("_row", "_row.pos").alias("_row"))
    return first.select("cid", *[F.col(f"_row.{c}").alias(c) for c in columns])
