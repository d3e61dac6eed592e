"""Comment sources: snapshot files, prepared tables, rows in a request, and a hook for live ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.runtime import Stage

_FIELDS = ("comment_id", "user_id", "username", "text", "timestamp", "likes", "raw")


def _typed(rows: DataFrame, v: str = "c", order: list | None = None) -> DataFrame:
    """Comment rows of a variant column; a raw part of any shape is kept as JSON text."""
    get = lambda k, t: F.try_variant_get(F.col(v), f"$.{k}", t)
    ts = get("timestamp", "double").cast("long")
    raw = F.when(F.schema_of_variant(get("raw", "variant")) == "STRING", get("raw", "string")).otherwise(F.to_json(get("raw", "variant")))
    raw = F.when(F.schema_of_variant(get("raw", "variant")) != "VOID", raw)
    return rows.select(
        *(order or []), get("comment_id", "string").alias("comment_id"), get("user_id", "string").alias("user_id"), get("username", "string").alias("username"),
        get("text", "string").alias("text"), ts.alias("timestamp"), get("likes", "double").cast("long").alias("likes"), raw.alias("raw"),
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Comments of snapshot files: an object with ``comments`` or a bare list, or such objects a line each; other elements are dropped.

    Rows are numbered by file and place in it (pos). A file that is not JSON, or without any comment
    object, is a ValueError.
    """
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    # values that follow each other without a comma, which no single value has in it, stand on a line each
    several = F.col("value").rlike(r"[}\]]\s*\n\s*[{\[]")
    whole = files.select("file", F.posexplode(F.when(several, F.split("value", "\r?\n")).otherwise(F.array("value"))).alias("line", "value"))
    v = F.try_parse_json("value")
    listed = F.coalesce(F.try_variant_get(v, "$.comments", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    items = whole.select("file", "line", F.posexplode(listed).alias("in_line", "c")).where(F.schema_of_variant("c").startswith("OBJECT"))
    items = items.select("file", (F.col("line").cast("long") * 2**32 + F.col("in_line")).alias("at"), "c")
    # counts of each file, not their rows, pass through the ordering
    stage = Stage(spark, "snapshot")
    rows = stage.put(_typed(items, order=["file", "at"]).withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1))
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    if not counts.limit(1).count():
        raise ValueError(f"no comments in {path}")
    before = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(before, "file").select((F.col("i") + F.col("before")).cast("long").alias("pos"), *_FIELDS)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A prepared Parquet table with the columns of ``schema.COMMENT``; further columns are dropped."""
    return spark.read.parquet(path).select("pos", *_FIELDS)


def from_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Comments given inline, in order; missing fields are null, raw may be a dict or JSON text."""
    import json

    data = []
    for i, r in enumerate(rows):
        raw = r.get("raw")
        data.append((i, *[None if r.get(k) is None else str(r[k]) for k in _FIELDS[:4]], *[None if r.get(k) is None else int(r[k]) for k in ("timestamp", "likes")], raw if raw is None or isinstance(raw, str) else json.dumps(raw)))
    return spark.createDataFrame(data, schema.COMMENT)


def texts_from_dict(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(user_id, corpus) given inline."""
    return spark.createDataFrame(list(texts.items()), "user_id string, corpus string")


def graph_from_rows(spark: SparkSession, nodes: Iterable[dict], edges: Iterable[dict]) -> tuple[DataFrame, DataFrame]:
    """nodes(id, label) and canonical edges(src, dst, w) given inline; nodes without edges are fine."""
    n = spark.createDataFrame([(str(x["id"]), x.get("label")) for x in nodes], "id string, label string")
    e = spark.createDataFrame([(str(x["source"]), str(x["target"]), float(x.get("weight") or 0.0)) for x in edges], schema.EDGE)
    return n, canonical_edges(e)


def canonical_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of edges(source, target, weight): null ends and self-edges dropped, null weight 0, the largest of repeats kept."""
    ok = edges.where("source is not null and target is not null and source <> target")
    return ok.groupBy(F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst")).agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("w"))


def from_events(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Comments made of an event stream and a document collection: an event is a comment, the previous event of its type and hour its parent."""
    ts = F.col("ts").cast("timestamp")
    thread = Window.partitionBy("event_type", F.date_trunc("hour", ts)).orderBy("ts", "event_id")
    e = events.select(
        F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("comment_id"), F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("u"), "user_id").alias("username"),
        F.unix_seconds(ts).alias("timestamp"), F.floor("value").cast("long").alias("likes"), F.lag("event_id").over(thread).cast("string").alias("parent"),
    )
    n = documents.count()
    d = documents.select(F.col("doc_id"), "text")
    raw = F.when(F.col("parent").isNotNull(), F.concat(F.lit('{"parent_id":"'), "parent", F.lit('"}')))
    return e.join(d, (F.col("pos") % max(1, n)) == F.col("doc_id"), "left").select("pos", "comment_id", "user_id", "username", "text", "timestamp", "likes", raw.alias("raw"))


#: A live source: (url, limit) -> rows. None is part of this library.
Fetcher = Callable[[str, int], list[dict]]


def load(spark: SparkSession, fetch: Fetcher | None, url: str, limit: int, fallback: str | None) -> DataFrame:
    """Comments of a live source, else of a snapshot; both failing is a RuntimeError that names both causes."""
    first: Exception | None = None
    if fetch:
        try:
            rows = fetch(url, limit)
            if rows:
                return from_rows(spark, rows[:limit])
            first = ValueError("the source gave no comments")
        except Exception as e:
            first = e
    try:
        if not fallback:
            raise FileNotFoundError("no snapshot given")
        return read_snapshot(spark, fallback).where(F.col("pos") < limit)
    except Exception as e:
        raise RuntimeError(f"no comments: source: {first}; snapshot: {e}") from e
