"""The pN_ queries of the text and vector problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, groups, knn, lookalikes, neardup, packing, pii, readability
from threadloom.operators.comments import one_row_per_comment

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.equal_looking_pairs(_table(spark, d, "comments"), "pos", ["text", "username"])


def p1_normalized(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "comments").select("pos", "text", "username")
    return lookalikes.with_canonical(rows, ["text", "username"])


def p1_looks(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_classes(_table(spark, d, "comments"), ["text", "username"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    edges, comps = _table(spark, d, "edges"), _table(spark, d, "graph_1000_components")
    stars = groups.star_links(comps, "component_id", "node_id")
    return groups.consolidate(comps.select(F.col("node_id").alias("id")).union(edges.select("source")).union(edges.select("target")), edges.select("source", "target").union(stars))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = knn.usable(_table(spark, d, "canopy_artifacts"), "user_id", "embeddings", 64)
    return knn.nearest(vectors, dim=64, k=5, floor=0.82)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = _neighbours(spark, d)
    return near.select(F.least("id", "neighbour").alias("user_id_a"), F.greatest("id", "neighbour").alias("user_id_b")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    comments = one_row_per_comment(_table(spark, d, "comments"), ["text"]).select(F.lit("comments").alias("collection"), F.col("cid").alias("record_id"), "text")
    nodes = _table(spark, d, "graph_100_nodes").groupBy("id").agg(F.min("text_sample").alias("text")).select(F.lit("graph_100_nodes").alias("collection"), F.col("id").alias("record_id"), "text")
    return neardup.near_duplicate_groups(comments.union(nodes), similarity=0.6, min_words=14, words=neardup.distinct_words)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.findings(_table(spark, d, "comments"), "pos", "text")
    kinds = found.select(F.col("key").alias("pos"), F.explode("kinds").alias("kind"))
    return kinds.where(F.col("kind").isin("email", "phone", "id_number", "address", "name"))  # cards and account numbers are no kind of this table


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.with_placeholders(_table(spark, d, "comments"), "pos", "text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(_table(spark, d, "documents"), "doc_id", "text")


#: Tokens a container holds.
CAPACITY = 4096


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.token_counts(_table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY).select("container_id", F.col("key").alias("doc_id"), "part", F.col("n").alias("n_tokens"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    documents = _table(spark, d, "documents").where("source is null or source <> 'raw_dump'")
    prose = documents.where(F.regexp_count("text", F.lit(r"\S+")) >= 40)
    return readability.reading_levels(prose.select("doc_id", "text"), _table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "level")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_normalized, p1_looks, p3_found, p4_found, p6_found, p7_found, p7_redacted, p8_ids, p9_containers, p10_found)}


_P3 = """
with u as (select user_id id, min(embeddings::double[]) v from canopy_artifacts
           where user_id is not null and len(embeddings) = 64 and list_bool_and(list_transform(embeddings, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embeddings, lambda x: x <> 0)) group by 1),
e as (select id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) v from u),
s as (select a.id a, b.id b, list_inner_product(a.v, b.v) c from e a join e b on a.id <> b.id),
t as (select * from s where c >= 0.82 qualify row_number() over (partition by a order by c desc, b) <= 5)
select distinct least(a, b) user_id_a, greatest(a, b) user_id_b from t
"""
_REACH = "reach as (select id, id lab from n union select l.b, r.lab from reach r join sym l on l.a = r.id)"
_P4 = f"""
with recursive star as (select node_id, min(node_id) over (partition by component_id) low from graph_1000_components where component_id is not null and node_id is not null),
l as (select source a, target b from edges where source is not null and target is not null union select node_id, low from star),
sym as (select a, b from l union select b, a from l),
n as (select distinct id from (select source id from edges union all select target from edges union all select node_id from graph_1000_components) where id is not null), {_REACH}
select id node_id, min(lab) group_id from reach group by 1
"""
_P6 = f"""
with recursive c as (select coalesce(nullif(comment_id, ''), nullif(json_extract_string(raw, '$.cid'), '')) cid, text from comments qualify row_number() over (partition by cid order by pos) = 1),
r as (select 'comments' col, cid rid, text from c where cid is not null union all select 'graph_100_nodes', id, min(text_sample) from graph_100_nodes where id is not null group by 2),
w as (select col, rid, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) w from r where text is not null),
x as (select col, rid, len(w) n, unnest(w) t from w where len(w) >= 14),
p as (select a.col, a.rid ra, b.rid rb from x a join x b on a.col = b.col and a.t = b.t and a.rid < b.rid group by 1, 2, 3, a.n, b.n having count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9),
sym as (select col || '|' || ra a, col || '|' || rb b from p union select col || '|' || rb, col || '|' || ra from p),
n as (select distinct a id from sym), {_REACH}
select split_part(id, '|', 1) collection, split_part(id, '|', 2) record_id, split_part(min(lab), '|', 2) group_id from reach group by id
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3, "p4_found": _P4, "p6_found": _P6}
