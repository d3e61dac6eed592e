"""The pN_ queries of the general problems: sessions and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import hierarchy, sessions
from threadloom.operators.comments import one_row_per_comment

SESSION_GAP = 1800


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    comments = spark.read.parquet(f"{d}/comments.parquet").where("user_id is not null and user_id <> '' and timestamp is not null")
    return sessions.sessionize(one_row_per_comment(comments, ["user_id", "timestamp"]), "user_id", "timestamp", SESSION_GAP)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select(F.col("entity").alias("user_id"), "session_start", "session_end", F.col("n_events").alias("n_comments"))


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select(F.col("entity").alias("user_id"), "session_start", "session_end", "duration", F.col("n_events").alias("n_comments"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    records = spark.read.parquet(f"{d}/comment_records.parquet")
    return hierarchy.resolve(records, "comment_id", "parent_id").select(F.col("id").alias("comment_id"), F.col("root").alias("root_id"), "depth")


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    records = spark.read.parquet(f"{d}/comment_records.parquet")
    return hierarchy.hierarchy(records, "comment_id", "parent_id").select(F.col("id").alias("comment_id"), "path", "depth", F.col("root").alias("root_id"), "n_descendants")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    records = spark.read.parquet(f"{d}/comment_records.parquet")
    return hierarchy.closure(hierarchy.resolve(records, "comment_id", "parent_id", with_path=True))


QUERIES = {f.__name__: f for f in (p2_found, p2_sessions, p5_found, p5_hierarchy, p5_descendants)}

_P2 = """
with c as (select coalesce(nullif(comment_id, ''), nullif(json_extract_string(raw, '$.cid'), '')) cid, pos, user_id, timestamp ts
           from comments where user_id is not null and user_id <> '' and timestamp is not null),
one as (select user_id, ts from c qualify row_number() over (partition by coalesce('c' || cid, 'p' || pos) order by pos) = 1),
marked as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= 1800 then 0 else 1 end fresh from one),
numbered as (select *, sum(fresh) over (partition by user_id order by ts range between unbounded preceding and current row) s from marked)
select user_id, min(ts) session_start, max(ts) session_end, {extra} count(*) n_comments from numbered group by user_id, s
"""
_P5 = """
with recursive n as (select comment_id id, min(nullif(parent_id, '')) up from comment_records where comment_id is not null and comment_id <> '' group by 1),
walk as (select id, id cur, [id] seen, 'go' state from n
         union all
         select w.id, coalesce(n.up, w.cur), case when n.up is null then w.seen else list_append(w.seen, n.up) end,
                case when n.id is null or n.up is null then 'end' when list_contains(w.seen, n.up) then 'loop' else 'go' end
         from walk w left join n on n.id = w.cur where w.state = 'go'),
full_ as (select id, case when state = 'loop' then list_min(seen[list_position(seen, cur):]) else cur end root, case when state = 'loop' then -1 else len(seen) - 1 end depth, case when state = 'end' then list_reverse(seen) end path from walk where state <> 'go'),
"""
ORACLE = {
    "p2_found": _P2.format(extra=""),
    "p2_sessions": _P2.format(extra="max(ts) - min(ts) duration,"),
    "p5_found": _P5 + "z as (select 1) select id comment_id, root root_id, depth from full_",
    "p5_descendants": _P5 + "z as (select id, unnest(path) anc, unnest(range(len(path))) at_, len(path) m from full_) select anc ancestor_id, id descendant_id, m - 1 - at_ distance from z where at_ < m - 1",
    "p5_hierarchy": _P5 + "z as (select anc, count(*) k from (select unnest(path[:-2]) anc from full_ where path is not null) group by 1) select id comment_id, array_to_string(path, '>') path, depth, root root_id, case when depth >= 0 then coalesce(k, 0) end n_descendants from full_ left join z on z.anc = id",
}
