"""Comments to records, account summaries and the mention, reply and co-thread layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.functions.text import json_leaves, mentions
from threadloom.operators import hierarchy
from threadloom.runtime import Stage

_FALSY = ("null", '""', "0", "0.0", "false", "{}", "[]")


def _member(variant: Column, key: str) -> Column:
    """JSON text of a member, null if it is missing or would count as false."""
    return _let(F.to_json(F.variant_get(variant, f"$.{key}", "variant")), lambda t: F.when(~t.isin(*_FALSY), t))


def _scalar(json: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")


def _truthy(text: Column) -> Column:
    return F.when(~text.isin("", "0", "null"), text)


def _of_object(json: Column) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{k}"), F.lit("")) for k in ("cid", "id", "comment_id")])


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def parent_of(raw: Column) -> Column:
    """The parent id that raw JSON names.

    The first key with a value that is not empty decides, even if that value is "0", which means
    none. An object stands for its cid, id or comment_id; a list for its first element.
    """

    def of_value(value: Column) -> Column:
        head = F.get_json_object(value, "$[0]")
        first = F.when(value.startswith("["), F.when(head.startswith("{"), _of_object(head)).otherwise(head)).when(value.startswith("{"), _of_object(value)).otherwise(_scalar(value))
        return _let(first, _truthy)

    return _let(_let(F.try_parse_json(raw), lambda v: F.coalesce(*[_member(v, k) for k in schema.PARENT_KEYS])), of_value)


def fragments(text: Column, raw: Column) -> Column:
    """Distinct non-empty texts of a comment and of its author's profile, in order."""

    def leaves(v: Column) -> Column:
        return F.flatten(F.transform(F.array(*[_member(v, k) for k in (*schema.TEXT_KEYS, *[f"user.{k}" for k in schema.PROFILE_KEYS])]), json_leaves))

    all_ = F.concat(F.array(text), F.coalesce(_let(F.try_parse_json(raw), leaves), F.array().cast("array<string>")))
    trimmed = F.transform(all_, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def new_account_signal(raw: Column) -> Column:
    """1.0 if the account's labels speak of a new one, 0.0 if not, null without labels."""

    def signal(v: Column) -> Column:
        labels = F.flatten(F.transform(F.array(*[_member(v, f"user.{k}") for k in schema.LABEL_KEYS]), json_leaves))
        return _let(labels, lambda x: F.when(F.size(x) > 0, F.lower(F.array_join(x, " ")).rlike("new|baru|recent|fresh").cast("double")))

    return _let(F.try_parse_json(raw), signal)


def records(comments: DataFrame) -> DataFrame:
    """One row per comment row with a non-empty user_id: pos, comment_id, user_id, username, text, timestamp, likes, parent_id, mentions, new_account_signal, fragments.

    comment_id falls back to the raw JSON's cid. Columns of ``comments`` beyond those of the comment
    schema are ignored. Malformed JSON counts as none.
    """
    raw = F.col("raw")
    cid = F.coalesce(F.nullif(F.col("comment_id"), F.lit("")), _truthy(F.get_json_object(raw, "$.cid")))
    return comments.where("user_id is not null and user_id <> ''").select(
        "pos",
        cid.alias("comment_id"),
        "user_id",
        F.regexp_replace(F.coalesce("username", F.lit("")), r"(?U)^\s+|\s+$", "").alias("username"),
        F.coalesce("text", F.lit("")).alias("text"),
        "timestamp",
        F.coalesce("likes", F.lit(0)).alias("likes"),
        parent_of(raw).alias("parent_id"),
        mentions(F.col("text")).alias("mentions"),
        new_account_signal(raw).alias("new_account_signal"),
        fragments(F.col("text"), raw).alias("fragments"),
    )


def prefix(comments: DataFrame, n: int) -> DataFrame:
    """The first n comments by arrival."""
    return comments.where(F.col("pos") < n)


def username_map(recs: DataFrame) -> DataFrame:
    """(uname, user_id): the account that last used a lower-cased name."""
    return recs.groupBy(F.lower("username").alias("uname")).agg(F.max_by("user_id", "pos").alias("user_id"))


def comment_lookup(recs: DataFrame) -> DataFrame:
    """(comment_id, user_id, parent_id) of the last row of each comment id."""
    last = recs.where("comment_id is not null").groupBy("comment_id").agg(F.max_by(F.struct("user_id", "parent_id"), "pos").alias("r"))
    return last.select("comment_id", "r.user_id", "r.parent_id")


def _pair_counts(pairs: DataFrame) -> DataFrame:
    """(src, dst, w) counts of (a, b) pairs in canonical order, self-pairs left out."""
    return pairs.where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))


def mention_edges(recs: DataFrame) -> DataFrame:
    named = recs.select(F.col("user_id").alias("a"), F.explode("mentions").alias("uname"))
    return _pair_counts(named.join(username_map(recs).select("uname", F.col("user_id").alias("b")), "uname"))


def reply_edges(recs: DataFrame) -> DataFrame:
    parents = comment_lookup(recs).select(F.col("comment_id").alias("p"), F.col("user_id").alias("b"))
    return _pair_counts(recs.where("parent_id is not null").join(parents, F.col("parent_id") == F.col("p")).select(F.col("user_id").alias("a"), "b"))


def thread_roots(lookup: DataFrame) -> DataFrame:
    """(id, root, depth) of each comment. On a cycle a comment is its own root; a chain into one ends where it enters."""
    return hierarchy.entered_roots(lookup.select(F.col("comment_id").alias("id"), F.when(F.col("parent_id") != F.col("comment_id"), F.col("parent_id")).alias("up")))


def thread_members(recs: DataFrame) -> DataFrame:
    """Distinct (root, user_id): authors of a thread's comments and of the comments they answer."""
    lookup = Stage(recs.sparkSession, "members").put(comment_lookup(recs))  # used for roots and for authors
    roots = thread_roots(lookup)
    start = F.coalesce("parent_id", "comment_id")
    at = recs.where(start.isNotNull()).select("user_id", "parent_id", start.alias("start"))
    rooted = at.join(roots.select(F.col("id").alias("r_id"), "root"), F.col("start") == F.col("r_id"), "left").select(F.coalesce("root", "start").alias("root"), "user_id", "parent_id")
    authors = lookup.select(F.col("comment_id").alias("p"), F.col("user_id").alias("author"))
    parents = rooted.where("parent_id is not null").join(authors, F.col("parent_id") == F.col("p")).select("root", F.col("author").alias("user_id"))
    return rooted.select("root", "user_id").union(parents).distinct()


def shared_threads(members: DataFrame) -> DataFrame:
    """Members of threads with at least two of them."""
    several = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("root")
    return members.join(several, "root", "left_semi")


def co_thread_edges(members: DataFrame) -> DataFrame:
    """(src, dst, w): threads that two accounts share. All pairs of a thread are edges by definition."""
    a, b = members.select("root", F.col("user_id").alias("src")), members.select("root", F.col("user_id").alias("dst"))
    return a.join(b, "root").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def user_threads(members: DataFrame) -> DataFrame:
    """(user_id, thread_count) over threads with at least two members."""
    return shared_threads(members).groupBy("user_id").agg(F.count(F.lit(1)).alias("thread_count"))


def user_summary(recs: DataFrame, threads: DataFrame | None = None, arrays: bool = False) -> DataFrame:
    """One row per account: counters, first and last time, span, average likes, new-account signal, thread count.

    The name is that of the first row, even if empty. ``arrays`` adds the sorted timestamps and
    threads, whose length has no bound; everything else works without them.
    """
    out = recs.groupBy("user_id").agg(
        F.min_by("username", "pos").alias("username"),
        F.count(F.lit(1)).alias("comment_count"),
        F.count("parent_id").alias("reply_count"),
        F.sum(F.size("mentions").cast("long")).alias("mention_count"),
        F.sum("likes").alias("total_likes"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        F.count("timestamp").alias("stamps"),
        F.min("pos").alias("first_pos"),
        F.max("new_account_signal").alias("new_account_signal"),
        *([F.sort_array(F.collect_list("timestamp")).alias("timestamps")] if arrays else []),
    )
    out = (
        out.withColumn("activity_span_sec", F.when(F.col("stamps") >= 2, F.col("last_timestamp") - F.col("first_timestamp")).otherwise(0).cast("double"))
        .withColumn("avg_likes", F.col("total_likes") / F.col("comment_count"))
        .withColumn("profile_metadata_available", F.col("new_account_signal").isNotNull())
    )
    if threads is None:
        return out
    per = shared_threads(threads).groupBy("user_id").agg(F.count(F.lit(1)).alias("thread_count"), *([F.sort_array(F.collect_list("root")).alias("threads")] if arrays else []))
    out = out.join(per, "user_id", "left").withColumn("thread_count", F.coalesce("thread_count", F.lit(0).cast("long")))
    return out.withColumn("threads", F.coalesce("threads", F.array().cast("array<string>"))) if arrays else out


def user_texts(recs: DataFrame) -> DataFrame:
    """(user_id, corpus): an account's fragments in order of arrival, joined by spaces."""
    parts = recs.select("user_id", "pos", "fragments").where(F.size("fragments") > 0)
    joined = parts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "fragments"))).alias("p"))
    return joined.select("user_id", F.array_join(F.flatten(F.transform("p", lambda x: x["fragments"])), " ").alias("corpus"))


def activity_points(recs: DataFrame) -> DataFrame:
    """(user_id, ts) of every timed comment."""
    return recs.where("timestamp is not null").select("user_id", F.col("timestamp").cast("double").alias("ts"))
