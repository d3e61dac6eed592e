"""Queries for each operator over the comment, graph, document and vector tables, with their SQL.

Where a metric needs clusters, they come from a rule both engines share: the last two digits of the
account id. Doubles are rounded to six places so that both engines' sums compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import scores, text, urls
from threadloom.operators import canopy, components, layers, louvain, metrics, mst, parse, ranking, scoring, tfidf, vectors
from threadloom.plans import pipeline
from threadloom.runtime import Stage
from threadloom.schema import Params
from threadloom.sources.comments import canonical_edges, from_events
from threadloom.streaming import summaries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
K = 15


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return parse.records(_table(spark, d, "comments"))


def _r(name: str, places: int = 6):
    return F.round(name, places).alias(name)


def _stage(spark: SparkSession) -> Stage:
    return Stage(spark, "query")


# --- SQL parts -------------------------------------------------------------------------------------

_FALSY = "('null', '\"\"', '0', '0.0', 'false', '{}', '[]')"
_VALUE = "coalesce(" + ", ".join(f"case when json_extract(raw, '$.{k}')::varchar not in {_FALSY} then json_extract(raw, '$.{k}')::varchar end" for k in ("reply_comment_id", "reply_to_comment_id", "parent_comment_id", "reply_id", "reply_comment", "parent_id")) + ")"
_REC = f"""
raws as (select *, {_VALUE} v from comments where user_id is not null and user_id <> ''),
rec as (select pos, coalesce(nullif(comment_id, ''), nullif(json_extract_string(raw, '$.cid'), '')) comment_id, user_id,
    regexp_replace(coalesce(username, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') username, coalesce(text, '') text, timestamp ts, coalesce(likes, 0) likes,
    nullif(nullif(case when v[1] = '{{' then coalesce(nullif(json_extract_string(v, '$.cid'), ''), nullif(json_extract_string(v, '$.id'), ''), nullif(json_extract_string(v, '$.comment_id'), ''))
                       when v[1] = '[' then json_extract_string(v, '$[0]') else v::json ->> '$' end, ''), '0') parent_id,
    list_transform(regexp_extract_all(coalesce(text, ''), '@([A-Za-z0-9_\\.]+)', 1), lambda x: lower(x)) mentions, raw from raws)"""
_LOOKUP = "look as (select comment_id, arg_max(user_id, pos) user_id, arg_max(struct_pack(p := parent_id), pos).p parent_id from rec where comment_id is not null group by 1)"
_MENTION = """
names as (select lower(username) uname, arg_max(user_id, pos) b from rec group by 1),
mention_e as (select least(a, b) src, greatest(a, b) dst, count(*)::double w from (select user_id a, unnest(mentions) uname from rec) join names using (uname) where a <> b group by 1, 2)"""
_REPLY = "reply_e as (select least(r.user_id, l.user_id) src, greatest(r.user_id, l.user_id) dst, count(*)::double w from rec r join look l on r.parent_id = l.comment_id where r.user_id <> l.user_id group by 1, 2)"
_ROOTS = """
walk as (select comment_id id, comment_id cur, [comment_id] seen, false done from look
         union all
         select w.id, case when l.parent_id is null or l.parent_id = w.cur or l.comment_id is null then w.cur else l.parent_id end,
                list_append(w.seen, l.parent_id), l.comment_id is null or l.parent_id is null or l.parent_id = w.cur or list_contains(w.seen, l.parent_id)
         from walk w left join look l on l.comment_id = w.cur where not w.done),
roots as (select id, cur root, len(seen) - 2 depth from walk where done)"""
_MEMBERS = """
att as (select r.user_id, r.parent_id, coalesce(o.root, coalesce(r.parent_id, r.comment_id)) root from rec r left join roots o on o.id = coalesce(r.parent_id, r.comment_id) where coalesce(r.parent_id, r.comment_id) is not null),
members as (select root, user_id from att union select a.root, l.user_id from att a join look l on a.parent_id = l.comment_id),
shared as (select * from members where root in (select root from members group by 1 having count(*) >= 2)),
thread_e as (select a.user_id src, b.user_id dst, count(*)::double w from members a join members b on a.root = b.root and a.user_id < b.user_id group by 1, 2)"""


def _norm(name: str) -> str:
    return f"""
{name}_s as (select u, sum(w) s from (select src u, w from {name} union all select dst, w from {name}) group by 1),
{name}_n as (select e.src, e.dst, e.w / ln(2 + greatest(1, a.s * b.s)) w from {name} e join {name}_s a on a.u = e.src join {name}_s b on b.u = e.dst)"""


_SUMMARY = """
summ as (select user_id, arg_min(username, pos) username, count(*) comment_count, count(parent_id) reply_count, sum(len(mentions))::bigint mention_count, sum(likes)::bigint total_likes,
    min(ts) first_timestamp, max(ts) last_timestamp, count(ts) stamps, min(pos) first_pos from rec group by 1)"""
_WINDOWS = "win as (select user_id, first_timestamp::double f, last_timestamp::double l, (first_timestamp + last_timestamp) / 2.0 c, greatest(1, comment_count) / greatest(1, last_timestamp - first_timestamp)::double rate, first_pos from summ where first_timestamp is not null)"
_BASE = f"with {_REC}, {_LOOKUP}, "
_RBASE = f"with recursive {_REC}, {_LOOKUP}, {_ROOTS}, {_MEMBERS}, "
# the graph that metric queries use: mention and reply layers, normalised and fused
_FUSED = f"{_MENTION}, {_REPLY}, {_norm('mention_e')}, {_norm('reply_e')}, fused as (select src, dst, sum(w) w from (select src, dst, w from mention_e_n union all select src, dst, 0.8 * w from reply_e_n) group by 1, 2)"
_CLUSTERS = "clu as (select user_id, right(user_id, 2) cluster_id from summ)"
_GRAPH = f"{_BASE} {_SUMMARY}, {_FUSED}, {_CLUSTERS}, inn as (select a.cluster_id, e.* from fused e join clu a on a.user_id = e.src join clu b on b.user_id = e.dst where a.cluster_id = b.cluster_id), "
_CLAMP = "greatest(0, least(1, {}))"


# --- parsing ---------------------------------------------------------------------------------------


@query(f"{_BASE} x as (select 1) select pos, comment_id, user_id, parent_id, array_to_string(mentions, ',') mentions from rec")
def comment_records(spark, d):
    return _records(spark, d).select("pos", "comment_id", "user_id", "parent_id", F.array_join("mentions", ",").alias("mentions"))


@query(f"""{_BASE} {_SUMMARY} select user_id, username, comment_count, reply_count, mention_count, total_likes, first_timestamp, last_timestamp,
case when stamps >= 2 then last_timestamp - first_timestamp else 0 end::double activity_span_sec, round(total_likes / comment_count, 6) avg_likes from summ""")
def user_summary(spark, d):
    s = parse.user_summary(_records(spark, d))
    return s.select("user_id", "username", "comment_count", "reply_count", "mention_count", "total_likes", "first_timestamp", "last_timestamp", "activity_span_sec", _r("avg_likes"))


@query(f"{_BASE} x as (select lower(username) uname, arg_max(user_id, pos) user_id from rec group by 1) select * from x")
def username_map(spark, d):
    return parse.username_map(_records(spark, d))


@query(f"{_BASE} {_MENTION} select * from mention_e")
def mention_edges(spark, d):
    return parse.mention_edges(_records(spark, d))


@query(f"{_BASE} {_REPLY} select * from reply_e")
def reply_edges(spark, d):
    return parse.reply_edges(_records(spark, d))


@query(f"{_RBASE} x as (select 1) select id, root from roots")
def thread_roots(spark, d):
    return parse.thread_roots(parse.comment_lookup(_records(spark, d))).select("id", "root")


@query(f"{_RBASE} x as (select 1) select src, dst, w from thread_e")
def co_thread_edges(spark, d):
    return parse.co_thread_edges(parse.thread_members(_records(spark, d)))


@query(f"{_RBASE} x as (select 1) select user_id, count(*) thread_count from shared group by 1")
def thread_count(spark, d):
    return parse.user_threads(parse.thread_members(_records(spark, d)))


_FRAGS = """
frag as (select user_id, pos, list_filter([regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') for x in [text, json_extract_string(raw, '$.reply_comment.cid'), json_extract_string(raw, '$.user.nickname'), json_extract_string(raw, '$.user.signature')]], lambda x: x is not null and x <> '') l from rec),
uniq as (select user_id, pos, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') t from frag where len(l) > 0)"""


@query(f"{_BASE} {_FRAGS}, c as (select user_id, string_agg(t, ' ' order by pos) corpus from uniq group by 1) select user_id, length(corpus) n_chars, md5(corpus) digest from c")
def user_corpus(spark, d):
    c = parse.user_texts(_records(spark, d))
    return c.select("user_id", F.length("corpus").cast("long").alias("n_chars"), F.md5(F.encode("corpus", "UTF-8")).alias("digest"))


@query("""with j as (select pos, regexp_extract_all(raw, '"(?:[^"\\\\]|\\\\.)*"(?:\\s*:)?|-?[0-9][0-9.eE+-]*|true|false') t from comments where raw is not null)
select pos, len(list_filter(t, lambda x: not ends_with(x, ':') and x <> '""')) n_leaves, list_filter(t, lambda x: not ends_with(x, ':') and x <> '""')[1]::json ->> '$' first_leaf from j""")
def nested_json_flatten(spark, d):
    leaves = text.json_leaves(F.col("raw"))
    return _table(spark, d, "comments").where("raw is not null").select("pos", F.size(leaves).cast("long").alias("n_leaves"), F.try_element_at(leaves, F.lit(1)).alias("first_leaf"))


@query("""with e as (select *, lag(event_id) over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) parent from events), n as (select greatest(1, count(*)) n from documents)
select event_id pos, event_id::varchar comment_id, e.user_id::varchar user_id, 'u' || e.user_id username, text, floor(epoch(ts))::bigint "timestamp", floor(value)::bigint likes, case when parent is not null then '{"parent_id":"' || parent || '"}' end raw
from e cross join n left join documents on doc_id = event_id % n""")
def event_comments(spark, d):
    return from_events(_table(spark, d, "events"), _table(spark, d, "documents"))


# --- layers ----------------------------------------------------------------------------------------


def _layer(name: str, base: str, parts: str, make):
    def run(spark, d):
        return layers.normalize_layer(make(_records(spark, d))).select("src", "dst", _r("w"))

    run.__name__ = f"layer_normalized_{name}"
    query(f"{base} {parts} select src, dst, round(w, 6) w from {'thread_e' if name == 'co_thread' else name + '_e'}_n")(run)


_layer("mention", _BASE, f"{_MENTION}, {_norm('mention_e')}", parse.mention_edges)
_layer("reply", _BASE, f"{_REPLY}, {_norm('reply_e')}", parse.reply_edges)
_layer("co_thread", _RBASE, _norm("thread_e"), lambda r: parse.co_thread_edges(parse.thread_members(r)))


@query(f"{_BASE} {_SUMMARY}, {_WINDOWS} select user_id, f \"first\", l \"last\", c center, round(rate, 6) rate, row_number() over (order by c, first_pos) - 1 \"rank\" from win")
def activity_windows(spark, d):
    w = layers.activity_windows(parse.user_summary(_records(spark, d)))
    return ranking.global_rank(w, ["center", "first_pos"], _stage(spark)).select("user_id", "first", "last", "center", _r("rate"), F.col("rank").cast("long").alias("rank"))


@query(f"""{_BASE} {_SUMMARY}, {_WINDOWS},
g as (select greatest(120, least(greatest(1, max(c) - min(c)), greatest(180, 0.12 * greatest(1, max(c) - min(c))))) s from win),
rk as (select *, row_number() over (order by c, first_pos) r from win),
p as (select a.user_id u, b.user_id v, b.r rv, abs(a.c - b.c) gap, a.f af, a.l al, b.f bf, b.l bl, a.rate ra, b.rate rb, s from rk a join rk b on abs(a.r - b.r) between 1 and {3 * K}, g),
q as (select *, greatest(0, 1 - gap / greatest(1, s)) near, greatest(0, least(al, bl) - greatest(af, bf)) both_, greatest(1, greatest(al, bl) - least(af, bf)) whole from p),
sc as (select u, v, rv, {_CLAMP.format("0.55 * near + 0.25 * (case when al <= af and bl <= bf then near when both_ > 0 then both_ / whole else greatest(0, 1 - gap / greatest(1, 1.5 * s)) end) + 0.2 * greatest(0, 1 - abs(ln(1 + ra) - ln(1 + rb)) / ln(6))")} w from q),
t as (select * from sc where w > 0.18 qualify row_number() over (partition by u order by round(w, 12) desc, rv) <= {K})
select least(u, v) src, greatest(u, v) dst, round(max(w), 6) w from t group by 1, 2""")
def temporal_edges(spark, d):
    return layers.temporal_edges(parse.user_summary(_records(spark, d)), K).select("src", "dst", _r("w"))


_FUSE_ALL = f"""{_MENTION}, {_REPLY}, {_norm('mention_e')}, {_norm('reply_e')}, {_norm('thread_e')},
fused as (select src, dst, sum(w) w from (select src, dst, w from mention_e_n union all select src, dst, 0.8 * w from reply_e_n union all select src, dst, 0.35 * w from thread_e_n) group by 1, 2 having sum(w) > 0)"""
_PENAL = """
asg as (select user_id, min(canopy) canopy from canopy_artifacts where canopy is not null group by 1),
pen as (select e.src, e.dst, case when a.canopy <> b.canopy then e.w * 0.6 else e.w end w from fused e left join asg a on a.user_id = e.src left join asg b on b.user_id = e.dst)"""


def _fused(spark, d, thread: bool = True) -> DataFrame:
    stage = _stage(spark)
    recs = stage.put(_records(spark, d))
    parts = [(layers.normalize_layer(parse.mention_edges(recs)), 1.0), (layers.normalize_layer(parse.reply_edges(recs)), 0.8)]
    if thread:
        parts.append((layers.normalize_layer(stage.put(parse.co_thread_edges(parse.thread_members(recs)))), 0.35))
    return stage.put(layers.fuse(parts))


def _assignment(spark, d) -> DataFrame:
    return _table(spark, d, "canopy_artifacts").where("canopy is not null").groupBy("user_id").agg(F.min("canopy").alias("canopy"))


@query(f"{_RBASE} {_FUSE_ALL} select src, dst, round(w, 6) w from fused")
def fused_edges(spark, d):
    return _fused(spark, d).select("src", "dst", _r("w"))


@query(f"{_RBASE} {_FUSE_ALL}, {_PENAL} select src, dst, round(w, 6) w from pen")
def penalized_edges(spark, d):
    return layers.penalize(_fused(spark, d), _assignment(spark, d), 0.6).select("src", "dst", _r("w"))


@query(f"""{_RBASE} {_FUSE_ALL}, {_PENAL}, sym as (select src u, dst v, w from pen union all select dst, src, w from pen),
t as (select * from sym qualify row_number() over (partition by u order by round(w, 12) desc, v) <= {K})
select least(u, v) src, greatest(u, v) dst, round(max(w), 6) w from t group by 1, 2""")
def pruned_edges(spark, d):
    return layers.prune(layers.penalize(_fused(spark, d), _assignment(spark, d), 0.6), K).select("src", "dst", _r("w"))


# --- text ------------------------------------------------------------------------------------------

_SLANG = "case t " + " ".join(f"when '{a}' then '{b}'" for a, b in text.SLANG.items()) + " else t end"


def _lemma_sql(token: str) -> str:
    out = f"(case when {token} in {text.PRESERVED} then {token} || '!' else {_SLANG.replace('case t', f'case {token}').replace('else t', f'else {token}')} end)"
    for pattern, _, tail in text.STEPS:
        out = f"regexp_replace({out}, '{pattern}', '\\1{tail}')"
    return out


_TOK = "tok as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) t from documents where text is not null)"


@query(f"with {_TOK} select t token, {_lemma_sql('t')} lemma from tok")
def stem_tokens(spark, d):
    t = _table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("token")).distinct()
    return t.select("token", text.lemma(F.col("token")).alias("lemma"))


@query()
def normalized_tokens(spark, d):
    return _table(spark, d, "documents").select("doc_id", text.normalized(F.col("text")).alias("clean"))


_DOC_TEXT = "src_t as (select doc_id::varchar doc, text from documents where text is not null)"
_USER_TEXT = "src_t as (select user_id doc, text from comments where user_id is not null and user_id <> '' and text is not null)"


def _simple_rows(df: DataFrame, key: str, col: str) -> DataFrame:
    """Rows for TF-IDF by plain tokens, which SQL can make as well."""
    stops = text.stop_words()
    toks = F.transform(F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9_]+"), F.lit(0)), text.lemma)
    rows = df.select(F.col(key).cast("string").alias("doc"), F.filter(toks, lambda t: (F.length(t) >= 2) & ~t.isin(*stops)).alias("toks"))
    return rows.where(F.size("toks") > 0)


_STOPS = "(" + ", ".join(f"'{w}'" for w in text.stop_words()) + ")"


def _tfidf_sql(source: str) -> str:
    """weights(doc, term, w) of source(doc, text)."""
    return f"""
raw_t as (select doc, t from (select doc, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) t from {source})),
lem_d as (select t, {_lemma_sql('t')} term from (select distinct t from raw_t)),
tf as (select doc, term, count(*) tf from raw_t join lem_d using (t) where length(term) >= 2 and term not in {_STOPS} group by 1, 2),
n_d as (select count(distinct doc) n from tf), df as (select term, count(*) df from tf group by 1),
wt as (select doc, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) w from tf join df using (term), n_d),
weights as (select doc, term, w / sqrt(sum(w * w) over (partition by doc)) w from wt)"""


def _plain_counts(df: DataFrame, key: str, col: str, stage: Stage | None = None) -> DataFrame:
    """Counts of the tokens of ``_simple_rows``."""
    stops = text.stop_words()
    return tfidf.raw_counts(df, key, col, text.lemma, lambda t: (F.length(t) >= 2) & ~t.isin(*stops), stage)


def _plain_weights(df: DataFrame, key: str, col: str) -> DataFrame:
    return tfidf.weights_of(_plain_counts(df, key, col))


def _doc_weights(spark, d) -> DataFrame:
    return _plain_weights(_table(spark, d, "documents").where("text is not null"), "doc_id", "text")


def _user_texts(spark, d) -> DataFrame:
    return _table(spark, d, "comments").where("user_id is not null and user_id <> '' and text is not null")


def _user_weights(spark, d) -> DataFrame:
    return _plain_weights(_user_texts(spark, d), "user_id", "text")


@query(f"with {_DOC_TEXT}, {_tfidf_sql('src_t')} select doc, term, round(w, 6) w from weights")
def tfidf_weights(spark, d):
    return _doc_weights(spark, d).select("doc", "term", _r("w"))


def _grid_sql(n_max: int = 3) -> str:
    def option(top: int, low: str, when: str) -> str:
        return f"select {top} ngram_max, {low} min_df, coalesce(sum(df), 0)::bigint entries, count(*) features from (select df from terms, n_d where n <= {top} and df >= {low} and df <= case when nd < 30 then 1.0 else 0.95 end * nd order by total desc, term limit 20000) where (select {when} from n_d)"

    options = " union all ".join(option(top, low, when) for top in (3, 2, 1) for low, when in (("1", "true"), ("2", "nd >= 30")))
    return f"""
raw_t as (select doc, unnest(t) t, unnest(range(len(t))) i from (select doc, regexp_extract_all(lower(text), '[a-z0-9_]+') t from src_t)),
lem_d as (select t, {_lemma_sql('t')} term from (select distinct t from raw_t)),
kept as (select doc, term, row_number() over (partition by doc order by i) i from raw_t join lem_d using (t) where length(term) >= 2 and term not in {_STOPS}),
toks as (select doc, i, term a, lead(term, 1) over w b, lead(term, 2) over w c from kept window w as (partition by doc order by i)),
grams as (select doc, 1 n, a term from toks union all select doc, 2, a || ' ' || b from toks where b is not null union all select doc, 3, a || ' ' || b || ' ' || c from toks where c is not null),
terms as (select term, n, count(distinct doc) df, count(*) total from grams group by 1, 2), n_d as (select count(distinct doc) nd from grams), opt as ({options})
select *, row_number() over (order by entries desc, features desc, ngram_max desc, min_df) = 1 chosen from opt"""


@query(f"with {_DOC_TEXT}, {_grid_sql()}")
def tfidf_grid_choice(spark, d):
    rows = _simple_rows(_table(spark, d, "documents").where("text is not null"), "doc_id", "text").withColumn("pos", F.lit(0).cast("long"))
    fitted = tfidf.fit(rows.select("doc", "pos", "toks"))
    out = [(n, low, e, f, n == fitted.ngram_max and low == fitted.min_df) for n, low, e, f in fitted.grid]
    return spark.createDataFrame(out, "ngram_max int, min_df int, entries bigint, features bigint, chosen boolean")


@query(f"""with {_USER_TEXT}, {_tfidf_sql('src_t')},
sim as (select a.doc u, b.doc v, sum(a.w * b.w) w from weights a join weights b using (term) where a.doc <> b.doc group by 1, 2),
t as (select * from sim where round(w, 9) > 0 qualify row_number() over (partition by u order by round(w, 9) desc, v) <= {K})
select least(u, v) src, greatest(u, v) dst, round(max(w), 6) w from t group by 1, 2""")
def content_knn_edges(spark, d):
    stage, first = _stage(spark), _stage(spark)
    counts = stage.put(_plain_counts(_user_texts(spark, d), "user_id", "text", first))
    first.clear()
    v, n = tfidf.vectors_of(counts)
    stage.drop(counts)
    return layers.content_edges(v, K, n).select("src", "dst", _r("w"))


@query(f"""with {_DOC_TEXT}, {_tfidf_sql('src_t')}, m as (select doc_id::varchar doc, coalesce(source, 'none') cluster_id from documents),
att as (select cluster_id, doc, term, w from weights join m using (doc)),
own as (select cluster_id, sum(w * w) o, count(distinct doc) n from att group by 1),
wh as (select cluster_id, sum(s * s) q from (select cluster_id, term, sum(w) s from att group by 1, 2) group by 1)
select cluster_id, n n_text, round(case when n >= 2 then {_CLAMP.format("(q - o) / (n * (n - 1.0))")} else 0 end, 6) similarity from own join wh using (cluster_id)""")
def cluster_content_repetition(spark, d):
    m = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("user_id"), F.coalesce("source", F.lit("none")).alias("cluster_id"))
    return tfidf.mean_pairwise(_stage(spark).put(_doc_weights(spark, d)), m).select("cluster_id", "n_text", _r("similarity"))


@query("""with t as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) w from documents)
select a.doc_id, round(case when len(a.w) + len(b.w) = 0 then 0 else len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) end, 6) jaccard from t a join t b on b.doc_id = a.doc_id + 1""")
def token_jaccard(spark, d):
    t = _table(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))).alias("w"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("w2"))
    return t.join(b, "doc_id").select("doc_id", F.round(scores.jaccard(F.col("w"), F.col("w2")), 6).alias("jaccard"))


# --- vectors ---------------------------------------------------------------------------------------


def _embeddings(spark, d) -> DataFrame:
    return vectors.unit(_table(spark, d, "embeddings"), "vec_id", "embedding")


_EMB = "e as (select vec_id::varchar id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) v from embeddings)"


@query(f"""with {_EMB}, s as (select a.id u, b.id v, list_inner_product(a.v, b.v) w from e a join e b on a.id <> b.id)
select u, v, round(w, 6) w from s qualify row_number() over (partition by u order by round(w, 9) desc, v) <= 5""")
def embedding_cosine_knn(spark, d):
    return vectors.cosine_neighbours(_embeddings(spark, d), 5).select("u", "v", _r("w"))


@query(f"""with {_EMB}, s as (select a.id, a.label la, b.label lb, avg(1 - list_inner_product(a.v, b.v)) x from e a join e b on a.id <> b.id group by 1, 2, 3),
o as (select id, max(case when la = lb then x end) a, min(case when la <> lb then x end) b from s group by 1)
select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) silhouette from o""")
def embedding_silhouette(spark, d):
    labels = _table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("label"))
    return spark.createDataFrame([(round(vectors.silhouette(_embeddings(spark, d), labels), 6),)], "silhouette double")


@query()
def svd_embeddings(spark, d):
    stage = _stage(spark)
    fitted = pipeline.fit_texts(stage.put(_records(spark, d)))
    return pipeline.embed(fitted, pipeline.content_vectors(fitted, stage), stage)


def _canopies(spark, d) -> canopy.Canopies:
    stage = _stage(spark)
    usable = vectors.unit(_table(spark, d, "canopy_artifacts").where(F.size("embeddings") == 64), "user_id", "embeddings")
    v = stage.put(usable.groupBy("id").agg(F.min("v").alias("v")))
    order = ranking.global_rank(v.select("id"), ["id"], stage, "ord")
    return canopy.from_pairs(order, vectors.cosine_pairs(v, 0.6), 0.6, 0.8)


_CANOPY = """with recursive raw_v as (select user_id id, sqrt(list_sum(list_transform(embeddings, lambda y: y::double * y::double))) l, embeddings v from canopy_artifacts where user_id is not null and len(embeddings) = 64),
e as (select id, min(list_transform(v, lambda x: x::double / l)) v from raw_v where l > 0 and not isnan(l) group by 1),
o as (select id, row_number() over (order by id) - 1 ord, v from e),
near as (select a.ord, b.ord other, list_inner_product(a.v, b.v) w from o a join o b on a.ord <> b.ord),
gone as (select o.ord, list(other) filter (where w >= 0.8) lst from o left join near using (ord) group by 1), every as (select list(ord order by ord) all_ from o),
piv as (select ord, lst gone, 0 k from gone where ord = (select min(ord) from o)
        union all select g.ord, list_concat(p.gone, g.lst), p.k + 1 from (select piv.*, list_filter(all_, lambda x: x > piv.ord and not list_contains(coalesce(gone, []), x))[1] nxt from piv, every) p join gone g on g.ord = p.nxt),
mem as (select k, ord from piv union select k, other from piv join near using (ord) where w >= 0.6)"""


@query(f"{_CANOPY} select id user_id, 'canopy_' || lpad(min(k)::varchar, 3, '0') canopy from mem join o using (ord) group by 1")
def canopy_assignments(spark, d):
    return _canopies(spark, d).assignment


@query(f"{_CANOPY} select 'canopy_' || lpad(k::varchar, 3, '0') canopy, id user_id from mem join o using (ord)")
def canopy_members(spark, d):
    return _canopies(spark, d).members


@query()
def canopy_threshold_grid(spark, d):
    *_, rows = canopy.tune(canopy.tuning_sample(_embeddings(spark, d)), 0.6, 0.8)
    return spark.createDataFrame(rows, "t1 double, t2 double, n_canopies int, silhouette double")


# --- graph -----------------------------------------------------------------------------------------

_EDGE = "e as (select least(source, target) src, greatest(source, target) dst, coalesce(max(weight), 0) w from edges where source is not null and target is not null and source <> target group by 1, 2)"
_NODE = "n as (select distinct id from (select source id from edges union all select target from edges union all select id from graph_100_nodes) where id is not null)"
_COMP = "sym as (select src u, dst v from e union all select dst, src from e), reach as (select id, id lab from n union select s.v, r.lab from reach r join sym s on s.u = r.id), comp as (select id, min(lab) label from reach group by 1)"


def _edges(spark, d) -> DataFrame:
    return canonical_edges(_table(spark, d, "edges"))


def _nodes(spark, d) -> DataFrame:
    e = _table(spark, d, "edges")
    return e.select(F.col("source").alias("id")).union(e.select("target")).union(_table(spark, d, "graph_100_nodes").select("id")).where("id is not null").distinct()


def _as_links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"))


@query(f"with recursive {_EDGE}, {_NODE}, {_COMP} select id, label from comp")
def connected_components(spark, d):
    return components.connected_components(_nodes(spark, d), _as_links(_edges(spark, d)))


@query(f"""with recursive {_EDGE}, {_NODE}, {_COMP}, z as (select label, count(*) component_size, row_number() over (order by count(*) desc, label) - 1 component_id, '["' || string_agg(id, '","' order by id) || '"]' node_ids from comp group by 1)
select component_id, component_size, node_ids from z""")
def component_summary(spark, d):
    at = components.numbered(components.connected_components(_nodes(spark, d), _as_links(_edges(spark, d))))
    comps = at.select("component_id", "component_size", F.col("id").alias("node_id"), F.col("id").alias("label"))
    return pipeline.component_summary(comps).select("component_id", "component_size", "node_ids")


_FOREST = f"""{_COMP}, rk as (select *, row_number() over (order by w desc, src desc, dst desc) r from e),
both_r as (select r, src u, dst v from rk union all select r, dst, src from rk),
walk as (select r id, src cur from rk union select walk.id, v from walk join both_r on u = cur and r < walk.id),
forest as (select src, dst, w from rk where not exists (select 1 from walk where id = r and cur = dst)),
cuts as (select label, list_sort(list(w))[count(*) // 2 + 1] threshold, count(*) tree_edges from forest join comp on id = src group by 1)"""
_FOREST_CLUSTERS = """strong as (select src, dst from e join comp on id = src join cuts using (label) where w >= threshold), sym2 as (select src u, dst v from strong union all select dst, src from strong),
reach2 as (select id, id lab from n union select s.v, r.lab from reach2 r join sym2 s on s.u = r.id), fclu as (select min(lab) cluster_id, id user_id from reach2 group by 2)"""


@query(f"with recursive {_EDGE}, {_NODE}, {_FOREST} select src, dst, w, round(1 / (w + 1e-9), 6) distance from forest")
def mst_forest(spark, d):
    return mst.forest(_edges(spark, d)).withColumn("distance", F.round(scores.distance(F.col("w")), 6))


@query(f"with recursive {_EDGE}, {_NODE}, {_FOREST} select label, threshold, tree_edges from cuts")
def mst_weights_summary(spark, d):
    comps = components.connected_components(_nodes(spark, d), _as_links(_edges(spark, d)))
    return mst.median_cuts(mst.forest(_edges(spark, d)), comps)


@query(f"with recursive {_EDGE}, {_NODE}, {_FOREST}, {_FOREST_CLUSTERS} select cluster_id, user_id from fclu")
def mst_clusters(spark, d):
    return mst.clusters(_nodes(spark, d), _edges(spark, d))


@query()
def louvain_clusters(spark, d):
    return louvain.clusters(_nodes(spark, d), _edges(spark, d))


@query(f"""with {_EDGE}, {_NODE}, c as (select count(*) nn from n), m as (select count(*) ne, avg(w) aw, max(w) mw from e),
i as (select count(*) k from n where id not in (select src from e union select dst from e))
select nn num_nodes, ne num_edges, round(2.0 * ne / nn, 6) avg_degree, round(2.0 * ne / (nn * (nn - 1.0)), 9) density, k isolated_nodes, round(aw, 6) avg_weight, round(mw, 6) max_weight from c, m, i""")
def graph_stats(spark, d):
    return metrics.graph_stats(_nodes(spark, d), _edges(spark, d)).select("num_nodes", "num_edges", _r("avg_degree"), _r("density", 9), "isolated_nodes", _r("avg_weight"), _r("max_weight"))


@query(f"with {_EDGE}, {_NODE} select id from n where id not in (select src from e union select dst from e)")
def isolated_nodes(spark, d):
    return metrics.isolated(_nodes(spark, d), _edges(spark, d))


@query(f"with {_EDGE} select unnest([0.5, 0.8, 0.9]::double[]) q, round(unnest([quantile_cont(w, 0.5), quantile_cont(w, 0.8), quantile_cont(w, 0.9)]), 6) value from e")
def edge_quantiles(spark, d):
    qs = [0.5, 0.8, 0.9]
    values = ranking.quantiles(_edges(spark, d), "w", qs, _stage(spark))
    return spark.createDataFrame([(q, None if v is None else round(v, 6)) for q, v in zip(qs, values)], "q double, value double")


@query("with s as (select canopy, list_sort(list(total_likes)) l from graph_100_nodes where total_likes is not null group by 1) select canopy, l[floor((len(l) - 1) * 0.8)::int + 1] p80 from s")
def floor_quantiles(spark, d):
    return ranking.floor_quantile(_table(spark, d, "graph_100_nodes"), "canopy", "total_likes", 0.8, "p80")


# --- scores for given clusters ---------------------------------------------------------------------


class _Graph:
    def __init__(self, spark, d):
        self.stage = _stage(spark)
        recs = self.stage.put(_records(spark, d))
        self.summary = self.stage.put(parse.user_summary(recs))
        self.edges = self.stage.put(layers.fuse([(layers.normalize_layer(parse.mention_edges(recs)), 1.0), (layers.normalize_layer(parse.reply_edges(recs)), 0.8)]))
        self.clusters = self.stage.put(self.summary.select(F.substring("user_id", -2, 2).alias("cluster_id"), "user_id"))

    def stats(self) -> DataFrame:
        return self.stage.put(scoring.cluster_stats(self.clusters, self.edges, self.summary, None))


_DENS = f"""
sz as (select cluster_id, count(*) n from clu group by 1),
iw as (select cluster_id, count(*) ne, avg(w) aw from inn group by 1),
dg as (select cluster_id, max(dd) md from (select cluster_id, u, count(*) dd from (select cluster_id, src u from inn union all select cluster_id, dst from inn) group by 1, 2) group by 1),
p9 as (select greatest(1, quantile_cont(w, 0.9)) p from fused),
den as (select cluster_id, n cluster_size, coalesce(aw, 0) avg_weight, case when n > 1 then {_CLAMP.format("2.0 * coalesce(ne, 0) / (n * (n - 1.0))")} else 0 end structural_density,
    case when n > 1 then {_CLAMP.format("coalesce(aw, 0) / p")} else 0 end weighted_density, case when n > 1 and ne > 0 then md / (2.0 * ne / n) else 0 end deg_conc_raw
    from sz left join iw using (cluster_id) left join dg using (cluster_id), p9),
dens as (select *, {_CLAMP.format("0.55 * structural_density + 0.45 * weighted_density")} cluster_density, case when deg_conc_raw > 0 then {_CLAMP.format("(deg_conc_raw - 1) / 3")} else 0 end deg_conc from den)"""
_TEMP = f"""
gl as (select greatest(1, max(last_timestamp) - min(first_timestamp))::double gspan, greatest(1, sum(comment_count)) / greatest(1, max(last_timestamp) - min(first_timestamp))::double grate,
    quantile_cont(comment_count, 0.5) med, greatest(1, quantile_cont(greatest(comment_count - 1, 0), 0.9)) px from summ),
tc as (select cluster_id, sum(comment_count)::double tot, sum(stamps) ns, min(first_timestamp) lo, max(last_timestamp) hi, min((first_timestamp + last_timestamp) / 2.0) cl, max((first_timestamp + last_timestamp) / 2.0) ch, count(first_timestamp) cn, count(*) mem
    from clu join summ using (user_id) group by 1),
ts as (select *, case when ns >= 2 then greatest(1, hi - lo)::double else 1 end span from tc, gl),
tp as (select cluster_id, case when ns > 0 and mem > 1 then 1 else 0 end k, span, case when tot / span <= grate then 0 else {_CLAMP.format("(tot / span / grate - 1) / 3")} end pr, {_CLAMP.format("1 - span / gspan")} co,
    case when cn >= 2 then {_CLAMP.format("1 - (ch - cl) / gspan")} when cn = 1 then {_CLAMP.format("1 - span / gspan")} else 0 end al from ts),
temp as (select cluster_id, k * pr temporal_rate_pressure, k * co temporal_compactness, k * al temporal_alignment, k * span cluster_span_sec, {_CLAMP.format("k * (0.45 * pr + 0.3 * co + 0.25 * al)")} temporal_burst from tp)"""
_FREQ = f"""
fc as (select cluster_id, count(*) mem, avg(case when comment_count > greatest(1, med) then 1.0 else 0.0 end) rep, avg(greatest(0, comment_count - greatest(1, med))) ov, any_value(px) px from clu join summ using (user_id), gl group by 1),
freq as (select cluster_id, case when mem > 1 then {_CLAMP.format("0.5 * rep + 0.5 * " + _CLAMP.format("ov / px"))} else 0 end high_frequency, case when mem > 1 then rep else 0 end high_frequency_repeat_ratio, case when mem > 1 then {_CLAMP.format("ov / px")} else 0 end high_frequency_excess from fc)"""
_STATS = f"""{_GRAPH} {_DENS}, {_TEMP}, {_FREQ},
st as (select *, case when cluster_size > 1 then (0.25 * cluster_density + 0.2 * temporal_burst + 0.15 * high_frequency) / 0.85 else 0 end score from dens join temp using (cluster_id) join freq using (cluster_id)),
cut as (select greatest(0.5, quantile_cont(score, 0.8)) c from st where score > 0),
top1 as (select cluster_id, score from st order by score desc, cluster_id limit 1),
sus as (select st.*, case when exists (select 1 from st, cut where score >= c) then score >= c else st.cluster_id = (select cluster_id from top1) and (select score from top1) >= 0.35 end is_suspicious from st, cut)"""


@query(f"{_GRAPH} {_DENS} select cluster_id, cluster_size, round(structural_density, 6) structural_density, round(weighted_density, 6) weighted_density, round(cluster_density, 6) cluster_density, round(avg_weight, 6) avg_weight from dens")
def cluster_density(spark, d):
    g = _Graph(spark, d)
    rates = scoring.global_rates(g.summary, g.edges)
    return scoring.density(g.clusters, g.edges, rates.p90_weight).select("cluster_id", "cluster_size", _r("structural_density"), _r("weighted_density"), _r("cluster_density"), _r("avg_weight"))


@query(f"{_GRAPH} {_DENS} select cluster_id, round(deg_conc_raw, 6) deg_conc_raw, round(deg_conc, 6) deg_conc from dens")
def degree_concentration(spark, d):
    g = _Graph(spark, d)
    return scoring.density(g.clusters, g.edges, scoring.global_rates(g.summary, g.edges).p90_weight).select("cluster_id", _r("deg_conc_raw"), _r("deg_conc"))


@query(f"{_GRAPH} {_TEMP} select cluster_id, round(temporal_rate_pressure, 6) temporal_rate_pressure, round(temporal_compactness, 6) temporal_compactness, round(temporal_alignment, 6) temporal_alignment, cluster_span_sec, round(temporal_burst, 6) temporal_burst from temp")
def temporal_burst(spark, d):
    g = _Graph(spark, d)
    t = scoring.temporal(g.clusters, g.summary, scoring.global_rates(g.summary, g.edges))
    return t.select("cluster_id", _r("temporal_rate_pressure"), _r("temporal_compactness"), _r("temporal_alignment"), "cluster_span_sec", _r("temporal_burst"))


@query(f"{_GRAPH} {_TEMP}, {_FREQ} select cluster_id, round(high_frequency, 6) high_frequency, round(high_frequency_repeat_ratio, 6) high_frequency_repeat_ratio, round(high_frequency_excess, 6) high_frequency_excess from freq")
def high_frequency(spark, d):
    g = _Graph(spark, d)
    t = scoring.frequency(g.clusters, g.summary, scoring.global_rates(g.summary, g.edges))
    return t.select("cluster_id", _r("high_frequency"), _r("high_frequency_repeat_ratio"), _r("high_frequency_excess"))


_REASON_SQL = "array_to_string(list_transform(list_sort(list_filter([{'v': -cluster_density, 'i': 0, 'l': 'kepadatan cluster tinggi'}, {'v': -temporal_burst, 'i': 2, 'l': 'aktivitas temporal sinkron'}, {'v': -high_frequency, 'i': 3, 'l': 'frekuensi komentar tinggi'}], lambda r: r.v <= -0.45))[1:3], lambda r: r.l), '|')"


@query(f"{_STATS} select cluster_id, round(score, 6) score, is_suspicious from sus")
def cluster_score(spark, d):
    return scoring.suspicion(_Graph(spark, d).stats())[0].select("cluster_id", _r("score"), "is_suspicious")


@query(f"{_STATS} select round(case when exists (select 1 from st, cut where score >= c) then c when (select score from top1) >= 0.35 then (select score from top1) else c end, 6) cutoff from cut")
def suspicious_cutoff(spark, d):
    return spark.createDataFrame([(round(float(scoring.suspicion(_Graph(spark, d).stats())[1]), 6),)], "cutoff double")


@query(f"{_STATS} select cluster_id, case when cluster_size > 1 then {_REASON_SQL} else '' end reasons from st")
def top_reasons(spark, d):
    return _Graph(spark, d).stats().select("cluster_id", F.array_join("reasons", "|").alias("reasons"))


_NODE_SQL = f"""
nst as (select user_id, sum(w) s from (select src user_id, w from inn union all select dst, w from inn) group by 1),
nj as (select c.user_id, c.cluster_id, coalesce(s, 0) strength, comment_count c from clu c left join nst using (user_id) join summ using (user_id)),
nm as (select *, greatest(1, max(strength) over (partition by cluster_id)) ms, greatest(1, max(c) over (partition by cluster_id)) mc from nj),
np as (select nm.*, case when cluster_size > 1 then {_CLAMP.format("0.6 * " + _CLAMP.format("strength / ms") + " + 0.4 * " + _CLAMP.format("c / mc"))} else 0 end prominence, st.score cs, cluster_size from nm join st using (cluster_id)),
ns as (select user_id, cluster_id, strength, prominence, case when cluster_size > 1 then {_CLAMP.format("0.7 * cs + 0.3 * prominence")} else 0 end score from np)"""


@query(f"{_STATS}, {_NODE_SQL} select user_id, cluster_id, round(strength, 6) strength, round(prominence, 6) prominence, round(score, 6) score from ns")
def node_scores(spark, d):
    g = _Graph(spark, d)
    return scoring.node_scores(g.clusters, g.edges, g.summary, g.stats()).select("user_id", "cluster_id", _r("strength"), _r("prominence"), _r("score"))


# all five signals over clusters of the spanning forest; whether an account is new comes from a rule both engines share: its last digit
_FULL = f"""{_BASE.replace("with ", "with recursive ", 1)} {_SUMMARY}, {_FUSED.replace("fused as", "fused_raw as")}, fused as (select src, dst, round(w, 9) w from fused_raw),
e as (select * from fused), n as (select user_id id from summ), {_FOREST}, {_FOREST_CLUSTERS}, clu as (select * from fclu), inn as (select a.cluster_id, e.* from fused e join clu a on a.user_id = e.src join clu b on b.user_id = e.dst where a.cluster_id = b.cluster_id),
{_DENS}, {_TEMP}, {_FREQ}, {_USER_TEXT}, {_tfidf_sql('src_t')}, att_w as (select cluster_id, doc, term, w from weights join clu on user_id = doc),
own_w as (select cluster_id, sum(w * w) o, count(distinct doc) nt from att_w group by 1), wh_w as (select cluster_id, sum(s * s) q from (select cluster_id, term, sum(w) s from att_w group by 1, 2) group by 1),
rep as (select cluster_id, case when nt >= 2 then {_CLAMP.format("(q - o) / (nt * (nt - 1.0))")} else 0 end rp from own_w join wh_w using (cluster_id)),
age as (select cluster_id, avg(case when right(user_id, 1) > '2' then right(user_id, 1)::int % 2 end) av, count(*) filter (where right(user_id, 1) > '2') / count(*) cov from clu group by 1),
st as (select dens.*, temporal_burst, high_frequency, coalesce(rp, 0) content_repetition, case when cluster_size > 1 then av end account_age, case when cluster_size > 1 then cov else 0 end account_age_coverage,
    case when cluster_size > 1 then (0.25 * cluster_density + 0.25 * coalesce(rp, 0) + 0.2 * temporal_burst + 0.15 * coalesce(av, 0) + 0.15 * high_frequency) / (case when av is null then 0.85 else 1 end) else 0 end score
    from dens join temp using (cluster_id) join freq using (cluster_id) join age using (cluster_id) left join rep using (cluster_id)),
cut as (select greatest(0.5, quantile_cont(score, 0.8)) c from st where score > 0), top1 as (select cluster_id, score from st order by score desc, cluster_id limit 1),
sus as (select st.*, case when exists (select 1 from st, cut where score >= c) then score >= c else st.cluster_id = (select cluster_id from top1) and (select score from top1) >= 0.35 end is_suspicious from st, cut)"""
_FULL_REASONS = "array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'v': -coalesce({k}, 0)::double, 'i': {i}, 'l': '{v}'}}" for i, (k, v) in enumerate(scoring.REASONS.items())) + "], lambda r: r.v <= -0.45))[1:3], lambda r: r.l), '|')"


class _Forest(_Graph):
    """The graph with clusters of its spanning forest, content weights and new-account signals."""

    def __init__(self, spark, d):
        super().__init__(spark, d)
        digit = F.substring("user_id", -1, 1)
        self.summary = self.summary.withColumn("new_account_signal", F.when(digit > "2", digit.cast("int") % 2).cast("double"))
        self.edges = self.stage.put(self.edges.select("src", "dst", _r("w", 9)))
        self.clusters = self.stage.put(mst.clusters(self.summary.select(F.col("user_id").alias("id")), self.edges))
        self.weights = _user_weights(spark, d)

    def stats(self) -> DataFrame:
        return self.stage.put(scoring.suspicion(scoring.cluster_stats(self.clusters, self.edges, self.summary, self.weights))[0])


@query(f"""{_FULL} select cluster_id, cluster_size, round(cluster_density, 6) cluster_density, round(content_repetition, 6) content_repetition, round(temporal_burst, 6) temporal_burst, round(high_frequency, 6) high_frequency, round(account_age, 6) account_age,
round(account_age_coverage, 6) account_age_coverage, round(score, 6) score, case when cluster_size > 1 then {_FULL_REASONS} else '' end reasons, is_suspicious from sus""")
def forest_cluster_scores(spark, d):
    signals = [_r(c) for c in ("cluster_density", "content_repetition", "temporal_burst", "high_frequency", "account_age", "account_age_coverage", "score")]
    return _Forest(spark, d).stats().select("cluster_id", "cluster_size", *signals, F.array_join("reasons", "|").alias("reasons"), "is_suspicious")


@query(f"""{_FULL}, {_NODE_SQL}, deg as (select u, count(*) degree, sum(w) strength from (select src u, w from fused union all select dst, w from fused) group by 1)
select ns.user_id, ns.cluster_id, round(ns.score, 6) score, round(ns.prominence, 6) node_prominence, coalesce(nullif(username, ''), ns.user_id) username, coalesce(degree, 0) degree, round(coalesce(deg.strength, 0), 6) strength, round(sus.content_repetition, 6) content_repetition, round(account_age, 6) account_age_ratio
from ns join sus using (cluster_id) join summ using (user_id) left join deg on u = ns.user_id where is_suspicious""")
def suspicious_users(spark, d):
    g = _Forest(spark, d)
    stats = g.stats()
    out = scoring.suspicious_details(g.clusters, g.edges, g.summary, stats, scoring.node_scores(g.clusters, g.edges, g.summary, stats), None)
    return out.select("user_id", "cluster_id", _r("score"), _r("node_prominence"), "username", "degree", _r("strength"), _r("content_repetition"), _r("account_age_ratio"))


@query(f"""{_GRAPH} sy as (select src u, dst v, w from fused union all select dst, src, w from fused),
t as (select *, row_number() over (partition by u order by round(w, 12) desc, v) r from sy qualify r <= 5) select u user_id, string_agg(v, ',' order by r) peers, round(sum(w), 6) weight from t group by 1""")
def suspicious_top_edges(spark, d):
    g = _Graph(spark, d)
    labels = g.summary.select("user_id", F.col("username").alias("label"))
    t = scoring.top_edges(g.edges, g.summary.select("user_id"), labels)
    return t.select("user_id", F.array_join(F.transform("top_edges", lambda x: x["peer_id"]), ",").alias("peers"), F.round(F.aggregate("top_edges", F.lit(0.0), lambda a, x: a + x["weight"]), 6).alias("weight"))


@query(f"""{_GRAPH} m as (select sum(w) m from fused), lc as (select cluster_id, sum(w) l from inn group by 1), dc as (select cluster_id, sum(w) dd from (select src u, w from fused union all select dst, w from fused) join clu on clu.user_id = u group by 1)
select round(sum(coalesce(l, 0) / m - (dd / (2 * m)) ** 2), 6) modularity from dc left join lc using (cluster_id), m""")
def modularity(spark, d):
    g = _Graph(spark, d)
    return metrics.modularity(g.clusters, g.edges).select(_r("modularity"))


@query(f"""{_GRAPH} tot as (select sum(w) t, (select count(*) from clu) nn from fused), i as (select cluster_id, sum(w) i from inn group by 1),
cu as (select cluster_id, sum(w) c from (select a.cluster_id ca, b.cluster_id cb, w from fused e join clu a on a.user_id = e.src join clu b on b.user_id = e.dst where a.cluster_id <> b.cluster_id) x, lateral (select unnest([ca, cb]) cluster_id) group by 1),
z as (select cluster_id, count(*) n from clu group by 1), q as (select cluster_id, coalesce(i, 0) i, coalesce(c, 0) c, t from z left join i using (cluster_id) left join cu using (cluster_id), tot where n >= 2 and n < nn - 1)
select cluster_id, round(c / least(i + c, t - i), 6) conductance from q where least(i + c, t - i) > 0""")
def conductance(spark, d):
    g = _Graph(spark, d)
    return metrics.conductance(g.clusters, g.edges).select("cluster_id", _r("conductance"))


@query(f"""{_GRAPH} asg as (select user_id, min(canopy) canopy from canopy_artifacts where canopy is not null group by 1)
select round(sum(case when a.canopy = b.canopy then w else 0 end) / sum(w), 6) intra_canopy_edge_ratio from fused e left join asg a on a.user_id = e.src left join asg b on b.user_id = e.dst""")
def intra_canopy_ratio(spark, d):
    return metrics.intra_canopy_ratio(_Graph(spark, d).edges, _assignment(spark, d)).select(_r("intra_canopy_edge_ratio"))


@query("with z as (select canopy, count(*) n from canopy_artifacts where canopy is not null group by 1) select count(*) num_groups, round(avg(n), 6) avg_size, max(n) max_size, count(*) filter (where n = 1) singletons from z")
def group_size_summary(spark, d):
    return metrics.group_sizes(_table(spark, d, "canopy_artifacts").where("canopy is not null"), "canopy").select("num_groups", _r("avg_size"), "max_size", "singletons")


@query(f"""{_STATS} select cluster_id, cluster_size, round(score, 6) score, case when score >= 0.75 then 'high' when score >= 0.55 then 'medium' else 'low' end tier, case when score >= 0.5 then 'suspicious' else 'normal' end label from st order by score desc, cluster_size desc, cluster_id limit 5""")
def top_clusters(spark, d):
    s = _Graph(spark, d).stats().orderBy(F.desc("score"), F.desc("cluster_size"), "cluster_id").limit(5)
    return s.select("cluster_id", "cluster_size", _r("score"), metrics.risk_tier(F.col("score")).alias("tier"), metrics.suspicion_label(F.col("score")).alias("label"))


@query(f"""{_STATS}, {_NODE_SQL}, r as (select cluster_id, user_id, row_number() over (partition by cluster_id order by c desc, user_id) k from nj qualify k <= 4), a as (select cluster_id, string_agg(user_id, ',' order by k) top_accounts from r group by 1),
t as (select cluster_id, sum(comment_count)::bigint comments from clu join summ using (user_id) group by 1) select cluster_id, cluster_size, comments, top_accounts from st join a using (cluster_id) join t using (cluster_id)""")
def cluster_rollup_report(spark, d):
    g = _Graph(spark, d)
    at = g.clusters.join(g.summary.select("user_id", "comment_count"), "user_id")
    top = at.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("comment_count"), "user_id"))).where("k <= 4")
    names = top.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "user_id"))), lambda x: x["user_id"]), ",").alias("top_accounts"))
    return at.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"), F.sum("comment_count").alias("comments")).join(names, "cluster_id").select("cluster_id", "cluster_size", "comments", "top_accounts")


# --- links, reports, other -------------------------------------------------------------------------


@query("""select video_id, coalesce(nullif(regexp_extract(video_url, '/video/(\\d{5,25})', 1), ''), nullif(regexp_extract(video_url, '/photo/(\\d{5,25})', 1), ''), '') found_id,
lower(regexp_extract(video_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) host, coalesce(nullif(regexp_extract(video_url, '/@([^/?#]+)', 1), ''), 'tiktok') username from snapshots""")
def page_ids(spark, d):
    u = F.col("video_url")
    return _table(spark, d, "snapshots").select("video_id", urls.video_id(u).alias("found_id"), urls.host(u).alias("host"), urls.username(u).alias("username"))


_UNQUOTED = "replace(replace(case when regexp_matches(coalesce(text, ''), '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') then coalesce(text, '') else url_decode(replace(coalesce(text, ''), '+', '%2B')) end, chr(92) || 'u002F', '/'), chr(92) || '/', '/')"
_IN_PAGE = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{x.replace(chr(39), chr(39) * 2)}', 1), '')" for x in urls.IN_PAGE) + ", '')"


@query(f"with p as (select doc_id, {_UNQUOTED} t from documents) select doc_id, {_IN_PAGE} found_id from p")
def ids_in_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", urls.video_id_in_page(F.col("text")).alias("found_id"))


@query("""with r as (select video_url, max(saved_at) saved_at from snapshots group by 1) select video_url, saved_at from r order by saved_at desc, video_url limit 8""")
def run_history(spark, d):
    r = _table(spark, d, "snapshots").groupBy("video_url").agg(F.max("saved_at").alias("saved_at"))
    return r.orderBy(F.desc("saved_at"), "video_url").limit(8)


# runs by method (share of accounts kept) and size; their measures come from the summaries, so SQL can follow
@query(f"""{_BASE} {_SUMMARY}, r as (select case when comment_count >= 3 then 'busy' else 'quiet' end method, ntile_ size, comment_count, total_likes, last_timestamp - first_timestamp span from (select *, right(user_id, 1)::int % 3 ntile_ from summ))
select method, size, round(avg(comment_count), 6) comment_count, round(avg(total_likes), 6) total_likes, round(avg(span), 6) span from r group by 1, 2""")
def method_comparison(spark, d):
    s = parse.user_summary(_records(spark, d))
    rows = s.select(
        F.when(F.col("comment_count") >= 3, "busy").otherwise("quiet").alias("method"), (F.substring("user_id", -1, 1).cast("int") % 3).alias("size"), "comment_count", "total_likes", (F.col("last_timestamp") - F.col("first_timestamp")).alias("span")
    )
    return metrics.averages(rows, ["method", "size"], ["comment_count", "total_likes", "span"]).select("method", "size", _r("comment_count"), _r("total_likes"), _r("span"))


@query(f"{_BASE} {_SUMMARY} select user_id, comment_count, reply_count, mention_count, total_likes, first_timestamp, last_timestamp from summ")
def stream_user_summary(spark, d):
    schema = _table(spark, d, "comments").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/comment[s].parquet")
    base = _stage(spark).base
    run = summaries.run_to_table(summaries.user_summary(stream), f"{base}/table", checkpoint=f"{base}/checkpoint")
    run.processAllAvailable()
    run.stop()
    return spark.read.parquet(f"{base}/table").select("user_id", "comment_count", "reply_count", "mention_count", "total_likes", "first_timestamp", "last_timestamp")


@query()
def full_pipeline(spark, d):
    return pipeline.analyze(_table(spark, d, "comments"), Params(max_comments=None)).cluster_stats
