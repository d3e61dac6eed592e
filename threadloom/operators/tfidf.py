"""TF-IDF with the n-gram range and document-frequency floor chosen on a grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import normalized_tokens
from threadloom.operators.ranking import global_rank
from threadloom.runtime import Stage

MAX_FEATURES = 20_000
MAX_DF = 0.95
NGRAMS = (3, 2, 1)
#: Positions of one document that are put in order together.
CHUNK = 100_000


def token_rows(texts: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """(doc, pos, toks) of pieces of documents with at least one token; pos must be unique within a document."""
    rows = texts.select(F.col(doc).cast("string").alias("doc"), F.col(pos).cast("long").alias("pos"), normalized_tokens(F.col(text)).alias("toks"))
    return rows.where(F.size("toks") > 0)


def _following(rows: DataFrame) -> DataFrame:
    """``rows`` with the next two tokens of the document after each piece.

    Pieces are put in order within chunks of positions, then the chunks' first tokens among
    themselves, so that a document of any length is no one task's.
    """
    rows = rows.withColumn("chunk", F.expr(f"pos div {CHUNK}")).withColumn("head", F.slice("toks", 1, 2))
    two = lambda a, b: F.slice(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), 1, 2)
    w = Window.partitionBy("doc", "chunk").orderBy("pos")
    rows = rows.withColumn("next", two(F.lead("head", 1).over(w), F.lead("head", 2).over(w)))
    first = rows.groupBy("doc", "chunk").agg(F.min_by(two(F.col("head"), F.col("next")), "pos").alias("h"))
    c = Window.partitionBy("doc").orderBy("chunk")
    after = first.select("doc", "chunk", two(F.lead("h", 1).over(c), F.lead("h", 2).over(c)).alias("beyond"))
    return rows.join(after, ["doc", "chunk"]).select("doc", "toks", two(F.col("next"), F.col("beyond")).alias("next"))


def term_counts(rows: DataFrame, n_max: int = 3) -> DataFrame:
    """(doc, term, n, tf): counts of n-grams of 1 to n_max tokens, across a document's pieces."""
    if n_max == 1:
        return rows.select("doc", F.explode("toks").alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("n", F.lit(1))
    grams = F.transform(
        F.sequence(F.lit(1), F.size("toks")),
        lambda i: F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(n_max)), lambda n: i + n - 1 <= F.size("toks") + F.least(F.size("next"), F.lit(n_max - 1))),
            lambda n: F.struct(n.alias("n"), F.array_join(F.slice(F.concat("toks", "next"), i, n), " ").alias("term")),
        ),
    )
    return _following(rows).select("doc", F.explode(F.flatten(grams)).alias("g")).groupBy("doc", F.col("g.n").alias("n"), F.col("g.term").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class Fitted:
    """weights(doc, term, w), unit length by document, and the choice that made them."""

    weights: DataFrame
    vocabulary: DataFrame
    n_docs: int
    n_features: int
    ngram_max: int
    min_df: int
    grid: list[tuple[int, int, int, int]]  # (n-gram maximum, min_df, entries, features)


def min_df_values(n_docs: int) -> list[int]:
    return [1] if n_docs < 30 else [1, 2] if n_docs < 80 else [2, 1]


def fit(rows: DataFrame, min_docs: int = 1, ngrams: tuple[int, ...] = NGRAMS, max_features: int = MAX_FEATURES, max_df: float = MAX_DF) -> Fitted | None:
    """Best of the grid by (entries, features, n-gram maximum, -min_df); null if fewer than ``min_docs`` documents have tokens.

    Of equal total counts at the feature limit the smaller terms are kept. The vocabulary is at most
    ``max_features`` terms, whatever the corpus.
    """
    stage = Stage(rows.sparkSession, "tfidf")
    counts = stage.put(term_counts(rows, max(ngrams)))
    n_docs = counts.select("doc").distinct().count()
    if not n_docs or n_docs < min_docs:
        return None
    terms = stage.put(counts.groupBy("term", "n").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")))
    share = 1.0 if n_docs < 30 else max_df
    options = [(top, low) for top in ngrams for low in min_df_values(n_docs)]
    allowed = [(F.col("n") <= top) & (F.col("df") >= low) & (F.col("df") <= share * n_docs) for top, low in options]
    # one pass counts all options; only those beyond the feature limit need an order
    whole = terms.agg(*[x for i, c in enumerate(allowed) for x in (F.coalesce(F.sum(F.when(c, F.col("df"))), F.lit(0)).alias(f"e{i}"), F.count_if(c).alias(f"f{i}"))]).first()
    best, grid = None, []
    for i, (top, low) in enumerate(options):
        kept, entries, features = terms.where(allowed[i]), whole[f"e{i}"], whole[f"f{i}"]
        if features > max_features:
            kept = kept.orderBy(F.desc("total"), "term").limit(max_features)
            entries, features = kept.agg(F.sum("df"), F.count(F.lit(1))).first()
        grid.append((top, low, entries, features))
        key = (entries, features, top, -low)
        if features and (best is None or key > best[0]):
            best = (key, kept, top, low)
    if best is None:
        return None
    _, kept, top, low = best
    index = F.row_number().over(Window.orderBy("term")) - 1  # at most max_features rows
    vocabulary = stage.put(kept.select("term", "df", (F.ln((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf")).withColumn("idx", index.cast("int")))
    return Fitted(stage.put(_weights(counts, vocabulary)), vocabulary, n_docs, best[0][1], top, low, grid)


def _weights(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    raw = counts.join(F.broadcast(vocabulary), "term").select("doc", "term", "idx", (F.col("tf") * F.col("idf")).alias("w"))  # bounded by the feature limit
    norms = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "doc").select("doc", "term", "idx", (F.col("w") / F.col("norm")).alias("w"))


def unigram_weights(rows: DataFrame) -> DataFrame:
    """(doc, term, w) of all single tokens of token rows, without floor or limit."""
    return weights_of(term_counts(rows, 1).select("doc", "term", "tf"))


def raw_counts(texts: DataFrame, doc: str, text: str, normal, keep, stage: Stage | None = None) -> DataFrame:
    """(doc, term, tf) of the plain tokens of texts, made normal by ``normal(token)`` once for each distinct token, and kept where ``keep(term)``."""
    raw = texts.select(F.col(doc).cast("string").alias("doc"), F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))).alias("token"))
    stage = stage or Stage(texts.sparkSession, "tokens")
    counts = stage.put(raw.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("c")))
    # as tables, else the optimizer moves what keeps a term below the distinct and to the join's other side, to all rows of both
    tokens = stage.put(counts.select("token").distinct())
    terms = stage.put(tokens.select("token", normal(F.col("token")).alias("term")).where(keep(F.col("term"))))
    named = stage.put(counts.join(terms, "token").select("doc", "term", "c"))
    for table in (counts, tokens, terms):
        stage.drop(table)
    return named.groupBy("doc", "term").agg(F.sum("c").alias("tf"))


def weights_of(counts: DataFrame) -> DataFrame:
    """(doc, term, w), of unit length by document, of counts (doc, term, tf)."""
    counts = Stage(counts.sparkSession, "tfidf").put(counts)
    n = counts.select("doc").distinct().count()
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = counts.join(df, "term").select("doc", "term", (F.col("tf") * (F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1.0)).alias("w"))
    norms = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))


def vectors_of(counts: DataFrame) -> tuple[DataFrame, int]:
    """(id, idx, val) with the weights of ``weights_of`` by term number, of a table of counts, and how many terms there are."""
    stage = Stage(counts.sparkSession, "vectors")
    n = counts.select("doc").distinct().count()
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = stage.put(global_rank(df, ["term"], stage, "i").select("term", "df", F.col("i").cast("int").alias("idx")))
    raw = counts.join(terms, "term").select("doc", "idx", (F.col("tf") * (F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1.0)).alias("w"))
    # the norm as an aggregate: of the array, it would be computed again for each element
    packed = raw.groupBy(F.col("doc").alias("id")).agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("e"), F.sum(F.col("w") * F.col("w")).alias("n"))
    return stage.put(packed.select("id", F.transform("e", lambda x: x["idx"]).alias("idx"), F.transform("e", lambda x: x["w"] / F.sqrt("n")).alias("val"))), terms.count()


def vectors(weights: DataFrame) -> DataFrame:
    """(id, idx, val) sparse vectors of weights(doc, idx, w); a document has at most the vocabulary's entries."""
    packed = weights.groupBy(F.col("doc").alias("id")).agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("e"))
    return packed.select("id", F.transform("e", lambda x: x["idx"]).alias("idx"), F.transform("e", lambda x: x["w"]).alias("val"))


def mean_pairwise(weights: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, n_text, similarity): mean cosine over pairs of a cluster's documents, cut to 0..1; 0 for fewer than two.

    From the squared length of the cluster's summed vector, so no pair is formed.
    """
    at = weights.join(members.select("cluster_id", F.col("user_id").alias("doc")), "doc")
    own = at.groupBy("cluster_id").agg(F.sum(F.col("w") * F.col("w")).alias("own"), F.count_distinct("doc").alias("n_text"))
    sums = at.groupBy("cluster_id", "term").agg(F.sum("w").alias("s")).groupBy("cluster_id").agg(F.sum(F.col("s") * F.col("s")).alias("whole"))
    n = F.col("n_text").cast("double")
    mean = F.when(F.col("n_text") >= 2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("whole") - F.col("own")) / (n * (n - 1))))).otherwise(F.lit(0.0))
    return own.join(sums, "cluster_id").select("cluster_id", "n_text", mean.alias("similarity"))
