"""Lexical and hybrid retrieval, and its quality metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Saved, scope


#: Most asked terms that travel to all tasks.
ASKED = 100_000


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score): BM25 of documents for queries.

    ``docs``: (doc, tokens), all tokens of a document in one or several arrays;
    ``queries``: (query, token), distinct. A document's length is the size of
    its arrays; of its tokens only those that some query asks for leave the task
    (up to 100000 asked ones are broadcast), and one empty token more that
    carries the size, so texts are split once and what is shuffled are hits."""
    with scope() as tables:
        some = queries.select("token").where("token <> ''").distinct()
        asked = Saved(some.unionByName(some.sparkSession.range(1).select(F.lit("").alias("token"))), "bm25-asked").df
        few = asked.count() <= ASKED
        whole = F.filter("tokens", lambda t: t != "")
        each = docs.select("doc", F.size("tokens").alias("n"), F.explode(F.concat(whole, F.array(F.lit("")))).alias("token"))
        hits = each.join(F.broadcast(asked) if few else asked, "token", "left_semi")
        found = Saved(hits.groupBy("doc", "token").agg(F.count("*").alias("tf"), F.sum("n").alias("size")), "bm25").df
        tf, sizes = found.where("token <> ''").select("doc", "token", "tf"), found.where("token = '' AND size > 0").select("doc", "size")
        return tables.keep(Saved(bm25_scores(tf, sizes, queries, k1, b), "bm25-scores"))


def bm25_scores(tf: DataFrame, sizes: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score) from all frequencies (doc, token, tf) of the asked
    tokens and all documents' sizes (doc, size)."""
    whole = sizes.agg(F.avg("size").alias("avg"), F.count("*").alias("n"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    parts = tf.join(df, "token").join(queries, "token").join(sizes, "doc").join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("avg")))
    return parts.groupBy("query", "doc").agg(F.sum(part).alias("score"))


def depth(k: int = 5, times: int = 4, least: int = 20) -> int:
    """How many hits to fetch for k results."""
    return max(k * times, least)


def ranked(hits: DataFrame, keys: list[str], score: str, tie: str, most: int) -> DataFrame:
    """``hits`` with a 0-based ``rank`` within keys, the first ``most``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return hits.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < most)


def best_of_all(hits: DataFrame, score: str, tie: str, most: int) -> DataFrame:
    """``hits`` with a 0-based ``rank``, the first ``most`` of one list: each task
    keeps its first ones, and only these are numbered in one place."""
    first = hits.orderBy(F.desc(score), tie).limit(most)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)) - 1)


def fuse(lists: list[tuple[DataFrame, float]], keys: list[str], id_col: str, constant: int = 60, fill: list[str] | None = None) -> DataFrame:
    """(keys, id, score, first_list, first_rank, origins): weighted reciprocal
    rank fusion of ranked lists, ranks from 0 (W01, J06). Each column of
    ``fill`` comes from the first list in which it isn't null or empty."""
    fill = fill or []
    parts = [df.select(*keys, id_col, "rank", F.lit(i).alias("lst"), (F.lit(w) / (constant + F.col("rank"))).alias("part"), *fill) for i, (df, w) in enumerate(lists)]
    every = reduce(DataFrame.unionByName, parts)
    some = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("lst"))
    return every.groupBy(*keys, id_col).agg(
        F.sum("part").alias("score"), F.min(F.struct("lst", "rank")).alias("f"), F.array_sort(F.collect_set("lst")).alias("origins"), *[F.min_by(c, some(c)).alias(c) for c in fill]
    ).select(*keys, id_col, "score", F.col("f.lst").alias("first_list"), F.col("f.rank").alias("first_rank"), "origins", *fill)


def cap_per_document(hits: DataFrame, keys: list[str], doc: str, order: list[Column], k: int, most: int = 4) -> DataFrame:
    """The first k hits with at most ``most`` of a document, filled up from what
    was put off; hits without a document aren't capped (W03)."""
    walk = Window.partitionBy(*keys).orderBy(*order)
    within = Window.partitionBy(*keys, doc).orderBy(*order)
    hits = hits.withColumn("_pos", F.row_number().over(walk)).withColumn("_nth", F.row_number().over(within))
    late = (F.col("_nth") > most) & F.col(doc).isNotNull() & (F.col(doc).cast("string") != "")
    take = Window.partitionBy(*keys).orderBy(late, "_pos")
    return hits.withColumn("_take", F.row_number().over(take)).where(F.col("_take") <= k).drop("_take", "_pos", "_nth")


def cap_whole_list(hits: DataFrame, doc: str, order: list[Column], k: int, most: int = 4) -> DataFrame:
    """``cap_per_document`` for one list of any length (W03): what can be taken is
    among the first k of the documents' first ``most`` hits, or among the first
    2k of all; only these meet in one task."""
    walk = Window.partitionBy(doc).orderBy(*order)
    early = hits.withColumn("_n", F.row_number().over(walk)).where(F.col("_n") <= most).drop("_n").orderBy(*order).limit(k)
    short = early.unionByName(hits.orderBy(*order).limit(2 * k)).distinct().withColumn("_all", F.lit(0))
    return cap_per_document(short, ["_all"], doc, order, k, most).drop("_all")


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, hit, rr, ndcg) for one relevant document a query."""
    got = relevant.join(hits.where(F.col("rank") < k), ["query", "doc"], "left").groupBy("query").agg(F.min("rank").alias("rank"))
    found = F.col("rank").isNotNull()
    return got.select(
        "query", F.when(found, 1.0).otherwise(0.0).alias("hit"), F.when(found, 1 / (F.col("rank") + 1)).otherwise(0.0).alias("rr"), F.when(found, 1 / F.log2(F.col("rank") + 2)).otherwise(0.0).alias("ndcg")
    )


def best_overlap(fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """(fragment, source, common): the source that shares most tokens with each
    fragment, the smaller source on ties, none without a common token (J19).
    Both: (fragment or source, tokens)."""
    a = fragments.select("fragment", F.explode(F.array_distinct("tokens")).alias("t"))
    b = sources.select("source", F.explode(F.array_distinct("tokens")).alias("t"))
    common = a.join(b, "t").groupBy("fragment", "source").agg(F.count("*").alias("common"))
    first = Window.partitionBy("fragment").orderBy(F.desc("common"), "source")
    return common.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
