"""Answering questions from chunks: hybrid retrieval, fusion, reranking, caps,
abstention and extractive answers as one chain of joins and windows; and further
evidence from a graph of documents."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import clip, collapse, sanitise_citations, token_set
from ..tables import Saved, scope
from .board import expand_summaries
from .graph import pagerank
from .inverted import unit_vectors
from .retrieval import bm25, cap_per_document, depth, fuse, ranked
from .vectors import _block_top

#: Chunks of a document that the graph brings in, and documents it names. Fixed values.
GRAPH_CHUNKS, GRAPH_DOCS = 3, 5
#: Vectors in a block of the search for questions.
BLOCK = 4096


def token_overlap(question: Column, chunk: Column) -> Column:
    """The share of a question's tokens that a chunk has: the ranker where no model is at hand."""
    asked = token_set(question)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, token_set(chunk))) / F.size(asked)).otherwise(0.0)


def dense_hits(questions: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(query, chunk, cos): the ``most`` chunks nearest to each question's
    vector by cosine, to nine places, ties to the smaller chunk. Both in blocks
    of about 4096, a pair of blocks in a task. ``questions``: (query, vector);
    ``chunks``: (chunk, vector); those without a usable vector have none."""
    left = Saved(unit_vectors(questions, "query", "vector").select((-F.col("id") - 1).alias("id"), "v"), "dense-questions").df  # below 0, so that no id is met by itself
    right = Saved(unit_vectors(chunks, "chunk", "vector"), "dense-chunks").df
    n, m = (max(1, math.ceil(x.count() / BLOCK)) for x in (left, right))
    bucket = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.select(bucket(n).alias("x"), each(m).alias("y"), "id", "v").groupBy("x", "y")
    b = right.select(each(n).alias("x"), bucket(m).alias("y"), "id", "v").groupBy("x", "y")
    found = a.cogroup(b).applyInPandas(_block_top(most, -2.0, False), "src long, dst long, cos double")
    order = Window.partitionBy("src").orderBy(F.desc("cos"), "dst")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return best.select((-F.col("src") - 1).alias("query"), F.col("dst").alias("chunk"), "cos")


def retrieve(questions: DataFrame, chunks: DataFrame, tokens: Callable[[Column], Column], k: int = 5) -> DataFrame:
    """(query, chunk, score, rank, origins): dense and lexical hits of twice as
    deep lists, fused by reciprocal ranks (R01). A question without a usable
    vector goes by words alone."""
    deep = depth(k)
    dense = ranked(dense_hits(questions, chunks, deep), ["query"], "cos", "chunk", deep)
    asked = questions.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    words = bm25(chunks.select(F.col("chunk").alias("doc"), tokens(F.col("text")).alias("tokens")), asked)
    words = words.select("query", F.col("doc").alias("chunk"), F.round("score", 6).alias("score"))
    lexical = ranked(words, ["query"], "score", "chunk", deep)
    fused = fuse([(dense, 1.0), (lexical, 1.0)], ["query"], "chunk").withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first_list", "first_rank")
    return fused.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < deep).select("query", "chunk", "score", "rank", "origins")


def answers(questions: DataFrame, chunks: DataFrame, tokens: Callable[[Column], Column], ranker: Callable[[Column, Column], Column] | None = token_overlap, k: int = 5, floor: float = 0.5, per_document: int = 4) -> DataFrame:
    """(query, answer, sources, top, abstained): an answer from sources for each
    question (R01).

    ``questions``: (query, text, vector); ``chunks``: (chunk, doc, title, text,
    vector, members), ``members`` the chunks a summary stands for, or null.
    Retrieved chunks are ranked anew (without a ``ranker``, or where it gives no
    score for one of them, the fused order stays), at most ``per_document`` of a
    document are among the first ``k`` while there are others, and summaries
    give way to their members. Nothing is answered without sources, or if the
    best reranked one is below ``floor``; else the answer is the heads of the
    first sources, each cited by its number. Each question has a row.
    """
    with scope() as tables:
        found = Saved(retrieve(questions, chunks, tokens, k), "answer-found").df
        texts = chunks.select("chunk", "doc", "title", "text", "members")
        asked = questions.select("query", F.col("text").alias("question"))
        hits = found.join(texts, "chunk").join(asked, "query")
        score = ranker(F.col("question"), F.col("text")).cast("double") if ranker else F.lit(None).cast("double")
        hits = hits.withColumn("worth", score)
        all_ = F.bool_and(F.col("worth").isNotNull()).over(Window.partitionBy("query"))
        hits = Saved(hits.withColumn("reranked", all_), "answer-hits").df
        order = [F.when(F.col("reranked"), F.col("worth")).desc_nulls_last(), F.col("rank").asc()]
        kept = cap_per_document(hits, ["query"], "doc", order, k, per_document)
        final = F.row_number().over(Window.partitionBy("query").orderBy(*order))
        kept = Saved(kept.withColumn("place", final), "answer-kept").df
        top = kept.groupBy("query").agg(F.max("worth").alias("top"), F.bool_and("reranked").alias("reranked"))
        leaves = expand_summaries(kept, ["query"], "chunk", "members", "place", "worth").select("query", F.col("chunk").alias("leaf"), F.col("place").alias("n"))
        shown = leaves.join(texts.select(F.col("chunk").alias("leaf"), "title", "text"), "leaf")
        source = F.struct("n", F.col("leaf").alias("chunk"), F.coalesce("title", F.lit("")).alias("title"), clip(collapse(F.coalesce("text", F.lit(""))), 200, "…").alias("snippet"))
        listed = shown.groupBy("query").agg(F.array_sort(F.collect_list(source)).alias("s"))
        whole = asked.join(top, "query", "left").join(listed, "query", "left")
        n = F.coalesce(F.size("s"), F.lit(0))
        silent = scoring.abstain(F.when(F.col("s").isNull(), 0).otherwise(n), F.col("top"), F.coalesce("reranked", F.lit(False)), floor)
        lines = F.transform(F.slice("s", 1, 3), lambda x, i: F.concat(F.lit("[S "), (i + 1).cast("string"), F.lit("] "), x["title"], F.lit(": "), x["snippet"]))
        sources = F.coalesce(F.transform("s", lambda x: x["chunk"]), F.array().cast("array<long>"))
        text = F.when(~silent, F.array_join(lines, "\n"))
        return tables.keep(Saved(whole.select("query", text.alias("answer"), sources.alias("sources"), "top", F.coalesce(silent, F.lit(True)).alias("abstained")), "answers"))


def checked(answered: DataFrame, answer: str, sources: str) -> DataFrame:
    """``answered`` with citations beyond its sources taken out, and ``uncited``:
    there are sources, and it cites none (R01, T15)."""
    clean = sanitise_citations(F.col(answer), F.size(sources))
    return answered.withColumn(answer, clean).withColumn("uncited", (F.size(sources) > 0) & ~F.col(answer).rlike("\\[S\\s*\\d{1,4}\\]"))


def graph_evidence(hits: DataFrame, edges: DataFrame, chunks: DataFrame, question: Column, ranker: Callable[[Column, Column], Column] = token_overlap, documents: int = GRAPH_DOCS, per_document: int = GRAPH_CHUNKS) -> DataFrame:
    """(chunk, doc, worth, from_graph): one question's hits (chunk, doc, worth)
    and the first chunks of documents near theirs in the graph (R06).

    PageRank starts from the hits' documents; of the ``documents`` best ranked,
    those not among them give their first ``per_document`` chunks, ranked by the
    same ranker; all in the order of worth, earlier hits first among equals.
    ``chunks``: (chunk, doc, index, text)."""
    with scope() as tables:
        have = Saved(hits.select("doc").where("doc IS NOT NULL").distinct(), "graph-have").df
        scores = pagerank(edges, have.select(F.col("doc").alias("node")))
        named = scores.orderBy(F.round("score", 9).desc(), "node").limit(documents).select(F.col("node").alias("doc")).join(have, "doc", "left_anti")
        first = Window.partitionBy("doc").orderBy("index")
        extra = chunks.join(F.broadcast(named), "doc").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_document)
        extra = extra.join(hits.select("chunk"), "chunk", "left_anti").select("chunk", "doc", ranker(question, F.col("text")).alias("worth"), F.lit(True).alias("from_graph"))
        both = hits.select("chunk", "doc", "worth", F.lit(False).alias("from_graph")).unionByName(extra)
        return tables.keep(Saved(both, "graph-evidence")).orderBy(F.desc("worth"), "from_graph", "chunk")
