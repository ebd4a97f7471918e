"""How new a cluster or a statement is against the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maths import clamp01
from .bridges import round4
from .inverted import nearest_within

#: A statement nearer than this to a chunk of the corpus isn't new (fixed value).
MOST_SIMILAR = 0.92


def cluster_novelty(clusters: DataFrame, cluster_col: str, docs_col: str, keywords_col: str) -> DataFrame:
    """(cluster, novelty): the mean of how small a cluster is against the
    largest and how rare its keywords are among clusters (D09).

    Keywords are lower-cased, what isn't a Latin or Russian letter or a digit is
    a blank between them; they count once, empty ones not at all. Without keywords their part is 0.5; with one cluster, or
    no documents at all, the novelty is 0.5."""
    key = F.trim(F.regexp_replace(F.lower("k"), "[^a-zа-я0-9]+", " "))
    clusters = clusters.select(F.col(cluster_col).alias("cluster"), F.coalesce(F.col(docs_col), F.lit(0)).alias("docs"), F.col(keywords_col).alias("kws"))
    each = clusters.select(F.col("cluster").alias("c"), F.explode("kws").alias("k")).select("c", key.alias("k")).where("k <> ''").distinct()
    share = each.groupBy("k").agg(F.count("*").alias("in"))
    whole = clusters.agg(F.count("*").alias("clusters"), F.max("docs").alias("most"))
    sums = each.join(share, "k").groupBy("c").agg(F.avg("in").alias("in"))
    rows = clusters.select("cluster", "docs").join(sums, F.col("cluster") == F.col("c"), "left").join(F.broadcast(whole))
    size = 1 - F.col("docs") / F.col("most")
    rare = F.coalesce(1 - F.col("in") / F.col("clusters"), F.lit(0.5))
    known = (F.col("clusters") > 1) & (F.col("most") > 0)
    return rows.select(F.col("cluster").alias(cluster_col), F.when(known, round4(clamp01((size + rare) / 2))).otherwise(0.5).alias("novelty"))


def novelty_probe(statements: DataFrame, chunks: DataFrame, id_col: str, vector_col: str, owner_col: str, most: float = MOST_SIMILAR) -> DataFrame:
    """(probe, top_sim, nearest, share_read, novel): the nearest chunk of the
    statement's owner (D10); new if no chunk is as near as ``most``. Statements:
    (probe, owner, vector); one without a usable vector can't be probed and is
    not new."""
    found = nearest_within(statements, chunks, id_col, vector_col, owner_col)
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0)
    asked = statements.select(F.col("probe").alias("p"), usable.alias("usable"))
    return found.join(asked, F.col("probe") == F.col("p")).select("probe", "top_sim", "nearest", "share_read", (F.col("usable") & (F.col("top_sim") < most)).alias("novel"))
