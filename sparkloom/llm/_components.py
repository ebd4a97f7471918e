"""Connected components by distributed label propagation over saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Saved


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is
    its smallest node.

    Alternates large-star and small-star steps: each node's larger neighbours
    (then its smaller ones) are attached to its smallest neighbour, until the
    links no longer change. Rounds grow with the logarithm of the graph's
    diameter; every round is a saved table, so nothing is recomputed and no
    link reaches the driver. Smallest neighbours come from partial aggregates
    and joins Spark can split, so a hub needs no task of its own.
    """
    state = Saved(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    seen = mark_of(state.df)
    while True:  # each round but the last joins some node to a smaller one
        both = state.df.unionByName(state.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = Saved(large.distinct(), "large-star")
        # small star: every u has only smaller v here
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        after = Saved(small.distinct(), "small-star")
        large.drop()
        mark = mark_of(after.df)
        state.drop()
        state = after
        if mark == seen:
            break
        seen = mark
    roots = state.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.df.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(roots)
