"""A forest of groups of vectors, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Saved, scope
from .communities import communities
from .graph import components, mutual_graph
from .vectors import knn, vector_sum


def sized_components(edges: DataFrame, nodes: DataFrame | None = None, min_size: int = 2) -> DataFrame:
    """(node, component, size): components of at least ``min_size`` nodes, the
    largest first, ties by smallest node (G13)."""
    with scope() as tables:
        labels = components(edges, nodes)
        sizes = labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
        found = Saved(labels.join(sizes, "component").select("node", "component", "size"), "components")
        return tables.keep(found).orderBy(F.desc("size"), "component", "node")


def hierarchy(vectors: DataFrame, id_col: str, vector_col: str, k: int = 6, floor: float = 0.0, min_size: int = 2, most_levels: int | None = None) -> DataFrame:
    """(level, node, parent, n_children, n_leaves): every vector is a node of
    level 0; a node of a higher level is named by its smallest leaf (G14).

    The groups of level 1 are communities of the mutual neighbour graph, those
    above are its components; the vector of a group is the mean of its leaves'
    of length one. Groups of fewer than ``min_size`` aren't made, and their
    nodes have no parent, so each leaf has one root. It ends when a level has no
    group, fewer than ``min_size`` nodes, or after ``most_levels``; as each
    level has at most half of the nodes below, that is soon. Vectors without
    length or finite components, and null ids, are left out.
    """
    from .inverted import unit_vectors

    with scope() as tables:
        now = unit_vectors(vectors, id_col, vector_col).dropDuplicates(["id"])
        now = Saved(now.select(F.col("id").cast("long").alias("id"), F.col("v").alias("sum"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("kids")), "level").df
        done, level = [], 0
        while True:
            name = [F.lit(level).alias("level"), F.col("id").alias("node")]
            counts = [F.col("kids").alias("n_children"), F.col("n").alias("n_leaves")]
            few = now.count() < min_size or (most_levels is not None and level >= most_levels)
            parents = None
            if not few:
                edges = Saved(mutual_graph(knn(now, k, "id", "sum", floor), floor), "level-edges").df
                groups = communities(edges).members.withColumnRenamed("community", "component") if not level else sized_components(edges, None, min_size)
                parents = Saved(groups.where(F.col("size") >= min_size).select(F.col("node").alias("id"), F.col("component").alias("parent")), "level-parents").df
            if parents is None or not parents.head(1):
                done.append(now.select(*name, F.lit(None).cast("long").alias("parent"), *counts))
                break
            placed = Saved(now.join(parents, "id", "left"), "level-placed").df
            done.append(placed.select(*name, "parent", *counts))
            held = placed.where("parent IS NOT NULL")
            sums = vector_sum(held, ["parent"], "sum", F.lit(1.0)).select("parent", F.col("sum_v").alias("sum"))
            counted = held.groupBy("parent").agg(F.sum("n").alias("n"), F.count("*").alias("kids"))
            now = Saved(counted.join(sums, "parent").select(F.col("parent").alias("id"), "sum", "n", "kids"), "level").df
            level += 1
        whole = done[0]
        for x in done[1:]:
            whole = whole.unionByName(x)
        return tables.keep(Saved(whole, "hierarchy"))
