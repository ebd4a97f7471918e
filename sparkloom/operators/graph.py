"""Graph analytics over edge tables (src, dst, weight) with src < dst."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import edge_weight
from ..tables import Saved, scope


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the folder all executors share."""
    return Saved(df, f"graph-{name}").df


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def mutual_graph(neighbours: DataFrame, floor: float, mutual: bool = True) -> DataFrame:
    """Edges between vectors that are near enough, and (``mutual``) each among
    the other's neighbours (G01, J08)."""
    near = neighbours.where(F.col("cos") >= floor)
    pairs = near.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("cos").alias("cos"), F.count("*").alias("n"))
    return pairs.where("n = 2" if mutual else "n >= 1").select("src", "dst", "cos", edge_weight(F.col("cos")).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("src").agg(F.sum("weight").alias("degree"), F.count("*").alias("links")).withColumnRenamed("src", "node")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, term): inside / m - (degree / 2m)^2 for each community.
    ``members``: (node, community)."""
    total = edges.agg(F.sum("weight").alias("m"))
    a = members.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = members.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inside = edges.join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    by = degrees(edges).join(members, "node").groupBy("community").agg(F.sum("degree").alias("deg"))
    terms = by.join(inside, "community", "left").join(F.broadcast(total))
    return terms.select("community", (F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)).alias("term"))


def cross_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, n, weight): edges between each unordered pair of communities."""
    x = members.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    y = members.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    return edges.join(x, "src").join(y, "dst").where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, node): the nodes next to both ends of each pair."""
    both = both_ways(edges).select("src", F.col("dst").alias("node"))
    left = pairs.join(both.withColumnRenamed("src", "a"), "a")
    return left.join(both.withColumnRenamed("src", "b"), ["b", "node"]).where("node <> a AND node <> b").select("a", "b", "node")


def bridging_coefficient(edges: DataFrame) -> DataFrame:
    """(node, coefficient): 1/degree over the sum of the neighbours' 1/degree."""
    links = degrees(edges).select("node", "links")
    other = links.select(F.col("node").alias("dst"), (1 / F.col("links")).alias("inv"))
    around = both_ways(edges).join(other, "dst").groupBy(F.col("src").alias("node")).agg(F.sum("inv").alias("s"))
    return links.join(around, "node").select("node", F.when(F.col("s") > 0, 1 / F.col("links") / F.col("s")).otherwise(0.0).alias("coefficient"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): components named by their smallest node (G13), by
    passing the smallest label along edges and then along labels, so rounds
    grow with the logarithm of the longest chain."""
    with scope() as tables:
        both = saved(both_ways(edges).select("src", "dst"), "edges")
        ids = both.select(F.col("src").alias("node")).distinct()
        if nodes is not None:
            ids = ids.unionByName(nodes.select("node")).distinct()
        labels = saved(ids.withColumn("component", F.col("node")), "labels")
        while True:
            near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("m"))
            lower = labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
            jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
            nxt = lower.join(jump, F.col("component") == F.col("_n"), "left").select("node", "old", F.least("component", F.coalesce("_c", "component")).alias("component"))
            nxt = saved(nxt, "labels")
            labels = nxt.select("node", "component")
            if not nxt.where("component <> old").head(1):
                return tables.keep(Saved(labels, "components"))


def _weights(damping: float, n: int) -> list[float]:
    """How far each of ``n`` rounds goes from the old scores to the new, so that
    together they leave least of any error: the inverses of the zeros of the
    Chebyshev polynomial on [1 - damping, 1 + damping], where a round's factors
    lie on undirected edges; large and small ones in turn, so that none builds up."""
    order = sorted(range(1, n + 1), key=lambda k: (min(k, n + 1 - k), k))
    return [1 / (1 - damping * math.cos((2 * k - 1) * math.pi / (2 * n))) for k in order]


def pagerank(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, most: int = 100, tolerance: float = 1e-9, cut: int = 12) -> DataFrame:
    """(node, score): personalised PageRank over weighted undirected edges.

    ``nodes`` without an edge are nodes too: what lies on them goes back to the
    seeds. Seeds that aren't nodes are ignored; without any seed left the
    restart is uniform. It ends after ``most`` rounds, or when a plain round
    changes the scores by less than ``tolerance`` (L1). Where ``most`` plain
    rounds lead to the fixed point within 1e-6, rounds are weighted so that about
    half as many do (``_weights``).

    What lies on nodes without an edge needs no rounds: the scores are a multiple
    of those without it, which add up to 1 with it. A round is a join with the
    steps and a sum by node, whose order the next join uses; each node has a step
    to itself that carries its score and its restart. Every ``cut`` rounds the
    scores become a table; after twice as many, a plain round shows the change."""
    with scope() as tables:
        both = both_ways(edges)
        out = both.groupBy("src").agg(F.sum("weight").alias("total"))
        ids = out.select(F.col("src").alias("node"), F.lit(False).alias("lone"))
        if nodes is not None:
            rest = nodes.select("node").where("node IS NOT NULL").distinct().join(out.select(F.col("src").alias("node")), "node", "left_anti")
            ids = ids.unionByName(rest.select("node", F.lit(True).alias("lone")))
        chosen = saved(ids.join(seeds.select("node").distinct().withColumn("seed", F.lit(1.0)), "node", "left"), "nodes")
        found = chosen.agg(F.count("seed").alias("s"), F.count("*").alias("n"), F.count_if("lone").alias("lone"), F.count_if(F.col("lone") & F.col("seed").isNotNull()).alias("both")).first()
        start = F.when(F.col("seed").isNotNull(), 1.0 / max(found["s"], 1)).otherwise(0.0) if found["s"] else F.lit(1.0 / max(found["n"], 1))
        idle = found["both"] / found["s"] if found["s"] else found["lone"] / max(found["n"], 1)
        held = 1 - damping * idle  # of the mass, what doesn't come back from nodes without an edge
        restart = chosen.select("node", "lone", (start * ((1 - damping) / held if held else 1.0)).alias("r"), (start / (held or 1.0)).alias("score"))
        base = restart.where("NOT lone")
        step = both.join(out, "src").select("src", "dst", (F.lit(damping) * F.col("weight") / F.col("total")).alias("p"), F.lit(None).cast("double").alias("r"))
        step = saved(step.unionByName(base.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("double").alias("p"), "r")), "steps")
        scores = base.select("node", "score")
        faster, k, done = damping < 1 and damping**most <= 5e-7, 0, not base.head(1)
        weights = _weights(damping, 2 * cut) if faster else [1.0] * (2 * cut)
        while k < most and not done:
            for n in range(len(weights)):
                if k >= most - 1:
                    break
                k, a = k + 1, weights[n]
                own, other = (1 - a) * F.col("score") + a * F.col("r"), a * F.col("score") * F.col("p")
                scores = scores.join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("_d")).agg(F.sum(F.coalesce(other, own)).alias("score")).select(F.col("_d").alias("node"), "score")
                if n % cut == cut - 1:
                    scores = saved(scores, "scores")
            k += 1
            both_of = scores.join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("_d")).agg(F.sum(F.coalesce(F.col("score") * F.col("p"), F.col("r"))).alias("now"), F.max(F.when(F.col("r").isNotNull(), F.col("score"))).alias("was"))
            change = saved(both_of.select(F.col("_d").alias("node"), F.col("now").alias("score"), F.abs(F.col("now") - F.col("was")).alias("d")), "scores")
            scores = change.select("node", "score")
            done = (change.agg(F.sum("d").alias("d")).first()["d"] or 0.0) < tolerance
        lone = restart.where("lone").select("node", F.col("r").alias("score"))
        return tables.keep(Saved(scores.unionByName(lone), "ranks"))


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, hops: int = 4, top: int = 10) -> DataFrame:
    """(path, hops, score): all shortest paths of at most ``hops`` edges between
    a source and a target; score is the mean weight times 0.8 for each further
    hop, to six places; the ``top`` best, ties by path; of a path and its reverse
    the smaller (G08).

    Forwards only the best sum of weights to each node is kept, layer by layer
    from every source. The best path of a pair follows, and with it a floor that
    the ``top`` best reach. A source goes on only while a path from it can reach
    the floor if all its further edges are the heaviest; with all of its nodes,
    since these tell what is shortest. Backwards from the targets paths grow only
    while the best that can become of them reaches the floor, so that on dense
    graphs the other paths are never formed."""
    with scope() as tables:
        both = saved(both_ways(edges).groupBy("src", "dst").agg(F.max("weight").alias("weight")), "walks")
        layers = [saved(sources.select(F.col("node").alias("s")).distinct().select("s", F.col("s").alias("v"), F.lit(0.0).alias("best")), "front")]
        ends = saved(targets.select(F.col("node").alias("v")).distinct(), "ends")
        heaviest = both.agg(F.max("weight").alias("w")).first()["w"] or 0.0
        pairs, floor = [], float("-inf")
        worth = lambda total, d: F.round(total / d * 0.8 ** (d - 1), 6)
        ceiling = lambda best, k: [(best + (d - k) * heaviest) / d * 0.8 ** (d - 1) for d in range(k + 1, hops + 1)]
        for d in range(1, hops + 1):
            if max(ceiling(heaviest * (d - 1), d - 1)) < floor - 1e-6:
                break
            front = layers[-1]
            if floor > float("-inf"):
                hope = front.groupBy("s").agg(F.max("best").alias("b")).where(F.array_max(F.array(*ceiling(F.col("b"), d - 1))) >= floor - 1e-6)
                front = front.join(hope, "s", "left_semi")
            nxt = front.join(both, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.max(F.col("best") + F.col("weight")).alias("best"))
            for old in layers[-2:]:
                nxt = nxt.join(old.select("s", "v"), ["s", "v"], "left_anti")
            layers.append(saved(nxt, "front"))
            pairs.append(saved(layers[-1].join(ends, "v", "left_semi").select("s", "v", worth(F.col("best"), d).alias("score")).where(F.col("score") >= floor), "pairs"))
            every = pairs[0]
            for x in pairs[1:]:
                every = every.unionByName(x)
            firsts = every.where(F.col("score") >= floor).groupBy(F.least("s", "v").alias("a"), F.greatest("s", "v").alias("b")).agg(F.max("score").alias("score"))
            scores = [r["score"] for r in firsts.orderBy(F.desc("score")).limit(top).select("score").collect()]
            floor = scores[-1] if len(scores) == top else floor
        found = None
        for d in range(1, len(pairs) + 1):
            at = pairs[d - 1].where(F.col("score") >= floor).select("s", F.col("v").alias("at"), F.array("v").alias("path"), F.lit(0.0).alias("w"))
            if found is not None and not at.head(1):
                continue
            for k in range(d - 1, -1, -1):
                before = layers[k].select(F.col("s").alias("_s"), F.col("v").alias("_v"), "best")
                step = at.join(both, F.col("at") == F.col("src")).join(before, (F.col("s") == F.col("_s")) & (F.col("dst") == F.col("_v")))
                step = step.withColumn("w", F.col("w") + F.col("weight")).where(worth(F.col("best") + F.col("w"), d) >= floor)
                at = saved(step.select("s", F.col("dst").alias("at"), F.concat(F.array("dst"), F.col("path")).alias("path"), "w"), "paths")
            hit = at.select("path", F.lit(d).alias("hops"), worth(F.col("w"), d).alias("score"))
            found = hit if found is None else found.unionByName(hit)
        once = found.withColumn("key", F.least("path", F.reverse("path"))).groupBy("key").agg(F.first("hops").alias("hops"), F.max("score").alias("score"))
        best = once.select(F.col("key").alias("path"), "hops", "score").orderBy(F.desc("score"), "path").limit(top)
        return tables.keep(Saved(best, "paths"))


def lineage(new: DataFrame, previous: DataFrame, share: float = 0.3) -> DataFrame:
    """(cluster, best_previous, jaccard, merged_from, splits): how clusters
    continue earlier ones (G06, J09). Both: (cluster, member)."""
    n = new.groupBy("cluster").agg(F.count("*").alias("n"))
    p = previous.groupBy(F.col("cluster").alias("prev")).agg(F.count("*").alias("pn"))
    common = new.join(previous.withColumnRenamed("cluster", "prev"), "member").groupBy("cluster", "prev").agg(F.count("*").alias("c"))
    pairs = common.join(n, "cluster").join(p, "prev").withColumn("jaccard", F.col("c") / (F.col("n") + F.col("pn") - F.col("c"))).withColumn("feeds", F.col("c") / F.col("pn") >= share)
    feeders = pairs.where("feeds").groupBy("cluster").agg(F.count("*").alias("merged_from"))
    fed = pairs.where("feeds").groupBy("prev").agg(F.count("*").alias("splits"))
    first = Window.partitionBy("cluster").orderBy(F.desc("jaccard"), "prev")
    best = pairs.withColumn("r", F.row_number().over(first)).where("r = 1").select("cluster", F.col("prev").alias("best_previous"), "jaccard")
    return best.join(feeders, "cluster", "left").join(fed, F.col("best_previous") == F.col("prev"), "left").select(
        "cluster", "best_previous", F.round("jaccard", 6).alias("jaccard"), F.when(F.col("merged_from") >= 2, F.col("merged_from")).otherwise(0).cast("long").alias("merged_from"), F.when(F.col("splits") >= 2, F.col("splits")).otherwise(0).cast("long").alias("splits")
    )
