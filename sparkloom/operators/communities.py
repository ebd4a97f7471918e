"""Communities of weighted graphs by rounds of joins and sums.

Edges are tables (src, dst, weight) with each unordered pair once. Nodes of any
type that has an order will do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import Saved, scope
from .graph import both_ways

#: Gains are compared to so many places, so that the order of sums doesn't matter.
PLACES = 9


@dataclass
class Communities:
    """``members`` (node, community, size), the community named by its smallest
    node, and the modularity after each level."""

    members: DataFrame
    modularity: list[float] = field(default_factory=list)


def _around(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, k, loop, own, c, w, k_own, k_c): for each node, its community and
    each community next to it, with the weight that leads there and the degrees
    of both communities; a node's own community is always there."""
    to = edges.join(labels.select(F.col("v").alias("dst"), "c"), "dst").select(F.col("src").alias("v"), "c", "weight")
    own = labels.select("v", "c", F.lit(0.0).alias("weight"))
    weights = to.unionByName(own).groupBy("v", "c").agg(F.sum("weight").alias("w"))
    totals = labels.groupBy("c").agg(F.sum("k").alias("k_c"))
    mine = labels.join(totals.withColumnRenamed("k_c", "k_own"), "c").select("v", "k", "loop", F.col("c").alias("own"), "k_own")
    return weights.join(mine, "v").join(totals, "c")


def _best(around: DataFrame, twice: float, resolution: float) -> DataFrame:
    """(v, k, loop, own, part, best, gain): the community that raises modularity
    most if the node moves there alone, ties to the smaller; gain 0: it stays.
    ``part`` is the node's share of the present modularity: its weight inside
    its community, loops included, less what its degree lets expect."""
    home = F.col("c") == F.col("own")
    value = F.round(F.col("w") - resolution * F.col("k") * (F.col("k_c") - F.when(home, F.col("k")).otherwise(0.0)) / twice, PLACES)
    rows = around.withColumn("home", home).withColumn("value", value)
    firsts = [F.first(c).alias(c) for c in ("k", "own", "loop", "k_own")]
    found = rows.groupBy("v").agg(*firsts, F.max(F.when(F.col("home"), F.col("w"))).alias("w"), F.max(F.when(F.col("home"), F.col("value"))).alias("stay"), F.min(F.struct((-F.col("value")).alias("less"), "c")).alias("b"))
    part = (F.col("w") + F.col("loop") - resolution * F.col("k") * F.col("k_own") / twice) / twice
    return found.select("v", "k", "loop", "own", part.alias("part"), F.col("b.c").alias("best"), F.greatest(F.round(-F.col("b.less") - F.col("stay"), PLACES), F.lit(0.0)).alias("gain"))


def _some(node: Column, turn: int) -> Column:
    """Two thirds of the nodes, others each time."""
    return F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(3)) > 0


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two concern the same community, so that their gains add
    up, are made: those with the highest gain in both communities they concern."""
    wanted = moves.where("gain > 0")
    each = wanted.select("v", "gain", F.explode(F.array("own", "best")).alias("c"))
    first = each.groupBy("c").agg(F.min(F.struct((-F.col("gain")).alias("less"), "v")).alias("f"))
    went = first.groupBy(F.col("f.v").alias("v")).agg(F.count("*").alias("n")).where("n = 2").select("v", F.lit(True).alias("went"))
    found = moves.join(went, "v", "left").select("v", "k", "loop", F.when(F.col("went"), F.col("best")).otherwise(F.col("own")).alias("c"))
    return Saved(found, "labels").df


def _moved(edges: DataFrame, labels: DataFrame, twice: float, resolution: float, tolerance: float) -> tuple[DataFrame, float, bool]:
    """Local moving: (labels, modularity, whether any node moved). Each round
    two thirds of the nodes go where they gain most. If that lowers modularity
    (their gains don't add up where communities meet), the round is taken back
    and only moves in communities of their own are made, which can't lower it.
    So it is after a round that gains under ``tolerance``, and it ends when no
    node gains, or such a round gains under ``tolerance`` again."""
    before, last, turn, any_, bold, small = None, 0.0, 0, False, True, 0
    while True:
        moves = Saved(_best(_around(edges, labels), twice, resolution), "moves").df
        s = moves.agg(F.sum("part").alias("q"), F.count_if(F.col("gain") > 0).alias("n")).first()
        if before is not None and s["q"] < last - 1e-12 and bold:
            moves, bold = before, False  # the round before is made again, move by move apart
            labels = _apart(moves)
            continue
        small = small + 1 if before is not None and s["q"] - last < tolerance else 0
        if not s["n"] or small == 2:
            return moves.select("v", "k", "loop", F.col("own").alias("c")), s["q"], any_
        before, last, bold, any_, turn = moves, s["q"], not small, True, turn + 1
        if small:  # what is left to gain is gained by moves that can't get in each other's way
            labels = _apart(moves)
            continue
        labels = moves.select("v", "k", "loop", F.when((F.col("gain") > 0) & _some(F.col("v"), turn), F.col("best")).otherwise(F.col("own")).alias("c"))


def _refined(edges: DataFrame, labels: DataFrame, twice: float, resolution: float) -> DataFrame:
    """(v, k, loop, c, r): parts of each community that hang together. All start
    alone; a node still alone joins the part it gains most with if both it and
    the part are well tied to the rest of their community. Nodes leave only a
    part of their own, and join only parts that stay, so parts are connected."""
    ends = lambda side, name: labels.select(F.col("v").alias(side), F.col("c").alias(name))
    inside = Saved(edges.join(ends("src", "a"), "src").join(ends("dst", "b"), "dst").where("a = b").select("src", "dst", "weight"), "inside").df
    ties = inside.groupBy(F.col("src").alias("v")).agg(F.sum("weight").alias("tie"))
    whole = labels.groupBy("c").agg(F.sum("k").alias("k_all"))
    nodes = labels.join(whole, "c").join(ties, "v", "left").select("v", "k", "loop", "c", "k_all", F.coalesce("tie", F.lit(0.0)).alias("tie"), F.col("v").alias("r"))
    nodes, turn = Saved(nodes, "parts").df, 0
    while True:
        turn += 1
        to = inside.join(nodes.select(F.col("v").alias("dst"), "r"), "dst").groupBy(F.col("src").alias("v"), "r").agg(F.sum("weight").alias("w"))
        held = to.join(nodes.select("v", F.col("r").alias("mine")), "v").where("r = mine").groupBy("r").agg(F.sum("w").alias("held"))
        sizes = nodes.groupBy("r").agg(F.count("*").alias("n"), F.sum("k").alias("k_r"), F.sum("tie").alias("tie_r"))
        sizes = sizes.join(held, "r", "left").select("r", "n", "k_r", (F.col("tie_r") - F.coalesce("held", F.lit(0.0))).alias("cut"))
        alone = nodes.join(sizes.where("n = 1").select(F.col("r").alias("v")), "v", "left_semi")
        enough = lambda cut, k: F.round(F.col(cut) - resolution * F.col(k) * (F.col("k_all") - F.col(k)) / twice, PLACES) >= 0
        rows = to.join(alone.where(enough("tie", "k")).select("v", "k", "k_all"), "v").where("r <> v").join(sizes, "r").where(enough("cut", "k_r"))
        rows = rows.withColumn("value", F.round(F.col("w") - resolution * F.col("k") * F.col("k_r") / twice, PLACES)).where("value > 0")
        best = rows.groupBy("v").agg(F.min(F.struct((-F.col("value")).alias("less"), "r", "n")).alias("b")).select("v", F.col("b.r").alias("next"), (F.col("b.n") > 1).alias("large"))
        best = Saved(best, "part-moves").df
        if not best.head(1):
            return nodes.select("v", "k", "loop", "c", "r")
        # of two nodes alone the one with the smaller hash goes to the other, if that stays
        goes = F.col("large") | (F.xxhash64("v", F.lit(turn)) < F.xxhash64("next", F.lit(turn)))
        wish = best.select("v", "next", goes.alias("goes"))
        going = wish.where("goes").select(F.col("v").alias("away"))
        went = wish.where("goes").join(going, F.col("next") == F.col("away"), "left_anti").select("v", "next")
        nodes = Saved(nodes.join(went, "v", "left").withColumn("r", F.coalesce("next", "r")).drop("next"), "parts").df


def communities(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, algorithm: str = "leiden", tolerance: float = 1e-3) -> Communities:
    """Communities by modularity (G03): local moving, refinement of each
    community into well-tied connected parts (``algorithm="leiden"``; anything
    but "louvain" means it), and a smaller graph of the parts, which starts from
    the communities found; level by level until nothing moves and no part has
    two nodes. "louvain" makes the communities themselves the smaller graph.

    Modularity never falls from round to round. Ties go to the smallest
    community name; which half of the nodes may move in a round goes by a hash,
    so equal input gives equal communities. Without edges, or for nodes without
    an edge, each node is a community; loops, null ends and weights of 0 or less
    count as no edge, and repeated edges add up.

    A round shuffles the edges by their ends and sums partially first; nothing
    but two sums a round reaches the driver.
    """
    louvain = algorithm.strip().lower() == "louvain"
    with scope() as tables:
        pairs = edges.where("src <> dst AND weight > 0").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
        now = Saved(both_ways(pairs).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "both").df
        degree = now.groupBy(F.col("src").alias("v")).agg(F.sum("weight").alias("k"))
        labels = Saved(degree.select("v", "k", F.lit(0.0).alias("loop"), F.col("v").alias("c")), "labels").df
        twice = labels.agg(F.sum("k").alias("k")).first()["k"]
        of = Saved(labels.select(F.col("v").alias("node"), "v"), "names").df
        found, modularity = of.select("node", F.col("v").alias("community")), []
        while twice:
            labels, value, any_ = _moved(now, labels, twice, resolution, tolerance)
            modularity.append(value)
            found = of.join(labels.select("v", F.col("c").alias("community")), "v").select("node", "community")
            parts = labels.withColumn("r", F.col("c")) if louvain else _refined(now, labels, twice, resolution)
            parts = Saved(parts, "levels").df
            sizes = parts.agg(F.count("*").alias("v"), F.countDistinct("r").alias("r")).first()
            if sizes["v"] == sizes["r"] or (louvain and not any_):
                break
            name = lambda side, to: parts.select(F.col("v").alias(side), F.col("r").alias(to))
            lifted = Saved(now.join(name("src", "a"), "src").join(name("dst", "b"), "dst").groupBy("a", "b").agg(F.sum("weight").alias("weight")), "lifted").df
            loops = lifted.where("a = b").select(F.col("a").alias("r"), F.col("weight").alias("in"))
            grouped = parts.groupBy("r").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"), F.min("c").alias("c"))
            labels = Saved(grouped.join(loops, "r", "left").select(F.col("r").alias("v"), "k", (F.col("loop") + F.coalesce("in", F.lit(0.0))).alias("loop"), "c"), "labels").df
            now = lifted.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
            of = Saved(of.join(parts.select("v", "r"), "v").select("node", F.col("r").alias("v")), "names").df
        if nodes is not None:
            rest = nodes.select("node").where("node IS NOT NULL").distinct().join(found.select("node"), "node", "left_anti")
            found = found.unionByName(rest.select("node", F.col("node").alias("community")))
        sizes = found.groupBy("community").agg(F.min("node").alias("first"), F.count("*").alias("size"))
        return Communities(tables.keep(Saved(found.join(sizes, "community").select("node", F.col("first").alias("community"), "size"), "communities")), modularity)


def attached(edges: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``edges`` (src, dst, cos, weight), and one more for each node of
    ``neighbours`` (src, dst, cos, rank) that has none: to its nearest, whatever
    its cosine (G02).

    In order of nodes: a node to which a smaller one was attached before has an
    edge by then and isn't attached itself. The order is settled in rounds: a
    node is decided once all smaller lone nodes that want it are.
    """
    from ..functions.maths import edge_weight

    with scope() as tables:
        there = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
        wants = neighbours.where("rank = 1 AND cos IS NOT NULL AND NOT isnan(cos)").select("src", "dst", "cos").join(there, "src", "left_anti")
        state = Saved(wants.withColumn("joins", F.lit(None).cast("boolean")), "lone").df
        while state.where("joins IS NULL").head(1):
            before = state.select(F.col("src").alias("other"), F.col("dst").alias("wanted"), F.col("joins").alias("sure"))
            on = (F.col("src") == F.col("wanted")) & (F.col("other") < F.col("src"))
            first = state.where("joins IS NULL").join(before, on, "left").groupBy("src").agg(F.max(F.col("sure")).alias("taken"), F.count_if(F.col("other").isNotNull() & F.col("sure").isNull()).alias("open"))
            decided = first.select(F.col("src").alias("s"), F.when(F.col("taken"), False).when(F.col("open") == 0, True).alias("now"))
            state = Saved(state.join(decided, F.col("src") == F.col("s"), "left").select("src", "dst", "cos", F.coalesce("joins", "now").alias("joins")), "lone").df
        more = state.where("joins").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "cos", edge_weight(F.col("cos")).alias("weight")).dropDuplicates(["src", "dst"])
        return tables.keep(Saved(edges.select("src", "dst", "cos", "weight").unionByName(more), "attached"))
