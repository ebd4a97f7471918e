"""Prefix tries of conversations.

Conversations go to groups by the digest of their first turn. A group that is
small enough becomes a trie of dictionaries inside one task; a larger one is
led natively past the turns that all its members share and falls apart by the
next turn, until every part is small, has one member or has ended.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Saved, scope

#: Most turns of a group that becomes one trie, of a task's groups on average,
#: and most turns of a conversation that are looked at at once.
GROUP, TASK, SPAN = 1000, 1000, 512
#: Most oversized groups whose keys are broadcast.
BROADCAST = 50_000
#: Ids alike but for so many bits are one piece of text.
PIECE = 12

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()


def digested(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, digest, size): turns numbered from 1 within each
    conversation, nulls first, ties by digest; ``size`` is the text's number of
    code points. Null roles and texts are empty.

    Turns are sorted over ranges of (conversation, turn, digest), so a long
    conversation spans several tasks; numbers go on from the counts of the
    ranges before."""
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(who), F.lit(":"), who, said), 256)), 1, 16)
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(said).cast("long").alias("size"))
    rows = Saved(rows.withColumn("tie", F.monotonically_increasing_id()), "trie-rows").df
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    ranged = Saved(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "trie-ranges").df
    within = ranged.withColumn("row", F.row_number().over(Window.partitionBy("conv", "range").orderBy(*order[1:])))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("conv", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # most conversations lie in one range; the others' later ranges are few
    starts = starts.where("before > 0").select(F.col("conv").alias("c"), F.col("range").alias("r"), "before")
    numbered = within.join(starts, (F.col("conv") == F.col("c")) & (F.col("range") == F.col("r")), "left")
    return numbered.select("conv", (F.col("row") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "digest", "size")


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """(conv, pos, digest, size): each conversation's first ``head`` turns (at
    most ``most``) replaced by those of the conversation ``base``."""
    convs = turns.select("conv").distinct().select("conv", base.alias("base"), head.alias("head"))
    heads = turns.where(F.col("pos") <= most).select(F.col("conv").alias("b"), F.col("pos").alias("p"), "digest", "size")
    taken = convs.join(heads, (F.col("base") == F.col("b")) & (F.col("p") <= F.col("head"))).select("conv", F.col("p").alias("pos"), "digest", "size")
    there = heads.groupBy("b").agg(F.count("*").alias("n"))
    less = F.col("head") - F.coalesce("n", F.lit(0))
    short = convs.join(there, F.col("base") == F.col("b"), "left").select(F.col("conv").alias("c"), less.alias("less")).where("less > 0")
    own = turns.withColumn("head", head).where(F.col("pos") > F.col("head")).drop("head")
    own = own.join(short, F.col("conv") == F.col("c"), "left").select("conv", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "digest", "size")
    return taken.unionByName(own)


def _below(key: Column, digest: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(key, digest), 256), 1, 32))


def _tries(frames: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
    """The nodes of all groups of a task; rows (g, conv, pos, digest, size, up,
    depth) of a group's members from its top node on."""
    frame = frames.sort_values(["g", "conv", "pos"], kind="stable")
    starts = np.flatnonzero((frame["g"] != frame["g"].shift()).to_numpy())
    out = []
    columns = [frame[c].tolist() for c in ("conv", "pos", "digest", "size", "up")]
    for a, b in zip(starts, [*starts[1:], len(frame)]):
        out += _trie(*[c[a:b] for c in columns], frame["g"].iloc[a])
    return pd.DataFrame(out, columns=["g", "top", *(c.split()[0] for c in _NODE.split(", "))]).astype({"parent_conv_id": "int64"})


def _trie(conv: list, pos: list, digest: list, size: list, up: list, g: bytes) -> list[tuple]:
    """The nodes of one group, whose members come by id and have their first
    turn in common. Nodes are dictionaries of pointers to children; sums are
    taken in an iterative postorder."""
    children: list[dict] = [{}]
    first, members, length, depth, parent, ends = [-1], [0], [0], [pos[0] - 1], [-1], [[]]
    node = 0
    for k, c in enumerate(conv):
        if k == 0 or c != conv[k - 1]:
            node = 0
        below = children[node].get(digest[k])
        if below is None:
            below = children[node][digest[k]] = len(children)
            children.append({})
            first.append(c)  # members come by id: the first is the smallest
            members.append(0)
            length.append(size[k])
            depth.append(pos[k])
            parent.append(node)
            ends.append([])
        node = below
        members[node] += 1
        if k + 1 == len(conv) or conv[k + 1] != c:
            ends[node].append(c)
    leaves, saved = [0] * len(children), [0] * len(children)
    stack = [(1, iter(children[1].values()))]
    while stack:
        node, rest = stack[-1]
        below = next(rest, None)
        if below is not None:
            stack.append((below, iter(children[below].values())))
            continue
        stack.pop()
        leaves[node] = leaves[node] or 1
        saved[node] += (members[node] - 1) * length[node]
        leaves[parent[node]] += leaves[node]
        saved[parent[node]] += saved[node]
    first[0] = up[0]
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else _NONE
    return [(g, n == 1, first[n], depth[n], first[parent[n]], members[n], len(children[n]), leaves[n], saved[n], sha(ends[n])) for n in range(1, len(children))]


def _ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv): the hash of the ids in order,
    joined by commas. Ids become pieces of text over ranges of 4096 numbers; a
    node's pieces pass through one hash as a stream, sorted, so that no more
    than a batch is held."""
    pieces = rows.groupBy("node", F.shiftright("conv", PIECE).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    ordered = pieces.repartition("node").sortWithinPartitions("node", "piece")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for frame in frames:
            done = []
            for n, ids in zip(frame["node"], frame["ids"]):
                if n != node:
                    done += [(node, sha.hexdigest())] if sha else []
                    node, sha = n, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if sha:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])

    return ordered.select("node", "ids").mapInPandas(hashed, "node binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): a row for each distinct sequence of first turns
    of ``turns`` (conv, pos from 1 without gaps, digest, size), from the empty
    one, whose members are all of ``convs`` (conv).

    Groups start as the conversations of one first turn. Round by round: groups
    of one member give a chain of nodes natively; groups of at most 1000 turns
    in all and 512 in each become tries in tasks; of any other group the turns
    that all members share (among the next 512; the common prefix of its
    smallest and its largest member, by digests) are nodes of one chain, and
    what follows is dealt anew by the next turn. So a first turn, or a whole
    conversation, that a third of all rows hold is never in one task. Leaves
    and savings of these chains are summed upwards, round by round.

    Turns are alike if their 128-bit digests are. Rounds grow with the number
    of branchings inside oversized groups, and with the length that more than
    one conversation shares beyond 512 turns.
    """
    with scope() as tables:
        return tables.keep(Saved(_nodes(convs, turns), "trie-nodes"))


def _nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    turns, convs = Saved(turns, "trie-turns").df, Saved(convs.select("conv").distinct(), "trie-convs").df
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    top = convs.agg(F.min("conv")).first()[0]
    if top is None:
        return convs.sparkSession.createDataFrame([], _NODE)
    root = F.lit(b"")
    first = turns.where("pos = 1").select("conv", F.col("digest").alias("next"))
    # g: key of the turns up to ``depth``, the last of which tells the group apart; from: key of the group it comes from
    open_ = first.join(lengths, "conv").select(_below(root, F.col("next")).alias("g"), "conv", F.lit(1).cast("long").alias("depth"), "n", F.lit(top).cast("long").alias("up"), root.alias("from"))
    open_ = Saved(open_, "trie-open").df
    nodes, tops, chains, ended = [], [], [], []
    ended.append(convs.join(first.select(F.col("conv").alias("c")), F.col("conv") == F.col("c"), "left_anti").select(root.alias("node"), "conv"))
    while open_.head(1):
        stats = open_.groupBy("g").agg(F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("depth") + 1).alias("turns"), F.max(F.col("n") - F.col("depth") + 1).alias("longest"), F.min("conv").alias("first"))
        stats = Saved(stats, "trie-stats").df
        large = stats.where(f"n_convs > 1 AND (turns > {GROUP} OR longest > {SPAN})").select(F.col("g").alias("lg"), "n_convs", "first")
        few = large.count()
        kind = F.broadcast if few <= BROADCAST else (lambda df: df)  # else Spark joins, and splits what is skewed
        rest = open_.join(kind(large.select("lg")), F.col("g") == F.col("lg"), "left_anti") if few else open_
        one = stats.where("n_convs = 1").select(F.col("g").alias("og"))
        alone = rest.join(one, F.col("g") == F.col("og"), "left_semi")
        shared = rest.join(one, F.col("g") == F.col("og"), "left_anti")
        nodes.append(_alone(alone, turns))
        tops.append(alone.select("from", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
        grown = Saved(_shared(shared, turns), "trie-grown").df
        nodes.append(grown.drop("g", "top"))
        known = shared.groupBy("g").agg(F.first("from").alias("from"))
        tops.append(grown.where("top").join(known, "g").select("from", "n_leaves", "saved_tokens"))
        if not few:
            break
        members = open_.join(kind(large), F.col("g") == F.col("lg")).drop("lg")
        led, open_, over = _led(members, turns)
        chains.append(led)
        ended.append(over)
    return _joined(nodes, tops, chains, ended, convs, top)


def _alone(groups: DataFrame, turns: DataFrame) -> DataFrame:
    """Chains of groups with one member."""
    rows = turns.join(groups.select(F.col("conv").alias("c"), "depth", "n", "up"), (F.col("conv") == F.col("c")) & (F.col("pos") >= F.col("depth")))
    last = F.col("pos") == F.col("n")
    return rows.select(
        F.col("conv").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.when(F.col("pos") == F.col("depth"), F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_NONE)).alias("ends_sha256"),
    )


def _shared(groups: DataFrame, turns: DataFrame) -> DataFrame:
    """Tries of small groups, several to a task."""
    rows = turns.join(groups.select("g", F.col("conv").alias("c"), "depth", "up"), (F.col("conv") == F.col("c")) & (F.col("pos") >= F.col("depth")))
    rows = Saved(rows.select("g", "conv", "pos", "digest", "size", "up"), "trie-shared").df
    parts = max(1, math.ceil(rows.count() / TASK))
    return rows.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts))).groupBy("part").applyInPandas(_tries, f"g binary, top boolean, {_NODE}")


def _led(members: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chains, groups after them, members that end with their chain)."""
    ahead = (F.col("pos") >= F.col("depth")) & (F.col("pos") < F.col("depth") + SPAN)
    seen = turns.join(members.select(F.col("conv").alias("c"), "depth"), (F.col("conv") == F.col("c")) & ahead)
    spans = seen.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "size"))).alias("span"))
    spans = spans.select(F.col("conv").alias("c"), F.transform("span", lambda x: x.digest).alias("digests"), F.transform("span", lambda x: x["size"]).alias("sizes"))
    rows = Saved(members.join(spans, F.col("conv") == F.col("c")).drop("c"), "trie-spans").df
    # what the smallest and the largest share, all between them do
    ends = rows.groupBy("g").agg(F.min("digests").alias("low"), F.max("digests").alias("high"), F.max(F.struct(F.col("conv") == F.col("first"), "sizes")).alias("s"), *[F.first(c).alias(c) for c in ("depth", "n_convs", "first", "up", "from")])
    differ = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a != b, F.lit(True))), True)
    chains = ends.withColumn("share", F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int"))
    # a group larger than its span has a next turn to fall apart by, unless all members end
    chains = Saved(chains.select("g", "share", F.slice("s.sizes", F.lit(1), F.col("share")).alias("sizes"), "depth", "n_convs", "first", "up", "from"), "trie-chains").df
    cut = chains.select(F.col("g").alias("cg"), "share")
    cut = F.broadcast(cut) if cut.count() <= BROADCAST else cut
    rows = rows.join(cut, F.col("g") == F.col("cg")).withColumn("end", F.col("depth") + F.col("share") - 1)
    rows = rows.join(turns.select(F.col("conv").alias("c"), "pos", F.col("digest").alias("next")), (F.col("conv") == F.col("c")) & (F.col("pos") == F.col("end") + 1), "left")
    rows = Saved(rows.select("g", "conv", "n", "end", "first", "next"), "trie-led").df
    after = rows.where("next IS NOT NULL").select(_below(F.col("g"), F.col("next")).alias("g"), "conv", (F.col("end") + 1).alias("depth"), "n", F.col("first").alias("up"), F.col("g").alias("from"))
    return chains, Saved(after, "trie-open").df, rows.where("next IS NULL").select(F.col("g").alias("node"), "conv")


def _joined(nodes: list[DataFrame], tops: list[DataFrame], chains: list[DataFrame], ended: list[DataFrame], convs: DataFrame, top: int) -> DataFrame:
    """All nodes; chains and the root get the sums of what hangs below them."""
    ends = Saved(_ends(reduce(DataFrame.unionByName, ended)), "trie-ends").df
    sums = lambda df: df.groupBy("from").agg(F.count("*").alias("below"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).withColumnRenamed("from", "node")
    below = Saved(reduce(DataFrame.unionByName, tops), "trie-tops").df
    for chain in reversed(chains):
        found = chain.join(sums(below), F.col("g") == F.col("node"), "left").drop("node").join(ends, F.col("g") == F.col("node"), "left").drop("node")
        leaves, children = F.coalesce("n_leaves", F.lit(1)), F.coalesce("below", F.lit(0))
        later = lambda i: F.aggregate(F.slice("sizes", i + 1, F.col("share")), F.lit(0).cast("long"), lambda a, x: a + x)
        found = found.select("g", "from", "depth", "share", "first", "up", "n_convs", children.alias("children"), leaves.alias("leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends"), "sizes")
        found = Saved(found, "trie-led-sums").df
        whole = (F.col("n_convs") - 1) * later(F.lit(0)) + F.col("saved")
        below = Saved(below.unionByName(found.select("from", F.col("leaves").alias("n_leaves"), whole.alias("saved_tokens"))), "trie-tops").df
        each = found.select("*", F.posexplode("sizes").alias("i", "size"))
        last = F.col("i") == F.col("share") - 1
        nodes.append(each.select(
            F.col("first").alias("conv_id"),
            (F.col("depth") + F.col("i")).alias("depth"),
            F.when(F.col("i") == 0, F.col("up")).otherwise(F.col("first")).alias("parent_conv_id"),
            "n_convs",
            F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            ((F.col("n_convs") - 1) * later(F.col("i")) + F.col("saved")).alias("saved_tokens"),
            F.when(last, F.col("ends")).otherwise(F.lit(_NONE)).alias("ends_sha256"),
        ))
    under = sums(below).where(F.col("node") == F.lit(b""))
    root = convs.agg(F.count("*").alias("n_convs")).withColumn("node", F.lit(b"")).join(under, "node", "left").join(ends, "node", "left")
    nodes.append(root.select(
        F.lit(top).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("below", F.lit(0)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    ))
    return reduce(DataFrame.unionByName, nodes)


def conversation_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, most: int = 0, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of ``prefix_trie`` of all conversations, after their first
    ``head`` turns (at most ``most``) were replaced by those of conversation
    ``base`` (both columns over ``conv``; by default none are).

    Turns go by ``turn``, nulls first, ties by digest. Null roles and texts are
    empty; rows without a conversation's id take no part. Repeated rows are
    turns each. A conversation may be left without turns; it belongs to the
    root and ends there. Other columns are ignored; an empty table gives an
    empty result, without a root.
    """
    with scope() as tables:
        rows = Saved(digested(conversations, conv, turn, role, text), "trie-digested").df
        convs = rows.select("conv").distinct()
        return tables.keep(Saved(prefix_trie(convs, rebuilt(rows, base, head, most) if most else rows), "conversations"))
