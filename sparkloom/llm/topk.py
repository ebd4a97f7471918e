"""Exact top-k search by Fagin's threshold algorithm over sorted lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Saved, scope

#: Vectors in a block, and queries that meet a block in one task.
BLOCK, QUERIES = 4096, 4096
#: Queries that read a block's lists together.
GROUP = 256
#: Stands for no floor.
_NONE = -(1 << 63)


class SortedLists:
    """The vectors of a block, with a list for each dimension sorted by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, whole = ids[order], vectors[order].astype(np.int64)
        self.most = max((abs(int(x)) for x in (whole.max(initial=0), whole.min(initial=0))), default=0)
        self.whole, self.kinds = whole, {}
        self.lists = np.argsort(-whole, axis=0, kind="stable")  # best first for positive weights
        self.values = np.take_along_axis(whole, self.lists, axis=0)

    def top(self, query: np.ndarray, own: int, k: int, floor: float = -math.inf, first: int = 4) -> tuple[np.ndarray, np.ndarray, int]:
        """``group`` for one query."""
        (found,), scored = self.group(query[None, :], np.array([own]), k, [floor], first)
        return *found, scored

    def group(self, queries: np.ndarray, owns: np.ndarray, k: int, floors: list[float], first: int = 4) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each query (ids, scores), and the number of vectors scored: the k
        highest inner products, ties to smaller ids, without rows of the query's
        own id; those under its floor may be missing.

        The lists of all dimensions in which some query has a weight are read
        downwards at once (upwards for negative weights), in steps that double.
        A vector is scored when a list first names it, for all queries of the
        group that are still open, as one product. For a query no unmet vector
        can score above its inner product with the components at the present
        depth; once that is below its k-th score or its floor it is closed.
        """
        n, d = self.whole.shape
        limit = self.most * max((abs(int(x)) for x in (queries.max(initial=0), queries.min(initial=0))), default=0) * d
        kind = np.float64 if limit < 1 << 53 else np.int64 if limit < 1 << 63 else object
        vectors, values, q = (x.astype(kind, copy=False) for x in (self._as(kind), self.values, queries))
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        down, up = np.flatnonzero((queries > 0).any(axis=0)), np.flatnonzero((queries < 0).any(axis=0))
        begin, end = np.searchsorted(self.ids, owns, "left"), np.searchsorted(self.ids, owns, "right")
        met, rows = np.zeros(n, dtype=bool), np.zeros(0, dtype=np.int64)
        scores = [np.zeros(0, dtype=kind)] * len(queries)
        open_, depth, step = np.arange(len(queries)), 0, first
        while depth < n and len(open_):
            bound = plus[open_] @ values[depth] + minus[open_] @ values[n - 1 - depth]
            open_ = open_[[not b < max(floors[i], self._kth(scores[i], k)) for i, b in zip(open_, bound.tolist())]]
            if not len(open_):
                break
            last = min(n, depth + step)
            named = np.concatenate([self.lists[depth:last, down].ravel(), self.lists[n - last : n - depth, up].ravel()]) if len(down) + len(up) else np.arange(n)
            hit = np.zeros(n, dtype=bool)
            hit[named] = True
            new = np.flatnonzero(hit & ~met)
            met |= hit
            if len(new):
                found = q[open_] @ vectors[new].T
                rows = np.concatenate([rows, new])
                for i, s in zip(open_, found):
                    scores[i] = np.concatenate([scores[i], s])
                    own = (new >= begin[i]) & (new < end[i])
                    if own.any():  # a row of the query's own id is no candidate
                        scores[i][len(scores[i]) - len(new) :][own] = -math.inf if kind is not np.int64 else -(1 << 63)
            depth, step = last, 2 * step
        out = []
        for i, s in enumerate(scores):
            at = rows[: len(s)]
            keep = ~((at >= begin[i]) & (at < end[i]))
            at, s = at[keep], s[keep]
            if len(s) > 4 * k:  # only what may be among the best
                near = s >= self._kth(s, k)
                at, s = at[near], s[near]
            best = np.lexsort((at, -s))[:k]  # ids are in order of their places
            out.append((self.ids[at[best]], _as_long(s[best])))
        return out, int(met.sum())

    @staticmethod
    def _kth(scores: np.ndarray, k: int):
        if len(scores) < k:
            return -math.inf
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        return kth.item() if isinstance(kth, np.generic) else kth

    def _as(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = self.whole.astype(kind)
        return self.kinds[kind]


def _as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as long numbers; what a long can't hold becomes its limit."""
    if scores.dtype == object:
        scores = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in scores], dtype=np.int64)
    return scores.astype(np.int64)


def _search(k: int):
    def block(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries) or not len(vectors):
            return none
        lists = SortedLists(vectors["vec_id"].to_numpy(), np.stack(vectors["v"].to_numpy()).astype(np.int64))
        ids, floors = queries["vec_id"].to_numpy(), [-math.inf if f == _NONE else f for f in queries["floor"].tolist()]
        asked = np.stack(queries["v"].to_numpy()).astype(np.int64)
        out = []
        for at in range(0, len(ids), GROUP):
            part = slice(at, at + GROUP)
            for own, (found, scores) in zip(ids[part], lists.group(asked[part], ids[part], k, floors[part])[0]):
                out.append((np.full(len(found), own), found, scores))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    return block


_FOUND = "query_id long, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products
    of components floor(scale * x), ties to smaller ids, exact.

    Vectors are dealt to blocks of about 4096 by a hash of the row; every query
    meets every block, in groups of at most 4096 queries, so a task holds one
    block and one group whatever the input. Queries first search one block
    each; the k-th score found there goes along as a floor, so that other
    blocks stop reading their lists early and return only what may belong to
    the result.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do null ids, nor vectors that differ in length from most (ties:
    the longer length stays). Components beyond the range of a long after
    scaling count as its limit, as do scores beyond it. Rows that repeat an id
    are candidates each, for queries of other ids; of several query rows with
    one id the largest vector in order asks. Vectors alike score alike and go
    by id. Other columns are ignored; an empty table gives an empty result.
    """
    with scope() as tables:
        return tables.keep(Saved(_found(vectors, queries, k, id_col, vector_col, scale), "topk-found"))


def components(df: DataFrame, id_col: str, vector_col: str, scale: int, *others: Column) -> DataFrame:
    """(vec_id, others, v): components floor(scale * x), those beyond a long as
    its limit; without rows whose id is null or whose vector is null, empty or
    holds null or non-finite components."""
    x = F.col(vector_col)
    whole = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))

    def component(e: Column) -> Column:
        y = F.lit(float(scale)) * e.cast("double")
        high = F.lit(float(1 << 63))
        return F.when(y >= high, F.lit((1 << 63) - 1)).when(y <= -high, F.lit(-(1 << 63))).otherwise(F.floor(F.when(F.abs(y) < high, y)))

    return df.where(whole).where(finite).select(F.col(id_col).cast("long").alias("vec_id"), *others, F.transform(x, component).alias("v"))


def _found(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    def clean(df: DataFrame) -> DataFrame:
        return components(df, id_col, vector_col, scale)

    base = Saved(clean(vectors), "topk-vectors").df
    asked = clean(queries).groupBy("vec_id").agg(F.max("v").alias("v"))
    size = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims, n = (size["d"], size["count"]) if size else (0, 0)
    base = base.where(F.size("v") == dims)
    asked = Saved(asked.where(F.size("v") == dims), "topk-queries").df
    blocks = max(1, math.ceil(n / BLOCK))
    groups = max(1, math.ceil(asked.count() / QUERIES))
    base = base.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("home", F.pmod(F.col("grp"), F.lit(blocks)).cast("int"))

    def meet(asked: DataFrame, own: bool) -> DataFrame:
        """The queries' best in their home block, or in all others."""
        if own:
            left = asked.withColumn("block", F.col("home"))
            at_home = F.when(F.col("block") < groups, F.sequence(F.col("block"), F.lit(groups - 1), F.lit(blocks)))
            right = base.withColumn("grp", F.explode(at_home))
        else:
            left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <> home")
            right = base.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        left = left.select("grp", "block", "vec_id", "v", "floor").groupBy("grp", "block")
        return left.cogroup(right.select("grp", "block", "vec_id", "v").groupBy("grp", "block")).applyInPandas(_search(k), _FOUND)

    near = Saved(_best(meet(asked.withColumn("floor", F.lit(_NONE).cast("long")), True), k).drop("rank"), "topk-near").df
    found = near
    if blocks > 1:
        floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(_NONE)).alias("floor")).withColumnRenamed("query_id", "f_id")
        rest = meet(asked.join(floors, F.col("vec_id") == F.col("f_id"), "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE).cast("long"))), False)
        found = near.unionByName(rest)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
