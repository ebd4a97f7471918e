"""Pooling and nearest neighbours over vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import dot, l2_normalise, norm
from ..tables import Saved, scope

#: Components of the vectors in a block of the neighbour search; blocks at least, so that all cores have work, unless they were of fewer vectors than that.
COMPONENTS, BLOCKS, FEW = 1 << 22, 16, 1024
#: Centroids in a broadcast array.
MOST = 1024


def chunk_weight(is_refs: Column, index: Column, cue: Column, lead: int = 2) -> Column:
    """Weight of a chunk in its document's vector."""
    return F.when(is_refs, 0.05).when(index <= lead - 1, 2.0).when(cue, 1.5).otherwise(1.0)


def vector_sum(vectors: DataFrame, keys: list[str], vector: str, weight: Column) -> DataFrame:
    """(keys, sum_v, sum_w, n): weighted sums of vectors, component by component.

    Components are exploded, so the sums are formed in partial aggregates and a
    hot key is no burden; nothing is collected into lists of vectors."""
    parts = vectors.select(*keys, F.posexplode(vector).alias("i", "x"), weight.alias("w"))
    sums = parts.groupBy(*keys, "i").agg(F.sum(F.col("x") * F.col("w")).alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"))
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("p"), F.max("w").alias("sum_w"), F.max("n").alias("n"))
    return packed.select(*keys, F.transform("p", lambda e: e["s"]).alias("sum_v"), "sum_w", "n")


def pool(vectors: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(key, vector, n): the length-one weighted mean of each key's normalised
    vectors; the plain mean where the weights add up to nothing (A16, A18)."""
    unit = vectors.withColumn("_u", l2_normalise(F.col(vector)))
    sums = vector_sum(unit, [key], "_u", weight if weight is not None else F.lit(1.0))
    if weight is not None:
        plain = vector_sum(unit, [key], "_u", F.lit(1.0)).select(F.col(key).alias("_k"), F.col("sum_v").alias("_plain"))
        sums = sums.join(plain, F.col(key).eqNullSafe(F.col("_k"))).withColumn("sum_v", F.when((F.col("sum_w") > 1e-6) & (norm(F.col("sum_v")) > 0), F.col("sum_v")).otherwise(F.col("_plain")))
    return sums.select(key, l2_normalise(F.col("sum_v")).alias("vector"), "n")


def corpus_centre(centres: DataFrame, vector: str, docs: Column) -> DataFrame:
    """(vector): the mean of the clusters' centres weighted by their documents,
    at least one each (A19), one row, summed by component."""
    one = centres.withColumn("_one", F.lit(1))
    sums = vector_sum(one, ["_one"], vector, F.greatest(F.coalesce(docs, F.lit(1)), F.lit(1)).cast("double"))
    return sums.select(F.transform("sum_v", lambda x: x / F.col("sum_w")).alias("vector"))


def where(mask: np.ndarray) -> np.ndarray:
    """The flat places of the few that are true, looked for eight at a time."""
    flat = np.ravel(mask)
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    eight = (8 * some[:, None] + np.arange(8)).ravel()
    return np.r_[eight[flat[eight]], np.flatnonzero(flat[whole:]) + whole]


def _best(i: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, ids, cos, place) of the k best of each i: highest cosine, then smallest id."""
    order = np.lexsort((ids, -cos, i))
    i = i[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    keep = place < k
    return i[keep], ids[order][keep], cos[order][keep], place[keep]


class _Side:
    """The k best so far of each row of a block, ids ascending: ``cos`` (to nine
    places, -inf: none yet) and ``ids``."""

    def __init__(self, block: pd.DataFrame, k: int, floor: float):
        block = block.sort_values("id", kind="stable")
        self.own, self.v, self.k, self.floor = block["id"].to_numpy(), np.stack(block["v"].to_numpy()), k, floor
        self.short = self.v.astype(np.float32)
        self.cos, self.ids = np.full((len(block), k), -np.inf), np.zeros((len(block), k), dtype=np.int64)

    def take(self, rows: slice, other: _Side, cols: slice, about: np.ndarray, axis: int) -> None:
        """Take in the products ``about``, in single precision, of own ``rows``
        with the other's ``cols``; ``axis`` is that of the other's. What single
        precision doesn't rule out is multiplied in double precision."""
        error = (self.v.shape[1] + 8) * 2.5e-7
        least = np.maximum(self.cos[rows, -1], self.floor)
        open_ = ~np.isfinite(self.cos[rows, -1])
        if about.shape[axis] > self.k and open_.any():
            kth = about.shape[axis] - self.k
            at = np.partition(about if open_.all() else np.compress(open_, about, 1 - axis), kth, axis=axis).take(kth, axis=axis).astype(np.float64)
            least[open_] = np.maximum(least[open_], at - error)
        least = np.maximum(least - error, -4.0).astype(np.float32)
        at = where(about >= (least[:, None] if axis else least))
        if not len(at):
            return
        i, j = np.divmod(at, about.shape[1])
        i, j = (i, j) if axis else (j, i)
        if len(i) > max(64, 8 * self.k) * len(least):  # many alike: their products are formed at once, the first of equals are the smallest ids
            parts = []
            for n in range(rows.start, rows.stop, 64):
                part = slice(n, min(n + 64, rows.stop))
                s = np.round(self.v[part] @ other.v[cols].T, 9)
                s[self.own[part, None] == other.own[cols]] = -np.inf
                first = np.argsort(-s, axis=1, kind="stable")[:, : self.k]
                parts.append((np.repeat(np.arange(n, part.stop), first.shape[1]), first.ravel() + cols.start, np.take_along_axis(s, first, axis=1).ravel()))
            i, j, cos = (np.concatenate(x) for x in zip(*parts))
        else:
            i, j = i + rows.start, j + cols.start
            cos = np.round(np.einsum("ij,ij->i", self.v[i], other.v[j]), 9)
            cos[self.own[i] == other.own[j]] = -np.inf
        keep = (cos >= self.floor) & (cos >= self.cos[i, -1]) & np.isfinite(cos)
        i, ids, cos, place = _best(i[keep], other.own[j[keep]], cos[keep], self.k)
        some, inv = np.unique(i, return_inverse=True)
        both = np.full((2, len(some), 2 * self.k), np.inf)
        both[1, :, : self.k], both[1, inv, self.k + place] = -self.cos[some], -cos
        names = np.zeros((len(some), 2 * self.k), dtype=np.int64)
        names[:, : self.k], names[inv, self.k + place] = self.ids[some], ids
        order = np.lexsort((names, both[1]), axis=1)[:, : self.k]
        self.cos[some], self.ids[some] = -np.take_along_axis(both[1], order, axis=1), np.take_along_axis(names, order, axis=1)

    def found(self) -> pd.DataFrame:
        some = np.isfinite(self.cos)
        return pd.DataFrame({"src": np.repeat(self.own, some.sum(axis=1)), "dst": self.ids[some], "cos": self.cos[some]})


def _block_top(k: int, floor: float, own: bool = True):
    """The search in a pair of blocks (x, y), for the rows of both if they are of
    one table (``own``; the same rows where x = y), else for those of the first."""

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"src": [], "dst": [], "cos": []}).astype({"src": "int64", "dst": "int64", "cos": "float64"})
        x, same = _Side(left, k, floor), own and key[0] == key[1]
        y = x if same else _Side(right, k, floor)
        for m in range(0, len(y.own), 4096):
            cols = slice(m, min(m + 4096, len(y.own)))
            for n in range(0, len(x.own), 512):
                rows = slice(n, min(n + 512, len(x.own)))
                about = x.short[rows] @ y.short[cols].T
                if same:
                    about[x.own[rows, None] == x.own[cols]] = -8.0
                x.take(rows, y, cols, about, 1)
                if own and not same:
                    y.take(cols, x, rows, about, 0)
        return x.found() if same or not own else pd.concat([x.found(), y.found()], ignore_index=True)

    return search


def knn(vectors: DataFrame, k: int, id_col: str, vector_col: str, floor: float = -2.0) -> DataFrame:
    """(src, dst, cos, rank): each vector's k nearest others by cosine, ties to
    the smaller id (J07, W05).

    Vectors meet in blocks, each pair of blocks once, in one task, as matrix
    products of single precision; only what these can't rule out is multiplied
    in double precision. A pair of blocks returns at most k rows a vector. Blocks
    hold at most about 4 million components, so a vector is sent to as many
    tasks as there are blocks; the products grow with the square of the table.
    Vectors that aren't finite, or have no length, have no neighbours."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    length = norm(F.col("v"))
    with scope() as tables:
        clean = clean.repartition("id").where((length > 0) & (length < float("inf")) & ~F.isnan(length)).withColumn("v", l2_normalise(F.col("v")))
        clean = Saved(clean, "knn-unit").df  # before the copies, so that each is normalised once
        whole = clean.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("size")).first()
        blocks = max(1, math.ceil(whole["n"] * whole["size"] / COMPONENTS), min(BLOCKS, math.ceil(whole["n"] / FEW)))
        clean = clean.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        left = clean.select(F.col("b").alias("x"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("y"), "id", "v").groupBy("x", "y")
        right = clean.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("x"), F.col("b").alias("y"), "id", "v").groupBy("x", "y")
        found = left.cogroup(right).applyInPandas(_block_top(k, floor), "src long, dst long, cos double")
        best = Window.partitionBy("src").orderBy(F.desc("cos"), "dst")
        return tables.keep(Saved(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "knn"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, sim): the centroid of highest cosine, ties to the smaller
    label (J15). Up to MOST centroids go along as one broadcast array, so vectors
    aren't shuffled; more meet the vectors in blocks."""
    c = centroids.select(F.col(label_col).cast("long").alias("l"), l2_normalise(F.col("vector")).alias("c"))
    rows = vectors.select(F.col(id_col), l2_normalise(F.col(vector_col)).alias("_v"))
    blocks = max(1, math.ceil(centroids.count() / MOST))
    parts = c.groupBy(F.pmod(F.xxhash64("l"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("l", "c")).alias("cs"))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else rows.withColumn("_b", F.lit(0))
    near = F.array_max(F.transform("cs", lambda x: F.struct(F.round(dot(F.col("_v"), x["c"]), 9).alias("sim"), (-x["l"]).alias("l"))))
    found = rows.join(F.broadcast(parts) if blocks == 1 else parts, "_b").select(id_col, near.alias("m"))
    found = found if blocks == 1 else found.groupBy(id_col).agg(F.max("m").alias("m"))
    return found.select(id_col, (-F.col("m.l")).cast("int").alias(label_col), F.col("m.sim").alias("sim"))
