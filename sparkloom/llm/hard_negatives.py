"""Hard-negative mining with a vector-approximation file."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Saved, scope
from .topk import components

#: Vectors in a block, and anchors that meet a block in one task.
BLOCK, ANCHORS = 4096, 2048
#: Cells of a dimension (a byte), and rows their borders are fitted on.
CELLS, SAMPLE = 64, 4096
_LONG = (1 << 63) - 1


def cell_borders(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """(dimension, cells - 1): inner borders with about as many of the sample's
    components in each cell; a component lies in the cell numbered by how many
    borders are at most as large as it."""
    if not len(sample):
        return np.zeros((sample.shape[1], cells - 1), dtype=np.int64)
    return np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="higher").T.astype(np.int64)


class Approximations:
    """A block's vectors by label, and the cell of each component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, borders: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order].astype(np.int64)
        self._once()
        self.cells = np.stack([np.searchsorted(b, x, "right") for b, x in zip(borders, self.vectors.T)]).astype(np.uint8)
        # what a component in a cell can be: between its borders, and for the outer cells up to the block's extremes
        low, high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        self.lo = np.maximum(np.column_stack([low, borders]), low[:, None])
        self.hi = np.minimum(np.column_stack([borders - 1, high]), high[:, None])
        self.hi = np.maximum(self.hi, self.lo)  # cells without members
        self.most = max(abs(int(low.min())), abs(int(high.max())))

    def _once(self) -> None:
        """Of rows alike in id, label and vector one stays."""
        if len(np.unique(self.ids)) == len(self.ids):
            return
        seen, stay = set(), np.zeros(len(self.ids), dtype=bool)
        for k, row in enumerate(zip(self.ids.tolist(), self.labels.tolist(), map(bytes, self.vectors))):
            stay[k] = row not in seen
            seen.add(row)
        self.ids, self.labels, self.vectors = self.ids[stay], self.labels[stay], self.vectors[stay]

    def kind(self, anchor: np.ndarray) -> type:
        """Numbers that hold every sum of products exactly. Those beyond floats
        (where scores may also be cut to a long) are rare and scored in full."""
        limit = self.most * max(abs(int(x)) for x in anchor) * len(anchor)
        return np.float64 if limit < 1 << 53 else object

    def bounds(self, anchor: np.ndarray, rows: slice | np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product each row can have by its
        cells: for every dimension a table of the products' limits by cell, in
        which the rows' cells are looked up."""
        q = anchor.astype(kind)[:, None]
        a, b = q * self.lo.astype(kind), q * self.hi.astype(kind)
        least, largest = np.minimum(a, b), np.maximum(a, b)
        cells = self.cells[:, rows]
        low, high = least[0].take(cells[0]), largest[0].take(cells[0])
        for d in range(1, len(cells)):
            low += least[d].take(cells[d])
            high += largest[d].take(cells[d])
        return low, high

    def scores(self, anchor: np.ndarray, rows: np.ndarray, kind: type) -> np.ndarray:
        """Exact inner products; beyond a long they count as its limit."""
        found = self.vectors[rows].astype(kind) @ anchor.astype(kind)
        return np.clip(found, -_LONG - 1, _LONG).astype(np.int64)

    def nearest(self, own: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, rows scored): the k best rows of the label but the anchor's own."""
        first, last = np.searchsorted(self.labels, [label, label + 1])
        rows = np.arange(first, last)
        rows = rows[self.ids[rows] != own]
        if not len(rows):
            return rows, rows, 0
        kind = self.kind(anchor)
        if len(rows) > k and kind is np.float64:
            low, high = self.bounds(anchor, rows, kind)
            rows = rows[high >= np.sort(low)[-k]]
        return *self._best(rows, self.scores(anchor, rows, kind), k), len(rows)

    def in_windows(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window (least, largest score) the (ids, scores) of the k
        best rows of other labels in it, and how many rows were scored at all.

        A row whose bounds lie in the window is certainly there; once there are
        k of them, rows that can't reach the k-th largest lower bound are out."""
        first, last = np.searchsorted(self.labels, [label, label + 1])
        rows = np.concatenate([np.arange(first), np.arange(last, len(self.labels))])
        if not len(rows):
            return [(rows, rows)] * len(windows), 0
        kind = self.kind(anchor)
        low, high = self.bounds(anchor, rows, kind)
        open_ = np.zeros(len(rows), dtype=bool)
        masks = []
        for least, largest in windows:
            sure = low[(low >= least) & (high <= largest)]
            floor = max(least, np.sort(sure)[-k]) if len(sure) >= k else least
            masks.append((high >= floor) & (low <= largest) if kind is np.float64 else np.ones(len(rows), dtype=bool))
            open_ |= masks[-1]
        scores = np.zeros(len(rows), dtype=np.int64)
        scores[open_] = self.scores(anchor, rows[open_], kind)
        found = []
        for mask, (least, largest) in zip(masks, windows):
            inside = mask & (scores >= least) & (scores <= largest)
            found.append(self._best(rows[inside], scores[inside], k))
        return found, int(open_.sum())

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.lexsort((self.ids[rows], ~scores))[:k]  # ~x falls as x grows, without overflow
        return self.ids[rows[best]], scores[best]


def _block(frame: pd.DataFrame, borders: np.ndarray) -> Approximations:
    return Approximations(frame["vec_id"].to_numpy(), frame["label"].to_numpy(), np.stack(frame["v"].to_numpy()), borders)


def _positives(k: int, borders: np.ndarray):
    def meet(key, anchors: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(vectors):
            block = _block(vectors, borders)
            for own, label, v in zip(anchors["vec_id"], anchors["label"], anchors["v"]):
                ids, scores, _ = block.nearest(own, label, np.asarray(v, dtype=np.int64), k)
                out.append((np.full(len(ids), own), ids, scores))
        return _frame(("anchor_id", "positive_id", "positive_score"), out)

    return meet


def _negatives(k: int, percent: int, borders: np.ndarray):
    def meet(key, anchors: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(vectors):
            block = _block(vectors, borders)
            for own, label, v, tops in zip(anchors["vec_id"], anchors["label"], anchors["v"], anchors["tops"]):
                tops = [int(x) for x in tops]
                windows = [(max(-(-percent * x // 100), -_LONG - 1), x) for x in tops]
                found, _ = block.in_windows(label, np.asarray(v, dtype=np.int64), windows, k)
                out += [(np.full(len(ids), own), np.full(len(ids), x), ids, scores) for x, (ids, scores) in zip(tops, found)]
        return _frame(("anchor_id", "positive_score", "negative_id", "negative_score"), out)

    return meet


def _frame(names: tuple[str, ...], parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    whole = map(np.concatenate, zip(*parts)) if parts else [np.zeros(0)] * len(names)
    return pd.DataFrame({n: x.astype(np.int64) for n, x in zip(names, whole)})


def hard_negatives(vectors: DataFrame, anchors: DataFrame, k: int = 5, percent: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor and each of its ``k`` best rows of its
    label, the first ``k`` rows of other labels that score at least ``percent``
    per cent of the positive and no more than it.

    Scores are inner products of components floor(scale * x); higher ones come
    first, ties by smaller id. Every component lies in one of 64 cells, whose
    borders are quantiles of a sample of at most 4096 vectors (the smallest by
    a hash of the row); every vector is in the file of approximations. Rows are
    dealt to blocks of about 4096 by a hash, every anchor meets every block, in
    groups of at most 2048. In a block an anchor's tables of products by cell
    give each row's least and largest score; only rows that may be among the
    best, or enter a window, are scored exactly. So a task holds one block and
    one group, and sends back at most k rows a window.

    Rows with a null id, label or vector, or null or non-finite components take
    no part, nor do empty vectors, nor vectors that differ in length from most
    (ties: the longer length stays). Components and scores beyond a long count
    as its limit. Rows alike in id, label and components are one row; rows of
    one id that differ are rows each, but no row is a positive of its own id;
    of several anchor rows with one id that with the largest (label, vector)
    counts. An anchor without positives, or a positive without negatives in its
    window, gives no rows, as does a negative positive_score. Other columns are
    ignored; an empty table gives an empty result.
    """
    with scope() as tables:
        return tables.keep(Saved(_mined(vectors, anchors, k, percent, id_col, vector_col, label_col, scale), "hard-negatives"))


def _mined(vectors: DataFrame, anchors: DataFrame, k: int, percent: int, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    def clean(df: DataFrame) -> DataFrame:
        label = F.col(label_col).cast("long")
        return components(df.where(label.isNotNull()), id_col, vector_col, scale, label.alias("label"))

    base = Saved(clean(vectors), "negatives-vectors").df
    size = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims, n = (size["d"], size["count"]) if size else (0, 0)
    base = base.where(F.size("v") == dims)
    asked = clean(anchors).where(F.size("v") == dims).groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("a")).select("vec_id", "a.*")
    asked = Saved(asked, "negatives-anchors").df
    sample = base.orderBy(F.xxhash64("vec_id", "label", "v")).limit(SAMPLE).select("v").collect()
    borders = cell_borders(np.array([r["v"] for r in sample], dtype=np.int64).reshape(len(sample), dims))
    blocks, groups = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(asked.count() / ANCHORS))
    base = base.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    by_block = base.select("grp", "block", "vec_id", "label", "v").groupBy("grp", "block")

    def meet(rows: DataFrame, work, schema: str) -> DataFrame:
        rows = rows.withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return rows.groupBy("grp", "block").cogroup(by_block).applyInPandas(work, schema)

    def first(rows: DataFrame, keys: list[str], score: str, ident: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
        return rows.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = meet(asked, _positives(k, borders), "anchor_id long, positive_id long, positive_score long")
    near = Saved(first(near, ["anchor_id"], "positive_score", "positive_id").drop("rank"), "negatives-positives").df
    tops = near.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("tops")).withColumnRenamed("anchor_id", "vec_id")
    far = meet(asked.join(tops, "vec_id"), _negatives(k, percent, borders), "anchor_id long, positive_score long, negative_id long, negative_score long")
    far = first(far, ["anchor_id", "positive_score"], "negative_score", "negative_id")
    found = near.join(far, ["anchor_id", "positive_score"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
