"""Sequence packing as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Saved, numbered, scope, small_batches
from ._tokens import by_bytes, encoder, pack_ids

#: Piece lengths are grouped into widths of so many tokens for the linear program.
STEP = 8


def best_pattern(widths: np.ndarray, values: np.ndarray, capacity: int, demand: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of highest value
    that fits. With ``demand``, widths without demand aren't used."""
    if demand is not None:
        values = np.where(demand > 0, values, 0.0)
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = widths <= c
        gain = np.where(fit, values + best[np.maximum(c - widths, 0)], -1.0)
        k = int(np.argmax(gain))
        if fit[k] and gain[k] > best[c - 1] + 1e-12:
            best[c], took[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(widths), dtype=np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(widths[took[c]])
    return float(best[capacity]), pattern


def cutting_stock(widths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Patterns with the number of times each is used, covering ``demand``.

    The linear program (fewest bins) is solved by the revised simplex method;
    a knapsack prices new columns until none helps. Solutions are rounded down,
    and what is left is covered by greedily filled patterns. After ``rounds``
    columns (never met with 256 widths) the solution so far is rounded: still
    every demand is covered, only with more bins.
    """
    m = len(widths)
    if not m:
        return []
    single = np.maximum(1, capacity // widths)
    columns = [np.where(np.arange(m) == i, single, 0) for i in range(m)]
    inverse = np.diag(1.0 / single)
    x = demand / single
    for _ in range(rounds):
        duals = inverse.sum(axis=0)  # every column costs one bin
        value, pattern = best_pattern(widths, duals, capacity)
        if value <= 1 + 1e-9:
            break
        d = inverse @ pattern
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1.0), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = x - step * d
        x[out] = step
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        columns[out] = pattern
    used, left = [], demand.astype(np.int64).copy()
    for pattern, times in zip(columns, x):
        times = int(np.floor(times + 1e-6))
        active = pattern > 0
        if active.any():
            times = min(times, int((left[active] // pattern[active]).min()))
        if times > 0:
            used.append((pattern.copy(), times))
            left -= times * pattern
    while left.any():
        room, pattern = capacity, np.zeros(m, dtype=np.int64)
        for i in np.argsort(-widths, kind="stable"):
            take = min(int(left[i]), room // int(widths[i]))
            pattern[i] = take
            room -= take * int(widths[i])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        used.append((pattern, times))
        left -= times * pattern
    return used


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset``.

    Each document becomes its token ids and ``end_id``, cut into pieces of
    ``length`` and one shorter rest. A histogram of piece widths (at most
    ``length / 8`` classes, whatever the input) goes to the driver, where
    column generation finds the patterns. Pieces are ranked within their width
    class by hash buckets, so a class with a third of all pieces is spread;
    ranks map to patterns through a table of at most classes times patterns
    rows. Offsets come from a window over each sequence.

    Null text counts as empty: one piece with ``end_id`` alone. Repeated rows
    and null ids are packed like others; extra columns are ignored; an empty
    table gives an empty result.
    """
    with scope() as tables:
        return tables.keep(Saved(_packed(docs, tokenizer_path, length, end_id, id_col, text_col), "packed"))


def _packed(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    tail = pack_ids([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, False).encode
        for batch in by_bytes(batches, "text"):
            row, start, size, crc, total = [], [], [], [], []
            for k, text in enumerate(pc.fill_null(batch.column("text"), "").to_pylist()):
                ids = encode(text) + tail
                for at in range(0, len(ids), 4 * length):
                    part = ids[at : at + 4 * length]
                    row.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            ids_of = batch.column("id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(cut, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = Saved(pieces.withColumn("width", F.ceil(F.col("length") / STEP).cast("int")), "pack-pieces").df
    found = pieces.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect()  # at most length / STEP rows
    widths = np.array([r["width"] for r in found], dtype=np.int64)
    plan = cutting_stock(widths, np.array([r["n"] for r in found], dtype=np.int64), length // STEP)
    places, taken, first = [], np.zeros(len(widths), dtype=np.int64), 0
    for pattern, times in plan:
        for i in np.flatnonzero(pattern):
            lo, per = int(taken[i]), int(pattern[i])
            taken[i] += per * times
            places.append((int(widths[i]), lo, int(taken[i]), per, first))
        first += times
    places = spark.createDataFrame(places, "p_width int, lo long, hi long, per long, first long")
    ranked = numbered(pieces, ["width"], ["id", "start", "ids_crc32"], "rank", sum(r["n"] for r in found))
    placed = ranked.join(F.broadcast(places), (F.col("width") == F.col("p_width")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "width", "rank")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("width"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), "offset"
    )
