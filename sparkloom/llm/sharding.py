"""Sharding by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Saved, numbered, scope, small_batches
from ._tokens import by_bytes, encoder

#: A group of equal texts with over 1/HEAVY of any total is placed on the driver by itself.
HEAVY = 512
#: Lighter groups: so many in a part on average, and at most so many parts; the bins of all parts together.
PART, PARTS, BINS = 4096, 4096, 4096


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit: largest first, each where the dot product of its
    load with what is left of the shard's capacity is highest.

    ``loads`` has a row for each unit, with its share of each total. Shards
    start with the capacity 1/shards in each dimension; what is left may turn
    negative, so an overfull dimension counts against a shard. Ties go to the
    lower shard.
    """
    out = np.zeros(len(loads), dtype=np.int64)
    left = np.full((shards, loads.shape[1]), 1.0 / shards)
    for i in np.lexsort((np.arange(len(loads)), -loads.max(axis=1, initial=0.0))):
        best = int(np.argmax(left @ loads[i]))
        out[i] = best
        left[best] -= loads[i]
    return out


def _binned(bins: int, parts: int):
    """Places the groups of each part, which come largest first, one by one into
    the part's bins; only what is left of the bins is kept in memory."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, np.zeros((bins, 3))
        for batch in batches:
            part = batch.column("part").to_pylist()
            loads = np.stack([batch.column(c).to_numpy() for c in ("sb", "st", "sr")], axis=1)
            out = np.empty(len(part), dtype=np.int64)
            for i, p in enumerate(part):
                if p != now:
                    now, left = p, np.full((bins, 3), 1.0 / (parts * bins))
                best = int(np.argmax(left @ loads[i]))
                left[best] -= loads[i]
                out[i] = p * bins + best
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(out), *(batch.column(c) for c in ("sb", "st", "sr"))], ["grp", "unit", "sb", "st", "sr"])

    return binned


def _measured(tokenizer_path: str):
    """Rows with the number of tokens of each text."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(tokenizer_path, True).lengths
        for batch in by_bytes(batches, "text"):
            counts = pa.array(lengths(pc.fill_null(batch.column("text"), "").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "size", "text_crc32", "grp")), counts], ["id", "size", "text_crc32", "grp", "n_tokens"])

    return measured


def shard(docs: DataFrame, tokenizer_path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``size``, ``text_crc32``, ``n_tokens``, ``law`` ("bytes"),
    ``shard``, ``slot`` (gapless from 0 in the shard) and ``grown_shard`` (null).

    Equal texts form a group and stay together, unless the group alone exceeds
    a shard's share of the bytes, tokens or rows: such a group is cut into
    parts of about a sixteenth of a shard by a hash of the id, since it fits nowhere.
    Loads are summed by Spark, partial sums first.

    Groups are placed one by one where the dot product of their load with the
    residual capacity is highest, in two levels. Groups with over 1/512 of a
    total (at most 1536) wait for the second level. The others are dealt to
    parts by a hash of the group, about 4096 to a part; a task places a part's
    groups, largest first, into the part's bins. At the second level the
    driver places bins and large groups, at most 34304 units whatever the
    input, into the shards. A table of few groups has one part, whose groups
    are each a bin of their own.

    Numbering within a shard goes by hash buckets, so no task holds a shard.
    Null text has no bytes (size 1, crc32 0, no tokens) and forms a group with
    empty text. Null ids and repeated rows are placed like others; extra
    columns are ignored; an empty table gives an empty result.
    """
    with scope() as tables:
        rows, total = _placed(docs, tokenizer_path, shards, id_col, text_col)
        rows = tables.keep(rows)
    return numbered(rows, ["shard"], ["id", "text_crc32"], "slot", total).select(
        F.col("id").alias(id_col), "size", "text_crc32", "n_tokens", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _placed(docs: DataFrame, tokenizer_path: str, shards: int, id_col: str, text_col: str) -> tuple[Saved, int]:
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_type = docs.schema[id_col].dataType.simpleString()
    asked = small_batches(docs).select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"), text.alias("text")
    )
    base = Saved(asked.mapInArrow(_measured(tokenizer_path), f"id {id_type}, size long, text_crc32 long, grp binary, n_tokens long"), "shard-rows").df
    loads = [F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("r")]
    total = [max(1, int(x or 0)) for x in base.agg(*loads).first()]
    sizes = [(F.col(c) / F.lit(float(t))).alias(s) for c, t, s in zip("btr", total, ("sb", "st", "sr"))]
    groups = base.groupBy("grp").agg(*loads).select("grp", "r", *sizes).withColumn("most", F.greatest("sb", "st", "sr"))
    groups = Saved(groups, "shard-groups").df

    # at most 3 * HEAVY groups are heavy, as each has over 1/HEAVY of one of three totals
    heavy = groups.where(F.col("most") > 1.0 / HEAVY)
    cut = F.when((F.col("most") > 1.0 / shards) & (F.col("r") > 1), F.ceil(16 * shards * F.col("most"))).otherwise(1).cast("int")
    heavy = heavy.select(F.col("grp").alias("h_grp"), cut.alias("pieces"))
    rows = base.join(F.broadcast(heavy), F.col("grp") == F.col("h_grp"), "left").drop("h_grp")
    rows = rows.withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("id", "grp"), F.col("pieces"))))
    rows = Saved(rows.drop("pieces"), "shard-cut").df

    light = groups.where(F.col("most") <= 1.0 / HEAVY)
    n = light.count()
    parts = max(1, min(PARTS, math.ceil(n / PART)))
    if parts == 1:
        units = light.select("grp", F.monotonically_increasing_id().alias("unit"), "sb", "st", "sr")
    else:
        dealt = light.withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(parts)).cast("long")).drop("r")
        dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", F.desc("most"), "grp").select("grp", "part", "sb", "st", "sr")
        units = dealt.mapInArrow(_binned(max(shards, BINS // parts), parts), "grp binary, unit long, sb double, st double, sr double")
    units = Saved(units, "shard-bins").df
    bins = units.groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("sb", "st", "sr")]).orderBy("unit").collect()
    pieces = rows.where("piece IS NOT NULL").groupBy("grp", "piece").agg(*loads).orderBy("grp", "piece").collect()
    shares = [[x["sb"], x["st"], x["sr"]] for x in bins] + [[x[c] / t for c, t in zip("btr", total)] for x in pieces]
    where = place(np.array(shares, dtype=float).reshape(len(shares), 3), shards).tolist()

    by_unit = spark.createDataFrame([(x["unit"], s) for x, s in zip(bins, where)], "p_unit long, shard int")
    by_piece = spark.createDataFrame([(bytes(x["grp"]), x["piece"], s) for x, s in zip(pieces, where[len(bins) :])], "p_grp binary, p_piece long, shard int")
    by_group = units.join(F.broadcast(by_unit), F.col("unit") == F.col("p_unit")).select(F.col("grp").alias("p_grp"), "shard")
    columns = ["id", "size", "text_crc32", "n_tokens", "shard"]
    big = rows.where("piece IS NOT NULL").join(F.broadcast(by_piece), (F.col("grp") == F.col("p_grp")) & (F.col("piece") == F.col("p_piece"))).select(columns)
    small = rows.where("piece IS NULL").join(by_group, F.col("grp") == F.col("p_grp")).select(columns)
    return Saved(big.unionByName(small), "shard-placed"), total[2]
