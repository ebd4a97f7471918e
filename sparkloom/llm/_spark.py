"""Spark helpers shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Saved, scope

__all__ = ["Saved", "numbered", "scope", "small_batches"]


def small_batches(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df``, in whose session Arrow batches from now on have at most so many
    bytes (or one row), so that long texts need no more memory than short ones."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int, per_bucket: int = 1024) -> DataFrame:
    """Number the rows of each key from 0 without gaps, whatever the key's size.

    Rows of a key are spread over hash buckets of ``order``; the numbers start
    at the count of the key's rows in lower buckets, so no task holds more than
    a bucket. ``rows`` is the row count of ``df``, from which the number of
    buckets follows. ``df`` is read twice and should be a saved table.
    """
    buckets = max(1, min(1 << 20, math.ceil(rows / per_bucket)))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)))
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), "_start")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = df.withColumn("_row", F.row_number().over(within) - 1)
    on = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = ranked.join(starts, on)
    return joined.withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_row", "_start", "_kb", *[f"_k{i}" for i in range(len(keys))])
