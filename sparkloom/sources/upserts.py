"""A keyed table on disk that rows are put into, key by key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import Saved, remove, scope


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def upsert(rows: DataFrame, folder: str, keys: list[str], order: Column, buckets: int = 64) -> None:
    """Put ``rows`` into the table in ``folder`` (in a place all executors
    share): a row replaces that of its keys, of several the last by ``order``
    (K03). Null keys are keys.

    The table lies in partitions by a hash of the keys. Only partitions that
    get a row are read, merged and written anew, each under a new name, and the
    list of current partitions is replaced at the end; a run that dies before
    leaves the table as it was, and the same rows put in twice change nothing."""
    spark = rows.sparkSession
    with scope():
        last = Window.partitionBy(*keys).orderBy(order.desc())
        new = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").withColumn("bucket", _bucket(keys, buckets))
        new = Saved(new, "upsert-new").df
        met = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as buckets at most
        now = _current(spark, folder)
        version = uuid.uuid4().hex
        merged = new
        if now:
            touched = [f"{folder}/{v}/bucket={b}" for b, v in now.items() if b in met]
            if touched:
                old = spark.read.schema(rows.schema).parquet(*touched).withColumn("bucket", _bucket(keys, buckets))
                same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
                mine = new.select("bucket", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).withColumnRenamed("bucket", "_b")
                on = F.col("bucket") == F.col("_b")
                for s in same:
                    on = on & s
                merged = old.join(mine, on, "left_anti").unionByName(new)
        if met:
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{version}")
        after = {**now, **dict.fromkeys(met, version)}
        listed = spark.createDataFrame(sorted(after.items()), "bucket int, version string")
        listed.coalesce(1).write.parquet(f"{folder}/lists/{_next(spark, folder):09}")
    for old in set(now.values()) - set(after.values()):  # no partition of these is current
        remove(spark, f"{folder}/{old}")


def _lists(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of complete lists."""
    at = f"{folder}/lists"
    if not _exists(spark, at):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(int(f.getPath().getName()) for f in found if _exists(spark, f"{at}/{f.getPath().getName()}/_SUCCESS"))


def _next(spark: SparkSession, folder: str) -> int:
    return (_lists(spark, folder) or [0])[-1] + 1


def _current(spark: SparkSession, folder: str) -> dict[int, str]:
    """Each partition's version in the last complete list."""
    numbers = _lists(spark, folder)
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{folder}/lists/{numbers[-1]:09}").collect()} if numbers else {}


def read_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of a table as it is now."""
    now = _current(spark, folder)
    if not now:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{v}/bucket={b}" for b, v in now.items()])
