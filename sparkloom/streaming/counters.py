"""Keyed counters, status machines and deduplication. Each takes a batch or a
streaming DataFrame; ``run_available`` runs a stream over what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import Saved, remove, shared_dir
from .stateful import rocks


def events_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files ``name`` in a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_available(stream: DataFrame, keys: list[str], mode: str = "update", folder: str | None = None) -> DataFrame:
    """The stream's result over all that is there now.

    Each micro-batch writes just its own rows, to a folder of its number, so a
    batch that runs twice replaces itself, and its cost is that of the keys that
    changed (X08). In the modes "update" and "complete" a key's row in the last
    batch that has it counts; in "append" all rows do. ``folder``, in a place all
    executors share, keeps rows and checkpoint for a later run, which goes on
    where this one ended; without it both are deleted."""
    spark = stream.sparkSession
    at = folder.rstrip("/") if folder else f"{shared_dir(spark)}/sparkloom-stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    with rocks(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        found = spark.createDataFrame([], stream.schema)
    else:
        schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
        found = spark.read.schema(schema).parquet(f"{at}/rows")
        if mode != "append":
            rest = [c for c in stream.columns if c not in keys]
            found = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")
        found = found.select(*stream.columns)
    if folder:
        return found
    table = Saved(found, "stream")
    remove(spark, at)
    return table.df


def per_minute(events: DataFrame, ts: str, keys: list[str], value: str) -> DataFrame:
    """(keys, minute, requests, total): tumbling minutes."""
    w = F.window(ts, "1 minute")
    return events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("requests"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("minute"), "requests", "total")


def per_day(events: DataFrame, ts: str, keys: list[str], value: str) -> DataFrame:
    """(keys, day, requests, total): a running total for each day."""
    return events.groupBy(*keys, F.date_format(ts, "yyyyMMdd").alias("day")).agg(F.count("*").alias("requests"), F.sum(value).alias("total"))


def living_counts(events: DataFrame, ts: str, keys: list[str], ttl: str) -> DataFrame:
    """(keys, start, last_until, n): counters that end when nothing is counted for ``ttl``."""
    return events.groupBy(*keys, F.session_window(ts, ttl).alias("s")).agg(F.count("*").alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("last_until"), "n")


def lockouts(events: DataFrame, key: str, ts: str, id_col: str, failed: Column, reset: Column, most: int, quiet_seconds: int, lock_seconds: int) -> DataFrame:
    """(key, id, locked_until): the failures that lock a key out: the ``most``-th
    in a row, without a success and without a longer pause between them (X06)."""
    rows = events.select(key, F.col(id_col), F.col(ts).alias("t"), failed.alias("f"), reset.alias("r")).where("f OR r")
    order = Window.partitionBy(key).orderBy("t", id_col)
    pause = F.coalesce(F.col("t").cast("timestamp").cast("double") - F.lag("t").over(order).cast("timestamp").cast("double") > quiet_seconds, F.lit(False))
    new = (pause | F.col("r") | F.coalesce(F.lag("r").over(order), F.lit(False))).cast("int")
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order)).where("f AND NOT r")
    nth = runs.withColumn("n", F.row_number().over(Window.partitionBy(key, "run").orderBy("t", id_col)))
    return nth.where(F.col("n") % most == 0).select(key, id_col, (F.col("t") + F.make_interval(secs=F.lit(lock_seconds))).alias("locked_until"))


def decided(events: DataFrame, key: str, ts: str, id_col: str, value: Column, quiet_seconds: int) -> DataFrame:
    """(key, value, fired_at): the batch form of ``stateful.debounced`` (X09): a
    value that stands for ``quiet_seconds`` before it changes, or before the
    last row of all, and isn't the one that fired last. Values of 0 or less
    never fire."""
    order = Window.partitionBy(key).orderBy("t", "i")
    rows = events.select(key, F.col(ts).alias("t"), F.col(id_col).alias("i"), value.cast("long").alias("value"))
    changes = rows.withColumn("was", F.coalesce(F.lag("value").over(order), F.lit(0))).where("value <> was")
    until = changes.withColumn("next", F.lead("t").over(order)).join(F.broadcast(rows.agg(F.max("t").alias("end"))))
    fired = F.col("t") + F.make_interval(secs=F.lit(quiet_seconds))
    stood = until.withColumn("fired_at", fired).where("value > 0 AND fired_at <= coalesce(next, end)")
    return stood.withColumn("last", F.lag("value").over(order)).where("last IS NULL OR last <> value").select(key, "value", "fired_at")


def latest_status(events: DataFrame, key: str, status: str, order: Column, count: str) -> DataFrame:
    """(key, status, count): the latest status, and the latest count that isn't null."""
    return events.groupBy(key).agg(F.max_by(status, order).alias(status), F.max_by(count, F.when(F.col(count).isNotNull(), order)).alias(count))


def first_of_each(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each combination of keys, kept in state on a stream."""
    return events.dropDuplicates(keys)
