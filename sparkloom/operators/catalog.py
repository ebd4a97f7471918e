"""Relational operators: optional filters, clamped pages, set membership, roll-ups."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filter(df: DataFrame, equal: Mapping[str, Any]) -> DataFrame:
    """Equalities, of which empty strings, None and 0 switch themselves off."""
    on = [F.col(c) == v for c, v in equal.items() if v not in ("", None, 0)]
    return df.where(reduce(Column.__and__, on)) if on else df


def payload_filter(df: DataFrame, equal: Mapping[str, Any] = {}, any_of: Mapping[str, list] = {}, none_of: Mapping[str, list] = {}) -> DataFrame:
    """Must equal, must be among, must not be among; empty lists are skipped."""
    on = [F.col(c) == v for c, v in equal.items()] + [F.col(c).isin(v) for c, v in any_of.items() if v] + [~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in none_of.items() if v]
    return df.where(reduce(Column.__and__, on)) if on else df


def has_all(tags: Column, wanted: list[str]) -> Column:
    """All wanted tags present; none wanted is no filter."""
    return F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), tags)) == 0 if wanted else F.lit(True)


def page(df: DataFrame, order: list[Column], limit: int = 60, offset: int = 0, most: int = 200) -> DataFrame:
    """A page with clamped limit and offset."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def zero_filled_days(df: DataFrame, day: str, last: str, days: int = 14) -> DataFrame:
    """(day, n): counts of the last ``days`` UTC days, zero where nothing is."""
    end = F.to_date(F.lit(last))
    every = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("d"))
    counts = df.where(F.col(day).between(F.date_sub(end, days - 1), end)).groupBy(F.col(day).alias("d")).agg(F.count("*").alias("n"))
    return every.join(counts, "d", "left").select(F.col("d").alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def evidence_by_source(evidence: DataFrame, item: str, source: Column, stance: str) -> DataFrame:
    """(item, supports, contradicts): counts of independent sources, where one
    contradiction outweighs any support from the same source (A13)."""
    per = evidence.groupBy(item, source.alias("_s")).agg(F.bool_or(F.col(stance) == "contradicts").alias("c"), F.bool_or(F.col(stance) == "supports").alias("s"))
    return per.groupBy(item).agg(F.count_if(F.col("s") & ~F.col("c")).alias("supports"), F.count_if("c").alias("contradicts"))


def next_numbers(new: DataFrame, before: DataFrame, key: str, number: str, order: list[Column]) -> DataFrame:
    """``new`` with the number that follows the highest of its key in ``before``,
    several rows of a key in ``order`` (J04); from 1 where there is none."""
    last = before.groupBy(F.col(key).alias("_k")).agg(F.max(number).alias("_last"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.withColumn("_nth", nth).join(last, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn(number, (F.coalesce("_last", F.lit(0)) + F.col("_nth")).cast("long")).drop("_nth", "_k", "_last")
