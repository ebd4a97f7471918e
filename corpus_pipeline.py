"""A corpus pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before
kept, and works on all of it. All but the last return the columns of
``documents``; the last returns the packed pieces.

Extra columns are carried along by name, whatever they are called. Rows that
repeat an id and everything else are one document, of which the second stage
keeps one. An empty table passes through all stages and gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._spark import Saved, scope
from sparkloom.llm.decontam import contamination
from sparkloom.llm.langid import fit, fuse, learn_priors, with_likelihood
from sparkloom.llm.near_dedup import near_duplicates
from sparkloom.llm.packing import pack
from sparkloom.llm.suffix_dedup import without_repeats


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id isn't among ``ids``; rows with a null id stay. The
    rows travel as one struct, so none of their names can clash."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kept = rows.join(ids.select(F.col("doc_id").alias("gone")), F.col("doc.doc_id") == F.col("gone"), "left_anti")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is clear; the source stands for a host.

    Null, empty and letterless texts have no language and go. A null source
    falls back to the prior of all rows; null ids and labels are no matter.
    Repeated rows count as often as they stand. Each text is scored once; what
    is saved of it is its evidence, and in the end the keys of rejected rows."""
    model = fit(docs)
    none = F.lit(None).cast("string")
    host = F.col("source").cast("string")
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("th"), "source").alias("key"), F.col("text").alias("_text"), host.alias("host"), none.alias("suffix"), none.alias("declared"))
    with scope() as tables:
        scored = Saved(with_likelihood(rows, "_text", model).drop("_text"), "pipeline-evidence").df
        gone = fuse(scored, model, learn_priors(scored, model)).where("_rejected").select("key.*").distinct()
        gone = tables.keep(Saved(gone, "pipeline-rejected"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("_th"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th")) & F.col("doc.source").eqNullSafe(F.col("source"))
    return rows.join(gone, same, "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near duplicates.

    Null ids can't be named and stay, as do empty texts. Of rows that repeat an
    id and everything else one stays; rows of one id with different contents
    are one document and stay or go together."""
    with scope() as tables:
        gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
        kept = _without(docs, tables.keep(Saved(gone, "pipeline-near")))
    return _distinct(docs, kept) if _repeats(docs) else kept


def _repeats(docs: DataFrame) -> bool:
    """Whether any id stands twice."""
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    return bool(ids.head(1))


def _distinct(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows that are alike in all columns once; rows without an id as they are."""
    named = kept.where("doc_id IS NOT NULL").dropDuplicates(docs.columns)
    return named.unionByName(kept.where("doc_id IS NULL"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out strings of 100 bytes that start earlier; documents of which
    nothing but blanks is left go.

    Rows with a null id have no place in the order and keep their text. Null
    and empty texts go. ``n_chars``, if there, is counted anew."""
    left = without_repeats(docs)
    left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left
    return left.where("text IS NOT NULL AND trim(text) <> ''")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Rows without an id are named by their text for this stage, so they go too
    if they hold an item; null and empty texts hold nothing and stay."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256)))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("doc_id"), F.col("text"))
    with scope() as tables:
        hits = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
        hits = tables.keep(Saved(hits, "pipeline-leaks"))
    kept = keyed.join(hits.withColumnRenamed("doc_id", "gone"), F.col("doc_id") == F.col("gone"), "left_anti")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens.

    A null or empty text is the end alone; null ids and repeated rows are
    packed like others."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", repeats),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: Minimum hashing, suffix sorting and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage
    saved on its way is deleted once its result stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope() as tables:
            after = Saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
            docs = tables.keep(after)
        if before:
            before.drop()
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
