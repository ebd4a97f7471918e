"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by size; the items of a class have at most u
shingles. Documents are cut into segments of 2u shingles that begin every u, so
an item that a document holds lies whole in one segment, and its containment
becomes a Jaccard similarity bounded from below, however long the document.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Saved, scope

#: Coordinates of a signature. An item three quarters of which stand in a
#: segment agrees with it in none with probability under (1 - 0.18)**64 = 3e-6.
COORDINATES = 64
WORDS = 5

#: XOR with a fixed number permutes 64-bit hashes: the minimum is the hash nearest to it.
_MASKS = [int.from_bytes(((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)).to_bytes(8, "little"), "little", signed=True) for i in range(COORDINATES)]


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def shingle_list(words: Column) -> Column:
    """Hashes of all five-word shingles in order; of the whole sequence, if it is
    shorter; without words, none."""
    n = F.size(words)
    full = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))
    return F.when(n >= WORDS, full).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words), n))).otherwise(F.array().cast("array<long>"))


def _nearest(shingles: Column, mask: int) -> Column:
    return F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(mask))))


def _signature(shingles: Column) -> Column:
    """(coordinate, value) of a set of shingles."""
    return F.array(*[F.struct(F.lit(j).alias("j"), _nearest(shingles, mask).alias("v")) for j, mask in enumerate(_MASKS)])


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, item, n_item, n_common): the documents that hold at least
    ``percent`` per cent of the distinct five-word shingles of a test item.

    1. Only documents that hold a shingle which some item's signature names can
       agree with it in a coordinate; they are found in one pass without a
       shuffle of texts (the signatures' shingles are broadcast where Spark
       finds them small, joined by shuffle where not).
    2. These documents' segments get signatures, joined to those of the items
       of the class by class, coordinate and value.
    3. Each pair found is checked by exact shingle containment.

    Items or documents whose text is null, empty or without words match
    nothing, as do null ids. A text of fewer than five words is one shingle and
    matches only an equal text. Rows that repeat an id count as one document
    with all their shingles (items: likewise). Other columns are ignored; an
    empty table on either side gives an empty result.
    """
    with scope() as tables:
        checked = tables.keep(Saved(_contained(docs, bench, id_col, text_col, item_col, item_text_col, percent), "bench-found"))
    return checked.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_common")


def _contained(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, percent: int) -> DataFrame:
    items = bench.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(shingle_list(word_list(F.col(item_text_col)))).alias("h")).distinct()
    sized = items.groupBy("item").agg(F.collect_set("h").alias("item_hs"), F.count("*").alias("n_item"))
    sized = Saved(sized.withColumn("u", F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("int")), "bench-items").df
    signed = sized.select("item", "u", F.explode(_signature(F.col("item_hs"))).alias("s")).select("item", "u", "s.*")
    signed = Saved(signed, "bench-signatures").df
    mask = F.element_at(F.lit(_MASKS), F.col("j") + 1)
    named = Saved(signed.select(F.col("v").bitwiseXOR(mask).alias("h")).distinct(), "bench-named").df

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = rows.select("id", word_list(F.col("text")).alias("w"))
    seeds = words.select("id", F.explode(shingle_list(F.col("w"))).alias("h")).join(named, "h", "left_semi").select("id").distinct()
    seeds = Saved(seeds, "bench-seeds").df
    suspects = rows.join(seeds, "id", "left_semi").select("id", word_list(F.col("text")).alias("w")).select("id", shingle_list(F.col("w")).alias("hs"))
    suspects = Saved(suspects, "bench-suspects").df

    classes = [r["u"] for r in sized.select("u").distinct().collect()]  # a power of two each: 31 at most
    starts = F.sequence(F.lit(0), F.greatest(F.size("hs") - 1, F.lit(0)), F.col("u"))
    by_class = suspects.select("id", "hs", F.explode(F.array(*[F.lit(u) for u in sorted(classes)]).cast("array<int>")).alias("u"))
    segments = by_class.select("id", "u", "hs", F.explode(starts).alias("at")).select("id", "u", F.slice("hs", F.col("at") + 1, 2 * F.col("u")).alias("seg"))
    found = segments.select("id", "u", F.explode(_signature(F.col("seg"))).alias("s")).select("id", "u", "s.*").join(signed, ["u", "j", "v"]).select("id", "item").distinct()
    found = Saved(found, "bench-candidates").df
    # only the pairs found are compared, and of each only what both hold goes on
    both = found.join(sized.select("item", "item_hs", "n_item"), "item").join(suspects, "id")
    common = both.select("id", "item", "n_item", F.explode(F.array_intersect("hs", "item_hs")).alias("h"))
    counted = common.groupBy("id", "item", "n_item").agg(F.countDistinct("h").alias("n_common"))
    return counted.where(100 * F.col("n_common") >= percent * F.col("n_item")).select("id", "item", "n_item", "n_common")
