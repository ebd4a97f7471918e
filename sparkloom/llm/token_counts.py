"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches
from ._tokens import by_bytes, encoder


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = 1 << 19) -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    The text goes to Python in Arrow batches that are cut again by bytes, so a
    batch of long rows needs no more memory than one of short rows; only counts
    come back. Long texts are encoded in pieces cut at safe boundaries, which
    gives the counts of the whole text. Without a shuffle: a lost task is
    redone from its input split.

    Null text counts as empty (0 bytes, 0 tokens). A null id is kept as null.
    Repeated rows give repeated results; other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(tokenizer_path, True).lengths
        for batch in by_bytes(batches, "text", batch_bytes):
            text = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            counts = pa.array(lengths(pc.fill_null(text, "").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, counts], ["id", "n_bytes", "n_tokens"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
