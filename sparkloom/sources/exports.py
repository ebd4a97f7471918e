"""Writers: CSV and JSON exports of a board, rows as JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_cell(value: Column) -> Column:
    """A cell in quotes where it holds a quote, a semicolon or a line end."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[";\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str], shares: tuple[str, ...] = ()) -> DataFrame:
    """(line): cells joined by semicolons; ``shares`` as whole per cent."""
    cells = [F.floor(F.col(c) * 100 + 0.5).cast("string") if c in shares else F.col(c) for c in columns]
    return df.select(F.concat_ws(";", *[csv_cell(c) for c in cells]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 files with a byte-order mark in the header, semicolons and CRLF."""
    named = df.toDF("﻿" + df.columns[0], *df.columns[1:])
    named.write.csv(path, sep=";", lineSep="\r\n", header=True, mode="overwrite", escape='"')


def json_items(df: DataFrame, id_col: str, priority: str) -> DataFrame:
    """(place, item): rows as JSON by descending priority, null counts as -1."""
    order = F.coalesce(F.col(priority), F.lit(-1))
    return df.select(F.col(id_col), order.alias("_o"), F.to_json(F.struct(*df.columns)).alias("item")).orderBy(F.desc("_o"), id_col).drop("_o")


def write_rows(df: DataFrame, path: str) -> None:
    """The same rows as JSON lines and as Parquet."""
    df.write.json(f"{path}/json", mode="overwrite")
    df.write.parquet(f"{path}/parquet", mode="overwrite")
