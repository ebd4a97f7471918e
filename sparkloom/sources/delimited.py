"""Delimited texts (CSV, TSV) as rows, and rows as lines of text with anchors."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_delimited

DELIMITERS = (",", ";", "\t", "|")
#: Records looked at to find the delimiter; letters of a cell; letters of a line.
SAMPLE, CELL, LINE = 32, 256, 900


def _records(text: str, delimiter: str) -> Iterator[list[str]]:
    return csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, skipinitialspace=True)


def _filled(record: list[str]) -> int:
    return sum(bool(cell.strip()) for cell in record)


def named_delimiter(text: str, filename: str, mime: str) -> str | None:
    """What a first line ``sep=`` or the file's kind say."""
    head = text.partition("\n")[0].rstrip("\r")
    if len(head) == 5 and head[:4].lower() == "sep=" and head[4] in DELIMITERS:
        return head[4]
    tabs = filename.lower().endswith(".tsv") or mime.split(";")[0].strip().lower() == "text/tab-separated-values"
    return "\t" if tabs else None


def find_delimiter(text: str) -> str | None:
    """The candidate that gives most records with several cells, ten points each,
    and one for each that is as wide as the record before; on a tie the one that
    comes first in the first line. At least two such records are needed."""
    first = next((line for line in text.split("\n") if line.strip()), "")
    found = []
    for order, candidate in enumerate(DELIMITERS):
        widths: list[int] = []
        for record in _records(text, candidate):
            if (n := _filled(record)) and len(widths) < SAMPLE:
                widths.append(n)
            elif n:
                break
        many = sum(w > 1 for w in widths)
        if many >= 2:
            even = sum(a == b > 1 for a, b in zip(widths, widths[1:]))
            place = first.find(candidate)
            found.append((-(10 * many + even), place if place >= 0 else len(first), order, candidate))
    return min(found)[3] if found else None


class Names:
    """Header names that differ whatever their case."""

    def __init__(self):
        self.seen: set[str] = set()

    def unique(self, base: str) -> str:
        name, k = base, 1
        while name.lower() in self.seen:
            k += 1
            name = f"{base}_{k}"
        self.seen.add(name.lower())
        return name


def parse(text: str, filename: str, mime: str) -> tuple[str, list[tuple[int, list[str], list[str]]]] | None:
    """The delimiter, and (number, headers, cells) of each row that isn't blank;
    None for what is no table of two columns or more."""
    text = text.removeprefix("﻿")
    delimiter = named_delimiter(text, filename, mime)
    if text[:4].lower() == "sep=" and delimiter:
        text = text.partition("\n")[2]
    delimiter = delimiter or find_delimiter(text)
    if delimiter is None:
        return None
    headers, names, rows = None, Names(), []
    for number, record in enumerate(filter(None, _records(text, delimiter)), 1):  # empty lines aren't records
        if not _filled(record):
            continue
        cells = [cell.strip() for cell in record]
        if headers is None:
            headers = [names.unique(cell or f"unnamed_{i}") for i, cell in enumerate(cells, 1)]
            continue
        headers = headers + [names.unique(f"extra_{i}") for i in range(len(headers) + 1, len(cells) + 1)]
        rows.append((number, headers, cells))
    return (delimiter, rows) if rows and len(rows[-1][1]) >= 2 else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    for batch in batches:
        out: list[tuple] = []
        for at, (text, name, mime) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "name", "mime")))):
            if found := parse(text or "", name or "", mime or ""):
                out += [(at, found[0], *row) for row in found[1]]
        columns = [pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [()] * 5, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(columns[0]), batch.column("name").take(columns[0]), *columns[1:]], ["id", "name", "delimiter", "row", "headers", "cells"])


def delimited_rows(files: DataFrame, id_col: str, text_col: str, name: Column, mime: Column) -> DataFrame:
    """(id, name, delimiter, row, headers, cells): the rows of all files that are
    delimited tables by name or type (S02, S03, S04). Others give none."""
    id_type = files.schema[id_col].dataType.simpleString()
    asked = files.where(is_delimited(mime, name)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), name.alias("name"), mime.alias("mime"))
    return asked.mapInArrow(_rows, f"id {id_type}, name string, delimiter string, row long, headers array<string>, cells array<string>").withColumnRenamed("id", id_col)


def row_lines(rows: DataFrame) -> DataFrame:
    """``rows`` with ``lines``: each row as text that names its source.

    A line holds the source with the row's number and columns, then the cells as
    header=value, each cut at 256 letters; a row whose line would pass 900
    letters goes on in further lines, each with the first cell again."""
    safe = lambda c: F.trim(F.replace(c, F.lit("|"), F.lit("/")))
    cut = lambda c: F.when(F.length(c) > CELL, F.concat(F.substring(c, 1, CELL), F.lit("..."))).otherwise(c)
    head = F.transform("headers", safe)
    fields = F.transform("cells", lambda c, i: F.struct(F.get(head, i).alias("name"), F.concat(F.get(head, i), F.lit("="), safe(cut(c))).alias("text"), (c != "").alias("some")))
    base = F.replace(F.url_encode(F.regexp_extract("name", "([^/]*)$", 1)), F.lit("+"), F.lit("%20"))
    row = F.col("row").cast("string")

    def line(part: Column) -> Column:
        uri = F.concat(F.lit("source_uri="), base, F.lit("#rows="), row, F.array_join(F.transform(part, lambda f: F.concat(F.lit("&columns="), F.url_encode(f["name"]))), ""))
        return F.concat(uri, F.lit(" | row="), row, F.array_join(F.transform(part, lambda f: F.concat(F.lit(" | "), f["text"])), ""))

    # parts: rows of fields; the last one grows until its line would be too long
    some = F.filter(fields, lambda f: f["some"])
    first = F.slice(some, 1, 1)
    none = F.filter(F.array(first), lambda _: F.lit(False))

    def add(parts: Column, f: Column) -> Column:
        last = F.element_at(parts, -1)
        grown = F.concat(last, F.array(f))
        fits = F.length(line(F.when(F.array_contains(grown, F.get(first, F.lit(0))), grown).otherwise(F.concat(first, grown)))) <= LINE
        return F.when(F.size(parts) == 0, F.array(F.array(f))).when(fits, F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(grown))).otherwise(F.concat(parts, F.array(F.array(f))))

    rows = rows.withColumn("_parts", F.aggregate(some, none, add)).withColumn("_first", first)
    lines = F.transform("_parts", lambda p: line(F.when(F.array_contains(p, F.get("_first", F.lit(0))), p).otherwise(F.concat(F.col("_first"), p))))
    return rows.withColumn("lines", lines).drop("_parts", "_first")
