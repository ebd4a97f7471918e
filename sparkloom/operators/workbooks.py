"""Blocks, windows and cells of workbooks, over a table of their cells, and the
addresses that point into them.

Cells: (file, sheet, row, col, value, formula), rows and columns from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a window, and headers named in an address. Fixed values.
ROWS, COLUMNS = 25, 16


def column_label(col: Column) -> Column:
    """A, B, … Z, AA, … ZZZ for 1, 2, … 18278."""
    a = col - 1
    b = F.floor(a / 26) - 1
    c = F.floor(b / 26) - 1
    letter = lambda x: F.char(65 + F.pmod(x, F.lit(26)))
    return F.concat(F.when(col > 702, letter(c)).otherwise(""), F.when(col > 26, letter(b)).otherwise(""), letter(a))


def column_number(label: Column) -> Column:
    """The column of a label."""
    return F.aggregate(F.split(label, ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def address(row: Column, col: Column) -> Column:
    return F.concat(column_label(col), row.cast("string"))


def encoded(x: Column) -> Column:
    """Per cent encoding of all but letters, digits and ``-._~``."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def address_uri(file: Column, sheet: Column, cells: Column, first: Column, last: Column, headers: Column) -> Column:
    """The address of a range: file, sheet, range, rows and at most 16 headers."""
    named = F.slice(F.filter(headers, lambda h: h != ""), 1, COLUMNS)
    parts = [encoded(file), F.lit("#sheet="), encoded(sheet), F.lit("&range="), encoded(cells), F.lit("&row_start="), first.cast("string"), F.lit("&row_end="), last.cast("string")]
    return F.concat(*parts, F.array_join(F.transform(named, lambda h: F.concat(F.lit("&columns="), encoded(h))), ""))


def read_uri(uri: Column) -> Column:
    """An address's (file, sheet, range, row_start, row_end, columns, block_id),
    from its fragment, else its query; rows from the range where they aren't
    given; the block's name by default sheet!range (S10). What is missing is null."""
    rest = F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).when(uri.contains("?"), F.substring_index(uri, "?", -1)).otherwise("")
    decode = lambda x: F.try_url_decode(x)
    one = lambda key: decode(F.nullif(F.regexp_extract(rest, f"(?:^|&){key}=([^&]*)", 1), F.lit("")))
    cells = one("range")
    row = lambda n: F.regexp_extract(cells, "^\\$?[A-Za-z]+\\$?(\\d+)(?::\\$?[A-Za-z]+\\$?(\\d+))?$", n)
    number = lambda x: F.nullif(x, F.lit("")).try_cast("int")
    first = F.coalesce(number(one("row_start")), number(row(1)))
    last = F.coalesce(number(one("row_end")), number(row(2)), number(row(1)))
    named = F.transform(F.regexp_extract_all(rest, F.lit("(?:^|&)columns=([^&]*)"), F.lit(1)), decode)
    block = F.coalesce(one("block_id"), F.when(one("sheet").isNotNull() & cells.isNotNull(), F.concat(one("sheet"), F.lit("!"), cells)))
    file = F.nullif(decode(F.regexp_extract(uri, "^([^#?]*)", 1)), F.lit(""))
    return F.struct(file.alias("file"), one("sheet").alias("sheet"), cells.alias("range"), first.alias("row_start"), last.alias("row_end"), named.alias("columns"), block.alias("block_id"))


def unit(header: Column) -> Column:
    """``%`` if the header has it, else what its last round or square brackets hold."""
    out = F.lit("")
    for a, b in (("\\[", "\\]"), ("\\(", "\\)")):
        held = f"{a}([^{a}]*){b}[^{a}{b}]*$"
        out = F.when(header.contains(b[1]) & header.rlike(held), F.trim(F.regexp_extract(header, held, 1))).otherwise(out)
    return F.when(header.contains("%"), "%").otherwise(out)


def _blocks(cells: DataFrame) -> DataFrame:
    """Cells that hold something, with their ``island``, which is the block's,
    the block's number (from 1 within a sheet), first row ``top``, number of rows,
    first column ``a``, and the row's number within it from 0; with the first cell
    of the column in the block, blanks in its value collapsed (``flat``), and
    whether any such value in the block begins like the name of a column
    without a header.

    Rows without a gap between them are a block: a row's number less its place
    among the sheet's rows is the same for all of it. A sheet's cells meet in one
    window; nothing is joined, so cells that come partitioned by sheet aren't
    shuffled. What a query doesn't use of this isn't computed."""
    some = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    full = cells.where("file IS NOT NULL AND sheet IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL").where(some("value") | some("formula"))
    sheet, key = ["file", "sheet"], ["file", "sheet", "island"]
    placed = full.withColumn("island", F.col("row") - F.dense_rank().over(Window.partitionBy(*sheet).orderBy("row")))
    placed = placed.withColumn("first", F.first(F.struct("row", "value")).over(Window.partitionBy(*key, "col").orderBy("row")))  # in an order that serves the next windows too
    flat = F.trim(F.regexp_replace(F.coalesce("first.value", F.lit("")), "\\s+", " "))
    placed = placed.select(*cells.columns, "island", F.col("first.row").alias("first"), flat.alias("flat")).withColumn("like", F.col("flat").startswith("column_"))
    block = Window.partitionBy(*key)
    sums = {"top": F.min("row").over(block), "bottom": F.max("row").over(block), "a": F.min("col").over(block), "like": F.max("like").over(block)}
    numbered = placed.withColumns(sums).withColumn("block", F.dense_rank().over(Window.partitionBy(*sheet).orderBy("island")))
    return numbered.withColumn("n_rows", (F.col("bottom") - F.col("top") + 1).cast("long")).withColumn("place", F.col("row") - F.col("top"))


def _name(n_rows: Column, flat: Column, col: Column) -> Column:
    """A column's name before repeated ones are numbered, from the first row's value."""
    return F.when((n_rows > 1) & (flat != ""), flat).otherwise(F.concat(F.lit("column_"), column_label(col)))


def _headers(blocks: DataFrame) -> DataFrame:
    """(file, sheet, block, col, header): names of a block's columns: the first
    row's values if it has more than one row, blanks collapsed; column_X where
    there is none; repeated names are numbered from the second on."""
    key = ["file", "sheet", "block"]
    span = blocks.groupBy(*key).agg(F.min("col").alias("a"), F.max("col").alias("b"), F.max("n_rows").alias("n"))
    each = span.select(*key, "n", F.explode(F.sequence("a", "b")).alias("col"))
    first = blocks.where("place = 0").groupBy(*key, "col").agg(F.first("flat").alias("flat"))
    named = each.join(first, [*key, "col"], "left").withColumn("name", _name(F.col("n"), F.coalesce("flat", F.lit("")), F.col("col")))
    nth = F.row_number().over(Window.partitionBy(*key, "name").orderBy("col"))
    return named.withColumn("nth", nth).select(*key, "col", F.when(F.col("nth") > 1, F.concat("name", F.lit("_"), F.col("nth").cast("string"))).otherwise(F.col("name")).alias("header"))


def windows(cells: DataFrame) -> DataFrame:
    """(file, sheet, block_id, row_start, row_end, range, headers, uri): windows
    of 25 rows of each block's data, which is all but the first row where there
    are more (S08, S10). A sheet's rows meet in one window; sheets are many."""
    key = ["file", "sheet", "block"]
    blocks = _blocks(cells)
    heads = _headers(blocks).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("col", "header"))).alias("h"))
    heads = heads.select(*key, F.transform("h", lambda x: x["header"]).alias("headers"), F.get("h", F.lit(0))["col"].alias("a"), F.element_at("h", -1)["col"].alias("b"))
    data = blocks.where("place > 0 OR n_rows = 1").select(*key, "row", F.floor((F.col("place") - F.when(F.col("n_rows") > 1, 1).otherwise(0)) / ROWS).alias("w"))
    spans = data.groupBy(*key, "w").agg(F.min("row").alias("row_start"), F.max("row").alias("row_end")).join(heads, key)
    cells_ = F.concat(address(F.col("row_start"), F.col("a")), F.lit(":"), address(F.col("row_end"), F.col("b")))
    spans = spans.withColumn("range", cells_)
    uri = address_uri(F.col("file"), F.col("sheet"), F.col("range"), F.col("row_start"), F.col("row_end"), F.col("headers"))
    return spans.select("file", "sheet", F.concat("sheet", F.lit(":"), F.col("block").cast("string")).alias("block_id"), "row_start", "row_end", "range", "headers", uri.alias("uri"))


def sidecar(cells: DataFrame) -> DataFrame:
    """(file, sheet, address, row, col, value, formula, header, unit): all cells
    that hold something, with their column's header and unit (S09).

    Headers are ``_headers``', found in windows alone: repeated names are counted
    over the columns that hold something. One that holds nothing is named by its
    letters and counts where a header to its right is that name, so such blocks'
    columns are collected."""
    key = ["file", "sheet", "island"]
    header = F.when(F.col("first") == F.col("top"), F.col("flat")).otherwise("")
    found = _blocks(cells).withColumn("name", _name(F.col("n_rows"), header, F.col("col")))
    found = found.withColumn("cols", F.collect_set(F.when(F.col("like"), F.col("col"))).over(Window.partitionBy(*key)))
    same = F.dense_rank().over(Window.partitionBy(*key, "name").orderBy("col"))
    x = F.when(F.col("like") & F.col("name").rlike("^column_[A-Z]{1,3}$"), column_number(F.substring("name", 8, 3)))
    bare = x.between(F.col("a"), F.col("col") - 1) & ~F.array_contains("cols", x)
    found = found.withColumn("nth", same + F.when(bare, 1).otherwise(0))
    found = found.withColumn("header", F.when(F.col("nth") > 1, F.concat("name", F.lit("_"), F.col("nth").cast("string"))).otherwise(F.col("name")))
    return found.select("file", "sheet", address(F.col("row"), F.col("col")).alias("address"), "row", "col", "value", "formula", "header", unit(F.col("header")).alias("unit"))
