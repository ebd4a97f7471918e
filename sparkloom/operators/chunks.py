"""Splitting texts into chunks: structure blocks, a ladder of separators, greedy
merging, overlap, and the chunks' places in the text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From coarse to fine. Fixed values.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", " ")
#: A table may be so many times larger than a chunk before it is split.
TABLE = 3
#: Openings of captions, which have at most 200 letters. Fixed values.
CAPTIONS = ("рис.", "рисунок", "табл.", "таблица", "figure", "fig.", "table")
#: Names of sections by the first word of a heading, which has at most 64 letters. Fixed values.
SECTIONS = {
    "Abstract": "abstract аннотация реферат 摘要",
    "Introduction": "introduction введение 引言 绪论",
    "Methods": "methods methodology методы методика методология 方法 实验方法 实验",
    "Results": "results результаты 结果",
    "Discussion": "discussion обсуждение 讨论",
    "Conclusion": "conclusion conclusions выводы заключение 结论",
    "References": "references bibliography литература библиография 参考文献",
    "Acknowledgements": "acknowledgements acknowledgments благодарности 致谢",
}
#: What may stand before and behind the words of a heading. Fixed values.
_NUMBERING, _BEHIND = "0123456789.IVXivx )一二三四五六七八九十、", " .:—-：。、"
_SECTION_OF = {word: name for name, words in SECTIONS.items() for word in words.split()}
_GAP = re.compile(r"[^ ] {2,}[^ ]")


def section_name(line: str) -> str:
    """The section a heading opens, by its first word after any numbering; "" for other lines."""
    title = line.strip()
    if not title or len(title) > 64:
        return ""
    bare = title.rstrip(_BEHIND)
    for words in (bare.lstrip(_NUMBERING).split(), bare.split()):  # a word may itself begin with letters that number
        if words and words[0].lower() in _SECTION_OF:
            return _SECTION_OF[words[0].lower()]
    return ""


def is_row(line: str) -> bool:
    """A line of at least two cells, apart by tabs, else by bars, else by two blanks or more."""
    bare = line.rstrip(" \t\n")
    for mark in "\t|":
        if mark in bare:
            return sum(bool(cell.strip()) for cell in bare.split(mark)) >= 2
    return bool(_GAP.search(bare.lstrip(" ")))


def is_caption(line: str) -> bool:
    title = line.strip()
    return 0 < len(title) <= 200 and title.lower().startswith(CAPTIONS)


def blocks(text: str) -> list[tuple[str, bool, str]]:
    """(text, whether a table, section) in order; they add up to the text.

    A table is a run of two lines of cells or more, with a caption right above
    or below it. All between tables is one block of prose, headings included;
    its section is that of its last heading. A caption that is a whole block
    joins the table before it, else the block behind it."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    rows = [is_row(line) for line in lines]
    inside = [r and ((i > 0 and rows[i - 1]) or (i + 1 < len(lines) and rows[i + 1])) for i, r in enumerate(rows)]
    found: list[tuple[str, bool, str]] = []
    section, prose, i = "", "", 0
    while i < len(lines):
        start = i + (not inside[i] and is_caption(lines[i]) and i + 1 < len(lines) and inside[i + 1])
        end = start
        while end < len(lines) and inside[end]:
            end += 1
        if end == start:  # no table here
            section = section_name(lines[i]) or section
            prose += lines[i]
            i += 1
            continue
        end += end < len(lines) and is_caption(lines[end])
        if prose:
            found.append((prose, False, section))
        found.append(("".join(lines[i:end]), True, section))
        prose, i = "", end
    if prose:
        found.append((prose, False, section))
    return _with_captions(found)


def _with_captions(found: list[tuple[str, bool, str]]) -> list[tuple[str, bool, str]]:
    out: list[tuple[str, bool, str]] = []
    ahead, own = "", ""
    for k, (text, table, section) in enumerate(found):
        text, section = ahead + text, section or own
        ahead, own = "", ""
        if not table and "\n" not in text.strip() and is_caption(text):
            if out and out[-1][1]:
                out[-1] = (out[-1][0] + text, True, out[-1][2])
                continue
            if k + 1 < len(found):
                ahead, own = text, section
                continue
        out.append((text, table, section))
    return out


def words_cost(text: str) -> int:
    """A measure in words; pieces are never larger than they have words."""
    return len(text.split())


def guarded(measure: Callable[[str], int]) -> Callable[[str], int]:
    """A measure that counts letters where ``measure`` fails."""

    def cost(text: str) -> int:
        try:
            return measure(text)
        except Exception:  # noqa: BLE001  whatever a tokenizer raises, a chunk is cut all the same
            return len(text)

    return cost


def pieces(text: str, size: int, level: int = 0, measure: Callable[[str], int] = len) -> Iterator[str]:
    """Pieces that cost at most ``size`` and add up to the text; each separator
    stays with what is before it. What no separator parts is cut by letters."""
    if measure(text) <= size:
        yield text
    elif level == len(SEPARATORS):
        yield from (text[i : i + size] for i in range(0, len(text), size))
    else:
        for part in re.findall(f"(?s).*?{SEPARATORS[level]}|.+$", text):
            yield from pieces(part, size, level + 1, measure)


def merged(parts: Iterator[str], size: int, measure: Callable[[str], int] = len) -> Iterator[str]:
    """Pieces joined as long as their costs add up to at most ``size``."""
    held, cost = [], 0
    for part in parts:
        more = measure(part)
        if held and cost + more > size:
            yield "".join(held)
            held, cost = [], 0
        held.append(part)
        cost += more
    if held:
        yield "".join(held)


def split(text: str, size: int = 1000, overlap: int = 150, measure: Callable[[str], int] = len) -> list[tuple[str, str]]:
    """(chunk, section): tables whole up to three times the size, other blocks
    in merged pieces; each chunk but the first begins with the last ``overlap``
    letters of the one before; blank chunks are left out (T01). ``measure`` is
    what a text costs against the size, by default its letters (T08)."""
    bare = [(part, section) for block, table, section in blocks(text) for part in ([block] if table and measure(block) <= TABLE * size else merged(pieces(block, size, 0, measure), size, measure))]
    full = [(bare[i - 1][0][-overlap:] + part if i and overlap else part, section) for i, (part, section) in enumerate(bare)]
    return [(chunk, section) for chunk, section in full if chunk.strip()]


def chunk_texts(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 150, splitter: Callable = split, measure: Callable[[str], int] = len) -> DataFrame:
    """(id, chunk_index, chunk, section): the chunks of all texts, numbered from 0
    (T01, T02, T08). Null and blank texts have none. A task gives its chunks out
    whenever they have a million letters, so it holds one text's at most beside them."""
    id_type = df.schema[id_col].dataType.simpleString()
    cost = len if measure is len else guarded(measure)
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, letters = [], 0
            for at, text in enumerate(batch.column("text")):
                text = text.as_py()
                if text and text.strip():
                    new = [(at, k, *c) for k, c in enumerate(splitter(text, size, overlap, cost))]
                    found += new
                    letters += sum(len(c[2]) for c in new)
                if found and (letters > 1 << 20 or at + 1 == batch.num_rows):
                    at_, index, chunk, section = (pa.array(c, t) for c, t in zip(zip(*found), kinds))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at_), index, chunk, section], ["id", "chunk_index", "chunk", "section"])
                    found, letters = [], 0

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {id_type}, chunk_index int, chunk string, section string").withColumnRenamed("id", id_col)


def fixed_chunks(df: DataFrame, id_col: str, text: Column, size: int, overlap: int) -> DataFrame:
    """(id, chunk_index, start, chunk): windows of ``size`` letters each ``size - overlap``."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = df.where(F.length(text) > 0).select(F.col(id_col), text.alias("_t"), F.posexplode(starts).alias("chunk_index", "start"))
    return rows.select(id_col, "chunk_index", "start", F.col("_t").substr(F.col("start") + 1, F.lit(size)).alias("chunk"))


def located(chunks: DataFrame, id_col: str, source: str, chunk: str, index: str) -> DataFrame:
    """``chunks`` with ``start`` and ``end`` (letters, end exclusive) in the text
    whose white space is collapsed; (0, 0) for what isn't there. Each chunk is
    sought from behind the place of the one before it (T04)."""
    flat = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    per = chunks.groupBy(id_col).agg(F.first(flat(F.col(source))).alias("s"), F.array_sort(F.collect_list(F.struct(F.col(index).cast("int").alias("i"), flat(F.col(chunk)).alias("c")))).alias("c"))
    kind = chunks.schema[id_col].dataType.simpleString()
    found = per.select(F.col(id_col).alias("id"), "s", "c").mapInArrow(_places, f"id {kind}, i int, a int, b int")
    return found.select(F.col("id").alias(id_col), F.col("i").alias(index), F.col("a").alias("start"), F.col("b").alias("end"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's chunks in order, one pass over its text."""
    for batch in batches:
        found = []
        for row, (text, parts) in enumerate(zip(batch.column("s"), batch.column("c"))):
            text, at = text.as_py() or "", 0
            for part in parts.as_py():
                hit = text.find(part["c"], at) if part["c"] else -1
                found.append((row, part["i"], hit, hit + len(part["c"])) if hit >= 0 else (row, part["i"], 0, 0))
                at = hit + 1 if hit >= 0 else at
        row, *places = zip(*found) if found else ((),) * 4
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int32()) for x in places)], ["id", "i", "a", "b"])


def edges_of(df: DataFrame, key: str, index: str, most: int = 16) -> DataFrame:
    """The first and the last half of ``most`` chunks of each document, each once."""
    up = F.row_number().over(Window.partitionBy(key).orderBy(index))
    down = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(index)))
    return df.withColumn("_u", up).withColumn("_d", down).where((F.col("_u") <= most // 2) | (F.col("_d") <= most - most // 2)).drop("_u", "_d")
