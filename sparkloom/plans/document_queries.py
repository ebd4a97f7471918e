"""Queries of lexical analysis, workbooks and archives, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import maths, text
from ..operators import answers, archives, board, lexical, workbooks
from ..sources import exports, upserts
from ..tables import Saved, remove, shared_dir
from .queries import _edges, _register, _t


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """A workbook: a sheet for each supplier, a row for each of its lines, a gap after every 40 rows."""
    rn = F.row_number().over(Window.partitionBy("sheet").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))  # by sheet, as its blocks are found
    rows = _t(spark, d, "lineitem").withColumn("sheet", F.col("l_suppkey").cast("string")).withColumn("rn", rn).withColumn("row", (F.col("rn") + F.floor((F.col("rn") - 1) / 40)).cast("int"))
    part, line = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(" (kg)")), F.concat(F.lit("n"), F.col("l_linenumber").cast("string"))
    cells = F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in ((1, part), (2, line), (3, F.lit(" ")), (4, line))])
    return rows.select(F.lit("book 1.xlsx").alias("file"), "sheet", "row", F.explode(cells).alias("c"), F.lit(None).cast("string").alias("formula")).select("file", "sheet", "row", "c.*", "formula")


_ROWS = """WITH n AS (SELECT l_suppkey AS s, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem),
r AS (SELECT s, rn + (rn - 1) // 40 AS row, (rn - 1) // 40 AS b, (rn - 1) % 40 AS place, 'p' || l_partkey || ' (kg)' AS part, 'n' || l_linenumber AS line FROM n),
z AS (SELECT s, b, count(*) AS n_rows, max(part) FILTER (place = 0) AS p0, max(line) FILTER (place = 0) AS l0 FROM r GROUP BY s, b),
h AS (SELECT s, b, n_rows, CASE WHEN n_rows > 1 THEN [p0, l0, 'column_C', l0 || '_2'] ELSE ['column_A', 'column_B', 'column_C', 'column_D'] END AS headers FROM z)"""


@_register(
    _ROWS + """, w AS (SELECT r.s, r.b, headers, (place - CASE WHEN n_rows > 1 THEN 1 ELSE 0 END) // 25 AS w, min(row) AS row_start, max(row) AS row_end FROM r JOIN h USING (s, b) WHERE place > 0 OR n_rows = 1 GROUP BY ALL)
SELECT CAST(s AS VARCHAR) AS sheet, s || ':' || (b + 1) AS block_id, row_start, row_end, 'A' || row_start || ':D' || row_end AS range, headers,
  'book%201.xlsx#sheet=' || s || '&range=A' || row_start || '%3AD' || row_end || '&row_start=' || row_start || '&row_end=' || row_end || list_aggregate(list_transform(headers, lambda x: '&columns=' || replace(replace(replace(x, ' ', '%20'), '(', '%28'), ')', '%29')), 'string_agg', '') AS uri FROM w"""
)
def s08_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 25 rows of the blocks of a workbook, with headers and address."""
    return workbooks.windows(_cells(spark, d)).drop("file").withColumns({c: F.col(c).cast("long") for c in ("row_start", "row_end")})


@_register(
    _ROWS + """, c AS (SELECT s, b, row, unnest([1, 2, 4]) AS col, unnest([part, line, line]) AS value FROM r)
SELECT CAST(s AS VARCHAR) AS sheet, substr('ABCD', col, 1) || row AS address, value, headers[col] AS header, CASE WHEN col = 1 AND n_rows > 1 THEN 'kg' ELSE '' END AS unit FROM c JOIN h USING (s, b)"""
)
def s09_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the workbook with header and unit."""
    return workbooks.sidecar(_cells(spark, d)).select("sheet", "address", "value", "header", "unit")


@_register(
    """SELECT p_partkey, p_name AS sheet, 'B' || p_size || ':C' || (p_size + p_partkey) AS range, CAST(p_size AS INTEGER) AS row_start, CAST(p_size + p_partkey AS INTEGER) AS row_end, [p_type, p_brand] AS columns, p_name || '!B' || p_size || ':C' || (p_size + p_partkey) AS block_id FROM part"""
)
def s10_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses written for all parts and read again; every third leaves its rows to the range."""
    first, last = F.col("p_size"), F.col("p_size") + F.col("p_partkey")
    cells = F.concat(workbooks.address(first, F.lit(2)), F.lit(":"), workbooks.address(last, F.lit(3)))
    uri = workbooks.address_uri(F.col("p_brand"), F.col("p_name"), cells, first, last, F.array("p_type", F.lit(""), "p_brand"))
    short = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace(uri, "&row_(start|end)=[0-9]+", "")).otherwise(uri)
    return _t(spark, d, "part").select("p_partkey", workbooks.read_uri(short).alias("a")).select("p_partkey", "a.sheet", "a.range", "a.row_start", "a.row_end", "a.columns", "a.block_id")


def _level(n: int) -> str:
    """SQL of one level of archives: o{n} to be opened, f{n} found, o{n + 1} next."""
    return f"""s{n} AS (SELECT o.*, coalesce(c.n, 0) AS size FROM o{n} o LEFT JOIN cnt c USING (archive)),
f{n} AS (SELECT s.root, s.owner, s.archive, e.place, e.path, {n} AS level, e.nested, CASE WHEN e.junk THEN 'skipped' WHEN row_number() OVER (PARTITION BY s.root, s.archive, e.hash, e.junk ORDER BY e.place) > 1
  OR EXISTS (SELECT 1 FROM kn WHERE kn.owner = s.owner AND kn.hash = e.hash) THEN 'duplicate' ELSE 'registered' END AS outcome FROM s{n} s JOIN e USING (archive) WHERE size <= 6),
o{n + 1} AS (SELECT DISTINCT root, owner, nested AS archive FROM f{n} WHERE outcome = 'registered' AND nested IS NOT NULL)"""


@_register(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place FROM lineitem),
e AS (SELECT l_orderkey AS archive, place, CASE WHEN place % 5 = 4 THEN 'd/.f' ELSE 'd/f' || place END AS path, place % 5 = 4 AS junk, 'h' || (l_partkey % 60) AS hash, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS nested FROM l),
cnt AS (SELECT archive, count(*) AS n FROM e GROUP BY 1), kn AS (SELECT DISTINCT c_custkey % 5 AS owner, 'h' || c_nationkey AS hash FROM customer WHERE c_custkey % 5 = c_nationkey % 5),
o0 AS (SELECT o_orderkey AS root, o_custkey % 5 AS owner, o_orderkey AS archive FROM orders), """
    + _level(0) + ", " + _level(1) + """,
u AS (SELECT root, archive, place, path, level, outcome FROM f0 UNION ALL SELECT root, archive, place, path, level, outcome FROM f1
UNION ALL SELECT root, archive, NULL, NULL, 0, 'too many' FROM s0 WHERE size > 6 UNION ALL SELECT root, archive, NULL, NULL, 1, 'too many' FROM s1 WHERE size > 6 UNION ALL SELECT root, archive, NULL, NULL, 2, 'too deep' FROM o2)
SELECT * FROM u"""
)
def s18_archives(spark: SparkSession, d: str) -> DataFrame:
    """Orders as archives of their lines; returned parts are archives again."""
    line, part = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")), F.col("l_partkey")
    lines = _t(spark, d, "lineitem").withColumn("place", line)
    line = F.col("place")
    path = F.when(line % 5 == 4, "d/.f").otherwise(F.concat(F.lit("d/f"), line.cast("string")))
    entries = lines.select(F.col("l_orderkey").alias("archive"), line.cast("long").alias("place"), path.alias("path"), F.concat(F.lit("h"), (part % 60).cast("string")).alias("hash"), F.when(F.col("l_returnflag") == "R", part).alias("nested"))
    roots = _t(spark, d, "orders").select(F.col("o_orderkey").alias("archive"), (F.col("o_custkey") % 5).alias("owner"))
    k = F.col("c_custkey") % 5
    known = _t(spark, d, "customer").where(k == F.col("c_nationkey") % 5).select(k.alias("owner"), F.concat(F.lit("h"), F.col("c_nationkey").cast("string")).alias("hash"))
    return archives.expanded(roots, entries, known, most=6).drop("owner")


@_register(None)
def t25_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Stems of all documents and how often they stand there."""
    return lexical.frequencies(_t(spark, d, "documents"), "doc_id", F.col("text"))


@_register(None)
def r02_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for every benchmark item from an index on disk."""
    folder = f"{shared_dir(spark)}/sparkloom-index-{uuid.uuid4().hex}"
    lexical.build_index(_t(spark, d, "documents"), "doc_id", F.col("text"), folder, buckets=32)
    found = lexical.search(spark, folder, _t(spark, d, "benchmark"), "item_id", F.col("text"))
    found = Saved(found, "index-search").df
    remove(spark, folder)
    return found


# ---- kinds, headings, highlights


@_register(None)
def s16_headings(spark: SparkSession, d: str) -> DataFrame:
    """Which lines of all documents are headings."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t")
    return _t(spark, d, "documents").select("doc_id", lines).select("doc_id", "line", text.is_heading(F.col("t")).alias("heading"))


@_register(
    """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Гипотезы.docx' ELSE source END AS file, CASE WHEN doc_id % 7 = 0 THEN 'о гипотезах' END AS title,
    CASE doc_id % 5 WHEN 0 THEN '  Гипотезы по плану' || chr(10) || '1) ' WHEN 1 THEN 'после мозгового штурма гипотеза ' ELSE '' END || coalesce(text, '') AS t FROM documents),
    h AS (SELECT *, substr(lower(trim(t, ' ' || chr(9) || chr(10) || chr(13))), 1, 400) AS head FROM x)
    SELECT doc_id, CASE WHEN file LIKE '%ипотез%' OR title LIKE '%ипотез%' THEN 'hypotheses' ELSE '' END AS by_name,
    CASE WHEN (starts_with(trim(string_split(replace(head, chr(13), chr(10)), chr(10))[1]), 'гипотез') AND (contains(head, '1.') OR contains(head, '1)'))) OR (contains(head, 'гипотез') AND contains(head, 'мозгово')) THEN 'hypotheses' ELSE '' END AS by_text FROM h"""
)
def f13_document_kind(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by name and by text, some texts after a line of their own."""
    i = F.col("doc_id")
    start = F.when(i % 5 == 0, "  Гипотезы по плану\n1) ").when(i % 5 == 1, "после мозгового штурма гипотеза ").otherwise("")
    rows = _t(spark, d, "documents").select("doc_id", F.when(i % 4 == 0, "Гипотезы.docx").otherwise(F.col("source")).alias("file"), F.when(i % 7 == 0, "о гипотезах").alias("title"), F.concat(start, F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", text.kind_of_file(F.col("file"), F.col("title")).alias("by_name"), text.kind_of_text(F.col("t")).alias("by_text"))


@_register(
    "SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(p_type), '(steel|tin)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x), lambda x: x <> '') AS parts FROM part"
)
def t26_highlight(spark: SparkSession, d: str) -> DataFrame:
    """Types of parts, cut where a word of the query stands."""
    parts = text.highlighted(F.lower("p_type"), "Steel, tin or of")
    return _t(spark, d, "part").select("p_partkey", F.transform(parts, lambda x: x["part"]).alias("parts"))


@_register(
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'maintain' WHEN p_partkey % 5 = 1 THEN 'decrease' WHEN contains(lower(p_name), 'raise') THEN 'increase' WHEN p_partkey % 5 = 2 THEN 'maintain' ELSE 'increase' END AS direction FROM part"
)
def t21_direction(spark: SparkSession, d: str) -> DataFrame:
    """Directions as said, by words, or by default."""
    k = F.col("p_partkey")
    said = F.when(k % 3 == 0, " Maintain ").otherwise("")
    context = F.concat(F.when(k % 5 == 1, "Reduced loss, better than raised ").when(k % 5 == 2, "stable ").otherwise(""), F.when(F.lower("p_name").contains("raise"), F.col("p_name")).otherwise(""))
    return _t(spark, d, "part").select("p_partkey", text.direction(said, context).alias("direction"))


@_register(
    """WITH x AS (SELECT o_custkey, o_orderkey, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS metric FROM orders WHERE o_orderkey % 7 > 0),
    f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(title), lower(metric) ORDER BY o_orderkey) = 1)
    SELECT o_custkey, o_orderkey, title, metric FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 10"""
)
def t22_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer the first ten kinds of orders; every seventh has no title, some odd blanks and case."""
    k = F.col("o_orderkey")
    title = F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    metric = F.when(k % 3 == 0, "  ").otherwise(F.concat("o_orderstatus", F.lit(" ")))
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", title.alias("title"), metric.alias("metric"))
    return board.distinct_suggestions(rows, ["o_custkey"], "title", "metric", F.col("o_orderkey"))


@_register(
    """WITH f AS (SELECT l_orderkey AS item, CAST(l_suppkey AS VARCHAR) AS code, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2)
    SELECT item, code, s_name AS name, CAST(row_number() OVER (PARTITION BY item ORDER BY p, code) AS INTEGER) AS place FROM f JOIN supplier ON CAST(s_suppkey AS VARCHAR) = code WHERE s_nationkey < 20 QUALIFY place <= 3"""
)
def t23_codes(spark: SparkSession, d: str) -> DataFrame:
    """The first three known suppliers of each order, by their names."""
    taxonomy = _t(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("name"))
    picked = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("c"), "l_linenumber")
    return board.known_codes(picked, "item", F.col("c"), F.col("l_linenumber"), taxonomy)


@_register(
    """WITH i AS (SELECT o_orderkey AS item, CASE WHEN o_orderstatus = 'F' THEN 'bridge' ELSE 'cluster' END AS kind, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 11 / 10.0 END AS novelty FROM orders),
    e AS (SELECT l_orderkey AS item, count(DISTINCT l_suppkey % 3) AS docs, bool_or(l_linenumber = 1) AS a, bool_or(l_linenumber = 4) AS b FROM lineitem GROUP BY 1),
    r AS (SELECT kind, novelty, CASE WHEN coalesce(docs, 0) >= 2 THEN 1.0 ELSE 0.0 END AS cr, CASE WHEN coalesce(a AND b, false) THEN 1.0 ELSE 0.0 END AS sp FROM i LEFT JOIN e USING (item)),
    f AS (SELECT count(*) FILTER (kind = 'bridge') AS bridges, count(*) FILTER (kind = 'cluster') AS clusters, round(avg(cr) FILTER (kind = 'bridge'), 3) AS bridge_cross, round(avg(cr) FILTER (kind = 'cluster'), 3) AS cluster_cross,
      round(avg(sp) FILTER (kind = 'bridge'), 3) AS bridge_span, round(avg(novelty) FILTER (kind = 'bridge'), 3) AS bridge_novelty, round(avg(novelty) FILTER (kind = 'cluster'), 3) AS cluster_novelty FROM r)
    SELECT *, round(bridge_novelty - cluster_novelty, 3) AS novelty_delta FROM f"""
)
def a26_discovery_lift(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders as bridges against the others as clusters; lines are their evidence."""
    k = F.col("o_orderkey")
    items = _t(spark, d, "orders").select(k.alias("item"), F.when(F.col("o_orderstatus") == "F", "bridge").otherwise("cluster").alias("kind"), F.when(k % 4 > 0, F.col("o_custkey") % 11 / 10.0).alias("novelty"))
    relation = F.when(F.col("l_linenumber") == 1, "Theme_A").when(F.col("l_linenumber") == 4, "theme_b").otherwise("other")
    evidence = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 3).cast("string").alias("document"), relation.alias("relation"))
    return board.discovery_lift(items, evidence)


@_register(
    "SELECT o_orderkey, CAST(json_extract_string(j, '$.a') AS INTEGER) AS a, CAST(json_extract_string(j, '$.ranking.score') AS INTEGER) AS score, len(json_keys(j)) AS n FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN json_object('a', o_custkey, 'ranking', json_object('score', o_orderkey)) WHEN 1 THEN json_object('ranking', json_object('score', o_orderkey)) ELSE json_object('a', o_custkey, 'ranking', json_object('score', o_orderkey)) END AS j FROM orders)"
)
def m10_merged_json(spark: SparkSession, d: str) -> DataFrame:
    """A ranking set in objects that hold one, in what is no object, and in objects without one."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    before = F.when(k % 3 == 0, F.concat(F.lit('{"a":'), c, F.lit(',"ranking":{"old":1}}'))).when(k % 3 == 1, "no json").otherwise(F.concat(F.lit('{"a":'), c, F.lit("}")))
    whole = text.merged_json(before, "ranking", F.concat(F.lit('{"score":'), k.cast("string"), F.lit("}")))
    rows = _t(spark, d, "orders").select("o_orderkey", whole.alias("j"))
    return rows.select("o_orderkey", F.get_json_object("j", "$.a").cast("int").alias("a"), F.get_json_object("j", "$.ranking.score").cast("int").alias("score"), F.size(F.json_object_keys("j")).cast("long").alias("n"))


@_register("SELECT s_suppkey, CAST(s_suppkey % 9 AS DOUBLE) / 2 AS prompt, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE CAST(s_nationkey AS DOUBLE) END AS completion, lower(s_name) AS match FROM supplier")
def m12_prices(spark: SparkSession, d: str) -> DataFrame:
    """Price lists of suppliers, with broken entries and numbers."""
    k = F.col("s_suppkey")
    price = F.concat((k % 9 / 2).cast("string"), F.lit(" / "), F.when(k % 4 == 0, "?").otherwise(F.col("s_nationkey").cast("string")))
    setting = F.concat(F.lit("broken; =1/2;x=3; "), "s_name", F.lit(" = "), price, F.lit(";"))
    return _t(spark, d, "supplier").select("s_suppkey", F.explode(text.price_list(setting)).alias("p")).select("s_suppkey", "p.*")


@_register("SELECT vec_id, label FROM embeddings WHERE vec_id % 5 > 0 AND vec_id % 7 > 0 AND vec_id % 11 > 0 AND label = 2")
def s21_usable_points(spark: SparkSession, d: str) -> DataFrame:
    """One owner's points; some have no document, no vector or a component that isn't finite."""
    i = F.col("vec_id")
    broken = F.transform("embedding", lambda x, k: F.when((i % 11 == 0) & (k == 3), F.lit(float("inf")).cast("float")).otherwise(x))
    rows = _t(spark, d, "embeddings").select("vec_id", F.when(i % 5 > 0, i.cast("string")).otherwise("").alias("document"), F.when(i % 7 > 0, broken).alias("v"), F.col("label"), F.col("label").cast("string").alias("owner"))
    return board.usable_points(rows, "document", "v", "owner", "2").select("vec_id", "label")


# ---- ids and sinks

_SPACE = "5b3c9a52-8a4e-4f57-9d7e-2c1f0a6b8d43"


@_register(
    f"""WITH h AS (SELECT doc_id, sha1(unhex('{_SPACE.replace("-", "")}') || encode(source || ':' || doc_id)) AS h FROM documents)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST(('0x' || substr(h, 17, 1))::INTEGER AS INTEGER) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h"""
)
def k02_point_ids(spark: SparkSession, d: str) -> DataFrame:
    """The same id for a point whenever it is written."""
    name = F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))
    return _t(spark, d, "documents").select("doc_id", maths.chunk_id(_SPACE, name).alias("id"))


@_register("SELECT o_custkey, arg_max(o_orderstatus, (o_orderkey % 3, o_orderdate, o_orderkey)) AS status, arg_max(o_orderkey, (o_orderkey % 3, o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def k03_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's last order, put into a table in three turns."""
    folder = f"{shared_dir(spark)}/sparkloom-table-{uuid.uuid4().hex}"
    rows = _t(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), "o_orderkey", "o_orderdate")
    for turn in range(3):
        upserts.upsert(rows.where(F.col("o_orderkey") % 3 == turn), folder, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), 8)
    found = Saved(upserts.read_table(spark, folder, rows.schema).drop("o_orderdate"), "upserts").df
    remove(spark, folder)
    return found


@_register("SELECT kind, doc_id, lang, n_chars FROM documents, (SELECT unnest(['json', 'parquet']) AS kind)")
def k09_row_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON lines and as Parquet, and read again."""
    folder = f"{shared_dir(spark)}/sparkloom-rows-{uuid.uuid4().hex}"
    rows = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    exports.write_rows(rows, folder)
    read = [getattr(spark.read.schema(rows.schema), kind)(f"{folder}/{kind}").select(F.lit(kind).alias("kind"), *rows.columns) for kind in ("json", "parquet")]
    found = Saved(read[0].unionByName(read[1]), "row-sinks").df
    remove(spark, folder)
    return found


# ---- answers


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks, with the vector of their number where there is one; every 50th is a summary of the two behind it."""
    i = F.col("doc_id")
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    docs = _t(spark, d, "documents").where("doc_id IS NOT NULL").select(i.alias("chunk"), (i % 90).alias("doc"), F.col("source").alias("title"), "text", F.when(i % 50 == 0, F.array(i + 1, i + 2)).alias("members"))
    return docs.join(vectors, F.col("chunk") == F.col("v"), "left").drop("v")


@_register(None)
def r01_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to all benchmark items from documents."""
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    questions = _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text").join(vectors, F.col("query") == F.col("v"), "left").drop("v")
    return answers.answers(questions, _chunks(spark, d), lexical.tokens)


@_register(None)
def r06_graph_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for one question, with chunks of documents near its own in the graph of labels' neighbours."""
    chunks = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk"), (F.col("doc_id") % 90).alias("doc"), F.col("doc_id").alias("index"), "text")
    hits = chunks.where("doc IN (1, 2)").select("chunk", "doc", F.lit(0.5).alias("worth"))
    edges = _edges(spark, d).select((F.col("src") % 90).alias("a"), (F.col("dst") % 90).alias("b"), "weight").where("a <> b")
    edges = edges.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
    return answers.graph_evidence(hits, edges, chunks, F.lit("what is there about these things"))
