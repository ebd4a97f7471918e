"""Queries of the board operators and of the column functions, and their SQL.

``orders`` stand for ideas of customers, ``events`` for jobs, usage and answers,
``documents`` and ``conversations`` for texts, ``embeddings`` for clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import maths, scoring, text
from ..operators import board, bridges, catalog, graph, vectors
from .queries import _register, _t


def _r(c, n: int = 6):
    return F.round(c, n)


# ---- filters


@_register("SELECT o_orderkey, o_orderstatus FROM orders WHERE contains(lower(concat_ws(' ', o_orderstatus, o_orderpriority, CAST(o_orderkey AS VARCHAR))), 'f 1-urgent')")
def f05_text_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").withColumn("key", F.col("o_orderkey").cast("string"))
    return board.text_search(rows, ["o_orderstatus", "o_orderpriority", "key"], "F 1-Urgent").select("o_orderkey", "o_orderstatus")


@_register("SELECT doc_id, json_object('a', CAST(doc_id AS VARCHAR)) AS kept FROM documents")
def f07_json_branches(spark: SparkSession, d: str) -> DataFrame:
    json = F.to_json(F.struct(F.col("doc_id").cast("string").alias("a"), F.col("lang").alias("b")))
    return _t(spark, d, "documents").select("doc_id", board.keep_branches(json, ["a", "z"]).alias("kept"))


@_register("SELECT doc_id, source || '-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '' END AS name, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'other' END AS kind FROM documents WHERE contains(source || '-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '' END, 'rc') AND lang = 'en' AND doc_id % 2 = 0")
def f08_document_filter(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(""))
    rows = _t(spark, d, "documents").withColumn("name", name)
    return board.document_filter(rows, "name", "lang", "RC", "en", "pdf").select("doc_id", "name", board.file_type(F.col("name")).alias("kind"))


@_register("SELECT event_id, ts FROM events WHERE event_type IN ('click', 'view') AND ts <= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND ORDER BY ts, event_id LIMIT 25")
def f09_stuck(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    now = events.agg(F.max("ts").cast("string")).first()[0]
    return board.stuck(events, "event_type", ["click", "view"], "ts", now, 3600, 25).select("event_id", "ts")


@_register("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def f10_visible(spark: SparkSession, d: str) -> DataFrame:
    return board.visible(_t(spark, d, "orders"), "o_custkey", 7).select("o_orderkey")


@_register("SELECT p_partkey, p_name FROM part WHERE p_retailprice / 2000 BETWEEN 0 AND 1 AND NOT contains(lower(trim(p_name)), '9') AND NOT starts_with(lower(trim(p_name)), 'part#1 ') AND trim(p_name) <> ''")
def f11_usable(spark: SparkSession, d: str) -> DataFrame:
    return board.usable(_t(spark, d, "part"), "p_name", F.col("p_retailprice") / 2000, ["9"], ["part#1"]).select("p_partkey", "p_name")


@_register("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")
def f02_has_all(spark: SparkSession, d: str) -> DataFrame:
    tags = F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, "even"), F.when(F.col("doc_id") % 3 == 0, "third")), lambda x: x.isNotNull())
    return _t(spark, d, "documents").where(catalog.has_all(tags, ["even", "third"])).select("doc_id")


@_register("SELECT doc_id FROM documents WHERE contains(text, 'the') AND lang IN ('en', 'de') AND NOT source IN ('src1', 'src2')")
def f04_lexical_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").where(F.col("text").contains("the"))
    return catalog.payload_filter(rows, any_of={"lang": ["en", "de"]}, none_of={"source": ["src1", "src2"]}).select("doc_id")


@_register("""SELECT event_id, CASE WHEN value > 80 THEN 'duplicate' WHEN value / 100 < 0.35 AND NOT event_id % 2 = 0 AND NOT event_id % 3 = 0 THEN 'no mechanism or plan' WHEN NOT event_type = 'click' AND value / 100 < 0.35 THEN 'ungrounded' END AS reason FROM events""")
def f14_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _t(spark, d, "events").select("event_id", scoring.quality_gate(c("value") > 80, c("value") / 100, c("event_id") % 2 == 0, c("event_id") % 3 == 0, c("event_type") == "click").alias("reason"))


_ASKED = """WITH asked AS (SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'How does Aldan Works compare to NASA?' WHEN 1 THEN 'чем отличается сталь и сплав ' WHEN 2 THEN 'Is it "old" or new? And then? '
  WHEN 3 THEN 'what about the Upper Volga and or the Don vs. that ' WHEN 4 THEN 'x vs y, a and b ' ELSE '' END || coalesce(text, '') AS t FROM conversations)"""


@_register(
    _ASKED + r""", f AS (SELECT conv_id, turn, t, lower(t) AS low, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS w FROM asked),
e AS (SELECT *, len(list_distinct(list_transform(list_concat(regexp_extract_all(t, '"[^"]{1,80}"|«[^»]{1,80}»'), regexp_extract_all(t, '[A-ZА-ЯЁ]\p{L}+(?:[ \-][A-ZА-ЯЁ]\p{L}+)+'),
  regexp_extract_all(t, '\b[A-Z][A-ZА-ЯЁ]{0,4}[A-Z]\b'), list_filter(w[2:], lambda x: regexp_matches(x, '^[A-ZА-ЯЁ]\p{Ll}+$'))), lambda x: lower(trim(x))))) AS names FROM f)
SELECT conv_id, turn, (CASE WHEN regexp_matches(low, 'compare|comparison|compared to|versus| vs\.?\b|difference|differ|trade-?off|pros and cons|relationship between|сравн|различ|разниц|отлич|взаимосвяз|соотнош|по сравнению') THEN 2 ELSE 0 END
  + CASE WHEN length(t) - length(replace(t, '?', '')) >= 2 THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(low, '\band\b|\band then\b|\bas well as\b|\bor\b| и | или | а также | затем | потом ')) >= 2 THEN 1 ELSE 0 END
  + CASE WHEN names >= 2 THEN 1 ELSE 0 END + CASE WHEN len(w) >= 18 THEN 1 ELSE 0 END) >= 2 AND conv_id % 11 > 0 AS steps FROM e""".replace("\\\\", "\\")
)
def f15_needs_steps(spark: SparkSession, d: str) -> DataFrame:
    """Whether turns, some after a question, need several retrievals; some have a prompt of their own."""
    k = F.col("conv_id") % 6
    said = ["How does Aldan Works compare to NASA?", "чем отличается сталь и сплав ", 'Is it "old" or new? And then? ', "what about the Upper Volga and or the Don vs. that ", "x vs y, a and b "]
    start = F.coalesce(F.get(F.array(*[F.lit(x) for x in said]), k.cast("int")), F.lit(""))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.concat(start, F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("conv_id", "turn", text.needs_steps(F.col("t"), F.when(F.col("conv_id") % 11 == 0, "write it")).alias("steps"))


# ---- counts


@_register("SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def a03_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return board.grouped_counts(_t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@_register("SELECT event_type AS state, count(*) AS n FROM events GROUP BY 1")
def a02_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return board.grouped_counts(_t(spark, d, "events"), ["event_type"]).select(F.col("value").alias("state"), "n")


@_register("SELECT CAST(o_custkey AS VARCHAR) AS owner, count(*) AS n FROM orders GROUP BY 1")
def a01_counts(spark: SparkSession, d: str) -> DataFrame:
    return board.grouped_counts(_t(spark, d, "orders"), ["o_custkey"]).select(F.col("value").alias("owner"), "n")


@_register("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ':free' ELSE p_brand END AS model FROM part")
def a05_model_name(spark: SparkSession, d: str) -> DataFrame:
    dated = F.concat("p_brand", F.lit("-20250131"), F.when(F.col("p_partkey") % 2 == 0, ":free").otherwise(""))
    return _t(spark, d, "part").select("p_partkey", board.model_name(dated).alias("model"))


@_register("SELECT event_id, CASE WHEN event_type LIKE '%ick%' THEN 'first' WHEN event_type LIKE '%e%' AND event_type LIKE '%v%' THEN 'second' WHEN value > 50 THEN 'openrouter' ELSE 'local' END AS provider FROM events")
def a06_provider(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", board.provider(F.col("event_type"), F.greatest(F.col("value") - 50, F.lit(0)), [("ick", "first"), ("view", "second")]).alias("provider"))


@_register("WITH p AS (SELECT user_id, event_type, count(*) AS r, sum(value) AS c FROM events GROUP BY ALL) SELECT user_id, greatest(coalesce(max(r) FILTER (event_type IN ('click', 'view')), 1), 1) AS divisor, round(sum(c), 6) AS cost, round(sum(c) / greatest(coalesce(max(r) FILTER (event_type IN ('click', 'view')), 1), 1), 6) AS per_unit FROM p GROUP BY 1")
def a07_unit_cost(spark: SparkSession, d: str) -> DataFrame:
    usage = _t(spark, d, "events").withColumn("one", F.lit(1))
    return board.unit_cost(usage, "user_id", "event_type", ["click", "view"], "one", "value").withColumns({"cost": _r(F.col("cost")), "per_unit": _r(F.col("per_unit"))})


@_register("""SELECT count(*) AS "all", count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 5 = 0) AS needs_trl, count(*) FILTER (o_orderstatus = 'O') AS ready, count(*) FILTER (o_orderstatus = 'P') AS needs_verify FROM orders""")
def a10_queue_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    primary = F.when(status == "O", "ready").when(status == "P", "needs_verify")
    return board.queue_counts(_t(spark, d, "orders"), primary, (status != "F") & (F.col("o_orderkey") % 5 == 0), ["ready", "needs_verify"])


@_register(
    """WITH b AS (SELECT event_type, CAST(floor(value / 10) * 10 + 10 AS DOUBLE) AS le, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY le) AS cum, sum(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0.0) AS low FROM b)
    SELECT event_type, round(low + (le - low) * (0.95 * total - (cum - n)) / n, 6) AS quantile FROM c WHERE cum >= 0.95 * total QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1"""
)
def a15_histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    le = (F.floor(F.col("value") / 10) * 10 + 10).cast("double")
    buckets = _t(spark, d, "events").where("value IS NOT NULL").groupBy("event_type", le.alias("le")).agg(F.count("*").alias("n"))
    return board.histogram_quantile(buckets, ["event_type"], "le", "n", 0.95).withColumn("quantile", _r(F.col("quantile")))


@_register("SELECT source, arg_max(md5(text), (CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) * 1000000000 - doc_id) AS text FROM documents GROUP BY 1")
def a17_representative(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").withColumn("text", F.md5("text"))
    return board.representative(rows, "source", "text", F.col("n_chars") > 2000, F.col("doc_id"))


@_register("WITH c AS (SELECT source, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{L}]+'))) AS k FROM documents), e AS (SELECT DISTINCT source, k FROM c WHERE k <> '') SELECT k AS keyword, count(*) AS clusters, round(count(*) / (SELECT count(DISTINCT source) FROM documents), 6) AS share FROM e GROUP BY 1")
def a20_keyword_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("source", F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+")).alias("words"))
    return board.keyword_frequency(rows, "source", "words").withColumn("share", _r(F.col("share")))


@_register(
    r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-zа-я0-9+ -]+', ' ', 'g'), ' '),
      lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^(\\d+|\\d{4,}v\\d+|[a-z]+\\d{4,}v?\\d*)$') AND NOT list_contains(['"""
    + "','".join(text.STOP_WORDS)
    + r"""'], x)) AS w FROM conversations),
    g AS (SELECT conv_id, turn, i, n, list_slice(w, i, i + n - 1) AS g FROM w, (SELECT unnest([4, 3, 2]) AS n), unnest(range(1, 1 + greatest(len(w) - n + 1, 0))) AS t(i)),
    c AS (SELECT conv_id, array_to_string(g, ' ') AS phrase, n AS size, count(*) AS n, min(turn * 1000000 + i) AS first FROM g WHERE len(list_distinct(g)) >= 2 GROUP BY ALL)
    SELECT conv_id, phrase, n, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, size DESC, first) AS INTEGER) AS rank FROM c QUALIFY rank <= 8""".replace("\\\\", "\\")
)
def a21_top_phrases(spark: SparkSession, d: str) -> DataFrame:
    return board.top_phrases(_t(spark, d, "conversations"), "conv_id", F.col("text"), F.col("turn"))


@_register("SELECT o_orderpriority AS topic, round(0.6 * avg(greatest(0.0, 1 - (1998 - year(o_orderdate)) / 5.0)) + 0.4 * avg(CASE WHEN year(o_orderdate) >= 1997 THEN 1.0 ELSE 0.0 END), 6) AS freshness FROM orders WHERE year(o_orderdate) BETWEEN 1 AND 1998 GROUP BY 1")
def a22_freshness(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("topic"), F.year("o_orderdate").alias("y"))
    return board.freshness(rows, "topic", "y", 1998).withColumn("freshness", _r(F.col("freshness")))


@_register("SELECT 'discount' AS metric, round(avg(l_discount), 6) AS mean, count(l_discount) AS n, avg(l_discount) >= 0.04 AS passed FROM lineitem UNION ALL SELECT 'tax', round(avg(l_tax), 6), count(l_tax), avg(l_tax) >= 0.5 FROM lineitem UNION ALL SELECT 'none', NULL, 0, false")
def a23_metric_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.lit(None).cast("double").alias("none"))
    return board.metric_gate(rows, {"discount": 0.04, "tax": 0.5, "none": 0.1}).withColumn("mean", _r(F.col("mean")))


@_register("WITH l AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[CAST(len(v) // 2 AS BIGINT) + 1] AS p50, v[least(len(v) - 1, CAST(floor(len(v) * 0.95) AS BIGINT)) + 1] AS p95, round(list_avg(v), 6) AS mean FROM l")
def a24_latency_points(spark: SparkSession, d: str) -> DataFrame:
    return board.latency_points(_t(spark, d, "events"), "event_type", "value").withColumn("mean", _r(F.col("mean")))


@_register("SELECT a.o_orderpriority, round(avg(CASE WHEN a.o_totalprice > b.o_totalprice THEN 1.0 ELSE 0.0 END), 6) AS separation FROM orders a JOIN orders b ON a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = 'F' AND b.o_orderstatus <> 'F' GROUP BY 1")
def a25_pair_separation(spark: SparkSession, d: str) -> DataFrame:
    return board.pair_separation(_t(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", "o_totalprice").withColumn("separation", _r(F.col("separation")))


@_register("SELECT c_nationkey AS kpi, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def a27_open_per_kpi(spark: SparkSession, d: str) -> DataFrame:
    open_ = catalog.payload_filter(_t(spark, d, "customer"), none_of={"c_mktsegment": ["BUILDING", "MACHINERY"]})
    return open_.groupBy(F.col("c_nationkey").alias("kpi")).agg(F.count("*").alias("n"))


@_register(
    """WITH x AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS x, CASE WHEN label = 3 THEN 0 ELSE count(*) END AS docs FROM x GROUP BY label, i)
    SELECT CAST(i AS INTEGER) AS i, round(sum(x * greatest(1, docs)) / sum(greatest(1, docs)), 6) AS x FROM c GROUP BY i"""
)
def a19_corpus_centre(spark: SparkSession, d: str) -> DataFrame:
    """The labels' centres weighted by their vectors; label 3 counts as without any."""
    sums = vectors.vector_sum(_t(spark, d, "embeddings"), ["label"], "embedding", F.lit(1.0))
    centres = sums.select(F.transform("sum_v", lambda x: x / F.col("sum_w")).alias("c"), F.when(F.col("label") == 3, 0).otherwise(F.col("n")).alias("docs"))
    return vectors.corpus_centre(centres, "c", F.col("docs")).select(F.posexplode("vector").alias("i", "x")).select("i", _r(F.col("x")).alias("x"))


# ---- windows and order


@_register(
    """WITH h AS (SELECT l_suppkey AS item, l_partkey % 50 AS article, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS chunk, CAST(l_quantity AS INTEGER) % 7 AS overlap, l_extendedprice AS score FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY overlap DESC, score DESC, chunk) AS r FROM h),
    n AS (SELECT *, row_number() OVER (PARTITION BY item, article ORDER BY r) AS n FROM r QUALIFY n <= 2),
    l AS (SELECT *, min(r) OVER (PARTITION BY item, article) AS lead FROM n),
    a AS (SELECT *, dense_rank() OVER (PARTITION BY item ORDER BY lead) AS a FROM l QUALIFY a <= 6)
    SELECT item, article, chunk, CAST(row_number() OVER (PARTITION BY item ORDER BY a, n) AS INTEGER) AS place FROM a"""
)
def w06_select_evidence(spark: SparkSession, d: str) -> DataFrame:
    hits = _t(spark, d, "lineitem").selectExpr("l_suppkey AS item", "l_partkey % 50 AS article", "(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS chunk", "CAST(l_quantity AS INT) % 7 AS overlap", "l_extendedprice AS score")
    return board.select_evidence(hits, "item", "article", "chunk", "overlap", "score")


@_register(
    """WITH c AS (SELECT n_regionkey AS label, count(*) AS size, list(n_nationkey ORDER BY n_name) AS m FROM nation GROUP BY 1), e AS (SELECT label, size, unnest(m[1:2]) AS member, generate_subscripts(m[1:2], 1) - 1 AS p FROM c)
    SELECT CAST(row_number() OVER (ORDER BY p, size DESC, label) AS INTEGER) AS place, label, member FROM e QUALIFY place <= 15"""
)
def w07_round_robin(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation")
    ordered = F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))
    clusters = nation.groupBy(F.col("n_regionkey").alias("label")).agg(F.count("*").alias("size"), F.transform(ordered, lambda x: x["n_nationkey"]).alias("members"))
    return board.round_robin(clusters, "label", "size", "members")


@_register("WITH k AS (SELECT o_orderkey, o_custkey || ' ' || o_orderpriority AS k FROM orders WHERE o_orderstatus <> 'F') SELECT o_orderkey, CASE WHEN m < o_orderkey THEN m END AS duplicate_of FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY k) AS m FROM k)")
def w08_duplicate_statements(spark: SparkSession, d: str) -> DataFrame:
    statement = F.concat_ws("  ", F.col("o_custkey").cast("string"), F.upper("o_orderpriority"), F.lit("!"))
    rows = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", statement.alias("statement"))
    return board.earlier_duplicate(rows, "o_orderkey", text.statement_key(F.col("statement")), F.col("o_orderstatus") != "F").select("o_orderkey", "duplicate_of")


@_register("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS section FROM events")
def w10_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return board.carry_forward(_t(spark, d, "events"), "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id"))).select("user_id", "event_id", "section")


@_register("SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 1 OR n_chars % 2 = 1 ORDER BY n_chars DESC, doc_id DESC LIMIT 8")
def w11_changed_batch(spark: SparkSession, d: str) -> DataFrame:
    now = _t(spark, d, "documents").select("doc_id", "n_chars", F.sha1(F.col("n_chars").cast("string")).alias("sig"))
    before = now.where("doc_id % 2 = 0").select("doc_id", F.sha1((F.floor(F.col("n_chars") / 2) * 2).cast("string")).alias("sig"))
    return board.changed_batch(now, before, "doc_id", "sig", [F.desc("n_chars"), F.desc("doc_id")]).select("doc_id", "n_chars")


@_register("WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events), g AS (SELECT *, bool_and(value IS NOT NULL AND user_id % 2 = 0) OVER (PARTITION BY user_id) AS ok FROM r) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN ok THEN value END DESC NULLS LAST, rank) - 1 AS INTEGER) AS new_rank FROM g")
def l04_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = _t(spark, d, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return board.rerank(hits, ["user_id"], F.col("value"), "rank", F.col("user_id") % 2 == 0).select("user_id", "event_id", "new_rank")


@_register("WITH b AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS l, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l, r, o_orderkey) AS INTEGER) AS place FROM b QUALIFY place <= 12")
def l05_merge_pool(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    rows = _t(spark, d, "orders").withColumn("done", done).withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey", "done").orderBy("o_orderdate", "o_orderkey")))
    pool, new = rows.where("done"), rows.where("NOT done")
    return board.merge_pool(pool, new, ["o_custkey"], "o_orderkey", "rank")


@_register("SELECT label, count(*) AS size, list(vec_id ORDER BY vec_id)[1:8] AS first, list(vec_id ORDER BY vec_id)[1:5] AS leads FROM embeddings GROUP BY 1")
def l06_cluster_order(spark: SparkSession, d: str) -> DataFrame:
    return board.cluster_order(_t(spark, d, "embeddings").select("label", "vec_id"), "label", "vec_id")


@_register("WITH s AS (SELECT s_suppkey, s_name, 10 * (s_suppkey % 2) + 8 * (s_suppkey % 3) + 2 * (s_suppkey % 5) + least(s_nationkey, 5) AS score FROM supplier) SELECT s_suppkey, CAST(score AS BIGINT) AS score FROM s WHERE score > 5 OR NOT (SELECT max(score) > 5 FROM s)")
def l07_fallback_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "supplier").selectExpr("s_suppkey", "s_name", "s_suppkey % 2 AS a", "s_suppkey % 3 AS b", "s_suppkey % 5 AS c", "s_nationkey AS e")
    return board.fallback_sources(rows, "a", "b", "c", "e", "s_name").select("s_suppkey", F.col("score").cast("long").alias("score"))


@_register("WITH t AS (SELECT conv_id, turn, len(list_distinct(string_split(text, ' '))) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN n <= 4 THEN 12 WHEN n <= 8 THEN 8 ELSE 5 END AS k FROM t")
def l08_adaptive_k(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", board.adaptive_k(F.split("text", " ")).alias("k"))


@_register("SELECT doc_id, [lang, source] AS kept FROM documents")
def u01_distinct_ignoring_case(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(F.col("lang"), F.upper("lang"), F.col("source"), F.initcap("source"))
    return _t(spark, d, "documents").select("doc_id", board.distinct_ignoring_case(values).alias("kept"))


@_register("WITH t AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lower(text), ' ')) AS b FROM conversations) SELECT conv_id, turn, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard FROM t")
def u03_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", _r(board.jaccard(F.split("text", " "), F.split(F.lower("text"), " "))).alias("jaccard"))


# ---- joins


@_register(
    """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS item, CASE WHEN l_linenumber = 1 THEN 'affects_property' ELSE 'supports_kpi' END AS relation,
      CASE WHEN l_linenumber = 1 THEN 's' || l_suppkey ELSE 'p ' || l_partkey END AS source, CASE WHEN l_linenumber = 1 THEN 'P  ' || l_partkey ELSE 'k' || l_returnflag END AS target FROM lineitem),
    j AS (SELECT a.id AS ia, b.id AS ib, a.source AS process, a.target AS property, b.target AS kpi FROM e a JOIN e b ON a.relation = 'affects_property' AND b.relation = 'supports_kpi' AND replace(lower(a.target), '  ', ' ') = lower(b.source) AND a.item <> b.item),
    f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lower(process), lower(property), lower(kpi) ORDER BY ia, ib) = 1)
    SELECT process, property, kpi FROM f ORDER BY ia, ib LIMIT 12"""
)
def j12_property_transfers(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("l_linenumber") == 1
    edges = _t(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("item"), F.when(first, "affects_property").otherwise("supports_kpi").alias("relation"),
        F.when(first, F.concat(F.lit("s"), F.col("l_suppkey"))).otherwise(F.concat(F.lit("p "), F.col("l_partkey"))).alias("source"), F.when(first, F.concat(F.lit("P  "), F.col("l_partkey"))).otherwise(F.concat(F.lit("k"), F.col("l_returnflag"))).alias("target"),
    )
    return board.property_transfers(edges)


@_register("SELECT CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_suppkey AS VARCHAR) ELSE 'file:' || l_shipdate::DATE END AS node, count(*) AS degree, count(DISTINCT l_orderkey) AS items FROM lineitem GROUP BY 1")
def j14_evidence_graph(spark: SparkSession, d: str) -> DataFrame:
    doc = F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey").cast("string")).otherwise("")
    return board.evidence_graph(_t(spark, d, "lineitem"), "l_orderkey", doc, F.col("l_shipdate").cast("date").cast("string"))


@_register(
    """WITH e AS (SELECT conv_id, turn, turn % 5 AS score, CASE WHEN turn % 3 = 0 THEN turn END AS summary, unnest(CASE WHEN turn % 3 = 0 THEN [turn + 2, turn + 1] ELSE [turn] END) AS chunk, unnest(CASE WHEN turn % 3 = 0 THEN [0, 1] ELSE [0] END) AS p FROM conversations),
    f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn, p) = 1)
    SELECT conv_id, chunk, summary, score, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) AS INTEGER) AS place FROM f"""
)
def j16_expand_summaries(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    hits = _t(spark, d, "conversations").select("conv_id", "turn", turn.alias("chunk"), (turn % 5).alias("score"), F.when(turn % 3 == 0, F.array(turn + 2, turn + 1)).alias("members"))
    return board.expand_summaries(hits, ["conv_id"], "chunk", "members", "turn", "score")


@_register("SELECT l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_returnflag = 'R') AND l_returnflag = 'R'")
def r07_document_chunks(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem")
    document = lines.where("l_returnflag = 'R'").agg(F.min("l_orderkey")).first()[0]
    return board.document_chunks(lines, "l_orderkey", document, "l_linenumber", "l_returnflag", "R").select("l_linenumber", "l_partkey", "l_returnflag")


@_register("SELECT c.c_custkey AS cluster, coalesce(s.by_print, CASE WHEN c.c_custkey % 10 >= 1 AND lower(n.n_name) <> 'nation3' THEN n.n_name END) AS label FROM customer c LEFT JOIN (SELECT n_nationkey * 2 AS f, min(n_name) AS by_print FROM nation GROUP BY 1) s ON s.f = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def j17_reuse_labels(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    new = _t(spark, d, "customer").select(c("c_custkey").alias("cluster"), c("c_custkey").cast("string").alias("fingerprint"), c("c_nationkey").alias("previous"), F.when(c("c_custkey") % 10 >= 1, 0.95).otherwise(0.5).alias("jaccard"))
    old = _t(spark, d, "nation").select(c("n_nationkey").alias("previous"), (c("n_nationkey") * 2).cast("string").alias("fingerprint"), c("n_name").alias("label"))
    return board.reuse_labels(new, old, ["nation3"])


@_register("WITH i AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'draft' WHEN 'O' THEN 'archived' ELSE 'approved' END AS status FROM orders) SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND status = 'draft' THEN 'archived' WHEN o_custkey % 2 = 1 AND status = 'archived' THEN 'generated' ELSE status END AS new_status FROM i")
def d18_shift_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "draft").when(F.col("o_orderstatus") == "O", "archived").otherwise("approved")
    items = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), status.alias("status"))
    parents = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "archive").otherwise("activate").alias("action"))
    return board.shift_status(items, parents, "k", "status", "action").select("o_orderkey", "new_status")


@_register("SELECT p_partkey, 'brand' AS from_type, p_brand AS from_name, CASE WHEN p_size % 2 = 0 THEN 'size' ELSE 'type' END AS to_type, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS to_name FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), 'type', p_type FROM part WHERE p_size % 2 = 0")
def d19_chain_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").withColumn("even", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(" "))
    return board.chain_edges(rows, "p_partkey", [("brand", "p_brand"), ("size", "even"), ("type", "p_type")])


@_register("SELECT event_id FROM events WHERE event_type = 'queued' OR (event_type = 'click' AND epoch((SELECT max(ts) FROM events)) - epoch(ts) <= 86400)")
def d20_active_jobs(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    jobs = events.join(F.broadcast(now)).withColumn("event_type", F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")))
    return board.active_jobs(jobs, "event_type", F.col("ts"), F.col("now"), 86400).select("event_id")


@_register(
    """WITH o AS (SELECT c_nationkey AS cluster, c_mktsegment, o_orderpriority, CASE WHEN c_nationkey <> 4 AND o_orderkey % 3 > 0 THEN year(o_orderdate) END AS y FROM orders JOIN customer ON o_custkey = c_custkey),
    p AS (SELECT cluster, count(*) AS n, count(DISTINCT c_mktsegment) AS orgs, avg((y - y0) / (y1 - y0)) AS r, avg(CASE WHEN y >= y1 - 2 THEN 1.0 WHEN y IS NOT NULL THEN 0.0 END) AS late, sum(length(o_orderpriority)) / count(*) AS ip FROM o, (SELECT min(y) AS y0, max(y) AS y1 FROM o) GROUP BY 1),
    x AS (SELECT cluster, 0.6 * r + 0.4 * late AS sm, CASE WHEN cluster % 7 = 0 THEN NULL ELSE (cluster % 5) / 10.0 END AS nv, ip, 0.7 * n / (SELECT max(n) FROM p) + 0.3 * orgs / (SELECT max(orgs) FROM p) AS hr FROM p),
    m AS (SELECT cluster, CASE WHEN sm IS NULL THEN 0.5 ELSE (rank() OVER (ORDER BY sm NULLS LAST) - 1 + 0.5 * count(*) OVER (PARTITION BY sm)) / count(sm) OVER () END AS sm,
      CASE WHEN nv IS NULL THEN 0.5 ELSE (rank() OVER (ORDER BY nv NULLS LAST) - 1 + 0.5 * count(*) OVER (PARTITION BY nv)) / count(nv) OVER () END AS nv,
      (rank() OVER (ORDER BY ip) - 1 + 0.5 * count(*) OVER (PARTITION BY ip)) / count(*) OVER () AS ip, (rank() OVER (ORDER BY hr) - 1 + 0.5 * count(*) OVER (PARTITION BY hr)) / count(*) OVER () AS hr FROM x)
    SELECT cluster, round(sm, 6) AS sm, round(nv, 6) AS nv, round(ip, 6) AS ip, round(hr, 6) AS hr, round(0.4 * sm + 0.25 * nv + 0.2 * ip + 0.15 * hr, 6) AS tech_score, CAST(least(greatest(round_even(1 + 9 * pow(sm, 0.6) * pow(nv, 0.4) * (0.8 + 0.1 * (ip + hr)), 0), 1), 10) AS INTEGER) AS band FROM m"""
)
def d13_itc_index(spark: SparkSession, d: str) -> DataFrame:
    """Nations as clusters of orders, of which a third have no year, and one nation's none at all."""
    docs = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    known = (F.col("c_nationkey") != 4) & (F.col("o_orderkey") % 3 > 0)
    docs = docs.select(F.col("c_nationkey").alias("cluster"), F.when(known, F.year("o_orderdate")).alias("y"), F.length("o_orderpriority").alias("c"), F.col("c_mktsegment").alias("org"))
    near = _t(spark, d, "nation").select(F.col("n_nationkey").alias("cluster"), F.when(F.col("n_nationkey") % 7 != 0, (F.col("n_nationkey") % 5) / 10.0).alias("nv"))
    return board.itc_index(docs, "cluster", "y", "c", "org", near)


@_register(
    """WITH e AS (SELECT DISTINCT l_suppkey AS src, 100000 + l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'),
    p AS (SELECT DISTINCT l_suppkey AS a, l_suppkey + 1 + l_linenumber AS b FROM lineitem)
    SELECT a, b, x.dst AS node FROM p JOIN e x ON x.src = a JOIN e y ON y.src = b AND y.dst = x.dst"""
)
def j11_common_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Returned parts that two suppliers near in number share."""
    lines = _t(spark, d, "lineitem")
    edges = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), (100000 + F.col("l_partkey")).alias("dst"), F.lit(1.0).alias("weight")).distinct()
    pairs = lines.select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1 + F.col("l_linenumber")).alias("b")).distinct()
    return graph.common_neighbours(edges, pairs)


# ---- column functions


@_register("SELECT event_id, CASE WHEN event_id % 5 = 0 AND event_id % 2 = 1 AND event_id % 3 > 0 THEN 0.5 ELSE round(0.65 * CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE least(greatest(value / 100, 0.0), 1.0) END + 0.2 * CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.4 END + 0.15 * CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.3 END, 6) END AS fit FROM events WHERE value IS NOT NULL")
def d02_kpi_fit(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return _t(spark, d, "events").where("value IS NOT NULL").select("event_id", _r(scoring.kpi_fit(F.when(i % 5 != 0, F.col("value") / 100), i % 2 == 0, i % 3 == 0)).alias("fit"))


@_register("SELECT p_partkey, CASE WHEN p_size % 12 < 1 THEN 0.5 ELSE (least(p_size % 12, 9) - 1) / 8.0 END AS fit FROM part")
def d04_trl_fit(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", scoring.trl_fit(F.col("p_size") % 12).alias("fit"))


@_register("SELECT p_partkey, greatest(list_min(list_filter(range(1, 11), lambda k: (p_partkey // k) % 2 = 1 OR k = 10)) - 1, 1) AS level FROM part")
def d05_trl_level(spark: SparkSession, d: str) -> DataFrame:
    met = F.map_from_arrays(F.sequence(F.lit(1), F.lit(9)), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.floor(F.col("p_partkey") / k) % 2 == 0))
    return _t(spark, d, "part").select("p_partkey", scoring.trl_level(met).cast("long").alias("level"))


@_register(
    """WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'refuted' WHEN 2 THEN 'mixed' ELSE 'insufficient' END AS v0, event_id % 3 AS s, event_id % 2 AS c, value / 100 AS conf FROM events WHERE value IS NOT NULL),
    q AS (SELECT *, CASE WHEN c > 0 AND v0 IN ('supported', 'insufficient') THEN 'mixed' ELSE v0 END AS v, CASE WHEN s + c <= 0 THEN 0.0 ELSE floor(least(greatest(0.7 * least(1.0, (s + c) / 5) + 0.3 * CASE WHEN s > 0 AND c > 0 THEN 1.0 ELSE 0.6 END, 0.0), 1.0) * 1000 + 0.5) / 1000 END AS eq FROM v),
    b AS (SELECT *, floor(CASE v WHEN 'supported' THEN least(greatest(conf, 0.0), 1.0) WHEN 'refuted' THEN 1 - least(greatest(conf, 0.0), 1.0) WHEN 'mixed' THEN 0.4 ELSE 0.3 * eq END * 1000 + 0.5) / 1000 AS belief FROM q)
    SELECT event_id, v AS verdict, eq AS quality, belief, round(least(greatest(conf, 0.0), 1.0) * (1 - 2 * abs(belief - 0.5)) * (1 - eq), 6) AS priority FROM b"""
)
def d06_verdicts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    verdict = F.element_at(F.array(*[F.lit(x) for x in ("supported", "refuted", "mixed", "insufficient")]), (i % 4 + 1).cast("int"))
    rows = _t(spark, d, "events").where("value IS NOT NULL").select("event_id", (i % 3).alias("s"), (i % 2).alias("c"), (F.col("value") / 100).alias("conf"), scoring.reconcile(verdict, i % 2).alias("verdict"))
    rows = rows.withColumn("quality", scoring.evidence_quality(F.col("s") + F.col("c"), F.col("s"), F.col("c")))
    rows = rows.withColumn("belief", scoring.belief(F.col("verdict"), F.col("conf"), F.col("quality")))
    return rows.select("event_id", "verdict", "quality", "belief", _r(scoring.learning_priority(F.col("conf"), F.col("belief"), F.col("quality"))).alias("priority"))


@_register("SELECT l_suppkey, round(greatest(1 - count(*) FILTER (l_discount > 0.05) / count(*) - CASE WHEN l_suppkey % 2 = 0 THEN 0.2 ELSE 0.0 END, 0.0), 6) AS novelty FROM lineitem GROUP BY 1")
def d08_novelty(spark: SparkSession, d: str) -> DataFrame:
    per = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_discount") > 0.05).alias("c"), F.count("*").alias("n"))
    return per.select("l_suppkey", _r(scoring.novelty(F.col("c"), F.col("n"), F.col("l_suppkey") % 2 == 0)).alias("novelty"))


@_register("SELECT p_partkey, CASE WHEN NOT p_size >= 2 THEN 'convergence' WHEN NOT p_partkey % 3 > 0 THEN 'grounded' WHEN NOT p_retailprice / 2000 <= 0.6 THEN 'too similar' END AS reason FROM part")
def d11_gates(spark: SparkSession, d: str) -> DataFrame:
    gates = {"convergence": F.col("p_size") >= 2, "grounded": F.col("p_partkey") % 3 > 0, "too similar": F.col("p_retailprice") / 2000 <= 0.6}
    return _t(spark, d, "part").select("p_partkey", scoring.first_failure(gates).alias("reason"))


@_register("SELECT p_partkey, ((p_size > 25)::INT + (p_partkey % 2 = 0)::INT + (p_retailprice > 1200)::INT + (p_brand = 'Brand#1')::INT) / 4 AS share, list_filter([CASE WHEN NOT p_size > 25 THEN 'size' END, CASE WHEN NOT p_partkey % 2 = 0 THEN 'even' END, CASE WHEN NOT p_retailprice > 1200 THEN 'price' END, CASE WHEN NOT p_brand = 'Brand#1' THEN 'brand' END], lambda x: x IS NOT NULL) AS missing FROM part")
def d14_completeness(spark: SparkSession, d: str) -> DataFrame:
    share, missing = scoring.completeness({"size": F.col("p_size") > 25, "even": F.col("p_partkey") % 2 == 0, "price": F.col("p_retailprice") > 1200, "brand": F.col("p_brand") == "Brand#1"})
    return _t(spark, d, "part").select("p_partkey", share.alias("share"), missing.alias("missing"))


@_register("SELECT o_custkey, bool_or(o_orderstatus IN ('F', 'P')) AS counter, bool_or(o_orderstatus = 'O') AS grounded, count(DISTINCT o_orderdate) AS docs FROM orders GROUP BY 1")
def d16_counter_evidence(spark: SparkSession, d: str) -> DataFrame:
    stance = F.when(F.col("o_orderstatus") == "F", "contradicts").when(F.col("o_orderstatus") == "P", "context").otherwise("supports")
    rows = _t(spark, d, "orders").withColumn("stance", stance)
    return rows.groupBy("o_custkey").agg(F.bool_or(F.col("stance").isin("contradicts", "context")).alias("counter"), F.bool_or(F.col("stance") == "supports").alias("grounded"), F.countDistinct("o_orderdate").alias("docs"))


@_register("SELECT event_id, event_id % 4 = 0 OR (event_id % 2 = 0 AND value / 100 < 0.5) AS abstain, CASE WHEN value >= 80 THEN 'Highest' WHEN value >= 60 THEN 'High' WHEN value >= 35 THEN 'Medium' ELSE 'Low' END AS band FROM events WHERE value IS NOT NULL")
def d17_abstain(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    return _t(spark, d, "events").where("value IS NOT NULL").select("event_id", scoring.abstain(i % 4, v / 100, i % 2 == 0).alias("abstain"), scoring.priority_band(v).alias("band"))


@_register("SELECT event_id, round(least(greatest(value / 50, 0.0), 1.0) * CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE (event_id % 4) / 3.0 END * (1 - least(1.0, (event_id % 7) / 5)), 4) AS score FROM events WHERE value IS NOT NULL")
def d12_transfer_score(spark: SparkSession, d: str) -> DataFrame:
    """Some ideas have no strength."""
    i = F.col("event_id")
    return _t(spark, d, "events").where("value IS NOT NULL").select("event_id", scoring.transfer_score(F.col("value") / 50, F.when(i % 4 > 0, i % 4 / 3.0), i % 7).alias("score"))


@_register("SELECT vec_id, CAST(floor(x * 1000 + 0.5) / 1000 AS DOUBLE) AS r3, CAST(floor(x * 100 + 0.5) AS INTEGER) AS pct, round(least(greatest(x, 0.0), 1.0), 9) AS c01, sign(x) * floor(abs(x) * 10000 + 0.5) / 10000 AS r4, round_even(floor(x * 1000) + 0.5, 0) AS even FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def m04_rounding(spark: SparkSession, d: str) -> DataFrame:
    """All ways to round: halves up, away from 0, and to the even number."""
    x = F.get("embedding", F.lit(0)).cast("double")
    return _t(spark, d, "embeddings").select("vec_id", maths.round3(x).alias("r3"), maths.percent(x).alias("pct"), F.round(maths.clamp01(x), 9).alias("c01"), bridges.round4(x).alias("r4"), F.bround(F.floor(x * 1000) + F.lit(0.5), 0).alias("even"))


@_register("SELECT event_id, strftime(ts, '%Y%m%d') AS day FROM events")
def m09_day_key(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd").alias("day"))


@_register("SELECT doc_id, sha1(source || '|' || lang) AS transfer, sha256(source || chr(1) || lang) AS cache FROM documents")
def m07_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.sha1(F.concat_ws("|", "source", "lang")).alias("transfer"), F.sha2(F.concat_ws("\x01", "source", "lang"), 256).alias("cache"))


@_register("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def m08_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 stands in for a hash that Spark doesn't have."""
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("hash"))


@_register("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS cut, trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')) AS flat FROM documents")
def t05_clip(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.clip(F.col("text"), 100, "…").alias("cut"), text.collapse(F.col("text")).alias("flat"))


@_register("SELECT doc_id, lang || ' — ' || source || chr(10) || chr(10) || text AS chunk FROM documents")
def t06_breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.breadcrumb(F.col("lang"), F.col("source"), F.col("text")).alias("chunk"))


@_register("SELECT doc_id, doc_id % 3 = 0 AND n_chars >= 20 AS valid FROM documents")
def t07_valid_offsets(spark: SparkSession, d: str) -> DataFrame:
    offsets = F.array(F.lit(0), F.lit(10), F.when(F.col("doc_id") % 3 == 0, 20).otherwise(5))
    return _t(spark, d, "documents").select("doc_id", text.valid_offsets(offsets, F.col("n_chars")).alias("valid"))


_CITED = "coalesce(text, '') || ' [S' || (turn + 1) || '] so [S ' || (conv_id % 4) || '] and [S2]'"


@_register(
    f"""WITH c AS (SELECT conv_id, turn, {_CITED} AS a, conv_id % 3 AS n FROM conversations),
    x AS (SELECT *, regexp_extract_all(a, '\\[S\\s*(\\d{{1,4}})\\]', 1) AS xs FROM c),
    r AS (SELECT *, list_filter(list_transform(xs, lambda x: CAST(x AS INTEGER)), lambda x: x >= 1 AND x <= n) AS refs, list_filter(xs, lambda x: CAST(x AS INTEGER) < 1 OR CAST(x AS INTEGER) > n) AS bad FROM x),
    s AS (SELECT *, list_reduce(list_prepend(a, bad), lambda x, y: regexp_replace(x, '[ \t\n\v\f\r]?\\[S[ \t\n\v\f\r]*' || y || '\\]', '', 'g')) AS s FROM r)
    SELECT conv_id, turn, trim(regexp_replace(s, '[ \t\n\v\f\r]+', ' ', 'g')) AS clean, list_filter(refs, lambda x, i: list_position(refs, x) = i) AS refs, CAST(len(xs) AS INTEGER) AS cited FROM s"""
)
def t15_citations(spark: SparkSession, d: str) -> DataFrame:
    """Turns without the citations of sources beyond the up to two there are, and the sources they cite, in order."""
    t = F.expr(_CITED)
    rows = _t(spark, d, "conversations").select("conv_id", "turn", t.alias("a"), (F.col("conv_id") % 3).alias("n"))
    a, n = F.col("a"), F.col("n")
    return rows.select("conv_id", "turn", text.sanitise_citations(a, n).alias("clean"), text.citation_refs(a, n).alias("refs"), F.regexp_count("a", F.lit("\\[S\\s*\\d{1,4}\\]")).alias("cited"))


@_register(
    """WITH x AS (SELECT doc_id, source AS title, trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')) AS t, lang FROM documents)
    SELECT doc_id, '[S 1] ' || title || ': ' || CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END || chr(10) || '[S 2] lang ' || lang || ': ' || lang AS answer FROM x"""
)
def t17_extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    """The heads of two sources a document: its text and its language."""
    rows = _t(spark, d, "documents")
    return rows.select("doc_id", text.extractive_answer(F.array("text", "lang"), F.array("source", F.concat(F.lit("lang "), "lang"))).alias("answer"))


@_register("SELECT p_partkey, [p_size || ' mm', '5 kg'] AS signals, 1990 + p_size % 30 AS year, CASE WHEN p_partkey % 2 = 0 THEN 'Al2O3' END AS formula FROM part")
def t18_signals(spark: SparkSession, d: str) -> DataFrame:
    year = (1990 + F.col("p_size") % 30).cast("string")
    said = F.concat(F.lit("about "), F.col("p_size").cast("string"), F.lit(" mm and 5 kg, then 5 kg, in 1985 and "), year, F.when(F.col("p_partkey") % 2 == 0, " of Al2O3 OK").otherwise(" of it"))
    rows = _t(spark, d, "part").select("p_partkey", said.alias("t"))
    return rows.select("p_partkey", text.numeric_signals(F.col("t")).alias("signals"), text.years(F.col("t")).alias("year"), text.formula(F.col("t")).alias("formula"))


_HEADED = "CASE doc_id % 7 WHEN 0 THEN '3. References ' WHEN 1 THEN '## Works cited: ' WHEN 2 THEN 'Referencesx [1] [ 2 ] ' WHEN 3 THEN '[1] [2] [ 33 ] [4] [5] ' WHEN 4 THEN 'doi: 10.1000/ab 10.2000/x https://doi.org/10.3000/z ' ELSE '' END || coalesce(text, '')"


@_register(
    f"""WITH t AS (SELECT doc_id, {_HEADED} AS t FROM documents), f AS (SELECT doc_id, trim(regexp_replace(t, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS t FROM t),
    r AS (SELECT doc_id, t, greatest(len(regexp_extract_all(t, '[A-Za-zА-Яа-я]{{2,}}')), 1) AS words, len(regexp_extract_all(t, '(?i)(doi\\s*[:.]?\\s*|https?://(dx\\.)?doi\\.org/)?10\\.\\d{{4,9}}/\\S+')) AS dois,
      regexp_matches(regexp_replace(substr(t, 1, 120), '^[ .#0-9]+', ''), '(?i)^\\W{{0,6}}(references|bibliography|works cited|acknowledge?ments?)\\b') OR len(regexp_extract_all(t, '\\[\\s*\\d{{1,3}}\\s*\\]')) >= 5 AS by_head FROM f),
    s AS (SELECT *, t <> '' AND (by_head OR (dois >= 3 AND dois / words > 0.025)) AS refs FROM r)
    SELECT doc_id, refs, length(t) >= 200 AND words >= 30 AND len(regexp_extract_all(t, '[.!?](\\s|$)')) >= 2 AND NOT refs AS prose FROM s"""
)
def t11_detectors(spark: SparkSession, d: str) -> DataFrame:
    """Reference lists and prose among documents, some after a heading, marks or DOIs."""
    t = F.expr(_HEADED)
    rows = _t(spark, d, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", text.is_references(F.col("t")).alias("refs"), text.is_prose(F.col("t")).alias("prose"))


@_register("SELECT p_partkey, 'the ' || replace(lower(p_name), ' ', '') || ' 12 end' AS joined FROM part")
def t03_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Names set letter by letter, joined again."""
    name = F.lower(F.replace("p_name", F.lit(" "), F.lit("")))
    spaced = F.concat(F.lit("the "), F.trim(F.regexp_replace(name, "(.)", "$1 ")), F.lit(" 12 end"))
    return _t(spark, d, "part").select("p_partkey", text.collapse_spaced(spaced).alias("joined"))


@_register("SELECT p_partkey, regexp_matches(lower(w), '^(model|paper|vision|framework)') AS generic FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Model' WHEN 1 THEN 'paper for ' || p_size WHEN 2 THEN 'vision-model x' WHEN 3 THEN p_name ELSE 'framework' END AS w FROM part)")
def t14_generic_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that say nothing."""
    k = F.col("p_partkey") % 5
    label = F.when(k == 0, "Model").when(k == 1, F.concat(F.lit("paper for "), F.col("p_size").cast("string"))).when(k == 2, "vision-model x").when(k == 3, F.col("p_name")).otherwise("framework")
    return _t(spark, d, "part").select("p_partkey", text.is_generic(label).alias("generic"))


@_register(
    """WITH f AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'Application/PDF' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'image/' || lang WHEN 4 THEN '' WHEN 5 THEN 'application/zip' WHEN 6 THEN 'application/vnd.sqlite3' WHEN 7 THEN 'text/csv' END AS mime,
    source || CASE doc_id % 7 WHEN 0 THEN '.ZIP' WHEN 1 THEN '.msg' WHEN 2 THEN '.db' WHEN 3 THEN '.csv' WHEN 4 THEN '.tgz' WHEN 5 THEN '.docx' ELSE '' END AS name FROM documents),
    k AS (SELECT doc_id, lower(coalesce(mime, '')) AS m, lower(regexp_extract(name, '[.]([^.]+)$', 1)) AS e FROM f)
    SELECT doc_id, CASE WHEN m = 'application/zip' OR (m IN ('', 'application/octet-stream') AND e IN ('zip', 'tgz')) THEN 'archive' WHEN contains(m, 'pdf') THEN 'pdf' WHEN e = 'msg' THEN 'email' WHEN starts_with(m, 'image/') THEN 'vlm'
    WHEN contains(m, 'sqlite') OR (m IN ('', 'application/octet-stream') AND e = 'db') THEN 'sqlite' ELSE 'office' END AS route FROM k"""
)
def s01_file_route(spark: SparkSession, d: str) -> DataFrame:
    """The queue of every document by its type and the name it would have."""
    i = F.col("doc_id")
    mime = F.when(i % 9 == 3, F.concat(F.lit("image/"), "lang"))
    for k, x in ((0, "application/octet-stream"), (1, "Application/PDF"), (2, "text/plain"), (4, ""), (5, "application/zip"), (6, "application/vnd.sqlite3"), (7, "text/csv")):
        mime = mime.when(i % 9 == k, x)
    name = F.lit("")
    for k, x in enumerate((".ZIP", ".msg", ".db", ".csv", ".tgz", ".docx")):
        name = F.when(i % 7 == k, x).otherwise(name)
    return _t(spark, d, "documents").select("doc_id", text.file_route(mime, F.concat("source", name), "vlm").alias("route"))


@_register(
    """WITH f AS (SELECT doc_id, lower(substr(text, 1, 1)) AS c, doc_id % 4 AS k FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, k = 0 OR k = 2 AS delimited FROM f"""
)
def s02_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Which of the documents would be read as delimited texts."""
    k = F.col("doc_id") % 4
    mime = F.when(k == 0, "text/csv").when(k == 2, "application/octet-stream").otherwise("text/plain")
    name = F.concat("source", F.when(k == 2, ".TSV").otherwise(".txt"))
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.is_delimited(mime, name).alias("delimited"))


_HEADS = ("255044462D", "504B0304", "1F8B0808", "89504E470D0A1A0A", "474946383961", "524946460000000057415645", "FFD8FFEE", "4D5A9000", "000000186674797069736F6D", "")


@_register(
    """WITH f AS (SELECT doc_id, doc_id % 10 AS k, source || CASE doc_id % 6 WHEN 0 THEN '.PY' WHEN 1 THEN '.htm' WHEN 2 THEN '.md' WHEN 3 THEN '.bin' ELSE '' END AS name, doc_id % 6 AS e, substr(coalesce(text, ''), 1, 64) AS t FROM documents),
    h AS (SELECT *, k = 9 AND t <> '' AND regexp_matches(substr(t, 1, 64), '^[ -~\t\n\f\r]+$') AS plain FROM f)
    SELECT doc_id, CASE k WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'gzip' WHEN 3 THEN 'png' WHEN 4 THEN 'gif' WHEN 5 THEN 'wav' WHEN 7 THEN 'pebin' WHEN 8 THEN 'mp4' ELSE
      CASE e WHEN 0 THEN 'python' WHEN 1 THEN 'html' WHEN 2 THEN 'markdown' ELSE CASE WHEN plain THEN 'txt' ELSE 'unknown' END END END AS label,
      CASE WHEN k NOT IN (6, 9) THEN 'magic' WHEN e < 3 OR plain THEN 'heuristic' ELSE 'unknown' END AS source FROM h"""
)
def s23_magic_label(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of documents' texts behind the first bytes of files, by these or by the names they would have."""
    i = F.col("doc_id")
    head = F.unhex(F.element_at(F.array(*[F.lit(x) for x in _HEADS]), (i % 10 + 1).cast("int")))
    ends = F.element_at(F.array(*[F.lit(x) for x in (".PY", ".htm", ".md", ".bin", "", "")]), (i % 6 + 1).cast("int"))
    found = text.detected(F.concat("source", ends), F.concat(head, F.encode(F.substring(F.coalesce("text", F.lit("")), 1, 64), "UTF-8")))
    return _t(spark, d, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.label", "f.source")
