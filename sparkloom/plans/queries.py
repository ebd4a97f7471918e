"""Queries of the library's own operators over the test tables, and their SQL.

The tables stand in for those of a document catalogue: ``documents`` for
documents (source for the owner, lang for the kind), ``embeddings`` for vector
points (label for the document a vector belongs to, and for communities),
``events`` for usage rows, job records and keyed counters, ``orders`` and its
neighbours for the relational joins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import maths, scoring, text
from ..operators import catalog, graph, matching, retrieval, vectors
from ..tables import scope

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            """Tables saved on the way are deleted; the result is one then."""
            with scope() as tables:
                return tables.result(f(spark, d), f.__name__)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_TOKENS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{Nd}}]+'), lambda x: length(x) >= 4))"

# ---- retrieval


@_register(
    """
WITH q AS (SELECT unnest("""
    + _TOKENS.format("text")
    + """) AS token FROM documents WHERE doc_id = 7),
tok AS (SELECT doc_id, unnest("""
    + _TOKENS.format("text")
    + """) AS token FROM documents WHERE doc_id <> 7),
lex AS (SELECT doc_id, count(*) AS s FROM tok JOIN q USING (token) GROUP BY doc_id),
lexr AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) - 1 AS rank FROM lex QUALIFY rank < 20),
dense AS (SELECT e.vec_id AS doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 9) AS s
          FROM embeddings e, embeddings p WHERE p.vec_id = 7 AND e.vec_id <> 7),
denser AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) - 1 AS rank FROM dense QUALIFY rank < 20),
fused AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS score, min(lst) AS first_list FROM
  (SELECT doc_id, rank, 0 AS lst FROM denser UNION ALL SELECT doc_id, rank, 1 AS lst FROM lexr) GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, CAST(first_list AS INTEGER) AS first_list FROM fused ORDER BY score DESC, doc_id LIMIT 10"""
)
def w01_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and dense hits for document 7 fused by reciprocal rank, the ten best."""
    docs = _t(spark, d, "documents").select("doc_id", text.token_set(F.col("text")).alias("tokens"))
    probe = docs.where("doc_id = 7").select(F.col("tokens").alias("asked")).limit(1)
    lexical = docs.where("doc_id <> 7").join(F.broadcast(probe)).select("doc_id", F.size(F.array_intersect("tokens", "asked")).cast("long").alias("s")).where("s > 0")
    points = _t(spark, d, "embeddings")
    one = points.where("vec_id = 7").select(F.col("embedding").alias("p"))
    dense = points.where("vec_id <> 7").join(F.broadcast(one.limit(1))).select(F.col("vec_id").alias("doc_id"), F.round(maths.cosine(F.col("embedding"), F.col("p")), 9).alias("s"))
    n = retrieval.depth()
    top = lambda df: df.orderBy(F.desc("s"), "doc_id").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "doc_id")) - 1)
    fused = retrieval.fuse([(top(dense), 1.0), (top(lexical), 1.0)], [], "doc_id")
    return fused.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"), "first_list")


_BM25 = (
    """
tok AS (SELECT doc_id AS doc, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: length(x) >= 2)) AS token FROM documents),
tf AS (SELECT doc, token, count(*) AS tf FROM tok GROUP BY ALL), sz AS (SELECT doc, count(*) AS size FROM tok GROUP BY doc),
whole AS (SELECT avg(size) AS av, count(*) AS n FROM sz), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS (SELECT item_id AS query, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: length(x) >= 2))) AS token FROM benchmark),
sc AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / av))) AS score
  FROM q JOIN tf USING (token) JOIN df USING (token) JOIN sz USING (doc), whole GROUP BY query, doc),
r AS (SELECT query, doc, round(score, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 4) DESC, doc) - 1 AS rank FROM sc)"""
)


def _bm25_hits(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}\\p{Nd}]+"), lambda x: F.length(x) >= 2)
    tokens = _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), words(F.col("text")).alias("tokens"))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(words(F.col("text")))).alias("token"))
    scored = retrieval.bm25(tokens, asked).withColumn("score", F.round("score", 4))
    return retrieval.ranked(scored, ["query"], "score", "doc", 10)


@_register("WITH " + _BM25 + " SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 10")
def r02_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for every benchmark item by BM25."""
    return _bm25_hits(spark, d)


@_register(
    "WITH " + _BM25 + """, g AS (SELECT q.item_id AS query, min(r.rank) AS rank FROM benchmark q LEFT JOIN r ON r.query = q.item_id AND r.rank < 5 AND r.doc % 40 = q.item_id % 40 GROUP BY 1)
SELECT query, CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS hit, coalesce(round(1.0 / (rank + 1), 6), 0.0) AS rr, coalesce(round(1 / log2(rank + 2), 6), 0.0) AS ndcg FROM g"""
)
def d15_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hit, reciprocal rank and nDCG at 5; documents with the item's number modulo 40 stand for the relevant ones."""
    hits = _bm25_hits(spark, d).where("rank < 5").withColumn("doc", F.when(F.col("doc") % 40 == F.col("query") % 40, F.col("query")))
    relevant = _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("item_id").alias("doc"))
    got = retrieval.retrieval_metrics(hits, relevant, 5)
    return got.select("query", "hit", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"))


@_register(
    """WITH h AS (SELECT o_orderkey, o_custkey % 7 AS doc, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS nth FROM h),
t AS (SELECT *, row_number() OVER (ORDER BY nth > 4, pos) AS take FROM n) SELECT o_orderkey, CAST(doc AS BIGINT) AS doc FROM t WHERE take <= 20"""
)
def w03_cap_per_document(spark: SparkSession, d: str) -> DataFrame:
    """Twenty hits with at most four of one document, filled up from the rest."""
    hits = _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_custkey") % 7).alias("doc"), "o_totalprice")
    return retrieval.cap_whole_list(hits, "doc", [F.desc("o_totalprice"), F.col("o_orderkey")], 20).select("o_orderkey", "doc")


@_register(
    "WITH a AS (SELECT item_id AS fragment, unnest(" + _TOKENS.format("text") + ") AS t FROM benchmark), b AS (SELECT conv_id * 1000 + turn AS source, unnest(" + _TOKENS.format("text") + """) AS t FROM conversations),
c AS (SELECT fragment, source, count(*) AS common FROM a JOIN b USING (t) GROUP BY ALL)
SELECT fragment, source, common FROM c QUALIFY row_number() OVER (PARTITION BY fragment ORDER BY common DESC, source) = 1"""
)
def j19_best_source(spark: SparkSession, d: str) -> DataFrame:
    """For every benchmark item the conversation turn that shares most tokens."""
    a = _t(spark, d, "benchmark").select(F.col("item_id").alias("fragment"), text.token_set(F.col("text")).alias("tokens"))
    b = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("source"), text.token_set(F.col("text")).alias("tokens"))
    return retrieval.best_overlap(a, b)


# ---- vectors and graphs

_UNIT = "SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_KNN = "u AS (" + _UNIT + """), k AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.v, b.v), 9) AS cos FROM u a JOIN u b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.vec_id) <= 6),
e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(cos) AS cos, greatest(1e-6, (max(cos) + 1) / 2) AS weight FROM k WHERE cos >= 0.2 GROUP BY 1, 2 HAVING count(*) = 2)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Saved, since graph measures read their edges many times."""
    return graph.saved(graph.mutual_graph(vectors.knn(_t(spark, d, "embeddings"), 6, "vec_id", "embedding"), 0.2), "edges")


def _members(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("community"))


@_register("WITH " + _KNN + " SELECT src, dst, round(cos, 4) AS cos, CAST(row_number() OVER (PARTITION BY src ORDER BY cos DESC, dst) AS INTEGER) AS rank FROM k")
def j07_knn(spark: SparkSession, d: str) -> DataFrame:
    """The six nearest neighbours of every vector."""
    return vectors.knn(_t(spark, d, "embeddings"), 6, "vec_id", "embedding").select("src", "dst", F.round("cos", 4).alias("cos"), "rank")


@_register("WITH " + _KNN + " SELECT src, dst, round(weight, 4) AS weight FROM e")
def g01_mutual_graph(spark: SparkSession, d: str) -> DataFrame:
    """Mutual neighbours with a cosine of 0.2 or more."""
    return _edges(spark, d).select("src", "dst", F.round("weight", 4).alias("weight"))


@_register(
    "WITH " + _KNN + """, tot AS (SELECT sum(weight) AS m FROM e), w AS (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e),
deg AS (SELECT label, sum(weight) AS deg FROM w JOIN embeddings ON node = vec_id GROUP BY label),
ins AS (SELECT a.label, sum(weight) AS ins FROM e JOIN embeddings a ON e.src = a.vec_id JOIN embeddings b ON e.dst = b.vec_id WHERE a.label = b.label GROUP BY a.label)
SELECT label AS community, round(coalesce(ins, 0) / m - pow(deg / (2 * m), 2), 6) AS term FROM deg LEFT JOIN ins USING (label), tot"""
)
def g04_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity terms of the labels as communities."""
    return graph.modularity(_edges(spark, d), _members(spark, d)).select("community", F.round("term", 6).alias("term"))


@_register(
    "WITH " + _KNN + """ SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS n, round(sum(weight), 4) AS weight
FROM e JOIN embeddings a ON e.src = a.vec_id JOIN embeddings b ON e.dst = b.vec_id WHERE a.label <> b.label GROUP BY 1, 2"""
)
def j10_cross_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between each pair of labels."""
    return graph.cross_edges(_edges(spark, d), _members(spark, d)).select("a", "b", "n", F.round("weight", 4).alias("weight"))


@_register(
    "WITH " + _KNN + """, w AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), dg AS (SELECT src AS node, count(*) AS links FROM w GROUP BY src)
SELECT w.src AS node, round(1.0 / max(d.links) / sum(1.0 / o.links), 6) AS coefficient FROM w JOIN dg d ON d.node = w.src JOIN dg o ON o.node = w.dst GROUP BY w.src"""
)
def g10_bridging(spark: SparkSession, d: str) -> DataFrame:
    """Bridging coefficients of the neighbour graph."""
    return graph.bridging_coefficient(_edges(spark, d)).select("node", F.round("coefficient", 6).alias("coefficient"))


@_register(
    "WITH RECURSIVE " + _KNN + """, w AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
r AS (SELECT DISTINCT src AS node, src AS reach FROM w UNION SELECT r.node, w.dst FROM r JOIN w ON r.reach = w.src)
SELECT node, min(reach) AS component FROM r GROUP BY node"""
)
def g13_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the neighbour graph."""
    return graph.components(_edges(spark, d))


@_register(None)
def g07_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Personalised PageRank from vectors 1, 2 and 3."""
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    points = _t(spark, d, "embeddings").select(F.col("vec_id").alias("node"))
    return graph.pagerank(_edges(spark, d), seeds, points).select("node", F.round("score", 6).alias("score"))


@_register(None)
def g08_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths from label 0 to label 1."""
    points = _t(spark, d, "embeddings")
    return graph.shortest_paths(_edges(spark, d), points.where("label = 0").select(F.col("vec_id").alias("node")), points.where("label = 1").select(F.col("vec_id").alias("node")))


@_register(
    """WITH n AS (SELECT user_id % 40 AS cluster, event_id AS member FROM events), p AS (SELECT user_id % 25 AS prev, event_id AS member FROM events WHERE event_id % 10 < 9),
c AS (SELECT cluster, prev, count(*) AS c FROM n JOIN p USING (member) GROUP BY ALL), ns AS (SELECT cluster, count(*) AS n FROM n GROUP BY 1), ps AS (SELECT prev, count(*) AS pn FROM p GROUP BY 1),
x AS (SELECT *, c / (n + pn - c) AS jac, c / pn >= 0.3 AS feeds FROM c JOIN ns USING (cluster) JOIN ps USING (prev)),
m AS (SELECT cluster, count(*) AS mf FROM x WHERE feeds GROUP BY 1), s AS (SELECT prev, count(*) AS sp FROM x WHERE feeds GROUP BY 1),
b AS (SELECT cluster, prev, jac FROM x QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY jac DESC, prev) = 1)
SELECT cluster, prev AS best_previous, round(jac, 6) AS jaccard, CASE WHEN mf >= 2 THEN mf ELSE 0 END AS merged_from, CASE WHEN sp >= 2 THEN sp ELSE 0 END AS splits
FROM b LEFT JOIN m USING (cluster) LEFT JOIN s USING (prev)"""
)
def g06_lineage(spark: SparkSession, d: str) -> DataFrame:
    """How groups of events continue earlier groups."""
    ev = _t(spark, d, "events")
    new = ev.select((F.col("user_id") % 40).alias("cluster"), F.col("event_id").alias("member"))
    old = ev.where("event_id % 10 < 9").select((F.col("user_id") % 25).alias("cluster"), F.col("event_id").alias("member"))
    return graph.lineage(new, old)


@_register(
    "WITH u AS (" + _UNIT + """), x AS (SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN 0.05 WHEN vec_id % 4 <= 1 THEN 2.0 WHEN vec_id % 3 = 0 THEN 1.5 ELSE 1.0 END AS w, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM u),
s AS (SELECT label, i, sum(x * w) AS s FROM x GROUP BY ALL), l AS (SELECT label, sqrt(sum(s * s)) AS l FROM s GROUP BY 1)
SELECT label, CAST(i AS INTEGER) AS i, round(s / l, 4) AS x FROM s JOIN l USING (label)"""
)
def a16_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Weighted pooled vectors of the labels, one row a component."""
    id_ = F.col("vec_id")
    weight = vectors.chunk_weight(id_ % 5 == 0, id_ % 4, id_ % 3 == 0)
    pooled = vectors.pool(_t(spark, d, "embeddings"), "label", "embedding", weight)
    return pooled.select("label", F.posexplode("vector").alias("i", "x")).select("label", "i", F.round("x", 4).alias("x"))


@_register(
    "WITH u AS (" + _UNIT + """), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), s AS (SELECT label, i, sum(x) AS s FROM x GROUP BY ALL),
n AS (SELECT label, count(*) AS n FROM u GROUP BY 1)
SELECT label, CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE round(greatest(-1, least(1, (sum(s * s) - n) / (n * (n - 1)))), 4) END AS mean_cos FROM s JOIN n USING (label) GROUP BY label, n"""
)
def g05_cohesion(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine within each label, from the length of the sum of unit vectors."""
    unit = _t(spark, d, "embeddings").withColumn("u", maths.l2_normalise(F.col("embedding")))
    s = vectors.vector_sum(unit, ["label"], "u", F.lit(1.0))
    n = F.col("n")
    mean = (maths.dot(F.col("sum_v"), F.col("sum_v")) - n) / (n * (n - 1))
    return s.select("label", F.when(n <= 1, 1.0).otherwise(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)), 4)).alias("mean_cos"))


@_register(
    "WITH u AS (" + _UNIT + """), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), s AS (SELECT label, i, sum(x) AS s FROM x GROUP BY ALL),
c AS (SELECT label, list(s ORDER BY i) AS c FROM s GROUP BY 1), p AS (SELECT vec_id, c.label, round(list_cosine_similarity(v, c), 9) AS sim FROM u, c)
SELECT vec_id, label, round(sim, 4) AS sim FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1"""
)
def j15_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest label centroid."""
    points = _t(spark, d, "embeddings")
    found = vectors.nearest_centroid(points, vectors.pool(points, "label", "embedding"), "vec_id", "embedding", "label")
    return found.select("vec_id", "label", F.round("sim", 4).alias("sim"))


# ---- scores

_D01_FACTORS = "o_custkey % 11 / 10.0 AS kpi_fit, o_custkey % 7 / 6.0 AS evidence, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 9 / 8.0 END AS novelty, least(o_totalprice / 300000, 1.5) AS value, o_orderkey % 3 / 2.0 AS risk, o_orderkey % 8 / 7.0 AS trl_fit"


def _r3(x: str) -> str:
    return f"floor(({x}) * 1000 + 0.5) / 1000"


def _d01_sql(weights: dict[str, float]) -> str:
    unit = "CASE WHEN {0} IS NULL THEN 0.5 ELSE least(greatest(CAST({0} AS DOUBLE), 0.0), 1.0) END"
    parts = [_r3(f"CAST({w!r} AS DOUBLE) * ({'1 - ' if k == 'risk' else ''}{unit.format(k)})") for k, w in weights.items()]
    return (
        "WITH f AS (SELECT o_orderkey, o_orderstatus, " + _D01_FACTORS + " FROM orders), s AS (SELECT o_orderkey, o_orderstatus, 0.0 + " + " + ".join(parts) + " AS t FROM f) SELECT o_orderkey, "
        + _r3("least(greatest(t * CAST(CASE o_orderstatus WHEN 'F' THEN 1.15 WHEN 'P' THEN 0.4 ELSE 1.0 END AS DOUBLE), 0.0), 1.0)") + " AS score FROM s"
    )


#: A user's weights, which don't add up to one.
_OWN_WEIGHTS = {"kpi_fit": 0.5, "evidence": 0.25, "novelty": 0.0, "value": 1.0, "risk": 0.25, "trl_fit": 0.5}


def _ranked_orders(spark: SparkSession, d: str, weights: dict[str, float]) -> DataFrame:
    """Composite ranking with rounded contributions and status factors."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    factors = {"kpi_fit": c % 11 / 10.0, "evidence": c % 7 / 6.0, "novelty": F.when(k % 5 != 0, k % 9 / 8.0), "value": F.least(F.col("o_totalprice") / 300000, F.lit(1.5)), "risk": k % 3 / 2.0, "trl_fit": k % 8 / 7.0}
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("open")
    return _t(spark, d, "orders").select("o_orderkey", scoring.composite(factors, status, weights).alias("score"))


@_register(_d01_sql(scoring.RANK_WEIGHTS))
def d01_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Composite ranking with rounded contributions and status factors."""
    return _ranked_orders(spark, d, scoring.RANK_WEIGHTS)


@_register(_d01_sql(scoring.normalised(_OWN_WEIGHTS)))
def m11_own_weights(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking with a user's weights."""
    return _ranked_orders(spark, d, scoring.normalised(_OWN_WEIGHTS))


@_register(
    """WITH v AS (SELECT event_id, event_type, CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(value) END AS v FROM events)
SELECT event_id, CASE WHEN v IS NULL OR count(v) OVER (PARTITION BY event_type) <= 1 THEN 0.5::DOUBLE ELSE
round((rank() OVER (PARTITION BY event_type ORDER BY v NULLS FIRST) - 1 - count(*) FILTER (v IS NULL) OVER (PARTITION BY event_type) + 0.5 * count(v) OVER (PARTITION BY event_type, v)) / count(v) OVER (PARTITION BY event_type), 6) END AS pct FROM v"""
)
def w04_mid_rank(spark: SparkSession, d: str) -> DataFrame:
    """Mid-rank percentiles of values within each event type."""
    ev = _t(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 13 != 0, F.round("value")).alias("v"))
    return matching.with_mid_rank(ev, "v", "pct", ["event_type"]).select("event_id", F.round("pct", 6).alias("pct"))


@_register(
    """WITH e AS (SELECT l_orderkey, l_suppkey, bool_or(l_returnflag = 'R') AS c, bool_or(l_returnflag = 'A') AS s FROM lineitem GROUP BY 1, 2),
n AS (SELECT l_orderkey, count(*) FILTER (s AND NOT c) AS sup, count(*) FILTER (c) AS con FROM e GROUP BY 1),
v AS (SELECT *, CASE WHEN con > 0 AND sup > 0 THEN 'mixed' WHEN con > 0 THEN 'refuted' WHEN sup > 1 THEN 'supported' WHEN sup = 1 THEN 'insufficient' ELSE '' END AS verdict, 0.5 * least(1.0, sup / 4) + 0.5 * (sup + 1) / (sup + con + 2) AS raw FROM n)
SELECT l_orderkey, CAST(sup AS BIGINT) AS supports, CAST(con AS BIGINT) AS contradicts, verdict, round(CAST(CASE WHEN sup + con = 0 AND verdict = '' THEN 0.5 WHEN verdict = 'supported' THEN raw * 0.85 + 0.15 WHEN verdict = 'mixed' THEN raw * 0.8 WHEN verdict = 'refuted' THEN raw * 0.35 WHEN verdict = 'insufficient' THEN raw * 0.7 ELSE raw END AS DOUBLE), 6) AS confidence FROM v"""
)
def d03_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence confidence of orders: suppliers are sources, return flags stances."""
    stance = F.when(F.col("l_returnflag") == "R", "contradicts").when(F.col("l_returnflag") == "A", "supports").otherwise("context")
    n = catalog.evidence_by_source(_t(spark, d, "lineitem").withColumn("stance", stance), "l_orderkey", F.col("l_suppkey"), "stance")
    sup, con = F.col("supports"), F.col("contradicts")
    verdict = F.when((con > 0) & (sup > 0), "mixed").when(con > 0, "refuted").when(sup > 1, "supported").when(sup == 1, "insufficient").otherwise("")
    n = n.withColumn("verdict", verdict)
    return n.select("l_orderkey", "supports", "contradicts", "verdict", F.round(scoring.evidence_confidence(sup, con, F.col("verdict")), 6).alias("confidence"))


@_register(
    """SELECT CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'closed' WHEN o_orderkey % 3 = 0 THEN 'ready' WHEN o_orderkey % 3 = 1 THEN 'risk' WHEN o_orderkey % 2 = 0 THEN 'insufficient' ELSE 'needs_verify' END AS queue, count(*) AS n FROM orders GROUP BY 1"""
)
def f06_queues(spark: SparkSession, d: str) -> DataFrame:
    """Rows in each work queue."""
    k = F.col("o_orderkey")
    status = F.when((F.col("o_orderstatus") == "F") & (k % 4 == 0), "rejected").otherwise("open")
    verdict = F.when(k % 3 == 0, "supported").when(k % 3 == 1, "refuted").when(k % 2 == 0, "insufficient").otherwise("")
    return _t(spark, d, "orders").select(F.coalesce(scoring.queue(status, F.lit(None), verdict), F.lit("closed")).alias("queue")).groupBy("queue").agg(F.count("*").alias("n"))


# ---- catalogue


@_register("SELECT o_orderkey, coalesce(c_name, '') AS username, round(o_totalprice, 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING' WHERE o_orderstatus = 'P'")
def j01_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their owner's name, or an empty one."""
    owners = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    rows = catalog.optional_filter(_t(spark, d, "orders"), {"o_orderstatus": "P", "o_orderpriority": ""})
    return rows.join(owners, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("username"), F.round("o_totalprice", 2).alias("total"))


@_register("SELECT p_partkey, p_name, l_orderkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7 AND l_shipdate >= TIMESTAMP '1996-01-01'")
def j02_inner_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows linked to the members of one group."""
    part = _t(spark, d, "part").where("p_size = 7").select("p_partkey", "p_name")
    lines = _t(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP '1996-01-01'").select("l_partkey", "l_orderkey", "l_quantity")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_name", "l_orderkey", "l_quantity")


@_register("SELECT o_orderkey, o_orderdate FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey IN (1, 2, 3))")
def j03_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which some evidence cites a listed document."""
    cited = _t(spark, d, "lineitem").where(F.col("l_suppkey").isin(1, 2, 3)).select("l_orderkey")
    return _t(spark, d, "orders").join(cited, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderdate")


@_register(
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderdate < TIMESTAMP '1997-01-01' AS old FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM o WHERE old),
m AS (SELECT o_custkey, max(n) AS last FROM r WHERE n % 3 > 0 GROUP BY 1)
SELECT o_orderkey, coalesce(last, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderdate, o_orderkey) AS revision_no FROM o LEFT JOIN m ON m.o_custkey = o.o_custkey WHERE NOT old"""
)
def j04_revision_numbers(spark: SparkSession, d: str) -> DataFrame:
    """New orders number on from the highest kept revision of their customer."""
    orders, early = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    kept = orders.where(early).withColumn("revision_no", F.row_number().over(order)).where("revision_no % 3 > 0")
    return catalog.next_numbers(orders.where(~early), kept, "o_custkey", "revision_no", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "revision_no")


@_register(
    """WITH a AS (SELECT o_custkey AS id, CASE WHEN o_custkey % 3 > 0 THEN min(o_clerk) ELSE '' END AS title, row_number() OVER (ORDER BY max(o_totalprice) DESC, o_custkey) - 1 AS rank FROM (SELECT *, CAST(o_orderkey % 10 AS VARCHAR) AS o_clerk FROM orders) GROUP BY o_custkey),
b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS title, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer),
x AS (SELECT *, 0 AS lst, 1.0 / (60 + rank) AS part FROM a WHERE rank < 200 UNION ALL SELECT *, 1, 0.5 / (60 + rank) FROM b WHERE rank < 300)
SELECT id, round(sum(part), 6) AS score, list_sort(list_distinct(list(lst))) AS origins, arg_min(title, lst) FILTER (title IS NOT NULL AND title <> '') AS title FROM x GROUP BY id"""
)
def j06_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists merged by id; titles from the first list that has one."""
    o, c = F.col("o_custkey"), F.col("c_custkey")
    a = _t(spark, d, "orders").groupBy(o.alias("id")).agg(F.min((F.col("o_orderkey") % 10).cast("string")).alias("t"), F.max("o_totalprice").alias("s"))
    a = a.select("id", F.when(F.col("id") % 3 > 0, F.col("t")).otherwise("").alias("title"), "s", F.lit(1).alias("one"))
    b = _t(spark, d, "customer").select(c.alias("id"), F.when(c % 5 > 0, F.col("c_name")).alias("title"), F.col("c_acctbal").alias("s"), F.lit(1).alias("one"))
    lists = [(retrieval.best_of_all(x, "s", "id", n), w) for x, n, w in ((a, 200, 1.0), (b, 300, 0.5))]
    found = retrieval.fuse(lists, [], "id", fill=["title"])
    return found.select("id", F.round("score", 6).alias("score"), "origins", "title")


@_register("SELECT md5(text) AS hash, doc_id, n_chars, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, md5(text) ORDER BY n_chars DESC, doc_id) = 1")
def j05_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each content hash within an owner; max_by keeps the sums partial."""
    rows = _t(spark, d, "documents").select(F.md5("text").alias("hash"), "doc_id", "n_chars", "source")
    best = rows.groupBy("source", "hash").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("m"))).alias("b"))
    return best.select("hash", (-F.col("b.m")).alias("doc_id"), F.col("b.n_chars").alias("n_chars"), "source")


@_register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus IN ('O') AND NOT coalesce(l_suppkey IN (1, 2, 3, 4, 5), FALSE) AND l_quantity = 7")
def f03_payload_filter(spark: SparkSession, d: str) -> DataFrame:
    """Must, must be among, must not be among; pushed down to the scan."""
    rows = _t(spark, d, "lineitem")
    return catalog.payload_filter(rows, {"l_returnflag": "N", "l_quantity": 7.0}, {"l_linestatus": ["O"], "l_shipdate": []}, {"l_suppkey": [1, 2, 3, 4, 5]}).select("l_orderkey", "l_linenumber")


@_register("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 60 OFFSET 20")
def l01_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of rows in a chosen order."""
    rows = catalog.optional_filter(_t(spark, d, "orders"), {"o_orderstatus": "O"})
    return catalog.page(rows, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 60, 20).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@_register("SELECT d.day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-18', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) e ON e.day = d.day")
def a09_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the last 14 days, zero where nothing is."""
    rows = _t(spark, d, "events").where("event_type = 'error'").select(F.to_date("ts").alias("day"))
    return catalog.zero_filled_days(rows, "day", "2024-01-31")


_PROV = "CASE WHEN event_type = 'purchase' THEN 'real' WHEN event_type IN ('view', 'click') THEN 'notional' ELSE 'free' END"


@_register(
    f"""SELECT CAST(ts AS DATE) AS day, event_type AS model, {_PROV} AS provider, count(*) AS requests, round(sum(value), 2) AS cost FROM events
GROUP BY GROUPING SETS ((), (day), (model), (provider), (day, model))"""
)
def a04_usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Usage by day, model, provider and in all, in one pass over grouping sets."""
    provider = F.when(F.col("event_type") == "purchase", "real").when(F.col("event_type").isin("view", "click"), "notional").otherwise("free")
    rows = _t(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("model"), provider.alias("provider"), "value")
    sets = [[], [F.col("day")], [F.col("model")], [F.col("provider")], [F.col("day"), F.col("model")]]
    return rows.groupingSets(sets, "day", "model", "provider").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 2).alias("cost"))


@_register("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def a08_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each key as columns."""
    rows = _t(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "error"]).agg(F.count(F.lit(1)))
    return rows.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "view", "error")])


@_register("SELECT event_type AS kind, count(*) AS n, round(quantile_disc(value, 0.5), 3) AS p50, round(max(value), 3) AS most FROM events WHERE value >= 0 GROUP BY 1")
def a14_durations(spark: SparkSession, d: str) -> DataFrame:
    """Lower medians and maxima of each kind."""
    return _t(spark, d, "events").where("value >= 0").groupBy(F.col("event_type").alias("kind")).agg(
        F.count("*").alias("n"), F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)"), 3).alias("p50"), F.round(F.max("value"), 3).alias("most")
    )


@_register("SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT c_mktsegment) AS segments, count(*) FILTER (c_acctbal < 0) AS negative FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def a12_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals, distinct members and conditional counts."""
    rows = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct("c_mktsegment").alias("segments"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))


@_register("WITH x AS (SELECT source, lang AS facet FROM documents UNION SELECT source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END FROM documents) SELECT source, string_agg(facet, ',' ORDER BY facet) AS facets FROM x GROUP BY 1")
def a11_facets(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct facet values of each owner."""
    rows = _t(spark, d, "documents").select("source", F.explode(F.array("lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))).alias("facet"))
    return rows.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("facet")), ",").alias("facets"))


@_register(
    """WITH t AS (SELECT conv_id, turn, role, left(replace(text, '?', ' '), 240) AS t FROM conversations), u AS (SELECT conv_id, list(t ORDER BY turn) AS l FROM t WHERE role = 'user' GROUP BY 1)
SELECT conv_id, CAST(least(len(l), 3) AS INTEGER) AS n, md5(array_to_string(l[greatest(len(l) - 2, 1):], chr(10))) AS digest FROM u"""
)
def w12_dialog_window(spark: SparkSession, d: str) -> DataFrame:
    """The last three user turns of each conversation, in order."""
    turns = _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.substring(F.translate("text", "?", " "), 1, 240).alias("t"))
    recent = turns.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 3")
    got = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("l"))
    return got.select("conv_id", F.size("l").alias("n"), F.md5(F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("digest"))


@_register("SELECT doc_id, substr(sha1(CAST(doc_id AS VARCHAR) || chr(10) || source), 1, 16) AS fp FROM documents")
def m06_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of sorted ids."""
    return _t(spark, d, "documents").select("doc_id", maths.fingerprint(F.array(F.col("source"), F.col("doc_id").cast("string"), F.lit(""))).alias("fp"))


@_register("SELECT doc_id, CAST(len(" + _TOKENS.format("text") + ") AS INTEGER) AS n_tokens FROM documents")
def t09_token_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of documents' token sets."""
    return _t(spark, d, "documents").select("doc_id", F.size(text.token_set(F.col("text"))).alias("n_tokens"))


@_register("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def u04_difference(spark: SparkSession, d: str) -> DataFrame:
    """Pairs not yet processed."""
    rows = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    done = rows.where("l_returnflag = 'A'").drop("l_returnflag")
    return rows.where("l_returnflag = 'R'").drop("l_returnflag").distinct().join(done, ["l_partkey", "l_suppkey"], "left_anti")
