"""Queries of readers, writers, chunking and counters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks
from ..sources import delimited, exports
from ..streaming import counters, stateful
from .queries import _register, _t


def _nation_file(spark: SparkSession, d: str) -> DataFrame:
    """All nations of a region as one text with semicolons, a comma in each name."""
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat(F.col("n_name"), F.lit(", of|it")), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.repeat(F.lit("z"), 300)))
    per = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("ls"))
    return per.select("n_regionkey", F.concat(F.lit("Id;Name;id\n\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("text"))


@_register("SELECT n_regionkey, ';' AS delimiter, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS row, ['Id', 'Name', 'id_2'] AS headers, CAST(n_nationkey AS VARCHAR) AS first FROM nation")
def s03_delimited_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = delimited.delimited_rows(_nation_file(spark, d), "n_regionkey", "text", F.lit("dir/my nations.csv"), F.lit("text/plain"))
    return rows.select("n_regionkey", "delimiter", "row", "headers", F.get("cells", F.lit(0)).alias("first"))


@_register(
    """WITH r AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS row, n_name || ', of/it' AS name FROM nation)
    SELECT n_regionkey, row, ['source_uri=my%20nations.csv#rows=' || row || '&columns=Id&columns=Name' || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '&columns=id_2' END || ' | row=' || row || ' | Id=' || n_nationkey || ' | Name=' || name || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE ' | id_2=' || repeat('z', 256) || '...' END] AS lines FROM r"""
)
def s05_row_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = delimited.delimited_rows(_nation_file(spark, d), "n_regionkey", "text", F.lit("dir/my nations.csv"), F.lit("text/plain"))
    return delimited.row_lines(rows).select("n_regionkey", "row", "lines")


@_register("SELECT p_partkey || ';' || CASE WHEN p_partkey % 3 = 0 THEN '\"a;\"\"b\"\"\"' ELSE p_name END || ';' || CAST(floor(p_size / 50.0 * 100 + 0.5) AS BIGINT) AS line FROM part")
def k05_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, 'a;"b"').otherwise(F.col("p_name")).alias("name"), (F.col("p_size") / 50.0).alias("score"))
    return exports.csv_lines(rows, ["p_partkey", "name", "score"], ("score",))


@_register("SELECT event_id, '{\"event_id\":' || event_id || ',\"p\":' || CAST(CAST(value AS INTEGER) AS VARCHAR) || '}' AS item FROM events WHERE value > 90")
def k06_json_items(spark: SparkSession, d: str) -> DataFrame:
    return exports.json_items(_t(spark, d, "events").where("value > 90").select("event_id", F.bround("value", 0).cast("int").alias("p")), "event_id", "p")


@_register("SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(k * 400 AS INTEGER) AS start, substr(text, k * 400 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 101, 0)) // 400 + 1)) AS k FROM documents WHERE length(text) > 0)")
def t04_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.fixed_chunks(_t(spark, d, "documents"), "doc_id", F.col("text"), 500, 100)


@_register()
def t01_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of about 1000 letters of all documents."""
    return chunks.chunk_texts(_t(spark, d, "documents"), "doc_id", "text")


@_register("WITH l AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS u, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS v FROM documents) SELECT source, doc_id FROM l WHERE u <= 8 OR v <= 8")
def g15_edge_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.edges_of(_t(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@_register("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (value IS NOT NULL) AS value FROM (SELECT user_id, event_id, event_type, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events) GROUP BY 1")
def x03_latest_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    return counters.latest_status(rows, "user_id", "event_type", F.col("event_id"), "value")


@_register(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS last_until, count(*) AS n FROM g GROUP BY user_id, run"""
)
def x05_living_counts(spark: SparkSession, d: str) -> DataFrame:
    return counters.living_counts(_t(spark, d, "events"), "ts", ["user_id"], "6 hours")


@_register(
    """WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS f, event_type = 'purchase' AS r FROM events WHERE event_type IN ('error', 'purchase')),
    n AS (SELECT *, CASE WHEN coalesce(epoch(ts) - epoch(lag(ts) OVER w) > 864000, false) OR r OR coalesce(lag(r) OVER w, false) THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n)
    SELECT user_id, event_id, ts + INTERVAL 900 SECOND AS locked_until FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM g WHERE f) WHERE k % 2 = 0"""
)
def x06_lockouts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return counters.lockouts(_t(spark, d, "events"), "user_id", "ts", "event_id", kind == "error", kind == "purchase", 2, 864000, 900)


def _events_in_order(spark: SparkSession, d: str) -> DataFrame:
    return counters.events_stream(spark, d, "events.parquet")


@_register(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s),
    c AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS last_until, count(*) AS n FROM g GROUP BY user_id, run)
    SELECT c.* FROM c, (SELECT max(ts) AS m FROM events) WHERE epoch_ms(last_until) < epoch_ms(m) - 1000"""
)
def x05_living_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counters that have ended, from state with timers, over the events as a stream."""
    found = counters.run_available(stateful.living_counts(_events_in_order(spark, d), "ts", ["user_id"], 21600, "event_id", "1 second"), ["user_id"], "append")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last_until")})


@_register(None)
def x06_throttle_stream(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each attempt: errors are failures, purchases successes."""
    kind = F.col("event_type")
    events = _events_in_order(spark, d).where(kind.isin("error", "purchase"))
    return counters.run_available(stateful.throttled(events, "ts", ["user_id"], "event_id", kind == "purchase", 3, 864000, 86400, "1 second"), ["user_id"], "append")


_X09_SQL = """WITH e AS (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) % 3 AS value FROM events),
    c AS (SELECT * FROM (SELECT *, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS was FROM e) WHERE value <> was),
    s AS (SELECT *, ts + INTERVAL 12 HOUR AS fired_at FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, (SELECT max(ts) FROM e) AS m FROM c) WHERE value > 0 AND ts + INTERVAL 12 HOUR <= coalesce(nxt, m)),
    f AS (SELECT user_id, value, fired_at, m FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM s) WHERE last IS NULL OR last <> value)
    SELECT user_id, value, fired_at FROM f"""


@_register(_X09_SQL)
def x09_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Values that stood for half a day, once each."""
    return counters.decided(_t(spark, d, "events"), "user_id", "ts", "event_id", F.floor("value") % 3, 43200)


@_register(_X09_SQL + " WHERE epoch_ms(fired_at) < epoch_ms(m) - 1000")
def x09_trigger_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from state with timers, over the events as a stream."""
    found = stateful.debounced(_events_in_order(spark, d), "ts", ["user_id"], "event_id", F.floor("value") % 3, 43200, "1 second")
    return counters.run_available(found, ["user_id"], "append").withColumn("fired_at", F.col("fired_at").cast("timestamp_ntz"))


@_register("SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS requests, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def x07_per_minute(spark: SparkSession, d: str) -> DataFrame:
    return counters.per_minute(_t(spark, d, "events"), "ts", ["event_type"], "value").withColumn("total", F.round("total", 6))


@_register("SELECT event_type, strftime(ts, '%Y%m%d') AS day, count(*) AS requests, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def x08_daily_flush(spark: SparkSession, d: str) -> DataFrame:
    """The daily totals kept by a stream over the events' files."""
    stream = counters.per_day(counters.events_stream(spark, d, "events.parquet"), "ts", ["event_type"], "value")
    return counters.run_available(stream, ["event_type", "day"]).withColumn("total", F.round("total", 6))


@_register("SELECT DISTINCT user_id, event_type FROM events")
def x12_first_of_each(spark: SparkSession, d: str) -> DataFrame:
    return counters.first_of_each(_t(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])
