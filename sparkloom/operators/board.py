"""Board operators: filters, queues, ledgers, evidence and reports over tables of ideas, jobs and usage."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrase_tokens
from ..tables import Saved
from .matching import running_within, with_mid_rank

# ---- filters


def text_search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows whose columns, joined by blanks and lower-cased, contain the query."""
    whole = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    return df.where(whole.contains(query.lower())) if query else df


def file_type(filename: Column) -> Column:
    """The lower-cased extension; "other" without one."""
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), "\\.([A-Za-z0-9]+)$", 1))
    return F.when(ext != "", ext).otherwise("other")


def document_filter(df: DataFrame, name: str, status: str, needle: str = "", wanted: str = "", kind: str = "") -> DataFrame:
    """Substring of the name, exact status, derived file type; empty arguments are off."""
    df = df.where(F.lower(F.col(name)).contains(needle.lower())) if needle else df
    df = df.where(F.col(status) == wanted) if wanted else df
    return df.where(file_type(F.col(name)) == kind) if kind else df


def stuck(df: DataFrame, status: str, states: list[str], updated: str, now: str, age_seconds: int, most: int) -> DataFrame:
    """The longest unchanged rows in one of the states, not changed for ``age_seconds``."""
    old = F.col(updated) <= F.to_timestamp(F.lit(now)) - F.make_interval(secs=F.lit(age_seconds))
    return df.where(F.col(status).isin(states) & old).orderBy(updated, *[c for c in df.columns[:1]]).limit(most)


def visible(df: DataFrame, owner: str, who: str, privileged: bool = False) -> DataFrame:
    """A reader's own rows; all rows for the privileged."""
    return df if privileged else df.where(F.col(owner) == who)


def usable(df: DataFrame, title: str, score: Column, deny: list[str], verbs: list[str]) -> DataFrame:
    """Rows with a score in [0, 1] whose title holds no denied words and begins with no listed verb."""
    low = F.lower(F.trim(F.col(title)))
    noise = reduce(Column.__or__, [low.contains(x) for x in deny] + [low.startswith(x + " ") for x in verbs], F.lit(False))
    return df.where(score.isNotNull() & ~F.isnan(score) & score.between(0, 1) & (low != "") & ~noise)


def keep_branches(json: Column, keys: list[str]) -> Column:
    """The named top branches of a JSON object; '{}' for anything else."""
    parsed = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_filter(parsed, lambda k, _: k.isin(keys)))


# ---- counts and roll-ups


def grouped_counts(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n): counts by each dimension in one pass over grouping
    sets, most frequent first (A01, A02, A03)."""
    sets = df.groupingSets([[F.col(c)] for c in dimensions], *[F.col(c) for c in dimensions])
    counted = sets.agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(dimensions)])
    pick = lambda f: reduce(lambda out, i: F.when(F.col(f"_g{i}") == 0, f(i)).otherwise(out), range(len(dimensions)), F.lit(None).cast("string"))
    return counted.select(pick(lambda i: F.lit(dimensions[i])).alias("dimension"), pick(lambda i: F.col(dimensions[i]).cast("string")).alias("value"), "n")


def queue_counts(df: DataFrame, primary: Column, needs_trl: Column, queues: list[str]) -> DataFrame:
    """One row: how many rows are in each queue; one row may be in several (A10)."""
    return df.agg(F.count("*").alias("all"), F.count_if(F.coalesce(needs_trl, F.lit(False))).alias("needs_trl"), *[F.count_if(F.coalesce(primary == q, F.lit(False))).alias(q) for q in queues])


def model_name(name: Column) -> Column:
    """A model's name without its date, its tier kept."""
    return F.regexp_replace(name, "^(.*)-[0-9]{8}(:[^:]*)?$", "$1$2")


def provider(name: Column, cost: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose text the name contains, else paid by the use or local."""
    low = F.lower(name)
    out = F.when((cost > 0) | low.contains("/"), "openrouter").otherwise("local")
    for text, label in reversed(rules):
        out = F.when(low.contains(text), label).otherwise(out)
    return out


def unit_cost(usage: DataFrame, item: str, operation: str, lifecycle: list[str], requests: str, cost: str) -> DataFrame:
    """(item, divisor, cost, per_unit): the cost by the largest request count of a lifecycle operation, at least 1."""
    per = usage.groupBy(item, operation).agg(F.sum(requests).alias("r"), F.sum(cost).alias("c"))
    return per.groupBy(item).agg(F.greatest(F.coalesce(F.max(F.when(F.col(operation).isin(lifecycle), F.col("r"))), F.lit(1)), F.lit(1)).cast("long").alias("divisor"), F.sum("c").alias("cost")).withColumn("per_unit", F.col("cost") / F.col("divisor"))


def histogram_quantile(buckets: DataFrame, keys: list[str], bound: str, count: str, q: float) -> DataFrame:
    """(keys, quantile): by linear interpolation inside the bucket where the
    cumulated count reaches the share ``q`` (A15). ``count`` isn't cumulative."""
    along = Window.partitionBy(*keys).orderBy(bound)
    whole = Window.partitionBy(*keys)
    run = buckets.withColumn("_cum", F.sum(count).over(along)).withColumn("_n", F.sum(count).over(whole)).withColumn("_low", F.coalesce(F.lag(bound).over(along), F.lit(0.0)))
    hit = run.where((F.col("_cum") >= q * F.col("_n")) & (F.col("_n") > 0) & (F.col(count) > 0))
    first = hit.groupBy(*keys).agg(F.min(F.struct(bound, "_cum", "_n", "_low", count)).alias("b"))
    b = lambda c: F.col(f"b.{c}")
    return first.select(*keys, (b("_low") + (b(bound) - b("_low")) * (q * b("_n") - (b("_cum") - b(count))) / b(count)).alias("quantile"))


def representative(df: DataFrame, key: str, text: str, prose: Column, index: Column) -> DataFrame:
    """(key, text): prose first, then the lowest index."""
    return df.groupBy(key).agg(F.max_by(text, F.struct(prose.cast("int"), -index)).alias(text))


def keyword_frequency(clusters: DataFrame, cluster: str, words: str) -> DataFrame:
    """(keyword, clusters, share): in how many clusters a normalised keyword stands."""
    total = clusters.agg(F.countDistinct(cluster).alias("_t"))
    each = clusters.select(cluster, F.explode(words).alias("k")).select(cluster, F.lower(F.trim("k")).alias("keyword")).where("keyword <> ''").distinct()
    return each.groupBy("keyword").agg(F.count("*").alias("clusters")).join(F.broadcast(total)).select("keyword", "clusters", (F.col("clusters") / F.col("_t")).alias("share"))


def phrases(words: Column, sizes: tuple[int, ...] = (4, 3, 2)) -> Column:
    """All word n-grams with at least two distinct words, as (size, place, phrase)."""
    parts = []
    for n in sizes:
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), _fits(words, n))
        parts.append(F.transform(at, _gram(words, n)))
    return F.concat(*parts)


def _fits(words: Column, n: int):
    return lambda i: (F.size(words) >= i + n) & (F.size(F.array_distinct(F.slice(words, i + 1, n))) >= 2)


def _gram(words: Column, n: int):
    return lambda i: F.struct(F.lit(n).alias("size"), i.alias("at"), F.array_join(F.slice(words, i + 1, n), " ").alias("phrase"))


def top_phrases(df: DataFrame, key: str, text: Column, order: Column, most: int = 8) -> DataFrame:
    """(key, phrase, n, rank): the most frequent phrases of each key's texts,
    among equals the longer first, then that which stands first, texts by
    ``order`` (A21). Phrases don't reach from one row into the next.

    The words are bound by a lambda, so a text is split once and not again for
    each phrase; counts are summed in the tasks before the shuffle."""
    grams = F.flatten(F.transform(F.array(phrase_tokens(text)), lambda words: phrases(words)))
    each = df.select(key, order.alias("o"), F.explode(grams).alias("g")).groupBy(key, "g.phrase", "g.size").agg(F.count("*").alias("n"), F.min(F.struct("o", "g.at")).alias("first"))
    first = Window.partitionBy(key).orderBy(F.desc("n"), F.desc("size"), "first")
    return each.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).select(key, "phrase", "n", "rank")


def freshness(df: DataFrame, key: str, year: str, now: int, window: int = 5) -> DataFrame:
    """(key, freshness): 0.6 of the mean recency in the window and 0.4 of the
    share of this year and the last (A22); years that are missing, not positive
    or to come don't count, and a key without any has no row."""
    y = F.col(year)
    known = df.where((y > 0) & (y <= now))
    recency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - (now - window)) / F.lit(float(window))))
    return known.groupBy(key).agg((0.6 * F.avg(recency) + 0.4 * F.avg(F.when(y >= now - 1, 1.0).otherwise(0.0))).alias("freshness"))


def metric_gate(df: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    """(metric, mean, n, passed): means of what isn't null against floors; no value at all fails."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x"), F.lit(float(f)).alias("floor")) for m, f in floors.items()])).alias("m")).select("m.*")
    got = long.groupBy("metric").agg(F.avg("x").alias("mean"), F.count("x").alias("n"), F.max("floor").alias("floor"))
    return got.select("metric", "mean", "n", F.coalesce(F.col("mean") >= F.col("floor"), F.lit(False)).alias("passed"))


def latency_points(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, p50, p95, mean): the values at places n // 2 and int(0.95 n) of the
    order from 0 (A24), for keys that aren't null. Places are found by running
    sums of the counts of distinct values over ranges, so no task holds a key's
    values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    run = running_within(counts.where(F.col(key).isNotNull()), [key], [F.col(value)], F.col("c"), "_cum", "points")
    sizes = counts.groupBy(key).agg(F.sum("c").alias("_n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"))
    at = run.join(sizes, key)
    point = lambda p: F.min(F.when(F.col("_cum") > p, F.col(value)))
    p50, p95 = F.floor(F.col("_n") / 2), F.least(F.col("_n") - 1, F.floor(F.col("_n") * 0.95))
    return at.groupBy(key).agg(point(p50).alias("p50"), point(p95).alias("p95"), F.max("mean").alias("mean"))


def pair_separation(df: DataFrame, key: str, good: Column, score: str) -> DataFrame:
    """(key, separation): the share of (good, bad) pairs in which the good one
    scores higher (A25), from counts of distinct scores, without any pair."""
    counts = df.groupBy(key, F.col(score).alias("s")).agg(F.count_if(good).alias("g"), F.count_if(~good).alias("b"))
    below = Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    run = counts.withColumn("lower", F.coalesce(F.sum("b").over(below), F.lit(0)))
    sums = run.groupBy(key).agg(F.sum(F.col("g") * F.col("lower")).alias("won"), F.sum("g").alias("g"), F.sum("b").alias("b"))
    return sums.where("g > 0 AND b > 0").select(key, (F.col("won") / (F.col("g") * F.col("b"))).alias("separation"))


# ---- windows, order, selection


def select_evidence(hits: DataFrame, item: str, article: str, chunk: str, overlap: str, score: str, articles: int = 6, chunks: int = 2) -> DataFrame:
    """(item, article, chunk, place): chunks by overlap, then score, each once; at
    most two chunks of at most six articles, in the articles' order of appearance (W06)."""
    order = [F.desc(overlap), F.desc(score), F.col(chunk)]
    once = hits.withColumn("_d", F.row_number().over(Window.partitionBy(item, chunk).orderBy(*order))).where("_d = 1")
    walked = once.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(*order)))
    nth = walked.withColumn("_n", F.row_number().over(Window.partitionBy(item, article).orderBy("_r"))).where(F.col("_n") <= chunks)
    led = nth.withColumn("_lead", F.min("_r").over(Window.partitionBy(item, article)))
    ranked = led.withColumn("_a", F.dense_rank().over(Window.partitionBy(item).orderBy("_lead"))).where(F.col("_a") <= articles)
    return ranked.select(item, article, chunk, F.row_number().over(Window.partitionBy(item).orderBy("_a", "_n")).alias("place"))


def round_robin(clusters: DataFrame, label: str, size: str, members: str, passes: int = 2, most: int = 15) -> DataFrame:
    """(place, label, member): in pass p each cluster gives its p-th member,
    larger clusters first; members once (W07)."""
    each = clusters.select(label, size, F.posexplode(F.slice(members, 1, passes)).alias("p", "member"))
    keyed = each.withColumn("_k", F.lower(F.trim(F.col("member").cast("string"))))
    order = ["p", F.desc(size), label]
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_r = 1")
    top = first.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", label, "member")


def earlier_duplicate(df: DataFrame, id_col: str, key: Column, open_: Column) -> DataFrame:
    """``df`` of open rows with ``duplicate_of``: the smallest open id with the same key, null for itself."""
    rows = df.where(open_).withColumn("_k", key)
    first = rows.groupBy("_k").agg(F.min(id_col).alias("_first"))
    joined = rows.join(first, "_k")
    return joined.withColumn("duplicate_of", F.when(F.col("_first") < F.col(id_col), F.col("_first"))).drop("_k", "_first")


def carry_forward(marks: DataFrame, key: str, place: str, heading: Column) -> DataFrame:
    """``marks`` with ``section``: the last heading at or before each place."""
    return marks.withColumn("section", F.last(heading, ignorenulls=True).over(Window.partitionBy(key).orderBy(place)))


def changed_batch(current: DataFrame, known: DataFrame, key: str, signature: str, order: list[Column], most: int = 8) -> DataFrame:
    """The first rows in order whose signature isn't the known one."""
    before = known.select(F.col(key).alias("_key"), F.col(signature).alias("_sig"))
    return current.join(before, (F.col(key) == F.col("_key")) & (F.col(signature) == F.col("_sig")), "left_anti").orderBy(*order).limit(most)


def rerank(hits: DataFrame, keys: list[str], score: Column, rank: str, usable_: Column | None = None) -> DataFrame:
    """``hits`` with ``new_rank``: by score, stable in the earlier rank; queries
    with an unusable score keep the earlier order (L04)."""
    good = score.isNotNull() if usable_ is None else usable_ & score.isNotNull()
    whole = F.bool_and(good).over(Window.partitionBy(*keys))
    key = F.when(whole, score)
    marked = hits.withColumn("_s", key)
    return marked.withColumn("new_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_s"), rank)) - 1).drop("_s")


def merge_pool(pool: DataFrame, new: DataFrame, keys: list[str], id_col: str, rank: str, most: int = 12) -> DataFrame:
    """The pool, then new hits in order, each once, at most ``most``."""
    both = pool.select(*keys, id_col, F.lit(0).alias("_l"), rank).unionByName(new.select(*keys, id_col, F.lit(1).alias("_l"), rank))
    first = both.groupBy(*keys, id_col).agg(F.min(F.struct("_l", rank)).alias("_p"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_p", id_col))
    return first.withColumn("place", place).where(F.col("place") <= most).drop("_p")


def cluster_order(members: DataFrame, cluster: str, member: str, signals: int = 8, leads: int = 5) -> DataFrame:
    """(cluster, size, first, leads), largest clusters first, with their first members in order."""
    walk = Window.partitionBy(cluster).orderBy(member)
    sizes = members.groupBy(cluster).agg(F.count("*").alias("size"))
    first = members.withColumn("_r", F.row_number().over(walk)).where(F.col("_r") <= signals).groupBy(cluster).agg(F.array_sort(F.collect_list(member)).alias("first"))
    return sizes.join(first, cluster).withColumn("leads", F.slice("first", 1, leads)).orderBy(F.desc("size"), cluster)


def fallback_sources(df: DataFrame, overlap: str, keyword: str, label: str, docs: str, name: str, floor: int = 5) -> DataFrame:
    """``df`` with ``score``, best first; only those over ``floor`` if there are any."""
    score = 10 * F.col(overlap) + 8 * F.col(keyword) + 2 * F.col(label) + F.least(F.col(docs), F.lit(5))
    scored = df.withColumn("score", score)
    best = scored.agg((F.max("score") > floor).alias("_any"))
    return scored.join(F.broadcast(best)).where(~F.col("_any") | (F.col("score") > floor)).drop("_any").orderBy(F.desc("score"), name)


def adaptive_k(tokens: Column, base: int = 5, high: int = 12) -> Column:
    """More hits for shorter questions."""
    n = F.size(F.array_distinct(tokens))
    return F.when(n <= 4, high).when(n <= 8, (base + high) // 2).otherwise(base)


def distinct_ignoring_case(values: Column) -> Column:
    """Values once whatever their case; the first spelling stays."""
    low = F.transform(values, lambda x: F.lower(x))
    return F.filter(F.transform(values, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct values; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


# ---- joins of the board


def property_transfers(edges: DataFrame, most: int = 12) -> DataFrame:
    """(process, property, kpi): processes that affect a property which supports a
    KPI in another row; each triple once, the first ``most`` in edge order (J12).
    ``edges``: (id, item, relation, source, target)."""
    compact = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    a = edges.where("relation = 'affects_property'").select(F.col("id").alias("ia"), F.col("item").alias("xa"), F.col("source").alias("process"), F.col("target").alias("property"), compact(F.col("target")).alias("k"))
    b = edges.where("relation = 'supports_kpi'").select(F.col("id").alias("ib"), F.col("item").alias("xb"), compact(F.col("source")).alias("k"), F.col("target").alias("kpi"))
    # of a side's rows that differ only in their item, the first two items are enough to find the first pair of two items
    a = _two_items(a, ["k", F.lower("process").alias("low")], "ia", "xa")
    b = _two_items(b, ["k", F.lower("kpi").alias("low")], "ib", "xb")
    both = a.join(b, "k").where("xa <> xb")
    key = [F.lower("process"), F.col("k"), F.lower("kpi")]
    first = both.groupBy(*[x.alias(f"g{i}") for i, x in enumerate(key)]).agg(F.min(F.struct("ia", "ib", "process", "property", "kpi")).alias("m"))
    return first.orderBy("m.ia", "m.ib").limit(most).select("m.process", "m.property", "m.kpi")


def _two_items(side: DataFrame, keys: list, number: str, item: str) -> DataFrame:
    """Of each key the rows of the two items that come first, the first row of each."""
    rest = [c for c in side.columns if c not in ("k", number, item)]
    per = side.groupBy(*keys, item).agg(F.min(F.struct(number, *rest)).alias("m"))
    order = Window.partitionBy("k", "low").orderBy("m")
    return per.withColumn("_n", F.row_number().over(order)).where("_n <= 2").select("k", item, "m.*")


def evidence_graph(evidence: DataFrame, item: str, doc: Column, filename: Column) -> DataFrame:
    """(node, degree): documents by id, else by file name, with the number of citing edges."""
    node = F.when(F.coalesce(doc, F.lit("")) != "", doc).when(F.coalesce(filename, F.lit("")) != "", F.concat(F.lit("file:"), filename))
    return evidence.withColumn("node", node).where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("degree"), F.countDistinct(item).alias("items"))


def reuse_labels(new: DataFrame, old: DataFrame, generic: list[str], stability: float = 0.9) -> DataFrame:
    """(cluster, label): the label of equal fingerprint, else of the previous
    cluster where it is stable and its label isn't generic (J17).
    ``new``: (cluster, fingerprint, previous, jaccard); ``old``: (previous, fingerprint, label)."""
    same = old.groupBy("fingerprint").agg(F.min("label").alias("by_print"))
    by = old.select("previous", F.col("label").alias("by_line"))
    found = new.join(same, "fingerprint", "left").join(by, "previous", "left")
    line = F.when((F.col("jaccard") >= stability) & ~F.lower("by_line").isin(generic), F.col("by_line"))
    return found.select("cluster", F.coalesce("by_print", line).alias("label"))


def expand_summaries(hits: DataFrame, keys: list[str], chunk: str, members: str, rank: str, score: str) -> DataFrame:
    """(keys, chunk, summary, score, place): a summary's members stand in its place
    and inherit its score; other hits stay, without a summary; of a chunk that
    comes up twice the first place counts (J16). ``members``: an array, null or
    empty for plain hits."""
    member = F.transform(members, lambda m: F.struct(m.alias("chunk"), F.col(chunk).alias("summary")))
    plain = F.array(F.struct(F.col(chunk).alias("chunk"), F.lit(None).alias("summary")))
    each = hits.select(*keys, rank, score, F.posexplode(F.when(F.size(members) > 0, member).otherwise(plain)).alias("_p", "_leaf"))
    first = each.groupBy(*keys, F.col("_leaf.chunk").alias("_chunk")).agg(F.min(F.struct(rank, "_p", score, F.col("_leaf.summary").alias("summary"))).alias("_f"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(f"_f.{rank}"), F.col("_f._p")))
    return first.select(*keys, F.col("_chunk").alias(chunk), "_f.summary", F.col(f"_f.{score}").alias(score), place.alias("place"))


def document_chunks(chunks: DataFrame, document: str, wanted: str, index: str, owner: str = "", who: str = "") -> DataFrame:
    """One document's chunks by index; ``who`` also pins the owner, empty reads
    all (R07). Both conditions reach the scan."""
    rows = chunks.where(F.col(document) == wanted)
    return (rows.where(F.col(owner) == who) if who else rows).orderBy(index)


def shift_status(items: DataFrame, parents: DataFrame, key: str, status: str, action: str) -> DataFrame:
    """``items`` with ``new_status`` after their parents' actions: archive puts away
    what is open, activate brings archived ones back (D18)."""
    joined = items.join(parents.select(key, action), key, "left")
    new = F.when((F.col(action) == "archive") & F.col(status).isin("draft", "generated", "under_review"), "archived").when((F.col(action) == "activate") & (F.col(status) == "archived"), "generated")
    return joined.withColumn("new_status", F.coalesce(new, F.col(status))).drop(action)


def chain_edges(df: DataFrame, item: str, steps: list[tuple[str, str]]) -> DataFrame:
    """(item, from_type, from_name, to_type, to_name): edges along the steps that
    aren't blank, blanks skipped (D19). ``steps``: (type, column) in order."""
    nodes = F.filter(F.array(*[F.struct(F.lit(t).alias("t"), F.trim(F.col(c).cast("string")).alias("n")) for t, c in steps]), lambda x: F.coalesce(x["n"], F.lit("")) != "")
    pairs = F.when(F.size(nodes) >= 2, F.transform(F.sequence(F.lit(1), F.size(nodes) - 1), lambda i: F.struct(F.get(nodes, i - 1).alias("a"), F.get(nodes, i).alias("b"))))
    return df.select(item, F.explode(pairs).alias("e")).select(item, F.col("e.a.t").alias("from_type"), F.col("e.a.n").alias("from_name"), F.col("e.b.t").alias("to_type"), F.col("e.b.n").alias("to_name"))


def active_jobs(jobs: DataFrame, status: str, heartbeat: Column, now: Column, seconds: int = 75) -> DataFrame:
    """Queued jobs, and running ones with a heartbeat not older than ``seconds``."""
    at = lambda t: t.cast("timestamp").cast("double")
    fresh = (at(now) - at(heartbeat)) <= seconds
    return jobs.where((F.col(status) == "queued") | ((F.col(status) == "running") & fresh))


# ---- ITC index


def itc_index(docs: DataFrame, cluster: str, year: str, citations: str, org: str, distance: DataFrame) -> DataFrame:
    """(cluster, sm, nv, ip, hr, tech_score, band) from documents and the clusters'
    distance from the corpus (D13). ``distance``: (cluster, nv).

    Recency is a year's place between the first and the last of all documents;
    documents without a year have none, and a cluster without years, or a corpus
    of one year, no momentum (percentile 0.5). Percentiles come from counts of
    distinct values."""
    y = F.col(year)
    span = docs.agg(F.min(y).alias("y0"), F.max(y).alias("y1"))
    recency = F.when(F.col("y1") > F.col("y0"), (y - F.col("y0")) / (F.col("y1") - F.col("y0")))
    late = F.when(y.isNotNull(), F.when(y >= F.col("y1") - 2, 1.0).otherwise(0.0))
    per = docs.join(F.broadcast(span)).groupBy(cluster).agg(F.count("*").alias("n"), F.countDistinct(org).alias("orgs"), F.avg(recency).alias("r"), F.avg(late).alias("late"), (F.sum(citations) / F.count("*")).alias("ip"))
    most = per.agg(F.max("n").alias("mn"), F.max("orgs").alias("mo"))
    raw = per.join(F.broadcast(most)).join(distance, cluster, "left").select(cluster, (0.6 * F.col("r") + 0.4 * F.col("late")).alias("sm"), F.col("nv"), F.coalesce("ip", F.lit(0.0)).alias("ip"), (0.7 * F.col("n") / F.col("mn") + 0.3 * F.col("orgs") / F.greatest(F.col("mo"), F.lit(1))).alias("hr"))
    raw = Saved(raw, "itc").df
    for c in ("sm", "nv", "ip", "hr"):
        raw = with_mid_rank(raw, c, f"p_{c}")
    score = 0.40 * F.col("p_sm") + 0.25 * F.col("p_nv") + 0.20 * F.col("p_ip") + 0.15 * F.col("p_hr")
    g = F.pow("p_sm", F.lit(0.6)) * F.pow("p_nv", F.lit(0.4))
    band = F.least(F.greatest(F.bround(1 + 9 * g * (0.8 + 0.1 * (F.col("p_ip") + F.col("p_hr")))), F.lit(1.0)), F.lit(10.0)).cast("int")
    return raw.select(cluster, F.round("p_sm", 6).alias("sm"), F.round("p_nv", 6).alias("nv"), F.round("p_ip", 6).alias("ip"), F.round("p_hr", 6).alias("hr"), F.round(score, 6).alias("tech_score"), band.alias("band"))

# ---- suggestions, codes and lift


def distinct_suggestions(df: DataFrame, keys: list[str], title: str, metric: str, order: Column, most: int = 10) -> DataFrame:
    """``df`` without suggestions that repeat an earlier title and metric, in any
    case and with any blanks, or have no title; at most ``most`` of each key (T22)."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\\s+", " "))
    low = F.concat(F.lower(flat(title)), F.when(flat(metric) != "", F.concat(F.lit("|"), F.lower(flat(metric)))).otherwise(""))
    named = df.where(flat(title) != "").withColumns({title: flat(title), metric: flat(metric), "_key": low, "_order": order})
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_key").orderBy("_order"))).where("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))).where(F.col("_n") <= most).drop("_n", "_key", "_order")


def known_codes(picked: DataFrame, item: str, code: str, place: Column, taxonomy: DataFrame, most: int = 3) -> DataFrame:
    """(item, code, name, place): the first ``most`` distinct codes of each item
    that the taxonomy (code, name) has, with its names (T23)."""
    index = taxonomy.select(F.col("code").alias("_c"), "name").dropDuplicates(["_c"])
    first = picked.select(item, F.trim(code).alias("code"), place.alias("_p")).groupBy(item, "code").agg(F.min("_p").alias("_p"))
    found = first.join(index, F.col("code") == F.col("_c"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(item).orderBy("_p", "code"))).where(F.col("place") <= most).select(item, "code", "name", "place")


def discovery_lift(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: how bridges compare with clusters (A26): the share of each that
    cites two documents or more, the share of bridges that cite both themes, the
    mean novelty of each and the difference; null where there is nothing to
    take a mean of. ``items``: (item, kind "bridge" or "cluster", novelty);
    ``evidence``: (item, document, relation)."""
    said = evidence.groupBy("item").agg(F.countDistinct(F.nullif("document", F.lit(""))).alias("docs"), F.bool_or(F.lower("relation") == "theme_a").alias("a"), F.bool_or(F.lower("relation") == "theme_b").alias("b"))
    rows = items.join(said, "item", "left").select("kind", "novelty", (F.coalesce("docs", F.lit(0)) >= 2).cast("double").alias("cross"), F.coalesce(F.col("a") & F.col("b"), F.lit(False)).cast("double").alias("span"))
    of = lambda kind, c: F.avg(F.when(F.col("kind") == kind, F.col(c)))
    r = lambda x: F.round(x, 3)
    found = rows.agg(F.count_if(F.col("kind") == "bridge").alias("bridges"), F.count_if(F.col("kind") == "cluster").alias("clusters"), r(of("bridge", "cross")).alias("bridge_cross"), r(of("cluster", "cross")).alias("cluster_cross"), r(of("bridge", "span")).alias("bridge_span"), r(of("bridge", "novelty")).alias("bridge_novelty"), r(of("cluster", "novelty")).alias("cluster_novelty"))
    return found.withColumn("novelty_delta", r(F.col("bridge_novelty") - F.col("cluster_novelty")))


def usable_points(points: DataFrame, document: str, vector: str, owner: str | None = None, wanted: str = "") -> DataFrame:
    """Points of one owner ("" for all) that have a document and a vector of
    finite components (S21)."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    named = F.coalesce(F.col(document).cast("string"), F.lit("")) != ""
    found = points.where(named & v.isNotNull() & (F.size(v) > 0) & finite)
    return found.where(F.col(owner) == wanted) if owner and wanted else found
