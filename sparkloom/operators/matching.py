"""One-to-one assignment, and pairs of goals for transfers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Saved, scope
from .inverted import similar_pairs

#: Fixed values of the transfer rule.
LEAST_SIMILARITY, COVERED, LEAST_GAP, MOST_PAIRS = 0.55, 5, 1, 60


def running(df: DataFrame, order: Sequence[Column], value: Column, out: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to its own in ``order``
    (which must tell all rows apart). Rows are dealt to ranges of the order;
    within a range a window sums, and the ranges' totals before it are added, so
    no task holds more than a range or the list of ranges."""
    ranged = Saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumn("_value", value), name).df
    own = Window.partitionBy("_range").orderBy(*order)
    totals = ranged.groupBy(F.col("_range").alias("_r")).agg(F.sum("_value").alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = totals.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    summed = ranged.withColumn("_own", F.sum("_value").over(own)).join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    return summed.withColumn(out, (F.col("_own") + F.col("_start")).cast("long")).drop("_range", "_r", "_value", "_own", "_start")


def running_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, name: str) -> DataFrame:
    """``running`` within each key: the sum over all rows in the order of (keys,
    order), less what it was before the key's first row. So a key's rows may
    span several tasks. Keys must not be null."""
    summed = running(df.withColumn("_w", value), [*[F.col(k).asc() for k in keys], *order], F.col("_w"), out, name)
    if not keys:
        return summed.drop("_w")
    summed = Saved(summed, name).df
    starts = summed.groupBy(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)]).agg(F.min(F.col(out) - F.col("_w")).alias("_before"))
    on = [F.col(k) == F.col(f"_s{i}") for i, k in enumerate(keys)]
    joined = summed.join(starts, on)
    return joined.withColumn(out, (F.col(out) - F.col("_before")).cast("long")).drop("_w", "_before", *[f"_s{i}" for i in range(len(keys))])


def with_mid_rank(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the mid-rank percentile of ``value`` among the rows of its
    keys (W04): values below and half of the ties, by the number of values; 0.5
    for null or where there is one value at most. From counts of distinct
    values, summed over ranges, so no task holds a key's values."""
    names = [f"_k{i}" for i in range(len(keys))]
    known = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("_v"))
    counts = known.groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    summed = running_within(counts, names, [F.col("_v")], F.col("_c"), "_upto", "ranks")
    whole = counts.groupBy(*[F.col(n).alias(f"{n}w") for n in names]).agg(F.sum("_c").alias("_all"))
    place = (F.col("_upto") - 0.5 * F.col("_c")) / F.col("_all")
    ranks = summed.join(F.broadcast(whole) if not keys else whole, [F.col(n) == F.col(f"{n}w") for n in names] or F.lit(True))
    ranks = ranks.select(*names, "_v", F.when(F.col("_all") > 1, place).otherwise(0.5).alias(out))
    on = [F.col(value) == F.col("_v"), *[F.col(k) == F.col(n) for k, n in zip(keys, names)]]
    return df.join(ranks, on, "left").drop("_v", *names).withColumn(out, F.coalesce(out, F.lit(0.5)))


def unique_matches(rows: DataFrame, partners: DataFrame, row_id: str, partner_id: str, row_order: Sequence[str], partner_order: Sequence[str], keys: Sequence[str], most: int | None = None) -> DataFrame:
    """(row_id, partner_id, tier): each row of ``rows`` with its partner, null
    for a row that gets none (J18).

    The rule: rows come in ``row_order`` (names, "-" before one that falls;
    nulls last, then by id; the first ``most`` only). A row wants
    the first partner in ``partner_order`` that has its first key, else its
    second, and so on (``keys`` stand in both tables; null matches nothing). It
    gets it if nobody came before it, else nothing. A row that finds no partner
    by any key takes the first one that is still free. ``tier`` is the number of
    the key from 1, or one more for a free one. Rows whose keys are all null
    take no part.

    Rounds instead of a row after the other: a partner goes to the free-takers
    if more of them come before its first wanter than there are partners ahead
    of it that they take. Counting all ahead as taken gives too many; the
    numbers from that too few; and so on, each time nearer, until they agree. A
    round is a running sum over ranges.
    """
    with scope() as tables:
        wanted = [F.col(k).isNotNull() for k in keys]
        some = wanted[0]
        for x in wanted[1:]:
            some = some | x
        ordered = rows.select(F.col(row_id).alias("row"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(f"o{i}") for i, c in enumerate(_plain(row_order))], some.alias("some"))
        by = [_turned(F.col(f"o{i}"), c) for i, c in enumerate(row_order)] + [F.col("row")]
        placed = running(ordered, by, F.lit(1), "place", "match-rows")
        placed = placed.where(F.col("place") <= most) if most is not None else placed
        placed = placed.where("some").select("row", "place", *[f"k{i}" for i in range(len(keys))])

        others = partners.select(F.col(partner_id).alias("partner"), *[F.col(k).alias(f"p{i}") for i, k in enumerate(keys)], *[c.alias(f"o{i}") for i, c in enumerate(_plain(partner_order))])
        by = [_turned(F.col(f"o{i}"), c) for i, c in enumerate(partner_order)] + [F.col("partner")]
        others = Saved(running(others, by, F.lit(1), "at", "match-partners"), "match-order").df
        found = placed
        for i in range(len(keys)):
            first = others.where(F.col(f"p{i}").isNotNull()).groupBy(f"p{i}").agg(F.min("at").alias(f"at{i}"))
            found = found.join(first, F.col(f"k{i}") == F.col(f"p{i}"), "left").drop(f"p{i}")
        want = F.coalesce(*[F.col(f"at{i}") for i in range(len(keys))])
        tier = F.coalesce(*[F.when(F.col(f"at{i}").isNotNull(), i + 1) for i in range(len(keys))], F.lit(len(keys) + 1))
        found = Saved(found.select("row", "place", want.alias("want"), tier.alias("tier")), "match-wants").df
        found = Saved(running(found, [F.col("place")], F.col("want").isNull().cast("long"), "free", "match-free"), "match-counted").df
        takers = found.where("want IS NULL").count()

        # how many free-takers come before the first that wants a partner
        first = found.where("want IS NOT NULL").groupBy("want").agg(F.min(F.struct("place", "free", "row")).alias("f"))
        state = others.select("partner", "at").join(first, F.col("at") == F.col("want"), "left").select("partner", "at", F.coalesce("f.free", F.lit(takers)).alias("before"), F.col("f.row").alias("wanter"))
        state = Saved(state.withColumn("taken", F.lit(True)).withColumn("sum", F.col("at")), "match-state").df
        while takers:
            ahead = F.col("sum") - F.col("taken").cast("long")
            summed = running(state.select("partner", "at", "before", "wanter", F.col("sum").alias("was"), (F.col("before") > ahead).alias("taken")), [F.col("at")], F.col("taken").cast("long"), "sum", "match-sums")
            state = Saved(summed, "match-state").df
            if not state.where("sum <> was").head(1):
                break
        free = state.where("taken").select("partner", F.col("sum").alias("number")) if takers else state.where("false").select("partner", F.col("sum").alias("number"))
        given = found.where("want IS NULL").join(free, F.col("free") == F.col("number"), "left").select("row", "partner", "tier")
        own = state.where("NOT taken" if takers else "true").where("wanter IS NOT NULL").select(F.col("wanter").alias("w"), "partner")
        kept = found.where("want IS NOT NULL").join(own, F.col("row") == F.col("w"), "left").select("row", "partner", "tier")
        whole = given.unionByName(kept)
        return tables.keep(Saved(whole.select(F.col("row").alias(row_id), F.col("partner").alias(partner_id), F.when(F.col("partner").isNotNull(), F.col("tier")).alias("tier")), "matches"))


def _plain(order: Sequence[str]) -> list[Column]:
    return [F.col(c.lstrip("-")) for c in order]


def _turned(x: Column, by: str) -> Column:
    return x.desc_nulls_last() if by.startswith("-") else x.asc_nulls_last()


def transfer_pairs(goals: DataFrame, id_col: str, vector_col: str, counts: DataFrame, least: float = LEAST_SIMILARITY, covered: int = COVERED, least_gap: int = LEAST_GAP, most: int = MOST_PAIRS) -> DataFrame:
    """(donor, recipient, similarity, coverage): pairs of goals near enough, of
    which one has more ideas than the other, which isn't yet covered (J13).

    ``counts``: (id, n), goals without a row have 0. The donor has more; a pair
    whose counts differ by less than ``least_gap``, or whose recipient has
    ``covered`` or more, is none. The ``most`` nearest pairs (0: all), ties by
    ids. ``coverage`` is the recipient's count as a share of ``covered``."""
    with scope() as tables:
        counts = Saved(counts, "transfer-counts").df
        n = lambda side: counts.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"))
        more = F.col("n_a") > F.col("n_b")
        side = lambda x, y: F.when(more, F.col(x)).otherwise(F.col(y))

        def gap(near: DataFrame) -> DataFrame:
            both = near.join(n("a"), "a", "left").join(n("b"), "b", "left").na.fill(0, ["n_a", "n_b"])
            both = both.select(side("a", "b").alias("donor"), side("b", "a").alias("recipient"), F.col("cos").alias("similarity"), F.greatest("n_a", "n_b").alias("gives"), F.least("n_a", "n_b").alias("has"))
            return both.where((F.col("has") < covered) & (F.col("gives") - F.col("has") >= least_gap) & (F.col("gives") > F.col("has")))

        gaps = similar_pairs(goals, id_col, vector_col, least, gap)
        gaps = gaps.orderBy(F.desc("similarity"), "donor", "recipient").limit(most) if most else gaps
        return tables.keep(Saved(gaps.select("donor", "recipient", "similarity", (F.col("has") / covered).alias("coverage")), "transfers"))
