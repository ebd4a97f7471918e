"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

The sketch (Dahlgaard, Knudsen and Thorup, 2017) has T coordinates. In round i
below T each element goes to the bin its i-th hash names; in round T + j all
elements go to bin j. A bin keeps the smallest value of the first round that
reached it. So every coordinate fills, expected work is O(n + T log T), and the
share of equal coordinates of two sketches is concentrated around the Jaccard
similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Scope
from ._bytes import mix, numbers, shingles, text_bytes, word_hashes, words
from ._components import components
from ._spark import Saved, scope, small_batches
from ._tokens import by_bytes

#: Coordinates, and bands of ROWS coordinates each. A pair of similarity 0.75
#: shares no band with probability (1 - 0.75**4)**32 = 5e-6.
T, ROWS = 128, 4
BANDS = T // ROWS

_U = np.uint64
_SEEDS = numbers(2 * T, 101)
_EDGES = np.arange(T + 1, dtype=np.uint64)[:T] << _U(57)
_BAND = numbers(T, 211) | _U(1)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The T coordinates of a set of 64-bit hashes (not empty). A coordinate is
    its bin (7 bits), round (8 bits) and value (49 bits) in one number."""
    n, done = len(elements), 0
    best = np.full(T, np.iinfo(np.uint64).max, dtype=np.uint64)
    missing = np.ones(T, dtype=bool)
    while missing.any():
        more = max(1, math.ceil(1.1 * T * math.log(T) / n)) if not done else max(1, done // 2)
        rounds = np.arange(done, min(2 * T, done + more))
        h = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        place = np.where(rounds[:, None] < T, h >> _U(57), (rounds[:, None] % T).astype(np.uint64))
        with np.errstate(over="ignore"):
            keys = np.sort(((place << _U(57)) | (rounds[:, None].astype(np.uint64) << _U(49)) | ((h << _U(7)) >> _U(15))).ravel())
        at = np.searchsorted(keys, _EDGES)
        found = keys[np.minimum(at, len(keys) - 1)]
        hit = missing & (at < len(keys)) & ((found >> _U(57)) == np.arange(T, dtype=np.uint64))
        best[hit] = found[hit]
        missing &= ~hit
        done += len(rounds)
    return best


def bands(coordinates: np.ndarray) -> np.ndarray:
    """A hash of each band of ROWS coordinates; bands differ by their place too."""
    with np.errstate(over="ignore"):
        return mix((mix(coordinates) * _BAND).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64))


def text_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow column."""
    data, offsets = text_bytes(column)
    starts, ends, first = words(data, offsets)
    hashed = word_hashes(data, starts, ends)
    for a, b in zip(first[:-1], first[1:]):
        yield shingles(hashed[a:b])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        sizes, keys, lists = [], [], []
        for s in text_sets(batch.column("text")):
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            lists.append(_signed(bands(sketch(s))) if len(s) else np.zeros(0, dtype=np.int64))
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
        banded = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), banded], ["id", "n", "key", "bands"])


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        found = list(text_sets(batch.column("text")))
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        flat = _signed(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "s"])


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _prefix_pairs(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (id, comp) of different components that may be similar
    enough, by prefix filtering: with shingles ordered from rare to frequent,
    similar sets share one of the first n - ceil(n * percent / 100) + 1, and what
    stands from the first shared one on must be enough for the overlap that the
    two sizes need; the smaller set of a pair needs an even shorter prefix. No
    similar pair is lost; pairs that only share what many documents have in
    common are left out. A shingle is met component against component, so
    members of one component never meet each other."""
    rows = sets.join(members, "id").select("id", "comp", F.size("s").alias("n"), F.explode("s").alias("h"))
    rows = Saved(rows, "near-residue").df
    often = rows.groupBy("h").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    rare_first = Window.partitionBy("id").orderBy("df", "h")
    ranked = rows.join(often, "h").withColumn("r", F.row_number().over(rare_first))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
    prefix = Saved(ranked.where((F.col("r") <= reach) & (F.col("lo") != F.col("hi"))).select("h", "id", "comp", "n", "r"), "near-prefixes").df
    # the smaller set of a pair must have enough left for two sets of its own size
    smaller = prefix.where((100 + percent) * (F.col("n") - F.col("r") + 1) >= 2 * percent * F.col("n"))
    # components meet first, by the best that any of their members could reach
    rest = lambda n, r: F.max(F.col(n) - F.col(r) + 1)
    mine = smaller.groupBy("h", "comp").agg(F.min("n").alias("n"), rest("n", "r").alias("left"))
    theirs = prefix.groupBy("h", F.col("comp").alias("cb")).agg(F.min("n").alias("nb"), F.max("n").alias("mb"), rest("n", "r").alias("lb"))
    may = (F.col("mb") >= F.col("n")) & ((100 + percent) * F.least("left", "lb") >= percent * (F.col("n") + F.greatest("n", "nb")))
    groups = Saved(mine.join(theirs, "h").where((F.col("comp") != F.col("cb")) & may).select("h", "comp", "cb", "nb", "mb", "lb"), "near-groups").df
    # then a member meets the component it may still reach
    met = smaller.withColumnRenamed("id", "a").join(groups.select(F.col("h").alias("gh"), F.col("comp").alias("gc"), "cb", "nb", "mb", "lb"), (F.col("h") == F.col("gh")) & (F.col("comp") == F.col("gc")) & (F.col("mb") >= F.col("n")) & ((100 + percent) * F.least(F.col("n") - F.col("r") + 1, F.col("lb")) >= percent * (F.col("n") + F.greatest("n", "nb"))))
    left = met.select("h", "cb", "a", "n", "r")
    right = prefix.select("h", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    rest = F.least(F.col("n") - F.col("r"), F.col("nb") - F.col("rb")) + 1
    enough = (100 + percent) * rest >= percent * (F.col("n") + F.col("nb"))
    ordered = (F.col("n") < F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("a") < F.col("b")))
    return left.join(right, ["h", "cb"]).where(ordered & enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id`` (the smallest id that
    can be reached over links, itself included) and ``kept``.

    Two documents are linked if their sets of five-word shingles have a Jaccard
    similarity of ``percent`` per cent or more. Documents with equal sets form
    a class, found by partial aggregation; only the class's smallest id goes
    on. Candidates share a band of their sketches. In each bucket all members
    are checked against the bucket's smallest id, and components are formed
    from the links found, so a bucket of many near copies gives as many pairs
    as it has members. Only buckets that then still have several components may
    hide more links: their members are compared by an exact prefix filter.
    Every candidate is checked on the whole sets.

    Null or empty text, and text without words, has no shingles: such rows are
    linked with nothing and kept. Rows with a null id can't be named: they keep
    their n_shingles, component_id is null, kept is true. Rows that repeat an
    id are one document with the links of all its texts; each row's n_shingles
    and class are those of its own text. Other columns are ignored; an empty table gives an empty result.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with scope() as tables:
        base, found = _classes(rows, percent, tables)
    out = base.select("id", "n", "key").join(found, F.col("key") == F.col("c_key"), "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _classes(rows: DataFrame, percent: int, tables: Scope) -> tuple[DataFrame, DataFrame]:
    """Saved: the rows (id, n, key, bands), and the component of each class
    (c_key, component_id) that isn't alone."""
    sketches = Saved(rows.mapInArrow(_sketched, "id long, n long, key binary, bands array<long>"), "near-sketches")
    base = tables.keep(sketches)
    named = base.where("id IS NOT NULL AND key IS NOT NULL")
    classes = Saved(named.groupBy("key").agg(F.min("id").alias("rep"), F.min("n").alias("n")), "near-classes").df
    reps = named.select(F.col("id").alias("r_id"), F.col("key").alias("r_key"), "bands").join(classes, (F.col("r_id") == F.col("rep")) & (F.col("r_key") == F.col("key")), "left_semi")
    banded = reps.join(classes.select("key", "n"), F.col("r_key") == F.col("key")).select(F.explode("bands").alias("k"), F.col("r_id").alias("id"), "n")
    banded = Saved(banded, "near-bands").df
    leads = banded.groupBy("k").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("k", F.col("lead.id").alias("a"), F.col("lead.n").alias("na"))
    shared = Saved(banded.join(leads, "k"), "near-shared").df  # rows of buckets with two members or more
    close = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    # texts meet the ids by a sort-merge join at any size, so that small runs show the plan of large ones
    asked = shared.select(F.col("id").alias("w")).distinct().hint("merge")
    texts = rows.where("id IS NOT NULL").join(asked, F.col("id") == F.col("w"), "left_semi")
    sets = Saved(texts.mapInArrow(_as_sets, "id long, s array<long>"), "near-sets").df
    pairs = shared.withColumnsRenamed({"id": "b", "n": "nb"}).where("a <> b").where(close).select("a", "b").distinct()
    links = Saved(_verified(sets, pairs, percent), "near-links").df
    labels = Saved(components(links), "near-labels").df

    # members of buckets that still have several components
    label = shared.select("k", "id").join(labels, F.col("id") == F.col("node"), "left").select("k", "id", F.coalesce("component", "id").alias("comp"))
    label = Saved(label, "near-members").df
    mixed = label.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("k")
    members = label.join(mixed, "k", "left_semi").select("id", "comp").distinct()
    rest = Saved(_prefix_pairs(sets, members, percent), "near-rest").df
    if rest.head(1):
        more = Saved(_verified(sets, rest, percent), "near-links").df
        labels = Saved(components(links.unionByName(more)), "near-labels").df

    found = classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("c_key"), F.least(F.coalesce("component", "rep"), "rep").alias("component_id"))
    return base, tables.keep(Saved(found, "near-components"))
