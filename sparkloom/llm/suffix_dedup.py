"""Removal of repeated byte strings, by bucket-pointer refinement over suffixes
that a first pass leaves in question.

Every string of LENGTH bytes names one of its grams of GRAM bytes as its
anchor: the one with the smallest hash, the leftmost of equal ones. Equal
strings name the same place in them, so only suffixes near anchors whose gram
occurs again can be repeated. An anchor answers for a run of strings that name
it; the run's whole text is its context.

1. Anchor grams that occur twice or more: counted by partial aggregation.
2. Anchors with such grams (semi-join) are grouped by gram and context. Of
   equal contexts all but the earliest are repeated as a whole.
3. Earliest contexts that share a gram but differ are sorted as suffixes by
   bucket-pointer refinement to a depth of LENGTH: buckets of the first 25
   bytes are refined by the bucket numbers 25 bytes on, the new buckets by
   those 50 bytes on. Strings in one bucket then are equal. The contexts of a
   gram are refined within one task, those of a gram that has many by joins
   over all tasks, where a bucket's number is its earliest place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import BYTE_VALUE, give_back, mix, numbers, text_bytes
from ._spark import Saved, scope, small_batches
from ._tokens import by_bytes

LENGTH, GRAM = 100, 40
#: Grams with more different contexts than this are refined by several tasks instead of one.
HOT = 2000

_U = np.uint64
_BASE = int(BYTE_VALUE[7]) | 1
#: Byte values and base of a second, independent hash of contexts.
_VALUE2 = numbers(256, 41)
_BASE2 = int(_VALUE2[7]) | 1
#: Bytes of the first buckets.
_FIRST = 25
_PLACE_BITS = 26
_RUN = 1 << 17  # bytes handled at once
#: Bytes of contexts that are refined together.
PORTION = 1 << 18


def gram_hashes(data: np.ndarray, *lengths: int, values: np.ndarray = BYTE_VALUE, base: int = _BASE) -> list[np.ndarray]:
    """Rolling hashes of all grams of each length, made from grams of doubled
    length; the last ``length - 1`` entries of each are to be left alone."""
    parts = {1: values[data]}
    with np.errstate(over="ignore"):

        def chain(n: int, m: int) -> np.ndarray:  # grams of n bytes followed by m bytes
            out = parts[n] * _U(pow(base, m, 1 << 64))
            out[: len(out) - n] += parts[m][n:]
            return out

        k = 1
        while 2 * k <= max(lengths):
            parts[2 * k] = chain(k, k)
            k *= 2
        found = []
        for length in lengths:
            have, bit = 0, 1 << (length.bit_length() - 1)
            while bit:
                if length & bit:
                    if have and have + bit not in parts:
                        parts[have + bit] = chain(have, bit)
                    have += bit
                bit >>= 1
            found.append(mix(parts[length]))
    return found


def window_min(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of values[i : i + size] for every i; windows that pass the end are cut off."""
    n = len(values)
    whole = -(-n // size) * size
    top = np.iinfo(values.dtype).max
    padded = np.concatenate([values, np.full(whole - n + size, top, dtype=values.dtype)]).reshape(-1, size)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, gram, context, context2): for each anchor, its text's
    number, the first and last string start it answers for, a hash of its gram
    and two independent ones of its whole context, 128 bits."""
    out = []
    for first, a, b in _pieces(offsets):
        part = data[a:b]
        local = offsets[first[0] : first[1] + 1] - a
        if len(part) < LENGTH:
            continue
        gram, whole = gram_hashes(part, GRAM, LENGTH)
        place = np.arange(len(part), dtype=np.uint64)
        low = _U((1 << _PLACE_BITS) - 1)
        chosen = (window_min((gram & ~low) | place, LENGTH - GRAM + 1) & low).astype(np.int64)
        text = np.repeat(np.arange(len(local) - 1), np.diff(np.clip(local, 0, len(part))))
        ends = np.clip(local[1:], 0, len(part))[text]
        fits = np.flatnonzero(np.arange(len(part)) + LENGTH <= ends)
        if not len(fits):
            continue
        chosen, text = chosen[fits], text[fits]
        new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
        last = np.r_[new[1:], len(fits)] - 1
        lo, hi, at = fits[new], fits[last], chosen[new]
        with np.errstate(over="ignore"):
            span = (hi - lo).astype(np.uint64) * _U(1 << 20) + (at - lo).astype(np.uint64)
            context, context2 = (mix(w[lo] * _U(3) + w[hi] * _U(5) + span) for w in (whole, *gram_hashes(part, LENGTH, values=_VALUE2, base=_BASE2)))
        text_no = text[new] + first[0]
        shift = a - offsets[text_no]
        out.append((text_no, lo + shift, hi + shift, gram[at], context, context2))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, *[none.view(np.uint64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _pieces(offsets: np.ndarray) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Groups of texts of at most _RUN bytes, and longer texts in pieces that
    overlap so that every string lies in exactly one: (texts from, to), bytes from, to."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= _RUN:
            j += 1
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= _RUN:
            yield (i, j), a, b
        else:
            for at in range(a, b, _RUN):
                yield (i, j), at, min(b, at + _RUN + LENGTH - 1)
        i = j


def refine(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket numbers of the strings of LENGTH bytes at ``starts``, by
    bucket-pointer refinement; equal numbers mean equal strings. ``data`` must
    reach LENGTH bytes beyond each start."""
    at = np.unique((starts[:, None] + np.array([0, 25, 50, 75])).ravel())
    # initial buckets: 25 bytes, sorted as three numbers of 8 bytes and one byte; a
    # bucket's number is the count of strings in lower buckets
    rows = data[at[:, None] + np.arange(25)]
    words8 = np.ascontiguousarray(rows[:, :24]).view(np.uint64)
    bucket = np.zeros(len(at), dtype=np.int64)
    for column in (words8[:, 0], words8[:, 1], words8[:, 2], rows[:, 24].astype(np.uint64)):
        bucket = _split(bucket, column)
    # refinement: only buckets that still have several strings are sorted, by the
    # bucket numbers of a later offset; these numbers, once refined, serve the next depth
    for depth in (25, 50):
        base = np.flatnonzero(np.bincount(bucket, minlength=len(at))[bucket] > 1)
        place = np.minimum(np.searchsorted(at, at[base] + depth), len(at) - 1)
        later = np.where(at[place] == at[base] + depth, bucket[place], -1)
        bucket[base] = _split(bucket[base], later)
    return bucket[np.searchsorted(at, starts)]


def _split(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """New bucket numbers after the strings of each bucket are sorted by ``key``."""
    if not len(bucket):
        return bucket
    order = np.lexsort((key, bucket))
    b, k, n = bucket[order], key[order], np.arange(len(order))
    changed = np.r_[True, b[1:] != b[:-1]]
    first = np.maximum.accumulate(np.where(changed, n, 0))
    part = np.maximum.accumulate(np.where(changed | np.r_[True, k[1:] != k[:-1]], n, 0))
    out = np.empty_like(bucket)
    out[order] = b + part - first
    return out


def _ints(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in arrays]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        gram = anchors(*text_bytes(batch.column("text")))[3]
        values, counts = np.unique(gram, return_counts=True)
        yield pa.RecordBatch.from_arrays(_ints(values, np.minimum(counts, 2)), ["g", "c"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        text, lo, hi, *hashes = anchors(*text_bytes(batch.column("text")))
        keys = [batch.column(c).take(pa.array(text)) for c in ("id", "th")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), *_ints(*hashes)], ["id", "th", "lo", "hi", "g", "x", "y"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, hot, id, th, lo, body) of each run that a text is asked for."""
    for batch in by_bytes(batches, "text"):
        data, offsets = text_bytes(batch.column("text"))
        asked = batch.column("asked")
        flat, counts = asked.flatten(), np.diff(asked.offsets.to_numpy())
        owner = np.repeat(np.arange(len(counts)), counts)
        lo, hi = (flat.field(k).to_numpy() for k in (0, 1))
        begin = offsets[owner] + lo
        body = [data[a:b].tobytes() for a, b in zip(begin, begin + (hi - lo) + LENGTH)]
        take = pa.array(owner)
        yield pa.RecordBatch.from_arrays([flat.field(2), flat.field(3), batch.column("id").take(take), batch.column("th").take(take), pa.array(lo, pa.int32()), pa.array(body, pa.binary())], ["g", "hot", "id", "th", "lo", "body"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings among the contexts of one partition, gram by gram: the
    rows come sorted by gram, and are refined PORTION bytes at a time or one gram."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(table.column("body").combine_chunks())
        data = np.concatenate([data, np.zeros(LENGTH, dtype=np.uint8)])
        counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        bucket = refine(data, offsets[owner] + inside)
        id_, th, lo = (table.column(c).to_numpy() for c in ("id", "th", "lo"))
        place = lo[owner] + inside
        order = np.lexsort((place, th[owner], id_[owner], bucket))
        b = bucket[order]
        later = np.r_[False, b[1:] == b[:-1]] if len(b) else np.zeros(0, dtype=bool)
        # the same string of the same text, seen twice, is no repeat of itself
        first = np.maximum.accumulate(np.where(later, 0, np.arange(len(b))))
        o, f = owner[order], owner[order][first]
        later &= ~((id_[o] == id_[f]) & (th[o] == th[f]) & (place[order] == place[order][first]))
        got = order[later]
        # strings that begin one after another in a context are one run
        got = got[np.argsort(got)]
        new = np.r_[True, (owner[got][1:] != owner[got][:-1]) | (place[got][1:] != place[got][:-1] + 1)] if len(got) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(new)
        last = got[np.r_[at[1:], len(got)] - 1] if len(got) else got
        lead = got[at]
        yield pa.RecordBatch.from_arrays([pa.array(id_[owner[lead]]), pa.array(th[owner[lead]]), pa.array(place[lead].astype(np.int32)), pa.array((place[last] + LENGTH).astype(np.int32))], ["id", "th", "a", "b"])

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield from work(pa.Table.from_batches(rows))

    size = 0
    for batch in batches:
        grams = batch.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(grams)) + 1).tolist(), len(grams)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if size > PORTION and held[-1].column("g")[-1].as_py() != grams[a]:
                yield from flush(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += held[-1].column("body").nbytes
    yield from flush(held)
    give_back()


def _quarters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first 25 bytes of every suffix of the contexts that has them."""
    for batch in by_bytes(batches, "body", 1 << 17):
        data, offsets = text_bytes(batch.column("body"))
        counts = np.maximum(np.diff(offsets) - _FIRST + 1, 0)
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        rows = np.ascontiguousarray(data[(offsets[owner] + inside)[:, None] + np.arange(_FIRST)])
        head = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_FIRST), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())
        take = pa.array(owner)
        place = batch.column("lo").to_numpy()[owner] + inside
        yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("th").take(take), pa.array(place.astype(np.int32)), head], ["id", "th", "p", "q"])


def _refined_apart(contexts: DataFrame) -> DataFrame:
    """(id, th, a, b): what repeats among contexts too many for one task, by the
    same refinement over all tasks.

    A suffix's bucket is named by the earliest place of those in it. First
    buckets are alike in 25 bytes; a round joins each suffix's bucket with that
    of the suffix as many bytes on, and suffixes alike in both are one new
    bucket. Suffixes alone in their bucket leave. Names come from partial
    minima, so a bucket's size is no burden."""
    found = Saved(contexts.mapInArrow(_quarters, "id long, th long, p int, q binary").dropDuplicates(["id", "th", "p"]), "suffix-quarters").df
    found = _named(found, ["q"])
    for depth in (_FIRST, 2 * _FIRST):
        later = found.select(F.col("id").alias("i"), F.col("th").alias("t"), (F.col("p") - depth).alias("at"), F.col("bucket").alias("next"))
        pairs = found.join(later, (F.col("id") == F.col("i")) & (F.col("th") == F.col("t")) & (F.col("p") == F.col("at"))).select("id", "th", "p", "bucket", "next")
        found = _named(pairs.withColumnRenamed("bucket", "before"), ["before", "next"])
    place = F.struct("id", "th", "p")
    strings = found.where(place != F.col("bucket")).select("id", "th", "p", F.floor(F.col("p") / 4096).alias("block"))
    run = F.col("p") - F.row_number().over(Window.partitionBy("id", "th", "block").orderBy("p"))
    return strings.withColumn("run", run).groupBy("id", "th", "block", "run").agg(F.min("p").alias("a"), (F.max("p") + LENGTH).alias("b")).select("id", "th", "a", "b")


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(id, th, p, bucket) of the rows that aren't alone in their keys."""
    rows = Saved(rows.select("id", "th", "p", *keys), "suffix-rows").df
    names = rows.groupBy(*keys).agg(F.min(F.struct("id", "th", "p")).alias("bucket"), F.count("*").alias("n")).where("n > 1").drop("n")
    return Saved(rows.join(names, keys).select("id", "th", "p", "bucket"), "suffix-buckets").df


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a set of intervals; touching intervals are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, dtype=np.int64)
    return starts[new], ends[np.r_[new[1:], len(starts)] - 1] if len(new) else ends[:0]


_DIGEST = T.StructType([T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])


def _parts(text: pa.Array, spans: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """For each text: its bytes, the number of removed runs, and what is left."""
    at = spans.offsets.to_numpy()
    a, b = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    for k, value in enumerate(text):
        body = value.as_buffer() if value.is_valid else b""
        lo, hi = merged(a[at[k] : at[k + 1]], b[at[k] : at[k + 1]])
        view = memoryview(body)
        yield len(view), len(lo), b"".join(view[x:y] for x, y in zip([0, *hi], [*lo, len(view)]))


@F.arrow_udf(_DIGEST)
def _digest(text: pa.Array, spans: pa.Array) -> pa.Array:
    rows = [(n, n - len(rest), runs, hashlib.sha256(rest).hexdigest()) for n, runs, rest in _parts(text, spans)]
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


@F.arrow_udf(T.StringType())
def _kept(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([rest.decode("utf-8", "ignore") for _, _, rest in _parts(text, spans)], pa.string())


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans): the byte intervals that go, for each text that has any;
    ``th`` is xxhash64 of the text. See ``remove_repeats``."""
    with scope() as tables:
        return tables.keep(Saved(_spans(docs, id_col, text_col), "suffix-spans"))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    named = small_batches(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    grams = named.select("text").mapInArrow(_grams, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where("c > 1").select("g")
    grams = Saved(grams, "suffix-grams").df
    hits = named.mapInArrow(_anchor_rows, "id long, th long, lo int, hi int, g long, x long, y long").join(grams, "g", "left_semi")
    hits = Saved(hits, "suffix-anchors").df
    firsts = hits.groupBy("g", "x", "y").agg(F.min(F.struct("id", "th", "lo", "hi")).alias("f"), F.count("*").alias("n"))
    firsts = Saved(firsts.select("g", "x", "y", "f.*", "n"), "suffix-firsts").df
    same = firsts.where("n > 1").select("g", "x", "y", F.col("id").alias("f_id"), F.col("th").alias("f_th"), F.col("lo").alias("f_lo"))
    again = hits.join(same, ["g", "x", "y"]).where("NOT (id = f_id AND th = f_th AND lo = f_lo)").select("id", "th", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b"))

    many = firsts.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g", (F.col("m") > HOT).alias("hot"))
    asked = firsts.join(many, "g").groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi", "g", "hot")).alias("asked"))
    contexts = named.join(asked, ["id", "th"]).select("id", "th", "text", "asked").mapInArrow(_contexts, "g long, hot boolean, id long, th long, lo int, body binary")
    contexts = Saved(contexts, "suffix-contexts").df
    calm = contexts.where("NOT hot").select("g", "id", "th", "lo", "body").repartition("g").sortWithinPartitions("g")
    found = calm.mapInArrow(_refined, "id long, th long, a int, b int")
    hot = contexts.where("hot").select("id", "th", "lo", "body")
    found = found.unionByName(_refined_apart(hot)) if hot.head(1) else found
    return again.unionByName(found).groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spans = repeat_spans(docs, id_col, text_col).select(F.col("id").alias("s_id"), F.col("th").alias("s_th"), "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    return rows.join(spans, (F.col("id") == F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").select("doc", F.coalesce("spans", none).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    A byte is removed if a string of 100 bytes that covers it also starts
    earlier: in a row with a smaller id, or before in the same text. Strings
    never cross rows and are judged on the input.

    Null text counts as empty. Rows with a null id have no place in the order:
    they are matched with nothing and kept whole. Rows that repeat an id and
    its text are one document, and each gives its result; rows that repeat an
    id with another text are ordered by a hash of the text. Other columns are
    ignored. An empty table gives an empty result.
    """
    rows = _with_spans(docs.select(id_col, text_col), id_col, text_col)
    return rows.select(F.col("doc")[id_col].alias(id_col), _digest(F.col("doc")[text_col], "spans").alias("r")).select(id_col, "r.*")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the bytes that ``remove_repeats`` counts taken out of the
    text. What is left of a letter that a removal cut in two goes too. Null
    text stays null; all columns are kept."""
    rows = _with_spans(docs, id_col, text_col)
    text = F.col("doc")[text_col]
    left = F.when(F.size("spans") > 0, _kept(text, "spans")).otherwise(text)
    return rows.select(*[(left if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])
