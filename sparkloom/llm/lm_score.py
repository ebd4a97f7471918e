"""Scoring texts with a causal self-attention model trained in numpy.

Texts are lower-cased (A-Z) and encoded to subword ids. Each of the most
frequent ids is a class of the model (``attention``); the others share RARE
classes by a hash, as inputs and as outputs, and an id's probability is its
class's times its smoothed share of the class in all training texts. So the
probabilities of all ids and the end sum to one.

Counts come from Spark aggregates over all training texts; the model is trained
on every token of them, where the texts lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import one_thread, text_bytes, word_hashes, words
from ._spark import Saved, scope, small_batches
from ._tokens import by_bytes, byte_letters, encoder
from .attention import CLASSES, END, INPUTS, Followers, Net, Params, Trainer, blocks, flat, start_params, unflat

#: Classes of the rarer ids, the last before END.
RARE = 256
#: Parameters travel in parts of so many.
PART = 1 << 10


def is_held_out(id_: Column) -> Column:
    """Rows whose crc32 of the id as text is 1 modulo 5; null ids are not."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 1, F.lit(False))


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, False).encode
        for batch in by_bytes(batches, "text"):
            ids = [np.frombuffer(of(x.encode().lower().decode()), dtype="<u4").astype("<u2").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), pa.array(ids, pa.binary())], ["id", "held", "ids"])

    return encode


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        data, _ = text_bytes(batch.column("ids"))
        total += np.bincount(np.frombuffer(data.tobytes(), dtype="<u2"), minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["t", "c"])


def id_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id, its class, and the natural logarithm of its share of the class:
    its count with 0.5 added, so that no id has none."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    own, rare = np.split(order, [END - RARE])
    table = np.empty(len(counts), dtype=np.int64)
    table[own] = np.arange(len(own))
    table[rare] = END - RARE + rare * 40503 % 65521 % RARE
    mass = counts + 0.5
    return table, np.log(mass / np.bincount(table, weights=mass)[table])


def _classes(column: pa.Array, table: np.ndarray) -> list[np.ndarray]:
    """Each text's classes with END."""
    data, offsets = text_bytes(column)
    mapped = table[np.frombuffer(data.tobytes(), dtype="<u2")]
    return [np.append(mapped[a // 2 : b // 2], END) for a, b in zip(offsets[:-1], offsets[1:])]


def _follower_rows(table: np.ndarray):
    """How often what follows what in a task's texts: a row for each input, with
    the classes that followed it and their counts."""

    def followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(INPUTS * CLASSES, dtype=np.int64)
        for batch in by_bytes(batches, "ids", 1 << 20):
            x, y, _ = blocks(_classes(batch.column("ids"), table))
            ok = y >= 0
            total += np.bincount(x[ok] * CLASSES + y[ok], minlength=INPUTS * CLASSES)
        total = total.reshape(INPUTS, CLASSES)
        some = np.flatnonzero(total.any(axis=1))
        seen = [np.flatnonzero(total[i]) for i in some]
        packed = lambda rows, kind: pa.array([r.astype(kind).tobytes() for r in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packed(seen, "<i4"), packed([total[i, s] for i, s in zip(some, seen)], "<i8")], ["x", "y", "c"])

    return followers


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of rows of one input, added as they come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for x, y, c in zip(*(batch.column(k).to_pylist() for k in "xyc")):
            total.setdefault(x, np.zeros(CLASSES, dtype=np.int64))[np.frombuffer(y, dtype="<i4")] += np.frombuffer(c, dtype="<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.astype("<i8").tobytes() for c in total.values()], pa.binary())], ["x", "c"])


def count_followers(learn: DataFrame, table: np.ndarray) -> Followers:
    """What follows what in all training texts (ids). The driver gets 1026 rows
    of 1024 counts, whatever the number of texts."""
    rows = learn.select("ids").mapInArrow(_follower_rows(table), "x int, y binary, c binary").repartition("x").mapInArrow(_summed, "x int, c binary").toArrow()
    counts = np.zeros((INPUTS, CLASSES), dtype=np.int64)
    for x, c in zip(rows.column("x").to_pylist(), rows.column("c").to_pylist()):
        counts[x] = np.frombuffer(c, dtype="<i8")
    return Followers(counts)


def train(learn: DataFrame, table: np.ndarray, followers: Broadcast, rounds: int = 2) -> Params:
    """Train on rows (id, ids) of training texts.

    All texts are trained on where they lie, each in one of ``rounds`` rounds by
    a hash of the id: every task continues from the round's start over its own
    texts, and the tasks' parameters are averaged by their tokens. They travel in
    parts and are added as they come, so neither a task nor the driver holds
    more than one set."""
    params, parts = start_params(), "part int, v binary, n long"
    for k in range(rounds):
        own = learn.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(rounds)) == k).select("ids")
        found = own.mapInArrow(_local(params, table, followers), parts).repartition("part").mapInArrow(_added, parts).orderBy("part").toArrow()
        if found.num_rows:
            sums = np.concatenate([np.frombuffer(v, dtype="<f8") for v in found.column("v").to_pylist()])
            params = unflat(sums / found.column("n")[0].as_py())
    return params


def _part_rows(values: dict[int, np.ndarray], tokens: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(values), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in values.values()], pa.binary()), pa.array([tokens[k] for k in values], pa.int64())], ["part", "v", "n"])


def _local(start: Params, table: np.ndarray, followers: Broadcast):
    """A task's parameters times its tokens, and its tokens, after all its texts."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        trainer = Trainer(start, followers.value)
        for batch in by_bytes(batches, "ids", 1 << 18):
            trainer.fit(_classes(batch.column("ids"), table))
        if trainer.tokens:
            values = flat(trainer.p) * trainer.tokens
            cut = {k: values[at : at + PART] for k, at in enumerate(range(0, len(values), PART))}
            yield _part_rows(cut, dict.fromkeys(cut, trainer.tokens))

    return local


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values: dict[int, np.ndarray] = {}
    tokens: dict[int, int] = {}
    for batch in batches:
        for part, v, n in zip(*(batch.column(c).to_pylist() for c in ("part", "v", "n"))):
            values[part] = values.get(part, 0) + np.frombuffer(v, dtype="<f8")
            tokens[part] = tokens.get(part, 0) + n
    yield _part_rows(values, tokens)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 1 << 20):
        data, offsets = text_bytes(batch.column("text"))
        starts, ends, _ = words(data, offsets)
        values, counts = np.unique(word_hashes(data, starts, ends), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["h", "c"])


class Vocabulary:
    """The bytes of every token."""

    def __init__(self, path: str):
        tokenizer = encoder(path, False).tokenizer
        size = tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids must fit in two bytes")
        marks = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        back = {letter: b for b, letter in byte_letters().items()}
        names = [tokenizer.id_to_token(i) or "" for i in range(size)]
        parts = [marks[i].encode() if i in marks else bytes(back[x] for x in name if x in back) for i, name in enumerate(names)]
        self.sizes = np.array([len(x) for x in parts] + [0] * ((1 << 16) - size), dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bytes in a row, and where each id's begin (n + 1 places)."""
        sizes = self.sizes[ids]
        at = np.r_[0, np.cumsum(sizes)]
        return self.bytes[np.repeat(self.starts[ids] - at[:-1], sizes) + np.arange(at[-1])], at


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """One for each Python worker, kept from task to task."""
    return Vocabulary(path)


@dataclass(frozen=True)
class WordCounts:
    """What is known of the training words: the most frequent ones by hash, with
    their counts; all tokens; distinct tokens; ends of texts."""

    common: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    ends: int

    @property
    def room(self) -> float:
        return math.log10(self.n + 0.5 * (self.v + 1))


def _score(params: Params, followers: Broadcast, table: np.ndarray, within: np.ndarray, path: str, known: WordCounts):
    """Rows with ``h`` null: a text's score (``within``: ids' logarithmic shares of
    their classes), and what its common words and the end give ``base``. The
    others: a text's rarer words, once each with how often it stands there,
    whose counts are yet to be looked up."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        net, vocabulary = Net(params, followers.value), vocabulary_of(path)
        logs = np.log10(known.counts + 0.5) - known.room
        end_log = math.log10(known.ends + 0.5) - known.room
        for batch in by_bytes(batches, "ids", 1 << 17):
            rows = batch.num_rows
            raw, at = text_bytes(batch.column("ids"))
            ids, at = np.frombuffer(raw.tobytes(), dtype="<u2"), at // 2
            log = net.logs(*blocks(_classes(batch.column("ids"), table))).astype(np.float64)
            log += np.insert(within[ids], at[1:], 0.0)
            total = np.bincount(np.repeat(np.arange(rows), np.diff(at) + 1), weights=log, minlength=rows) / math.log(10)
            data, place = vocabulary.decode(ids)
            starts, stops, word_of = words(data, place[at])
            h = word_hashes(data, starts, stops)
            owner = np.repeat(np.arange(rows), np.diff(word_of))
            spot = np.minimum(np.searchsorted(known.common, h), max(0, len(known.common) - 1))
            found = known.common[spot] == h if len(known.common) else np.zeros(len(h), dtype=bool)
            seen = owner[found]
            sums = np.bincount(seen, weights=logs[spot[found]], minlength=rows) + end_log
            n_known = np.bincount(seen, minlength=rows) + (known.ends > 0)
            rare, times = _counted(owner[~found], h[~found])
            take = pa.array(np.concatenate([np.arange(rows), rare["owner"]]))
            empty = np.zeros(len(rare), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(take) for c in ("uid", "id", "held")),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(rare["h"].view(np.int64))]),
                    pa.array(np.concatenate([np.zeros(rows, dtype=np.int64), times])),
                    *(pa.array(np.concatenate([a, b])) for a, b in ((np.diff(word_of) + 1, empty), (n_known.astype(np.int64), empty), (sums, empty.astype(float)), (total, empty.astype(float)))),
                ],
                ["uid", "id", "held", "h", "times", "tokens", "known", "base", "a"],
            )

    return score


def _counted(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (owner, h), and how often each stands there."""
    order = np.lexsort((h, owner))
    rows = np.empty(len(h), dtype=[("owner", np.int64), ("h", np.uint64)])
    rows["owner"], rows["h"] = owner[order], h[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, dtype=np.int64)
    return np.ascontiguousarray(rows[first]), np.diff(np.r_[first, len(rows)])


def count_words(texts: DataFrame, common_words: int = 1 << 17) -> tuple[DataFrame, WordCounts]:
    """(h, c) of all words of training texts, saved, and the ``common_words``
    most frequent ones (a bound: 2 MB) for the tasks. Counts are summed within
    batches and tasks before the shuffle."""
    counts = Saved(texts.select("text").mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-words").df
    ends = texts.count()
    size = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(common_words).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(h)
    return counts, WordCounts(h[order], c[order], int(size["n"]) + ends, int(size["v"]) + (ends > 0), ends)


def lm_scores(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, both log10.

    ``score`` is the attention model's log10 probability of all subword ids of
    the lower-cased text and of its end. ``base_score`` is the sum of the words'
    smoothed shares in the training texts; it isn't a probability of the text,
    as any unseen word costs the same. Both learn from rows that aren't held
    out: word and id counts from all of them.

    Frequent training words are looked up in the tasks; other words leave them
    once a text, with their number, and are joined by hash. Texts are encoded
    once and kept as ids of two bytes; no text is shuffled. The counts of
    followers (1026 x 1024) are broadcast.

    Null text counts as empty: one token, the end. Null ids aren't held out.
    Repeated rows are scored and learned from as often as they stand. Other
    columns are ignored; an empty table gives an empty result.
    """
    with scope() as tables:
        return tables.keep(Saved(_scored(docs, tokenizer_path, id_col, text_col), "lm-scores"))


def _scored(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = small_batches(docs).select(F.col(id_col).alias("id"), is_held_out(F.col(id_col)).alias("held"), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    encoded = Saved(rows.mapInArrow(_encode(tokenizer_path), f"id {id_type}, held boolean, ids binary"), "lm-ids").df
    learn = encoded.where("NOT held")
    seen = learn.select("ids").mapInArrow(_id_counts, "t int, c long").groupBy("t").agg(F.sum("c").alias("c")).toArrow()
    counts_of = np.zeros(encoder(tokenizer_path, False).tokenizer.get_vocab_size())
    counts_of[seen.column("t").to_numpy()] = seen.column("c").to_numpy()
    table, within = id_classes(counts_of)
    followers = docs.sparkSession.sparkContext.broadcast(count_followers(learn, table))
    params = train(learn, table, followers)
    counts, known = count_words(rows.where("NOT held"))

    schema = f"uid long, id {id_type}, held boolean, h long, times long, tokens long, known long, base double, a double"
    found = encoded.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "held", "ids").mapInArrow(_score(params, followers, table, within, tokenizer_path, known), schema)
    joined = found.join(counts, "h", "left")
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5) - F.lit(known.room)
    rare = F.col("h").isNotNull()
    got = joined.groupBy("uid").agg(
        F.max_by(F.struct("id", "held"), "tokens").alias("row"),
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(rare & F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.when(rare, F.col("times") * log).otherwise(F.col("base"))).alias("base_score"),
        F.sum("a").alias("score"),
    )
    return got.select(F.col("row.id").alias(id_col), F.col("row.held").alias("held_out"), "n_tokens", "n_known", F.lit(known.n).cast("long").alias("train_tokens"), "base_score", "score")
