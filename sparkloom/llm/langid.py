"""Language identification by Bayesian fusion of evidence.

The posterior of a language is proportional to the likelihood of the text, the
likelihood of the language the markup declares, and a prior of the host. Host
priors are smoothed towards the prior of the host's address suffix, and these
towards the prior of all rows. Priors and the reliability of declarations are
sums of the text posteriors of all rows, by grouped aggregation. Text in none
of the languages goes to a background, in which all trigrams are as likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import LOWER, give_back, text_bytes
from ._spark import Saved, scope, small_batches
from ._tokens import by_bytes

#: Byte trigrams are hashed to so many buckets.
BUCKETS = 1 << 15
#: Bytes of text handled at once; a longer text goes in pieces.
PIECE = 1 << 19
#: Letters are lower-cased ASCII letters and all bytes of other letters; the rest counts as one blank.
_CLASS = LOWER.copy()
_CLASS[[b for b in range(128) if not 97 <= int(LOWER[b]) <= 122]] = 32
#: A text's evidence grows with its trigrams up to so many, since neighbours aren't independent.
ENOUGH = 200
#: The prior of the background.
BACKGROUND = 0.01
#: The share of each language's trigrams that is set aside for all languages' mean, mixed evenly with the background.
SPARE = 0.1


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of the trigrams of PIECE bytes at a time, texts cut
    anywhere; runs of blanks and trigrams across texts' edges are left out."""
    for at in range(0, max(0, len(data) - 2), PIECE):
        c = _CLASS[data[at : at + PIECE + 2]].astype(np.int32)
        end = at + len(c)
        lo, hi = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, end)
        own = np.repeat(np.arange(lo, hi), np.diff(np.clip(offsets[lo : hi + 1], at, end)))
        keep = np.flatnonzero((own[:-2] == own[2:]) & (c[1:-1] != 32))
        bucket = (c[:-2] * 7919 + c[1:-1] * 263 + c[2:])[keep].astype(np.int64) * 40503 % BUCKETS
        yield bucket, own[:-2][keep]


@dataclass(frozen=True)
class TextModel:
    """Log-likelihoods of trigram buckets for each language, and last the background."""

    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x (languages + 1), natural logarithms

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text, its tempered log-likelihoods and its number of trigrams."""
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        total, count = np.zeros((n, self.table.shape[1])), np.zeros(n)
        for bucket, text in _trigrams(data, offsets):
            if len(bucket):
                starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                total[text[starts]] += np.add.reduceat(self.table[bucket], starts, axis=0)
                count[text[starts]] += np.diff(np.r_[starts, len(text)])
        scale = np.minimum(count, ENOUGH) / np.maximum(count, 1)
        return total * scale[:, None], count


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(l, at, n): how often each bucket is met in the texts of each label."""
    total: dict[str, np.ndarray] = {}
    for batch in by_bytes(batches, "t"):
        data, offsets = text_bytes(batch.column("t"))
        labels, of = np.unique(np.array(batch.column("l").to_pylist(), dtype=object), return_inverse=True)
        counts = np.zeros(len(labels) * BUCKETS, dtype=np.int64)
        for bucket, text in _trigrams(data, offsets):
            counts += np.bincount(of[text] * BUCKETS + bucket, minlength=len(counts))
        for label, row in zip(labels, counts.reshape(len(labels), BUCKETS)):
            total[label] = total.get(label, 0) + row
    for label, row in total.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([label] * (len(some) + 1), pa.string()), pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[0, row[some]])], ["l", "at", "n"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = 4000) -> TextModel:
    """Fit on a bounded sample of labelled rows: about ``rows`` of them, 2 *
    ``rows`` at most, chosen by a hash of id and text. Rows without label or
    text aren't used. Without any labelled row the model knows one language,
    "und". The sample's whole texts are counted where they lie; the driver gets
    a count for each label and bucket."""
    known = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    share = rows / max(rows, known.count())
    place = F.xxhash64(F.col(id_col), F.col(text_col))
    picked = known.where(F.pmod(place, F.lit(1_000_000)) < share * 1_000_000).select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l"), place.alias("h"))
    last = picked.select("h").orderBy("h").limit(2 * rows).agg(F.max("h").alias("h"), F.count("*").alias("n")).first()
    sample = picked.where(F.col("h") <= last["h"]) if last["n"] else picked
    found = small_batches(sample.select("t", "l")).mapInArrow(_label_counts, "l string, at int, n long").groupBy("l", "at").agg(F.sum("n").alias("n")).toArrow()
    labels = np.array(found.column("l").to_pylist(), dtype=object)
    languages = tuple(sorted(set(labels))) or ("und",)
    counts = np.zeros((BUCKETS, len(languages)))
    if found.num_rows:
        at, n = (found.column(c).to_numpy() for c in ("at", "n"))
        real = at >= 0  # a row with -1 only names its label
        counts[at[real], np.searchsorted(np.array(languages, dtype=object), labels)[real]] = n[real]
    return TextModel(languages, likelihoods(counts))


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """A model's table from the counts of buckets for each language. What a
    language has spare is the same for all, however much text it has."""
    size = counts.sum(axis=0)
    shares = np.where(size > 0, counts / np.maximum(size, 1), 1 / BUCKETS)
    spare = (shares.mean(axis=1, keepdims=True) + 1 / BUCKETS) / 2
    return np.log(np.c_[(1 - SPARE) * shares + SPARE * spare, np.full(BUCKETS, 1 / BUCKETS)])


def with_likelihood(rows: DataFrame, text_col: str, model: TextModel) -> DataFrame:
    """``rows`` with ``_ev``: the text's log-likelihoods ``ll``, the background's last, and number of trigrams ``n``."""
    kind = T.StructType([T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    @F.arrow_udf(kind)
    def likelihood(text: pa.Array) -> pa.Array:
        total, count = model.score(text)
        give_back()
        ends = pa.array(np.arange(len(text) + 1, dtype=np.int32) * total.shape[1])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(total.ravel())), pa.array(count.astype(np.int64))], ["ll", "n"])

    return small_batches(rows).withColumn("_ev", likelihood(F.coalesce(F.col(text_col), F.lit(""))))


def _softmax(logs: Column, n: int) -> list[Column]:
    top = F.array_max(logs)
    parts = [F.exp(F.get(logs, F.lit(i)) - top) for i in range(n)]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


@dataclass(frozen=True)
class Priors:
    """Saved tables: ``hosts`` (host, suffix, prior), ``suffixes`` (suffix,
    prior), ``declared`` (declared, likelihood), and the prior of all rows."""

    hosts: DataFrame
    suffixes: DataFrame
    declared: DataFrame
    overall: tuple[float, ...]


def learn_priors(scored: DataFrame, model: TextModel, strength: float = 8.0) -> Priors:
    """Hierarchically smoothed priors from rows with ``host``, ``suffix``,
    ``declared`` and ``_ev``. Sums are formed before the shuffle, so a host
    with a third of all rows is no burden; rows without trigrams don't count,
    and what goes to the background counts for no language."""
    n = len(model.languages)
    logs = F.array(*[F.get("_ev.ll", F.lit(i)) for i in range(n)], F.get("_ev.ll", F.lit(n)) + F.lit(math.log(BACKGROUND * n)))
    post = scored.where("_ev.n > 0").select("host", "suffix", "declared", *[p.alias(f"p{i}") for i, p in enumerate(_softmax(logs, n + 1)[:n])])
    sums = [F.sum(f"p{i}").alias(f"c{i}") for i in range(n)]
    hosts = Saved(post.groupBy("host", "suffix", "declared").agg(*sums), "lang-hosts").df
    total = hosts.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]).first()
    counts = np.array([float(x or 0.0) for x in total])
    overall = tuple((counts + 1.0) / (counts.sum() + n))
    again = [F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]

    def smoothed(counts: list[Column], towards: list[Column]) -> Column:
        size = sum(counts[1:], counts[0])
        return F.array(*[(c + strength * t) / (size + strength) for c, t in zip(counts, towards)])

    cs = [F.col(f"c{i}") for i in range(n)]
    above = [F.lit(x) for x in overall]
    suffixes = hosts.where("suffix IS NOT NULL").groupBy("suffix").agg(*again).select("suffix", smoothed(cs, above).alias("s_prior"))
    suffixes = Saved(suffixes, "lang-suffixes").df
    by_host = hosts.where("host IS NOT NULL").groupBy("host", "suffix").agg(*again).join(suffixes, "suffix", "left")
    by_host = by_host.groupBy("host").agg(*again, F.max("s_prior").alias("s_prior"))
    towards = [F.coalesce(F.get("s_prior", F.lit(i)), above[i]) for i in range(n)]
    by_host = Saved(by_host.select("host", smoothed(cs, towards).alias("h_prior")), "lang-host-priors").df
    # how likely each language is to be declared so: towards the declaration's share of all rows
    marks = hosts.where("declared IS NOT NULL").groupBy("declared").agg(*again)
    every = marks.agg(*again).first()
    sizes = [float(x or 0.0) for x in every]
    share = sum(cs[1:], cs[0]) / F.lit(max(sum(sizes), 1e-9))
    marks = marks.select("declared", F.array(*[(cs[i] + strength * share) / (sizes[i] + strength) for i in range(n)]).alias("d_like"))
    return Priors(by_host, suffixes, Saved(marks, "lang-declared").df, overall)


def fuse(scored: DataFrame, model: TextModel, priors: Priors, least: float = 0.5) -> DataFrame:
    """``scored`` with ``_lang``, ``_probability`` and ``_rejected``.

    A row is rejected if its text has no trigram of letters ("und"), or if no
    language reaches the probability ``least`` beside the others and the
    background; ``_lang`` is then the likeliest language all the same. Ties go to the language first
    in order. Joins go by host, suffix and declaration; Spark broadcasts these
    tables where their size allows it."""
    n = len(model.languages)
    tables = ((priors.hosts, "host", "h_prior"), (priors.suffixes, "suffix", "s_prior"), (priors.declared, "declared", "d_like"))
    for table, key, value in tables:
        scored = scored.join(table.select(F.col(key).alias(f"_{key}"), F.col(value).alias(f"_{value}")), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    prior = F.coalesce("_h_prior", "_s_prior", F.array(*[F.lit(x) for x in priors.overall]))
    said = [F.get("_d_like", F.lit(i)) * x for i, x in enumerate(priors.overall)]
    beside = F.get("_ev.ll", F.lit(n)) + F.lit(math.log(BACKGROUND)) + F.coalesce(F.log(sum(said[1:], said[0])), F.lit(0.0))
    logs = F.array(*[F.get("_ev.ll", F.lit(i)) + F.log(F.get(prior, F.lit(i))) + F.coalesce(F.log(F.get("_d_like", F.lit(i))), F.lit(0.0)) for i in range(n)], beside)
    scored = scored.withColumn("_post", F.array(*_softmax(logs, n + 1)[:n])).drop("_h_prior", "_s_prior", "_d_like")
    top = F.array_max("_post")
    name = F.get(F.array(*[F.lit(x) for x in model.languages]), (F.array_position("_post", top) - 1).cast("int"))
    some = F.col("_ev.n") > 0
    return scored.select("*", F.when(some, name).otherwise("und").alias("_lang"), F.when(some, top).otherwise(0.0).alias("_probability"), (~some | (top < least)).alias("_rejected")).drop("_post", "_ev")


def identify(rows: DataFrame, model: TextModel, keys: list[str], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(keys, lang, probability, rejected) of rows with ``text_col``, ``host``,
    ``suffix`` and ``declared``; any of these may be null.

    Null or empty text, and text without letters, is "und" and rejected. A null
    host falls back to the suffix, a null suffix to all rows; a null declaration
    says nothing. Repeated rows count as often as they stand; an empty table
    gives an empty result."""
    rows = rows.select(*keys, F.col(text_col).alias("_text"), "host", "suffix", "declared")
    with scope() as tables:
        scored = Saved(with_likelihood(rows, "_text", model).drop("_text"), "lang-scored").df
        found = fuse(scored, model, learn_priors(scored, model), least)
        found = found.select(*keys, F.col("_lang").alias("lang"), F.col("_probability").alias("probability"), F.col("_rejected").alias("rejected"))
        return tables.keep(Saved(found, "lang-found"))


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, ``host``, ``suffix`` and ``declared``: the text
    between tags without scripts and styles, the address's host and last label,
    and the language that the html tag declares."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " "), "(?s)<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    said = F.lower(F.regexp_extract(html, "(?is)<html\\b[^>]*\\blang\\s*=\\s*[\"']?([a-zA-Z]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select("*", text.alias("text"), blank(host).alias("host"), blank(F.regexp_extract(host, "\\.([^.]+)$", 1)).alias("suffix"), blank(said).alias("declared"))
