"""Licence scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Saved, scope

#: Phrases whose exact places are counted. Fixed values.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Longer passages that may be matched with a few words changed. Fixed values.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu general public license as published by the free software foundation either version 2 of the license", "gpl-2"),
    ("gnu general public license as published by the free software foundation either version 3 of the license", "gpl-3"),
    ("gnu lesser general public license as published by the free software foundation either version 3 of the license", "lgpl-3"),
    ("gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "lgpl-2.1"),
    ("gnu lesser general public license version 3", "lgpl-3"),
    ("gnu lesser general public license version 2 1", "lgpl-2.1"),
    ("gnu affero general public license as published by the free software foundation either version 3 of the license", "agpl-3"),
    ("gnu affero general public license version 3", "agpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("subject to the terms of the mozilla public license version 2 0", "mpl-2"),
    ("made available under the terms of the eclipse public license 2 0", "epl-2"),
    ("made available under the terms of the eclipse public license v1 0", "epl-1"),
    ("licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib"),
    ("boost software license version 1 0", "boost-1"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl"),
)
#: Licence identifiers that may stand after "SPDX-License-Identifier:". Fixed values.
IDENTIFIERS = (
    ("mit", "mit"), ("apache 2 0", "apache-2"), ("gpl 2 0", "gpl-2"), ("gpl 3 0", "gpl-3"), ("lgpl 2 1", "lgpl-2.1"), ("lgpl 3 0", "lgpl-3"), ("agpl 3 0", "agpl-3"),
    ("bsd 2 clause", "bsd-2"), ("bsd 3 clause", "bsd-3"), ("mpl 2 0", "mpl-2"), ("epl 1 0", "epl-1"), ("epl 2 0", "epl-2"), ("isc", "isc"), ("unlicense", "unlicense"),
    ("zlib", "zlib"), ("bsl 1 0", "boost-1"), ("cc by 4 0", "cc-by-4"), ("cc by sa 4 0", "cc-by-sa-4"), ("cc by nc 4 0", "cc-by-nc"), ("cc0 1 0", "cc0-1"), ("wtfpl", "wtfpl"),
)
#: Words that tell licences of like wording apart. Fixed values.
NAMES = ("affero", "apache", "boost", "eclipse", "lesser", "mozilla", "noncommercial", "sharealike")
K = 3
#: Diagonals so near each other are one occurrence with words put in or left out.
NEAR = 2
#: Words of a passage that may differ: a tenth of them and one, no more than so many.
MOST_EDITS = 3


@dataclass(frozen=True)
class Template:
    words: list[str]
    label: str
    base: bool
    edits: int

    @property
    def numbers(self) -> list[str]:
        """Words that make the version: none of them may be missing."""
        return sorted({w for w in self.words if re.search("[0-9]", w)})

    @property
    def names(self) -> list[str]:
        return sorted(set(self.words) & set(NAMES))


#: Most texts with inexact spans whose keys (two numbers each) are broadcast.
ASKED = 1 << 20


def all_templates() -> list[Template]:
    """Base phrases first, then passages and identifiers."""
    spdx = tuple((f"spdx license identifier {name}", label) for name, label in IDENTIFIERS)
    found = [Template(phrase.split(), label, True, 0) for phrase, label in BASE]
    found += [Template(text.split(), label, False, min(MOST_EDITS, 1 + len(text.split()) // 10)) for text, label in PASSAGES]
    return found + [Template(text.split(), label, False, 0) for text, label in spdx]


def templates(spark: SparkSession) -> DataFrame:
    """(t, base, label, edits, n_grams, at, ta, tb, tc, th): the word 3-grams of all templates."""
    rows = []
    for t, x in enumerate(all_templates()):
        n = len(x.words) - K + 1
        rows += [(t, x.base, x.label, x.edits, n, i, *x.words[i : i + K]) for i in range(n)]
    found = spark.createDataFrame(rows, "t int, base boolean, label string, edits int, n_grams int, at int, ta string, tb string, tc string")
    return found.withColumn("th", F.xxhash64("ta", "tb", "tc"))


def word_list(text: Column) -> Column:
    """Words after lower-casing A-Z; other letters stay as they are."""
    text = F.coalesce(text, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
    return F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score``.

    Every 3-gram of words votes for the diagonal (place in the text minus place
    in the template) of each template that has it: a join on the gram's hash,
    verified on its three words. A template all of whose grams vote for one
    diagonal stands there word by word; only so do base phrases and licence
    identifiers count. Of the longer passages, neighbouring diagonals (at most
    two apart) with half of the grams or more are merged to a span, and the
    words of the text there are compared with the passage: the span counts if
    the edit distance in words is at most one and a tenth of the passage's
    words (no more than three), every number of the passage is there, and of
    NAMES just those of the passage, so that neither versions nor licences of
    like wording are mixed up. ``score`` is the largest share of a
    template's words that agree, 1 for a base phrase, 0 if nothing is found.

    The templates are constants of this module (some hundred grams) and are
    broadcast. Votes are summed within their task before the shuffle. Only
    texts with inexact spans are read again. Null text counts as empty: no
    words, empty labels, score 0, null first and last word. Null ids and
    repeated rows are rows like others; other columns are ignored; an empty
    table gives an empty result.
    """
    with scope() as tables:
        return tables.keep(Saved(_scanned(docs, id_col, text_col), "licences"))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th_text"), F.monotonically_increasing_id().alias("uid"), word_list(text).alias("w"))
    n = F.size("w")
    w = F.col("w")
    gram = lambda i: F.struct(*[F.get(w, i + k).alias(c) for k, c in enumerate("abc")])
    grams = F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), gram))
    keys = ["id", "th_text", "uid", "n_words"]
    voted = rows.select("id", "th_text", "uid", n.cast("long").alias("n_words"), F.posexplode_outer(grams).alias("pos", "g")).select(*keys, "pos", "g.*")
    found = F.broadcast(templates(docs.sparkSession))
    on = [F.xxhash64("a", "b", "c") == F.col("th"), F.col("a") == F.col("ta"), F.col("b") == F.col("tb"), F.col("c") == F.col("tc")]
    votes = voted.join(found, reduce(lambda x, y: x & y, on), "left").withColumn("diagonal", F.col("pos") - F.col("at"))
    about = ["t", "base", "label", "edits", "n_grams"]
    diagonals = votes.groupBy(*keys, *about, "diagonal").agg(F.count("at").alias("hits"), F.min("at").alias("lo"), F.max("at").alias("hi"))

    along = Window.partitionBy("uid", "t").orderBy("diagonal")
    new = F.when((F.col("edits") == 0) | (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR), 1).otherwise(0)
    spans = diagonals.withColumn("span", F.sum(new).over(along)).groupBy(*keys, *about, "span")
    first, last = F.min(F.struct(F.col("diagonal") + F.col("lo"), "lo")), F.max(F.struct(F.col("diagonal") + F.col("hi"), "hi"))
    spans = spans.agg(F.sum("hits").alias("hits"), F.max("hits").alias("straight"), F.max_by("diagonal", "hits").alias("at"), first.alias("f"), last.alias("l"))
    size = F.col("n_grams") + K - 1
    # where the passage would begin and end by the first and the last gram found
    spans = spans.select(*keys, *about, "hits", "straight", "at", (F.col("f.col1") - F.col("f.lo")).alias("begin"), (F.col("l.col1") - F.col("l.hi") + size).alias("end"))
    spans = Saved(spans, "licence-spans").df

    whole = F.col("straight") == F.col("n_grams")
    open_ = spans.where((F.col("edits") > 0) & ~whole & (2 * F.col("hits") >= F.col("n_grams")))
    edits = _edits(docs.select(F.col(id_col).alias("d_id"), F.xxhash64(text).alias("d_th"), text.alias("d_text")), open_)
    checked = spans.join(edits, ["uid", "t", "at"], "left")
    exact = F.col("t").isNotNull() & whole
    good = exact | F.coalesce(F.col("agree"), F.lit(False))
    place = F.col("base") & exact
    share = F.when(exact, 1.0).when(F.col("wrong").isNotNull(), F.greatest(1 - F.col("wrong") / size, F.lit(0.0))).otherwise(F.lit(0.0))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return checked.groupBy("id", "uid", "n_words").agg(
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("at"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("at"))).cast("long").alias("last_word"),
        joined(place).alias("base_labels"),
        joined(good).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    ).drop("uid").withColumnRenamed("id", id_col)


def _edits(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(uid, t, at, wrong, agree) of spans: the edit distance in words between
    the text there and the passage, and whether it is small enough.

    Words become letters of an alphabet of all templates' words, so that the
    distance of strings is that of words; ends may be up to two words off."""
    known = all_templates()
    letters = {w: chr(0x4E00 + i) for i, w in enumerate(sorted({w for x in known for w in x.words}))}
    alphabet = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    coded = F.array(*[F.lit("".join(letters[w] for w in x.words)) for x in known])
    numbers = F.array(*[F.array(*[F.lit(w) for w in x.numbers]).cast("array<string>") for x in known])
    names = F.array(*[F.array(*[F.lit(w) for w in x.names]).cast("array<string>") for x in known])
    asked = Saved(spans.select("id", "th_text").distinct(), "licence-asked").df
    asked = F.broadcast(asked) if asked.count() <= ASKED else asked  # else texts are shuffled to meet them
    same = F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_th") == F.col("th_text"))
    words = texts.join(asked, same, "left_semi").groupBy("d_id", "d_th").agg(F.first("d_text").alias("d_text"))
    rows = words.select("d_id", "d_th", word_list(F.col("d_text")).alias("w")).join(spans, same)
    begin, end = F.greatest(F.col("begin"), F.lit(0)), F.least(F.col("end"), F.col("n_words").cast("int"))
    rows = rows.select("uid", "t", "at", "edits", F.slice("w", begin + 1, F.greatest(F.least(end + NEAR, F.size("w")) - begin, F.lit(0))).alias("words"), (end - begin).alias("n"))
    rows = rows.withColumn("code", F.array_join(F.transform("words", lambda w: F.coalesce(F.element_at(alphabet, w), F.lit("?"))), ""))
    template = F.get(coded, F.col("t"))
    apart = [F.levenshtein(F.col("code").substr(F.lit(1 + a), F.greatest(F.col("n") + b - a, F.lit(0))), template) for a in range(NEAR + 1) for b in range(-NEAR, NEAR + 1)]
    rows = rows.withColumn("wrong", F.least(*apart))
    there = F.forall(F.get(numbers, F.col("t")), lambda x: F.array_contains(F.col("words"), x))
    named = F.array_sort(F.array_intersect(F.slice("words", F.lit(1), F.greatest(F.col("n"), F.lit(0))), F.array(*[F.lit(w) for w in NAMES])))
    return rows.select("uid", "t", "at", "wrong", ((F.col("wrong") <= F.col("edits")) & there & (named == F.get(names, F.col("t")))).alias("agree"))
