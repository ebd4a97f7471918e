"""Lexical analysis in Russian, English and Chinese, and an index of postings on
disk that a search reads by the terms asked.

Stemming is a table of rules per language (the public Porter and Snowball
algorithms), applied as expressions to the distinct words of a corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import Saved, scope
from .retrieval import bm25_scores

#: Words without meaning. Fixed values.
STOP = """
a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему
теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам сказал ведь там потом себя ничего ей может
они тут где есть надо ней для мы тебя их чем была сам чтоб без будто человек чего раз тоже себе под жизнь будет ж тогда кто этот
говорил того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее кажется сейчас были куда зачем сказать всех
никогда сегодня можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве сказала
три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между
""".split()

#: Letters that stand for a syllable or a word of their own.
_CJK = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}"
#: A run of such letters, or a word of others: letters, marks and digits, with an
#: apostrophe, point or colon between letters, a point or comma between digits.
#: What is often met is looked for first, scripts only beyond the first 128 signs.
_OFTEN, _FAR = "A-Za-z0-9_\\u00aa\\u00b5\\u00ba\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff\\u0400-\\u0481", "\\u0080-\\x{10FFFF}"
_PART = f"[{_OFTEN}[{_FAR}&&[\\p{{L}}\\p{{M}}\\p{{Nd}}]&&[^{_CJK}]]]+"
_TOKEN = f"({_PART}(?:(?:(?<=\\p{{L}})['’.:](?=\\p{{L}})|(?<=\\p{{Nd}})[.,;'](?=\\p{{Nd}})){_PART})*|[{_FAR}&&[{_CJK}]]+)"
#: Full-width signs and their plain forms.
_WIDE, _PLAIN = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))

#: Asked terms that travel to all tasks at most; tokens that are packed by word at once, about.
ASKED, PACKED = 100_000, 1 << 20


def _plain(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.lower(F.when(whole.rlike(f"[{_WIDE[0]}-{_WIDE[-1]}]"), F.translate(whole, _WIDE, _PLAIN)).otherwise(whole))


def _words(plain: Column) -> Column:
    return F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(1))


def _pairs(plain: Column, found: Column) -> Column:
    """``found`` with runs of Chinese, Japanese and Korean letters as pairs; texts without such letters stay as they are."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, 2))
    each = F.flatten(F.transform(found, lambda w: F.when(w.rlike(f"^[{_CJK}]"), pairs(w)).otherwise(F.array(w))))
    return F.when(plain.rlike(f"[{_FAR}&&[{_CJK}]]"), each).otherwise(found)


def tokens(text: Column) -> Column:
    """Lower-cased words; runs of Chinese, Japanese and Korean letters as pairs
    of neighbours (one alone stays alone); without words that mean nothing (T25)."""
    plain = _plain(text)
    return F.filter(_pairs(plain, _words(plain)), lambda w: ~w.isin(*STOP))


def exact_tokens(text: Column) -> Column:
    """Lower-cased runs of other than blanks: formulas, units and grades as they are."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != "")


# ---- English

_C, _V = "[^aeiou]", "[aeiouy]"
_CC, _VV = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
#: A measure above 0, of just 1, above 1; a vowel; a consonant, vowel and consonant at the end.
_M0, _M1, _M2 = f"^(?:{_CC})?{_VV}{_CC}", f"^(?:{_CC})?{_VV}{_CC}(?:{_VV})?$", f"^(?:{_CC})?{_VV}{_CC}{_VV}{_CC}"
_HAS_VOWEL, _CVC = f"^(?:{_CC})?{_V}", f"^{_CC}{_V}[^aeiouwxy]$"
#: Endings and what they become where the rest has a measure above 0. Fixed values.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
#: Endings that go where the rest has a measure above 1. Fixed values.
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _rest(w: Column, ending: str) -> Column:
    return F.regexp_replace(w, f"(?:{ending})$", "")


def _becomes(w: Column, table: str) -> Column:
    """The first rule by the longest ending; a word whose rest is too short stays."""
    rules = sorted((r.split(":") for r in table.split()), key=lambda r: -len(r[0]))
    out = w
    for ending, to in reversed(rules):
        rest = _rest(w, ending)
        out = F.when(w.endswith(ending), F.when(rest.rlike(_M0), F.concat(rest, F.lit(to))).otherwise(w)).otherwise(out)
    return out


def english_steps() -> list:
    """The steps of the English stemmer, each a function from a word to a word."""

    def plural(w):
        return F.when(w.rlike("(?:ss|i)es$"), F.regexp_replace(w, "es$", "")).when(w.rlike("[^s]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)

    def past(w):
        cut = F.when(_rest(w, "ed").rlike(_HAS_VOWEL) & w.endswith("ed"), _rest(w, "ed")).when(w.endswith("ing") & _rest(w, "ing").rlike(_HAS_VOWEL), _rest(w, "ing"))
        mended = F.when(cut.rlike("(?:at|bl|iz)$"), F.concat(cut, F.lit("e"))).when(cut.rlike("([^aeiouylsz])\\1$"), F.regexp_replace(cut, ".$", "")).when(cut.rlike(_CVC), F.concat(cut, F.lit("e"))).otherwise(cut)
        return F.when(w.endswith("eed"), F.when(_rest(w, "eed").rlike(_M0), F.regexp_replace(w, "d$", "")).otherwise(w)).when(cut.isNotNull(), mended).otherwise(w)

    def final_y(w):
        return F.when(w.endswith("y") & _rest(w, "y").rlike(_HAS_VOWEL), F.concat(_rest(w, "y"), F.lit("i"))).otherwise(w)

    def suffix(w):
        out = F.when(w.rlike("[st]ion$"), F.when(_rest(w, "ion").rlike(_M2), _rest(w, "ion")).otherwise(w)).otherwise(w)
        for ending in sorted(_STEP4.split(), key=len):
            rest = _rest(w, ending)
            out = F.when(w.endswith(ending), F.when(rest.rlike(_M2), rest).otherwise(w)).otherwise(out)
        return out

    def final_e(w):
        rest = _rest(w, "e")
        goes = rest.rlike(_M2) | (rest.rlike(_M1) & ~rest.rlike(_CVC))
        return F.when(w.endswith("e") & goes, rest).otherwise(w)

    def final_ll(w):
        return F.when(w.endswith("ll") & w.rlike(_M2), F.regexp_replace(w, "l$", "")).otherwise(w)

    return [plural, past, final_y, lambda w: _becomes(w, _STEP2), lambda w: _becomes(w, _STEP3), suffix, final_e, final_ll]


# ---- Russian

#: What is before the region of endings: all up to the first vowel.
_HEAD = "^([^аеиоуыэюя]*[аеиоуыэюя]"
#: Endings, the first group of each only behind а or я. Fixed values.
_GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
_PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"


def _ends(endings: str, behind: str = "") -> str:
    """A word with one of the endings, the longest, in its region."""
    return f"{_HEAD}.*?{behind})(?:{'|'.join(sorted(endings.split(), key=len, reverse=True))})$"


def _either(w: Column, groups: tuple[str, str]) -> Column | None:
    """Without an ending of either group, null if it has none; the longer ending counts."""
    first, second = _ends(groups[0], "[ая]"), _ends(groups[1])
    a, b = F.regexp_replace(w, first, "$1"), F.regexp_replace(w, second, "$1")
    return F.when(w.rlike(first) & w.rlike(second), F.when(F.length(a) < F.length(b), a).otherwise(b)).when(w.rlike(second), b).when(w.rlike(first), a)


def russian_steps() -> list:
    """The steps of the Russian stemmer, each a function from a word to a word."""

    def inflection(w):
        bare = F.regexp_replace(w, f"{_HEAD}.*)с[яь]$", "$1")
        adjective = F.regexp_replace(bare, _ends(_ADJECTIVE), "$1")
        participle = F.coalesce(_either(adjective, _PARTICIPLE), adjective)
        noun = F.regexp_replace(bare, _ends(_NOUN), "$1")
        return F.coalesce(_either(w, _GERUND), F.when(bare.rlike(_ends(_ADJECTIVE)), participle), _either(bare, _VERB), noun)

    def final_i(w):
        return F.regexp_replace(w, f"{_HEAD}.*)и$", "$1")

    def derived(w):
        v, c = "[аеиоуыэюя]", "[^аеиоуыэюя]"
        return F.regexp_replace(w, f"^(.*?{v}{c}.*?{v}{c}.*)ость?$", "$1")

    def tidy(w):
        plain = F.regexp_replace(w, f"{_HEAD}.*)ейше?$", "$1")
        return F.when(plain.rlike(f"{_HEAD}.*н)н$"), F.regexp_replace(plain, "н$", "")).when(plain != w, plain).otherwise(F.regexp_replace(w, f"{_HEAD}.*)ь$", "$1"))

    return [lambda w: F.replace(w, F.lit("ё"), F.lit("е")), inflection, final_i, derived, tidy]


def stemmed(words: DataFrame, word: str) -> DataFrame:
    """``words`` with ``stem``: English words of three letters or more by the
    English rules, Russian words by the Russian ones, others as they are (T25).
    A lambda binds what a step gives to the next, so that it isn't worked out
    anew for each of its rules."""
    english, russian = F.col(word).rlike("^[a-z]{3,}$"), F.col(word).rlike("^[а-яё]+$")
    with scope() as tables:
        parts = []
        for which, steps in ((english, english_steps()), (russian, russian_steps())):
            part = words.where(which).withColumn("stem", F.col(word))
            for step in steps:
                part = part.withColumn("stem", F.element_at(F.transform(F.array("stem"), step), 1))
            parts.append(part)
        rest = words.where(~F.coalesce(english | russian, F.lit(False))).withColumn("stem", F.col(word))
        return tables.result(parts[0].unionByName(parts[1]).unionByName(rest), "stems")


# ---- the index


def _packed(batches):
    """(word, docs, ns): of some texts at a time each word, the documents that have it and how often."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("tokens").flatten())
        if size >= PACKED:
            yield _by_word(held)
            held, size = [], 0
    if size:
        yield _by_word(held)


def _by_word(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    tokens, docs = table.column("tokens").combine_chunks(), table.column("doc").combine_chunks()
    words = tokens.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    pair, n = np.unique(words.indices.to_numpy() * np.int64(len(tokens)) + row, return_counts=True)
    word, row = np.divmod(pair, len(tokens))
    ends = pa.array(np.r_[0, np.cumsum(np.bincount(word, minlength=len(words.dictionary)))].astype(np.int32))
    return pa.RecordBatch.from_arrays([words.dictionary, pa.ListArray.from_arrays(ends, docs.take(pa.array(row))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int64)))], ["word", "docs", "ns"])


def frequencies(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(doc, term, tf): stems of all texts and how often they stand there. Words
    are counted in their task first, and leave it as one row each for about
    a million tokens; only distinct ones are stemmed. So only stems are shuffled
    row by row."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), _plain(text).alias("plain"))
    rows = rows.select("doc", "plain", _words(F.col("plain")).alias("found")).select("doc", _pairs(F.col("plain"), F.col("found")).alias("tokens"))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    kind = rows.schema["doc"].dataType.simpleString()
    packed = rows.mapInArrow(_packed, f"word string, docs array<{kind}>, ns array<bigint>")
    found = Saved(packed.where(~F.col("word").isin(*STOP)), "lexical-words").df
    stems = Saved(stemmed(found.select("word").distinct(), "word").withColumnRenamed("word", "w"), "lexical-stems").df
    each = found.join(stems, F.col("word") == F.col("w")).select(F.col("stem").alias("term"), F.inline(F.arrays_zip("docs", "ns")).alias("doc", "n"))
    return each.groupBy("doc", "term").agg(F.sum("n").alias("tf"))


def build_index(docs: DataFrame, id_col: str, text: Column, folder: str, buckets: int = 256, rows: int = 1 << 20) -> None:
    """Write the postings (term, doc, tf) of all texts, and the documents' sizes,
    to a folder all executors share.

    Postings lie in partitions by a hash of the term, sorted by term, so a search
    opens only the partitions and row groups of its terms. A partition is written
    by several tasks where it has more than ``rows`` rows on average, dealt by
    document, so a common term is in no single task."""
    with scope():
        tf = Saved(frequencies(docs, id_col, text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")), "lexical-tf").df
        parts = max(1, -(-tf.count() // (buckets * rows)))
        dealt = tf.repartition(buckets * parts, "bucket", F.pmod(F.xxhash64("doc"), F.lit(parts)))
        dealt.sortWithinPartitions("bucket", "term", "doc").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        tf.groupBy("doc").agg(F.sum("tf").alias("size")).write.mode("overwrite").parquet(f"{folder}/sizes")
        docs.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings")


def read_postings(spark: SparkSession, folder: str, terms: DataFrame) -> DataFrame:
    """The postings (token, doc, tf) of ``terms`` (token): the partitions that
    can hold them are chosen before anything is read."""
    buckets = spark.read.parquet(f"{folder}/settings").first()["buckets"]
    asked = Saved(terms.select("token").distinct(), "lexical-asked").df
    kept = [r["b"] for r in asked.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]  # as many as buckets at most
    few = asked.count() <= ASKED
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(kept))
    if few and asked.count() <= 200:  # so few that the scan itself can leave out other terms' row groups
        postings = postings.where(F.col("term").isin([r["token"] for r in asked.collect()]))
    side = F.broadcast(asked) if few else asked
    return postings.withColumnRenamed("term", "token").join(side, "token", "left_semi").select("token", "doc", "tf")


def search(spark: SparkSession, folder: str, queries: DataFrame, query_col: str, text: Column, most: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rank): the ``most`` best documents of an index for
    each query by BM25, scores to four places, ties to the smaller document (R02)."""
    with scope() as tables:
        asked = frequencies(queries, query_col, text).select(F.col("doc").alias("query"), F.col("term").alias("token"))
        asked = Saved(asked.distinct(), "lexical-queries").df
        tf = Saved(read_postings(spark, folder, asked), "lexical-hits").df
        scored = bm25_scores(tf, spark.read.parquet(f"{folder}/sizes"), asked, k1, b).withColumn("score", F.round("score", 4))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
        return tables.keep(Saved(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most), "lexical-found"))
