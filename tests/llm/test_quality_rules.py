"""Quality rules against plain Python, and on held-out labels."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm import queries
from sparkloom.llm.quality_rules import FEATURES, features, learn, quality_rules, text_statistics

SPACE = "[^\\x20\\x09-\\x0D]"


def _counts(text):
    t = text or ""
    w = re.findall(f"{SPACE}+", t)
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def _texts():
    r = random.Random(11)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(1, 8))) for _ in range(60)] + ["日本語", "Ünï\xa0x", "a b", "𝄞𝄞", "x|y", "<b>", "&&", "\x1c"]
    say = lambda n: " ".join(r.choices(vocab, k=n))
    part = say(11)
    out = [None, "", " \t\r\n", "one", say(19), say(20), "w " * 500, "\n".join([part, say(9), part, "", "  ", part + " "]), say(3000)]
    out += [f"{say(n)} {part}\n{say(n)}\t{part}\x0b{say(3)}" for n in (2, 5, 20, 60)]
    out += [" ".join((part.split() * 3)[: 8 + k]) for k in range(20)] + [part] * 3
    return out


def test_statistics_against_a_plain_loop(spark, sf):
    rows = list(enumerate(_texts())) + [(None, "no id"), (3, "again " * 30)]
    real = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for some in (rows, real):
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in some], "doc_id long, text string, n_words string, row int")
        labels = spark.createDataFrame([], "doc_id long, quality int")
        got = quality_rules(df, labels).collect()
        want = [(i, *_counts(t)) for i, t in some]
        assert sorted((tuple(x)[:7] for x in got), key=str) == sorted(want, key=str)
        assert all(x.kept != x.base_failed and x.rule is None for x in got)  # nothing to learn from
        assert quality_rules(df.limit(0), labels).count() == 0


def test_learned_list_is_right_on_held_out_labels(spark, sf):
    documents, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    truth = {x.doc_id: x.quality for x in labels.collect()}
    got = quality_rules(documents, labels.where("doc_id % 3 > 0")).collect()
    assert len(got) == documents.count()
    held = [x for x in got if x.doc_id in truth and x.doc_id % 3 == 0 and not x.base_failed]
    right = sum(x.kept == (truth[x.doc_id] != 0) for x in held)
    good = [x for x in held if truth[x.doc_id] != 0]
    assert right >= 0.97 * len(held) and sum(x.kept for x in good) >= 0.99 * len(good)
    assert {x.rule is None for x in got if x.kept} == {True} and any(x.rule for x in got)


def _learned(rows, most=3, precision=0.9, quantiles=24):
    """Sequential covering row by row; rows of (features, bad, prune)."""
    cuts = {}
    for c in FEATURES:
        values = set()
        for side in (True, False):
            v = sorted(x[0][c] for x in rows if x[1] == side)
            values |= {v[max(0, math.ceil(i / quantiles * len(v)) - 1)] for i in range(quantiles + 1)}
        values = sorted(values)
        cuts[c] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    holds = lambda x, rule: all((x[0][c] > t) == above for c, above, t in rule)
    rules = []
    while True:
        open_ = [x for x in rows if not any(holds(x, r) for r in rules)]
        grown = []
        while len(grown) < most:
            now = [x for x in open_ if not x[2] and holds(x, grown)]
            bad = sum(x[1] for x in now)
            if not bad or bad == len(now):
                break
            found = []
            for c in sorted(FEATURES):
                for t in cuts[c]:
                    for above in (False, True):
                        kept = [x for x in now if (x[0][c] > t) == above]
                        b = sum(x[1] for x in kept)
                        if b and len(kept) < len(now):
                            found.append((-b * (math.log2(b / len(kept)) - math.log2(bad / len(now))), c, len(kept), cuts[c].index(t), above, t))
            best = min(found, default=(0.0,))
            if best[0] >= 0:
                break
            grown.append((best[1], best[4], best[5]))
        if not grown:
            return rules

        def share(rule, some):
            kept = [x[1] for x in some if holds(x, rule)]
            return sum(kept), len(kept)

        prune = [x for x in open_ if x[2]]
        worth = lambda k: (lambda b, n: (2 * b - n) / max(1, n))(*share(grown[:k], prune))
        k = max(range(1, len(grown) + 1), key=lambda k: (worth(k), -k))
        if not all(b and b >= precision * n for b, n in (share(grown[:k], prune), share(grown[:k], open_))):
            return rules
        rules.append(grown[:k])


def test_covering_against_a_plain_loop(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        x = {c: round(r.random(), 2) for c in FEATURES}
        bad = x["digit_share"] > 0.8 or (x["word_length"] > 0.6 and x["capital_share"] <= 0.4)
        rows.append((i, x, bad != (r.random() < 0.03)))
    df = spark.createDataFrame([(i, *x.values(), b) for i, x, b in rows], f"id long, {', '.join(f'{c} double' for c in FEATURES)}, bad boolean")
    prune = {x.id for x in df.where("pmod(xxhash64(id), 3) = 0").collect()}
    got = learn(df, "id", F.col("bad")).rules
    want = _learned([(x, b, i in prune) for i, x, b in rows])
    assert [[(c.feature, c.above, c.threshold) for c in rule] for rule in got] == want and len(want) >= 2
    assert learn(df.where("bad"), "id", F.col("bad")).rules == () == learn(df.limit(0), "id", F.col("bad")).rules


def test_query(spark, sf):
    got = queries.op11_quality_rules(spark, sf)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    stats = text_statistics(spark.createDataFrame([(1, "A1! b.")], "doc_id long, text string")).select(*features()).first()
    assert stats.capital_share == 0.2 and stats.digit_share == 0.2 and stats.marks_per_word == 0.5
