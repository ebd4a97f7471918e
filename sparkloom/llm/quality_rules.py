"""Quality rules: decision lists learned by sequential covering.

Statistics of texts, counts for growing and pruning rules, and the finished
list, an ordered conditional expression, are DataFrame functions throughout.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Saved, scope

#: White space between words: blank, and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words in a window that may repeat.
WINDOW = 8
#: What rules are made of: name -> expression over the statistics of ``text_statistics``.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "repeated_line_share": "n_dup_lines / n_lines",
    "repeated_word_share": "n_repeat_words / n_words",
    "capital_share": "n_capitals / word_chars",
    "digit_share": "n_digits / word_chars",
    "stops_per_word": "n_stops / n_words",
    "marks_per_word": "n_marks / n_words",
    "words_per_line": "n_words / n_lines",
}


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows' columns as one struct ``row``, and counts over the whole text.

    ``n_words`` (runs of other than blanks), ``word_chars`` (code points in
    them), ``n_symbols``, ``n_lines`` (with a word), ``n_dup_lines`` (of these,
    equal to an earlier one), ``n_repeat_words`` (words inside windows of 8
    that stand in the text twice or more), ``n_capitals`` (A-Z), ``n_digits``
    (0-9), ``n_stops`` (``.``, ``:``, ``;``, ``?``) and ``n_marks`` (``!``).
    Windows are compared by a 64-bit hash. A null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), text.alias("text"))
    without = lambda letters: F.length("text") - F.length(F.translate("text", letters, ""))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    found = rows.select(
        "row",
        F.transform(words, lambda w: F.xxhash64(w)).alias("w"),
        lines.alias("lines"),
        F.length(F.translate("text", BLANKS, "")).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        without("0123456789").alias("n_digits"),
        without(".:;?").alias("n_stops"),
        without("!").alias("n_marks"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)]))
    found = found.withColumn("grams", F.when(F.size("w") >= WINDOW, windows))
    found = found.withColumn("twice", F.size(F.array_distinct("grams")) < F.size("grams"))
    # windows sorted by hash and place: those beside an equal one are found twice or more
    found = found.withColumn("sorted", F.when(F.col("twice"), F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get(F.col("sorted"), k)["g"] == x["g"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.col("n_symbols"),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.col("twice"), covered).otherwise(0),
        **{c: F.col(c) for c in ("n_capitals", "n_digits", "n_stops", "n_marks")},
    }
    return found.select("row", *[x.cast("long").alias(c) for c, x in counts.items()])


def features() -> list[Column]:
    """The features, 0 where there is nothing to divide by."""
    return [F.coalesce(F.expr(f"CAST(try_divide({e.replace(' / ', ', ')}) AS double)"), F.lit(0.0)).alias(name) for name, e in FEATURES.items()]


@dataclass(frozen=True)
class Condition:
    """A feature above (or not above) a threshold."""

    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > self.threshold if self.above else x <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects a text, and
    a text that meets none is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule(self) -> Column:
        """The text of the first rule that holds, null if none does: one
        conditional expression over the features."""
        found = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            holds = reduce(lambda a, b: a & b, [c.column() for c in rule])
            found = F.when(holds, F.lit(" AND ".join(map(str, rule)))).otherwise(found)
        return found


def _cuts(low_high: list[list[float]]) -> list[float]:
    """Midpoints between neighbouring values: a threshold keeps its distance
    from the rows on both sides."""
    values = sorted({x for part in low_high for x in part})
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def learn(labelled: DataFrame, id_col: str, bad: Column, quantiles: int = 24, precision: float = 0.9, most_conditions: int = 3, most_rules: int = 16) -> DecisionList:
    """A decision list for the rows where ``bad`` is true, from all rows of
    ``labelled`` (the features and ``id_col``; rows where ``bad`` is null tell nothing).

    Thresholds lie midway between neighbouring values among each class's
    ``quantiles`` quantiles, least and largest value. Rows become cells (the
    number of thresholds each feature exceeds) with counts; everything after
    reads these. Sequential covering: on two thirds of the rows (by a hash of
    the id) a rule grows by the condition with the highest information gain
    until it holds for no good row, gains nothing more or has
    ``most_conditions``; on the other third it is cut back to the beginning
    with the highest (bad - good) / (bad + good), the shorter of equals. It is
    taken if at least ``precision`` of the rows it holds for are bad, in that
    third and in all; its rows leave, and the next rule is grown for the rest,
    until one fails or there are ``most_rules``. What a step brings to the
    driver are counts by feature and threshold.

    Without rows of both classes the list is empty, and keeps all.
    """
    names = list(FEATURES)
    rows = labelled.where(bad.isNotNull()).select(*names, bad.alias("bad"), (F.pmod(F.xxhash64(id_col), F.lit(3)) == 0).alias("prune"))
    rows = Saved(rows, "rules-rows").df
    shares = [i / quantiles for i in range(quantiles + 1)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(c, shares, 2000).alias(c) for c in names]).collect()
    if len(found) < 2:
        return DecisionList(())
    cuts = {c: _cuts([r[c] for r in found]) for c in names}
    exceeded = lambda c: F.size(F.filter(F.lit(cuts[c]).cast("array<double>"), lambda t: F.col(c) > t))
    cells = Saved(rows.select(*[exceeded(c).alias(c) for c in names], "bad", "prune").groupBy(*names, "bad", "prune").agg(F.count("*").alias("n")), "rules-cells").df

    def column(rule: list[tuple[str, bool, int]]) -> Column:
        """Holds for a cell; a condition is (feature, above, number of the threshold)."""
        return reduce(lambda a, b: a & b, [F.col(c) > k if above else F.col(c) <= k for c, above, k in rule], F.lit(True))

    rules: list[list[tuple[str, bool, int]]] = []
    while len(rules) < most_rules:
        open_ = reduce(lambda a, rule: a & ~column(rule), rules, F.lit(True))
        grown: list[tuple[str, bool, int]] = []
        while len(grown) < most_conditions:
            step = _best_condition(cells.where(open_ & column(grown) & ~F.col("prune")), {c: len(x) for c, x in cuts.items()})
            if step is None:
                break
            grown.append(step)
        if not grown:
            break
        rule = _pruned(cells.where(open_), grown, column, precision)
        if rule is None:
            break
        rules.append(rule)
    return DecisionList(tuple(tuple(Condition(c, above, cuts[c][k]) for c, above, k in rule) for rule in rules))


def _best_condition(cells: DataFrame, sizes: dict[str, int]) -> tuple[str, bool, int] | None:
    """The condition with the highest gain: bad rows it keeps, times the rise
    of the logarithm of their share; None if none gains or no good row is left.
    Ties: by name, the fewer rows kept, the lower threshold."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bin")) for c in sizes]))
    rows = cells.select(each.alias("f"), "bad", "n").groupBy("f.feature", "f.bin", "bad").agg(F.sum("n").alias("n")).collect()
    counts = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for r in rows:
        counts[r["feature"]][r["bin"]][r["bad"]] += r["n"]
    some = next(iter(counts.values()), {})
    good, bad = (sum(x[side] for x in some.values()) for side in (0, 1))
    if not good or not bad:
        return None
    found = []
    for c in sorted(counts):
        below = [0, 0]
        for k in range(sizes[c]):
            below = [below[side] + counts[c][k][side] for side in (0, 1)]
            for above, (g, b) in ((False, below), (True, [good - below[0], bad - below[1]])):
                if b and g + b < good + bad:
                    gain = b * (math.log2(b / (g + b)) - math.log2(bad / (good + bad)))
                    found.append((-gain, c, g + b, k, above))
    best = min(found, default=(0.0,))
    return (best[1], best[4], best[3]) if best[0] < 0 else None


def _pruned(cells: DataFrame, grown: list[tuple[str, bool, int]], column, precision: float) -> list[tuple[str, bool, int]] | None:
    """The best beginning of a grown rule, or None if it isn't precise enough."""
    lengths = range(1, len(grown) + 1)
    side = {"good": ~F.col("bad"), "bad": F.col("bad")}
    wanted = [F.coalesce(F.sum(F.when(column(grown[:k]) & x & where, F.col("n"))), F.lit(0)).alias(f"{name}_{which}_{k}") for k in lengths for name, x in side.items() for which, where in (("prune", F.col("prune")), ("all", F.lit(True)))]
    r = cells.agg(*wanted).first()
    worth = lambda k: (r[f"bad_prune_{k}"] - r[f"good_prune_{k}"]) / max(1, r[f"bad_prune_{k}"] + r[f"good_prune_{k}"])
    best = max(lengths, key=lambda k: (worth(k), -k))
    sure = all(r[f"bad_{which}_{best}"] > 0 and r[f"bad_{which}_{best}"] >= precision * (r[f"bad_{which}_{best}"] + r[f"good_{which}_{best}"]) for which in ("prune", "all"))
    return grown[:best] if sure else None


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: the id, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept`` and ``rule``.

    ``base_failed``: under 20 words, or over 30 per cent of them in repeated
    windows. Other texts go by a decision list learned from those of them that
    ``labels`` (id, label: 0 is bad) names; ``rule`` is the text of the rule
    that rejected one, else null. Statistics of all texts are saved once; the
    labelled ones among them are joined by id.

    A null text is empty and fails the base. Null ids are kept as null and have
    no label; repeated rows are rows each. An id with several labels, or
    several texts, is learned from in each combination; null labels tell
    nothing. Without labels of both kinds all rows that pass the base are kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    with scope() as tables:
        return tables.keep(Saved(_judged(docs, labels, id_col, text_col, label_col), "quality"))


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    stats = text_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = Saved(stats.withColumn("base_failed", failed).select(F.col("row.id").alias("id"), "*").drop("row"), "quality-statistics").df
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("label_id"), (F.col(label_col) == 0).alias("bad"))
    passed = stats.where("NOT base_failed").select("id", *features())
    found = learn(passed.join(known, F.col("id") == F.col("label_id")).drop("label_id"), "id", F.col("bad"))
    judged = stats.select("*", *features()).withColumn("rule", F.when(~F.col("base_failed"), found.rule()))
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule")
