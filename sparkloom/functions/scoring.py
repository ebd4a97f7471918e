"""Scores of ideas and evidence, as expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import clamp01, round3

#: Weights of the ranking's factors. Fixed values.
RANK_WEIGHTS = {"kpi_fit": 0.25, "evidence": 0.20, "novelty": 0.20, "value": 0.15, "risk": 0.10, "trl_fit": 0.10}
#: Factors of the review status. Fixed values.
STATUS_FACTORS = {"approved": 1.15, "rejected": 0.4}


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    """A user's weights, in [0, 1] and with a positive sum, divided by it (M11,
    E04): what ``composite`` takes in place of the fixed ones."""
    if any(not 0 <= w <= 1 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must lie in [0, 1] and not all be 0")
    return {k: w / sum(weights.values()) for k, w in weights.items()}


def composite(factors: Mapping[str, Column], status: Column, weights: Mapping[str, float] = RANK_WEIGHTS) -> Column:
    """Sum of contributions rounded to three places, times the status factor,
    clamped and rounded again (D01). Null factors count as 0.5; of the risk what
    is missing to 1 counts."""
    worth = lambda k: 1 - clamp01(factors[k]) if k == "risk" else clamp01(factors[k])
    total = sum((round3(F.lit(w) * worth(k)) for k, w in weights.items()), F.lit(0.0))
    factor = F.lit(1.0)
    for name, x in STATUS_FACTORS.items():
        factor = F.when(status == name, x).otherwise(factor)
    return round3(F.least(F.greatest(total * factor, F.lit(0.0)), F.lit(1.0)))


def kpi_fit(confidence: Column, has_kpi: Column, measurable: Column) -> Column:
    """D02; 0.5 where neither confidence nor KPI nor measure is known. A missing
    confidence counts as 0.5 otherwise."""
    unknown = confidence.isNull() & ~has_kpi & ~measurable
    some = 0.65 * clamp01(confidence) + 0.20 * F.when(has_kpi, 1.0).otherwise(0.4) + 0.15 * F.when(measurable, 1.0).otherwise(0.3)
    return F.when(unknown, 0.5).otherwise(some)


def evidence_confidence(supports: Column, contradicts: Column, verdict: Column) -> Column:
    """Amount and balance of independent sources, corrected by the verdict."""
    raw = 0.5 * F.least(F.lit(1.0), supports / 4) + 0.5 * (supports + 1) / (supports + contradicts + 2)
    by = F.when(verdict == "supported", raw * 0.85 + 0.15).when(verdict == "mixed", raw * 0.8).when(verdict == "refuted", raw * 0.35).when(verdict == "insufficient", raw * 0.7).otherwise(raw)
    return F.when((supports + contradicts == 0) & (F.coalesce(verdict, F.lit("")) == ""), 0.5).otherwise(by)


def transfer_score(similarity: Column, strength: Column, has: Column, covered: int = 5) -> Column:
    """Similarity of the goals times the strength of what is transferred
    times what the recipient lacks of ``covered``, each in [0, 1], to four
    places. A missing strength counts as 0."""
    unit = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.round(unit(unit(similarity) * unit(strength) * (1 - unit(has / covered))), 4)


def trl_fit(trl: Column) -> Column:
    """D04."""
    return F.when(trl.isNull() | (trl < 1), 0.5).otherwise((F.least(trl, F.lit(9)) - 1) / 8)


def reconcile(verdict: Column, contradicts: Column) -> Column:
    """A contradiction turns supported or insufficient into mixed."""
    return F.when((contradicts > 0) & verdict.isin("supported", "insufficient"), "mixed").otherwise(verdict)


def evidence_quality(n: Column, supports: Column, contradicts: Column) -> Column:
    """Amount of evidence, and whether both stances are there; 0 without any."""
    both = (supports > 0) & (contradicts > 0)
    raw = 0.7 * F.least(F.lit(1.0), n / 5) + 0.3 * F.when(both, 1.0).otherwise(0.6)
    return F.when(n <= 0, 0.0).otherwise(round3(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))))


def belief(verdict: Column, confidence: Column, quality: Column) -> Column:
    """How far a statement is believed; a missing confidence counts as 0.5."""
    sure = clamp01(confidence)
    return round3(F.when(verdict == "supported", sure).when(verdict == "refuted", 1 - sure).when(verdict == "mixed", 0.4).otherwise(0.3 * quality))


def learning_priority(value: Column, belief_: Column, quality: Column) -> Column:
    """Worth learning about: valuable, undecided, and little known."""
    return clamp01(value) * (1 - 2 * F.abs(belief_ - 0.5)) * (1 - quality)


def queue(status: Column, trl: Column, verdict: Column) -> Column:
    """The primary work queue of an open row (F06); null once closed."""
    return F.when(status.isin("rejected", "archived"), F.lit(None)).when((status == "approved") | (verdict == "supported"), "ready").when(verdict.isin("refuted", "mixed"), "risk").when(verdict == "insufficient", "insufficient").otherwise("needs_verify")


def quality_gate(duplicate: Column, score: Column, mechanism: Column, plan: Column, grounded: Column, floor: float = 0.35) -> Column:
    """The first reason to archive a row, or null."""
    low = score < floor
    return F.when(duplicate, "duplicate").when(low & ~mechanism & ~plan, "no mechanism or plan").when(~grounded & low, "ungrounded")


def abstain(n_sources: Column, top: Column, reranked: Column, floor: float = 0.5) -> Column:
    """Answer nothing without sources, or if the best reranked one is below the floor."""
    return (n_sources == 0) | (reranked & (top < floor))


def priority_band(percent_: Column) -> Column:
    """K07."""
    return F.when(percent_.isNull(), "Medium").when(percent_ >= 80, "Highest").when(percent_ >= 60, "High").when(percent_ >= 35, "Medium").otherwise("Low")


def trl_level(met: Column) -> Column:
    """The highest level up to which all are met, at least 1; ``met`` maps
    levels from 1 to whether they are met, a missing level isn't."""
    first_gap = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(10)), lambda k: ~F.coalesce(F.element_at(met, k), F.lit(False)) | (k == 10)))
    return F.greatest(first_gap - 1, F.lit(1))


def completeness(checks: Mapping[str, Column]) -> tuple[Column, Column]:
    """The share of checks that hold, and the names of those that don't."""
    held = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks.values()), F.lit(0))
    missing = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return held / len(checks), missing


def novelty(close: Column, retrieved: Column, known: Column) -> Column:
    """One less the share of close sources; 0.5 without sources; less 0.2 for a known material."""
    return F.greatest(F.when(retrieved > 0, 1 - close / retrieved).otherwise(0.5) - F.when(known, 0.2).otherwise(0.0), F.lit(0.0))


def first_failure(gates: Mapping[str, Column]) -> Column:
    """The name of the first gate that doesn't hold, null if all do; an unknown gate fails."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(list(gates.items())):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out
