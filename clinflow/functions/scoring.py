"""Severity, risk band and ranking expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinflow.lookups.severity import RISK_BANDS, UNKNOWN_WEIGHT
from clinflow.functions.text import normalise_term


def base_weight(symptoms: Column, weights: dict[str, int]) -> Column:
    """J1 inside a row: sum of the weights of the raw terms; repeats count again."""
    table = F.create_map(*[F.lit(item) for pair in weights.items() for item in pair])
    known = F.transform(
        symptoms, lambda term: F.coalesce(F.try_element_at(table, normalise_term(term)), F.lit(UNKNOWN_WEIGHT))
    )
    return F.aggregate(known, F.lit(0), lambda total, weight: total + weight)


def severity_score(base: Column, duration_days: Column, age: Column) -> Column:
    """truncated product of base, duration factor (at most 2) and age factor, at most 100."""
    duration = F.least(F.lit(1.0) + duration_days * F.lit(0.1), F.lit(2.0))
    factor = F.when((age > 60) | (age < 5), F.lit(1.3)).otherwise(F.lit(1.0))
    return F.least((base * duration * factor).cast("int"), F.lit(100))


def risk_level(score: Column) -> Column:
    """level only; the band table carries tests and advice."""
    level = None
    for low, name, *_ in RISK_BANDS:
        if low is None:
            return level.otherwise(F.lit(name))
        hit = score >= low
        level = F.when(hit, F.lit(name)) if level is None else level.when(hit, F.lit(name))
    return level


def f1_score(overlap: Column, wanted: Column, known: Column, places: int | None = 4) -> Column:
    """Harmonic mean of overlap/wanted and overlap/known, rounded unless `places` is None."""
    precision, recall = overlap / wanted, overlap / known
    score = F.lit(2.0) * (precision * recall) / (precision + recall)
    return score if places is None else F.round(score, places)


def advisory_text(predictions: Column, score: Column, level: Column, advice: Column,
                  snippets: Column, otc: Column, prescription: Column) -> Column:
    """the text that asks for a summary of one scored request."""
    lines = F.transform(
        F.slice(predictions, 1, 3),
        lambda p, at: F.format_string("  %d. %s (%.1f%%)", at + 1, p["disease"], p["confidence"] * 100),
    )
    cut = F.transform(F.slice(snippets, 1, 2), lambda text: F.substring(text, 1, 200))
    knowledge = F.when(F.size(snippets) > 0, F.array_join(cut, "\n")).otherwise(F.lit("No additional context."))

    def names(items: Column, most: int, other: str) -> Column:
        return F.when(F.size(items) > 0, F.array_join(F.slice(items, 1, most), ", ")).otherwise(F.lit(other))

    return F.concat_ws(
        "\n",
        F.lit("Top predicted conditions:"), F.array_join(lines, "\n"),
        F.format_string("Risk level: %s (severity score %d/100)", level, score),
        F.concat(F.lit("Advice: "), advice),
        F.lit("Knowledge:"), knowledge,
        F.concat(F.lit("OTC medicines: "), names(otc, 3, "see a pharmacist")),
        F.concat(F.lit("Prescription medicines: "), names(prescription, 2, "consult a doctor")),
    )
