"""The whole scoring of symptom requests, and the trend batch over its logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinflow.functions.scoring import advisory_text, base_weight, risk_level, severity_score
from clinflow.lookups.severity import SEVERITY_WEIGHTS
from clinflow.operators import mapping, medicines, ranking
from clinflow.operators.cleanse import fill_log_defaults
from clinflow.operators.joining import lookup_join
from clinflow.operators.trends import disease_trend, recent_logs


@dataclass(frozen=True)
class Lookups:
    """Tables the scoring reads. `knowledge` has (disease, knowledge array of (disease, content))."""

    features: DataFrame
    synonyms: DataFrame
    diseases: DataFrame
    bands: DataFrame
    tiers: list[tuple[str, DataFrame]]
    knowledge: DataFrame | None = None


def with_severity(requests: DataFrame, bands: DataFrame, weights: dict[str, int] = SEVERITY_WEIGHTS) -> DataFrame:
    """J1 + F2 + F3 inside the row, with tests, advice and medicine type of the band."""
    base = base_weight(F.col("symptoms"), weights)
    scored = requests.withColumn("severity", severity_score(base, F.col("duration_days"), F.col("age")))
    scored = scored.withColumn("risk_level", risk_level(F.col("severity")))
    return lookup_join(scored, bands.select("risk_level", "tests", "advice", "medicine_type"), ["risk_level"])


def predictions(requests: DataFrame, lookups: Lookups, model_scores: DataFrame | None = None, top: int = 3,
                native: bool = False, resolved: DataFrame | None = None) -> DataFrame:
    """J2 → J6 (+ E4) → J7: ranked conditions per request; a request that matches no feature has none."""
    matched = mapping.map_symptoms(requests, lookups.features, lookups.synonyms, native=native, resolved=resolved)
    return blended(matched, lookups.diseases, model_scores, top)


def blended(matched: DataFrame, diseases: DataFrame, model_scores: DataFrame | None = None, top: int = 3) -> DataFrame:
    """J6 (+ E4) → J7 of (request_id, matched). The model only speaks for requests with a matched feature."""
    matched = matched.filter(F.size("matched") > 0)
    overlap = ranking.overlap_scores(matched, diseases)
    if model_scores is None:
        none = overlap.limit(0).select("request_id", "disease", "confidence", "pos")
        return ranking.blend_scores(overlap, none, top=top)
    asked = model_scores.join(matched.select("request_id"), "request_id", "left_semi")
    return ranking.blend_scores(overlap, ranking.top_probabilities(asked), top=top)


def score_requests(requests: DataFrame, lookups: Lookups, model_scores: DataFrame | None = None,
                   native: bool = False, resolved: DataFrame | None = None) -> DataFrame:
    """Requests (request_id, user_id, symptoms, duration_days, age; validated) with all results.

    `resolved` may bring the terms already resolved (`TermStore`).
    """
    ranked = predictions(requests, lookups, model_scores, native=native, resolved=resolved)
    lists = ranking.prediction_lists(ranked)
    none = F.array().cast("array<struct<disease:string,confidence:double>>")
    scored = with_severity(requests, lookups.bands).join(lists, "request_id", "left")
    scored = scored.withColumn("predictions", F.coalesce("predictions", none)).withColumn(
        "top_disease", F.coalesce("top_disease", F.lit("Unknown"))
    )
    named = scored.withColumnRenamed("top_disease", "disease")
    supplied = medicines.suggest_medicines(named, lookups.tiers).withColumnRenamed("disease", "top_disease")
    empty = F.array().cast("array<struct<disease:string,content:string>>")
    if lookups.knowledge is None:
        return supplied.withColumn("knowledge", empty)
    known = lookups.knowledge.select(F.col("disease").alias("top_disease"), F.col("knowledge").alias("_k"))
    return lookup_join(supplied, known, ["top_disease"], spread=["request_id"]).withColumn(
        "knowledge", F.coalesce("_k", empty)
    ).drop("_k")


def responses(scored: DataFrame) -> DataFrame:
    """P10: the nested answer of each request; knowledge texts cut to 300 characters."""
    return scored.select(
        "request_id", "predictions",
        F.struct(F.col("severity").alias("severity_score"), "risk_level", F.col("tests").alias("recommended_tests"), "advice").alias("risk"),
        F.struct(F.col("top_disease").alias("disease"), "otc", "prescription", "recommended", "source").alias("medicines"),
        F.transform("knowledge", lambda k: F.struct(
            F.coalesce(k["disease"], F.lit("Unknown")).alias("disease"), F.substring(k["content"], 1, 300).alias("content")
        )).alias("rag_knowledge"),
    )


def advisory_requests(scored: DataFrame) -> DataFrame:
    """F20 for each scored request."""
    snippets = F.transform("knowledge", lambda k: k["content"])
    return scored.select("request_id", advisory_text(
        F.col("predictions"), F.col("severity"), F.col("risk_level"), F.col("advice"), snippets, F.col("otc"), F.col("prescription")
    ).alias("request_text"))


def trend_batch(logs: DataFrame, as_of: Column, hours: int = 6) -> DataFrame:
    """S1 → P8 → A1."""
    return disease_trend(fill_log_defaults(recent_logs(logs, as_of, hours)))
