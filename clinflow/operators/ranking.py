"""Ranked conditions: overlap, model probabilities, and their blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinflow.functions.scoring import f1_score
from clinflow.operators.joining import by_key, lookup_join, top_rows

OVERLAP_SHARE = 0.7
MODEL_SHARE = 0.3
SCORER_TOP = 10


def overlap_scores(matched: DataFrame, diseases: DataFrame, key: str = "request_id", top: int | None = SCORER_TOP,
                   places: int | None = 4, salts: int = 1) -> DataFrame:
    """(key, disease, confidence, overlap, pos) of diseases that share features with the request.

    `matched` has (key, matched array), one row per request; `diseases` has (disease, features array).
    Both meet by feature, so a request only sees diseases that share one. Rows that repeat a disease
    are one disease with the features of all.
    """
    wanted = matched.select(
        key, F.size(F.array_distinct("matched")).alias("wanted"), F.explode(F.array_distinct("matched")).alias("feature")
    )
    whole = diseases.select("disease", F.explode("features").alias("feature")).groupBy("disease").agg(
        F.collect_set("feature").alias("features"))
    known = whole.select("disease", F.size("features").alias("known"), F.explode("features").alias("feature"))
    shared = (
        lookup_join(wanted, known, ["feature"], "inner", spread=[key], salts=salts)
        .groupBy(key, "disease")
        .agg(F.count("*").alias("overlap"), F.first("wanted").alias("wanted"), F.first("known").alias("known"))
    )
    scored = shared.select(
        key, "disease", f1_score(F.col("overlap"), F.col("wanted"), F.col("known"), places).alias("confidence"), "overlap"
    )
    if top is None:
        return scored
    return top_rows(scored, [key], [F.desc("confidence"), F.desc("overlap"), F.asc("disease")], top, "pos")


def top_probabilities(scores: DataFrame, key: str = "request_id", top: int = SCORER_TOP) -> DataFrame:
    """The largest probabilities above zero per request, to four places; `scores` has (key, disease, probability)."""
    ranked = top_rows(
        scores.filter(F.col("probability") > 0), [key], [F.desc("probability"), F.asc("disease")], top, "pos"
    )
    return ranked.select(key, "disease", F.round("probability", 4).alias("confidence"), "pos")


def probabilities_from_vector(scored: DataFrame, labels: list[str], key: str = "request_id", column: str = "probability") -> DataFrame:
    """One (key, disease, probability) row per class of a probability array."""
    return scored.select(key, F.posexplode(column).alias("at", "probability")).select(
        key, F.get(F.lit(labels), F.col("at")).alias("disease"), "probability"
    )


def blend_scores(overlap: DataFrame, model: DataFrame, key: str = "request_id", top: int = 3) -> DataFrame:
    """0.7 overlap + 0.3 model, ranked; ties keep overlap order, then model order.

    Both sides bring (key, disease, confidence, pos). A union and one aggregate take the place
    of a full outer join, so both sides are shuffled once.
    """
    none = F.lit(None).cast("int")
    sides = overlap.select(
        key, "disease", (F.col("confidence") * OVERLAP_SHARE).alias("part"), F.col("pos").alias("o"), none.alias("m")
    ).unionByName(model.select(
        key, "disease", (F.col("confidence") * MODEL_SHARE).alias("part"), none.alias("o"), F.col("pos").alias("m")
    ))
    merged = by_key(sides, key).groupBy(key, "disease").agg(
        (F.coalesce(F.max(F.when(F.col("o").isNotNull(), F.col("part"))), F.lit(0.0))
         + F.coalesce(F.max(F.when(F.col("m").isNotNull(), F.col("part"))), F.lit(0.0))).alias("score"),
        F.max("o").alias("o"), F.max("m").alias("m"),
    )
    order = [F.desc("score"), F.asc_nulls_last("o"), F.asc_nulls_last("m")]
    ranked = top_rows(merged, [key], order, top, "rank").filter(F.col("score") > 0)
    return ranked.select(key, "disease", F.round("score", 4).alias("confidence"), "rank")


def prediction_lists(ranked: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, predictions, top_disease) from ranked rows; a few rows per key by then."""
    item = F.struct("rank", "disease", "confidence")
    lists = ranked.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("r"))
    return lists.select(
        key,
        F.transform("r", lambda p: F.struct(p["disease"].alias("disease"), p["confidence"].alias("confidence"))).alias("predictions"),
        F.get("r", F.lit(0))["disease"].alias("top_disease"),
    )
