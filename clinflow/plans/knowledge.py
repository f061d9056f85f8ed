"""Knowledge per disease: one retrieval per distinct disease, not per request."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinflow.operators.neighbours import retrieve
from clinflow.plans.models import embed

QUESTION = "What are the symptoms and treatment of %s?"


def disease_knowledge(diseases: DataFrame, model: PipelineModel, chunks: DataFrame, k: int = 3, **sizes: int) -> DataFrame:
    """(disease, knowledge): the k nearest chunks of each distinct disease, best first.

    `chunks` has (item_id, vector, content, disease, source), vectors from the same model. The
    result is what `Lookups.knowledge` takes.
    """
    asked = diseases.select("disease").distinct().select(
        F.col("disease").alias("query_id"), F.format_string(QUESTION, "disease").alias("content")
    )
    return knowledge_lists(embed(model, asked).select("query_id", "vector"), chunks, k, **sizes)


def knowledge_lists(asked: DataFrame, chunks: DataFrame, k: int = 3, **sizes: int) -> DataFrame:
    """(disease, knowledge) for (query_id, vector) of diseases: their k nearest chunks, best first."""
    found = retrieve(asked, chunks, k, **sizes)
    best = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "disease", "content"))).alias("r"))
    return best.select(
        F.col("query_id").alias("disease"),
        F.transform("r", lambda x: F.struct(x["disease"].alias("disease"), x["content"].alias("content"))).alias("knowledge"),
    )
