"""Chat triage over a message table: carried disease, routes and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinflow.operators.chat import carried_disease, document_disease, in_english, triage_routes


def triage_messages(messages: DataFrame, guidance: DataFrame, medicines: DataFrame, supplied: str | None = None) -> DataFrame:
    """Route and reply of every human message.

    `messages` may bring `documents`, an array of retrieved texts, best first, and a column of
    translations, named by `supplied`; `medicines` has (disease, otc, rx). Diseases are looked for in the
    English form of what a human wrote, and in the replies as they are.
    """
    names = medicines.select("disease")
    rows = in_english(messages, supplied)
    read = rows.withColumn("_read", F.when(F.col("role") == "human", F.col("english")).otherwise(F.col("content")))
    asked = carried_disease(read, names, text="_read").drop("_read").filter(F.col("role") == "human")
    if "documents" not in messages.columns:
        asked = asked.withColumn("documents", F.array().cast("array<string>")).withColumn("from_documents", F.lit(None).cast("string"))
    else:
        asked = document_disease(asked, names)
    return triage_routes(asked, guidance, medicines)
