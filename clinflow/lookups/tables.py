"""Lookup constants as DataFrames.

They are written as SQL `VALUES`, so the optimizer knows their exact size and
decides by itself whether to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.lookups import seeds, severity, triage


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(sql_literal, value)) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def values_table(spark: SparkSession, columns: list[str], rows) -> DataFrame:
    body = ", ".join("(" + ", ".join(map(sql_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def severity_weights(spark: SparkSession) -> DataFrame:
    return values_table(spark, ["symptom", "weight"], severity.SEVERITY_WEIGHTS.items())


def risk_bands(spark: SparkSession) -> DataFrame:
    """One row per band, with the upper end of its score range."""
    rows, upper = [], None
    for low, level, tests, advice, kind in severity.RISK_BANDS:
        rows.append((low, upper, level, tests or [""], advice, kind))
        upper = low
    table = values_table(spark, ["min_score", "below_score", "risk_level", "tests", "advice", "medicine_type"], rows)
    return table.withColumn("tests", F.array_remove("tests", ""))


def features(spark: SparkSession) -> DataFrame:
    return values_table(spark, ["feature", "pos"], [(name, at) for at, name in enumerate(seeds.FEATURES)])


def synonyms(spark: SparkSession) -> DataFrame:
    return values_table(spark, ["phrase", "features"], seeds.SYNONYMS.items())


def disease_features(spark: SparkSession) -> DataFrame:
    return values_table(spark, ["disease", "features"], seeds.DISEASE_FEATURES.items())


def medicines(spark: SparkSession) -> DataFrame:
    rows = [(*row, at) for at, row in enumerate(seeds.MEDICINES)]
    return values_table(spark, ["disease", "drug_name", "drug_type", "pos"], rows)


def vignettes(spark: SparkSession) -> DataFrame:
    return values_table(spark, ["expected", "symptoms"], seeds.VIGNETTES)


def guidance(spark: SparkSession) -> DataFrame:
    rows = [(word, at, triage.GUIDANCE[word]) for at, word in enumerate(triage.KEYWORDS)]
    return values_table(spark, ["keyword", "ord", "guidance"], rows)
