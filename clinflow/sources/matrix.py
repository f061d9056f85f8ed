"""Symptom matrices: one 0/1 column per symptom and a label column."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_header(names: list[str]) -> list[str]:
    return [name.strip().lower().replace(" ", "_") for name in names]


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: no extra pass over the file to guess types."""
    return spark.read.csv(path, header=True)


def clean_matrix(table: DataFrame) -> DataFrame:
    """S3: clean names, no unnamed columns, integer features with 0 for null, trimmed `label` last."""
    table = table.toDF(*clean_header(table.columns))
    names = [name for name in table.columns if "unnamed" not in name]
    label = next((name for name in ("prognosis", "disease") if name in names), names[-1])
    number = lambda name: F.coalesce(F.col(name).try_cast("double").cast("int"), F.lit(0)).alias(name)
    return table.select(
        *[number(name) for name in names if name != label], F.trim(F.col(label).cast("string")).alias("label")
    )


def align_matrix(table: DataFrame, features: list[str]) -> DataFrame:
    """Known features in their order, 0 where absent, other columns dropped, `label` last."""
    table = table.toDF(*clean_header(table.columns))
    label = next((name for name in table.columns if "prognosis" in name or "disease" in name), None)
    if label is None:
        raise ValueError("no label column")
    held = set(table.columns) - {label}
    columns = [F.col(name) if name in held else F.lit(0).alias(name) for name in features]
    return table.select(*columns, F.col(label).cast("string").alias("label"))


def first_matrix(spark: SparkSession, paths: list[str], features: list[str]) -> DataFrame | None:
    """The first file that exists and has a label, aligned; None if there is none."""
    for path in paths:
        try:
            table = read_matrix(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if any("prognosis" in name or "disease" in name for name in clean_header(table.columns)):
            return align_matrix(table, features)
    return None


def disease_symptoms(matrix: DataFrame, label: str = "label") -> DataFrame:
    """Features that occur per disease, in column order.

    One pass and one aggregate over the wide rows: no row per cell is made.
    """
    names = [name for name in matrix.columns if name != label]
    sums = matrix.groupBy(label).agg(*[F.sum(name).alias(name) for name in names])
    held = F.filter(F.array(*[F.when(F.col(name) > 0, F.lit(name)) for name in names]), lambda f: f.isNotNull())
    return sums.select(F.col(label).alias("disease"), held.alias("features"))


def long_form(matrix: DataFrame, label: str = "label") -> DataFrame:
    """(label, feature, value) rows of a wide matrix."""
    names = [name for name in matrix.columns if name != label]
    return matrix.unpivot([label], names, "feature", "value")


def profile(matrix: DataFrame, label: str = "label") -> DataFrame:
    """A10: rows, feature count, distinct labels."""
    return matrix.groupBy(label).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(matrix.columns) - 1).alias("features"),
        F.count(label).alias("classes"),
        F.array_sort(F.collect_list(label)).alias("labels"),
    )


def merge_samples(*parts: DataFrame | None) -> DataFrame | None:
    """Union of the sample tables there are; None without any."""
    held = [part for part in parts if part is not None]
    return reduce(DataFrame.unionByName, held) if held else None
