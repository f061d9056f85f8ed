"""A stored table of resolved terms, to which only unseen terms are added."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.operators.mapping import FUZZY_CUTOFF, resolve_terms
from clinflow.sinks.tables import write_batch

STORED = "raw STRING, stage STRING, features ARRAY<STRING>"


def fingerprint(features: DataFrame, synonyms: DataFrame, cutoff: float, native: bool) -> str:
    """Names a vocabulary and the rules that are applied with it, whatever the order of its rows."""
    rows = features.select(F.xxhash64(F.lit("feature"), "feature").alias("h")).unionByName(
        synonyms.select(F.xxhash64(F.lit("phrase"), "phrase", F.array_sort("features")).alias("h")))
    sums = rows.distinct().agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n")).first()
    return f"{sums.n}-{int(sums['sum'] or 0) % 2**64:016x}-{cutoff}-{'levenshtein' if native else 'ratio'}"


@dataclass(frozen=True)
class TermStore:
    """Terms that one vocabulary has resolved, below `path`; another vocabulary has a store of its own beside it.

    Every batch adds a part with the terms that no earlier batch had; a batch without new terms adds none, and resolves nothing. A
    repeated batch reads the parts before its own and replaces its own, so it gives the same rows again.
    """

    path: str
    features: DataFrame
    synonyms: DataFrame
    cutoff: float = FUZZY_CUTOFF
    native: bool = False

    def folder(self) -> str:
        return f"{self.path}/{fingerprint(self.features, self.synonyms, self.cutoff, self.native)}"

    def stored(self, spark: SparkSession, folder: str) -> DataFrame | None:
        try:
            return spark.read.schema(f"{STORED}, batch_id BIGINT").parquet(folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def resolved(self, terms: DataFrame, batch_id: int | None = None) -> DataFrame:
        """(raw, stage, features) of all stored terms, with those of `terms` (raw) among them.

        Without a `batch_id` the terms make a new part after all others.
        """
        spark, folder = terms.sparkSession, self.folder()
        held = self.stored(spark, folder)
        if batch_id is None:
            batch_id = 0 if held is None else (held.agg(F.max("batch_id")).first()[0] + 1)
        wanted = terms.select("raw").filter(F.col("raw").isNotNull()).distinct()
        earlier = None if held is None else held.filter(F.col("batch_id") < batch_id)
        unseen = wanted if earlier is None else wanted.join(earlier.select("raw"), "raw", "left_anti")
        if not unseen.isEmpty():
            write_batch(resolve_terms(unseen, self.features, self.synonyms, self.cutoff, self.native), folder, batch_id)
        held = self.stored(spark, folder)
        if held is None:
            return spark.createDataFrame([], STORED)
        return held.filter(F.col("batch_id") <= batch_id).drop("batch_id")
