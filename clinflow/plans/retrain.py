"""M7: collect, guard, align, merge, split, train, compare, deploy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.operators import learning
from clinflow.operators.mapping import feature_vector
from clinflow.plans import models
from clinflow.session import written
from clinflow.sinks import tables
from clinflow.sinks.versioned import VersionedTable

STATUS = "status STRING, reason STRING, old_accuracy DOUBLE, new_accuracy DOUBLE, new_samples BIGINT, total_train BIGINT"


def sample_matrix(samples: DataFrame, features: list[str]) -> DataFrame:
    """F19 as (row_key, label, vector)."""
    return feature_vector(samples, features).select(
        F.concat(F.lit("log:"), F.col("log_id").cast("string")).alias("row_key"),
        F.col("confirmed_disease").alias("label"), "vector",
    )


def original_matrix(matrix: DataFrame, features: list[str], key: str) -> DataFrame:
    """(row_key, label, vector) of an aligned matrix with a key column."""
    return matrix.select(
        F.concat(F.lit("row:"), F.col(key).cast("string")).alias("row_key"), "label",
        F.array(*[F.col(name).cast("int") for name in features]).alias("vector"),
    )


def retrain(logs: DataFrame, original: DataFrame | None, features: list[str], classes: DataFrame, base: str,
            version: str, as_of: Column, estimator=None, kind: str = "boosted", force: bool = False,
            stored: VersionedTable | None = None) -> tuple[DataFrame, DataFrame]:
    """One status row, and the logs with the used samples marked (only when deployed).

    With `stored`, the table that the logs are kept in, the marks are committed to it after the deployment.
    Without an `estimator` boosted trees are trained. `original` comes from `original_matrix`, `base` is the model folder. Only single gate rows
    reach the driver; the training rows are written once to the shared folder.
    """
    spark: SparkSession = logs.sparkSession

    def status(name: str, reason: str | None, old=None, new=None, total=None) -> DataFrame:
        return spark.createDataFrame([(name, reason, old, new, count, total)], STATUS)

    samples = learning.new_samples(logs)
    count = samples.count()
    if count < learning.MIN_SAMPLES and not force:
        return status("skipped", f"{count} of {learning.MIN_SAMPLES} samples"), logs
    usable = learning.known_samples(samples, classes)
    parts = [part for part in (original, sample_matrix(usable, features)) if part is not None]
    merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = written(learning.stratified_split(merged, "row_key", "label"), "training")
    gate = rows.agg(F.count("*").alias("n"), F.count_distinct("label").alias("classes")).first()
    if gate.n == 0:
        return status("error", "no training data"), logs
    if gate.classes < 2:
        return status("error", "insufficient class diversity"), logs
    table = models.vector_from_array(rows, "vector")
    train, test = table.filter("not is_test"), table.filter("is_test")
    model = models.fit(train, estimator or models.boosted())
    current = tables.load_current(spark, base)
    old = models.predictions(current, test) if current else None
    result = learning.ab_gate(old, models.predictions(model, test), force=force).first()
    if not result.deploy:
        return status("not_deployed", None, result.old_accuracy, result.new_accuracy), logs
    tables.deploy_model(model, base, version, features, kind, result.old_accuracy, result.new_accuracy, as_of)
    if stored is not None:
        tables.mark_used(stored, samples, as_of)
    marked = tables.flag_used(logs, samples.select("log_id"), as_of)
    return status("deployed", None, result.old_accuracy, result.new_accuracy, train.count()), marked
