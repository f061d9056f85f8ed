"""Writers and table maintenance on Parquet."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.operators.joining import latest
from clinflow.sinks.versioned import VersionedTable

TREND_KEY = ["top_disease", "window_start"]


def trend_records(trends: DataFrame, as_of: Column, hours: int = 6) -> DataFrame:
    """K1: trend rows with their window and time of change."""
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    return trends.select("*", start.alias("window_start"), as_of.alias("window_end"), as_of.alias("updated_at"))


def upserted(existing: DataFrame, updates: DataFrame, key: list[str], order: str = "updated_at") -> DataFrame:
    """K1: one row per key, updates over stored rows; combined before the shuffle."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(rows, key, F.struct("_new", order)).drop("_new")


def trend_table(spark: SparkSession, path: str) -> VersionedTable:
    """K1: the stored trends, in parts by day."""
    return VersionedTable(spark, path, TREND_KEY, part=F.to_date("window_start"))


def upsert_trends(spark: SparkSession, path: str, updates: DataFrame) -> None:
    """K1 on a stored table: only the days in `updates` are read and rewritten, and seen at once or not at all."""
    trend_table(spark, path).merge(updates, lambda held, new: upserted(held, new, TREND_KEY))


def flag_used(logs: DataFrame, used: DataFrame, trained_at: Column) -> DataFrame:
    """K3: used_for_training and trained_at set for the log ids in `used`."""
    marks = used.select("log_id").distinct().withColumn("_used", F.lit(True))
    joined = logs.join(marks, "log_id", "left")
    hit = F.coalesce("_used", F.lit(False))
    stamp = F.col("trained_at") if "trained_at" in logs.columns else F.lit(None).cast("timestamp")
    flag = F.col("used_for_training") if "used_for_training" in logs.columns else F.lit(None).cast("boolean")
    return joined.withColumn("used_for_training", F.when(hit, F.lit(True)).otherwise(flag)).withColumn(
        "trained_at", F.when(hit, trained_at).otherwise(stamp)
    ).drop("_used")


def update_predictions(logs: DataFrame, updates: DataFrame) -> DataFrame:
    """K4: prediction and updated_at from a batch of (log_id, prediction, updated_at); the newest update of an id wins."""
    newest = latest(updates, ["log_id"], F.col("updated_at")).select(
        "log_id", F.col("prediction").alias("_p"), F.col("updated_at").alias("_at")
    )
    joined = logs.join(newest, "log_id", "left")
    stamp = F.col("updated_at") if "updated_at" in logs.columns else F.lit(None).cast("timestamp")
    return joined.withColumn("prediction", F.when(F.col("_at").isNotNull(), F.col("_p")).otherwise(F.col("prediction"))).withColumn(
        "updated_at", F.coalesce("_at", stamp)
    ).drop("_p", "_at")


def mark_used(logs: VersionedTable, used: DataFrame, trained_at: Column) -> int:
    """K3 on a stored table of logs, keyed by log_id: its new version."""
    return logs.merge(used.select("log_id"), lambda held, ids: flag_used(held, ids, trained_at))


def store_predictions(logs: VersionedTable, updates: DataFrame) -> int:
    """K4 on a stored table of logs, keyed by log_id: its new version."""
    return logs.merge(updates, update_predictions)


def log_records(scored: DataFrame, created_at: Column) -> DataFrame:
    """K5: the wide log row of a scored request, severity under both of its names."""
    optional = lambda name, other: F.coalesce(name, F.lit(other)) if name in scored.columns else F.lit(other)
    return scored.select(
        F.col("request_id").alias("log_id"), "user_id", "symptoms", "duration_days", "age",
        optional("language", "english").alias("language"), F.array_join("symptoms", ", ").alias("raw_text"),
        F.coalesce("top_disease", F.lit("Unknown")).alias("top_disease"), "predictions",
        F.get("predictions", F.lit(0)).alias("prediction"),
        "severity", F.col("severity").alias("severity_score"), "risk_level", created_at.alias("created_at"),
    )


def append_logs(records: DataFrame, path: str) -> None:
    records.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def audit_records(scored: DataFrame, created_at: Column, event_type: str = "predict") -> DataFrame:
    """K6: audit rows with the payload as JSON text."""
    payload = F.struct("symptoms", "top_disease", "risk_level", "severity")
    return scored.select(
        F.lit(event_type).alias("event_type"), F.col("user_id").cast("string").alias("user_id"),
        F.to_json(payload).alias("payload"), created_at.alias("created_at"),
    )


def topic_records(rows: DataFrame, topic: str, key: str | None = None) -> DataFrame:
    """K7: (topic, key, value) with the row as JSON; an absent key is empty. Works on streams."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    return rows.select(F.lit(topic).alias("topic"), name.alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def publish(records: DataFrame, form: str = "kafka", **options: str):
    """K7: send `topic_records` to the topics that their rows name.

    A batch is written at once; a stream gives its started query, for which `checkpointLocation` is needed. The
    options are those of the sink, such as `kafka.bootstrap.servers`.
    """
    if records.isStreaming:
        return records.writeStream.format(form).options(**options).start()
    return records.write.format(form).options(**options).mode("append").save()


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Rows of one micro-batch in a part of their own: a repeated batch replaces itself."""
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(path)


def save_model(model: PipelineModel, base: str, version: str, features: list[str], kind: str) -> None:
    """K8/K9: the model below its version, and one row of metadata. Older versions stay."""
    spark = SparkSession.active()
    labels = list(model.stages[0].labels)
    model.write().save(f"{base}/v={version}")
    spark.range(1).select(
        F.lit(version).alias("version"), F.lit(kind).alias("type"), F.lit(len(features)).alias("n_features"),
        F.lit(len(labels)).alias("n_classes"), F.lit(labels).alias("diseases"), F.lit(features).alias("feature_names"),
    ).coalesce(1).write.mode("append").parquet(f"{base}/metadata")


def deploy_model(model: PipelineModel, base: str, version: str, features: list[str], kind: str,
                 old_accuracy: float, new_accuracy: float, deployed_at: Column) -> DataFrame:
    """K8: save a version and append its deployment; the newest deployment is the pointer."""
    spark = SparkSession.active()
    before = current_version(spark, base)
    save_model(model, base, version, features, kind)
    row = spark.range(1).select(
        deployed_at.cast("timestamp").alias("deployed_at"), F.lit(version).alias("version"),
        F.lit(float(old_accuracy)).alias("old_accuracy"), F.lit(float(new_accuracy)).alias("new_accuracy"),
        F.round(F.lit(float(new_accuracy)) - F.lit(float(old_accuracy)), 2).alias("improvement"),
        F.lit(f"{base}/v={before}" if before else None).cast("string").alias("backup_path"),
    )
    table = deployments(spark, base)
    table.merge(row, lambda held, new: held.join(new, "version", "left_anti").unionByName(new))
    return table.read()


def deployments(spark: SparkSession, base: str) -> VersionedTable:
    """K8: a row for each deployed version of the model."""
    return VersionedTable(spark, f"{base}/deployments", ["version"], parts=1)


def current_version(spark: SparkSession, base: str) -> str | None:
    """The newest deployment: it is the pointer, and changes with one commit."""
    table = deployments(spark, base)
    return table.read().agg(F.max_by("version", F.struct("deployed_at", "version"))).first()[0] if table.versions() else None


def load_current(spark: SparkSession, base: str) -> PipelineModel | None:
    version = current_version(spark, base)
    return PipelineModel.load(f"{base}/v={version}") if version else None


def write_disease_map(diseases: DataFrame, path: str) -> None:
    """Disease to features as JSON lines."""
    diseases.write.mode("overwrite").json(path)
