"""Topic events as streams, from a broker or from files, with one shape for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_topics(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 1_000_000) -> DataFrame:
    """(topic, key, value, timestamp) from the start of the topics. Needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger).load()
    )
    return raw.select("topic", F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def read_event_files(spark: SparkSession, path: str, topic: str | None = None, files_per_trigger: int = 100,
                     pattern: str | None = None) -> DataFrame:
    """The same shape from JSON-line files, one event per line."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.text(path)
    name = F.lit(topic) if topic else F.get_json_object("value", "$.topic")
    return raw.select(name.alias("topic"), F.lit("").alias("key"), "value", F.current_timestamp().alias("timestamp"))


def read_table_files(spark: SparkSession, path: str, schema: str, pattern: str | None = None,
                     files_per_trigger: int = 100) -> DataFrame:
    """A stream over Parquet files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def parse(events: DataFrame, schema: str) -> DataFrame:
    """Event fields as columns; lines that do not parse keep their text in `_corrupt_record`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return events.withColumn("_event", F.from_json("value", schema, options)).select("value", "timestamp", "_event.*")


def of_topic(events: DataFrame, topic: str) -> DataFrame:
    """Events of one topic; other topics are left to their own queries."""
    return events.filter(F.col("topic") == topic)


def good_and_bad(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = parsed.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = parsed.filter(F.col("_corrupt_record").isNotNull()).select("value", "timestamp")
    return good, bad
