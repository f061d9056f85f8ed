"""Streams over the driver tables: each runs to its end and gives what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.scoring import OVERLAP_SQL, pairs
from clinflow import schemas
from clinflow.lookups import tables as lookups
from clinflow.operators.medicines import tier_lists
from clinflow.plans.scoring import Lookups
from clinflow.session import run_dir
from clinflow.sources import events
from clinflow.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
CHATS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def event_stream(spark, sf):
    """The events in four micro-batches, each of as many files as tasks can run: a file of one row group is read by one task."""
    folder, files = run_dir(spark, "events"), spark.sparkContext.defaultParallelism
    b.table(spark, sf, "events").repartition(4 * files, "event_id").write.parquet(folder)
    return events.read_table_files(spark, folder, EVENTS, files_per_trigger=files)


def log_stream(spark, sf):
    return logs_of(event_stream(spark, sf))


def logs_of(stream):
    return stream.selectExpr(
        "event_id AS log_id", "user_id", "event_type AS top_disease", "CAST(least(floor(value), 100) AS DOUBLE) AS severity",
        f"{b.LEVEL} AS risk_level", "CAST(ts AS TIMESTAMP) AS created_at", "event_id % 3 = 0 AS labeled",
        "CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 5 = 1 THEN false END AS used_for_training",
    )


def symptom_topic(spark, sf):
    """Symptom events as JSON text, one in fifty of them cut off."""
    at = f"CAST((event_id * 7 + i * 11 + event_id DIV 13) % {b.N_TERMS} AS INT)"
    terms = "array(" + ", ".join("'" + t + "'" for t in b.TERMS) + ")"
    body = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("log_id"), F.col("user_id").cast("string").alias("user_id"),
        F.expr(f"transform(sequence(0, CAST(event_id % 5 AS INT)), i -> element_at({terms}, {at} + 1))").alias("symptoms"),
        F.lit(3).alias("duration"), (F.col("user_id") % 90).cast("int").alias("age"),
    ))
    value = F.when(F.col("event_id") % 50 == 49, F.substring(body, 1, 20)).otherwise(body)
    return event_stream(spark, sf).select(
        F.lit("symptom-input").alias("topic"), F.lit("").alias("key"), value.alias("value"), F.current_timestamp().alias("timestamp")
    )


BODY_SQL = """'{"log_id":"' || log_id || '","user_id":"' || user_id || '","symptoms":' || to_json(symptoms) || ',"duration":3,"age":' || age || '}'"""


def lookup_tables(spark):
    return Lookups(
        lookups.features(spark), lookups.synonyms(spark), lookups.disease_features(spark), lookups.risk_bands(spark),
        [("static", tier_lists(lookups.medicines(spark), "pos"))],
    )


def scored_stream(spark, sf):
    out = run_dir(spark, "scored")
    jobs.scoring_stream(symptom_topic(spark, sf), lookup_tables(spark), out, f"{out}/checkpoint", native=True).awaitTermination()
    return out


SCORED = "log_id STRING, user_id STRING, severity INT, risk_level STRING, predictions ARRAY<STRUCT<disease: STRING, confidence: DOUBLE>>"


@query("t1_scoring_stream", f"""WITH {OVERLAP_SQL}, {b.WEIGHTS_SQL}, base AS (
  SELECT request_id, sum(coalesce(weight, 5))::INT AS base FROM (SELECT request_id, replace(lower(trim(raw)), ' ', '_') AS symptom
    FROM (SELECT request_id, unnest(symptoms) AS raw FROM requests)) LEFT JOIN weights USING (symptom) GROUP BY 1),
s AS (SELECT request_id, user_id, least(trunc(base * (1.0::DOUBLE + 3 * 0.1::DOUBLE)
  * CASE WHEN age > 60 OR age < 5 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END)::INT, 100) AS severity FROM requests JOIN base USING (request_id)),
lists AS (SELECT request_id, string_agg(disease || '=' || printf('%.4f', {b.rounded('confidence * 0.7::DOUBLE', 4)}), '|' ORDER BY confidence * 0.7::DOUBLE DESC, pos) AS predictions
  FROM overlap WHERE pos <= 3 GROUP BY 1)
SELECT 'prediction-result' AS topic, user_id::VARCHAR AS key, request_id::VARCHAR AS log_id, user_id::VARCHAR AS user_id, severity,
  CASE WHEN severity >= 70 THEN 'HIGH' WHEN severity >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, coalesce(predictions, '') AS predictions
FROM s LEFT JOIN lists USING (request_id) WHERE request_id % 50 <> 49""")
def t1(spark, sf):
    out = scored_stream(spark, sf)
    rows = spark.read.parquet(f"{out}/results").select("topic", "key", F.from_json("value", SCORED).alias("v")).select("topic", "key", "v.*")
    return rows.withColumn("predictions", pairs("predictions"))


@query("t1_dead_letters", f"WITH {b.LOGS_SQL} SELECT left({BODY_SQL}, 20) AS value, 'not readable' AS reason FROM logs WHERE log_id % 50 = 49")
def t1_letters(spark, sf):
    return spark.read.parquet(f"{scored_stream(spark, sf)}/dead_letters").select("value", "reason")


@query("t2_audit_mirror", f"WITH {b.LOGS_SQL} SELECT 'symptom-input' AS type, CASE WHEN log_id % 50 = 49 THEN left({BODY_SQL}, 20) ELSE {BODY_SQL} END AS payload FROM logs")
def t2(spark, sf):
    out = run_dir(spark, "audit")
    rows = jobs.audit_mirror(symptom_topic(spark, sf), "symptom-input")
    jobs.table_stream(rows, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema("type STRING, payload STRING").parquet(out)


@query("t3_topic_routing", "SELECT event_type AS topic, props AS value FROM events WHERE event_type = 'click'")
def t3(spark, sf):
    out = run_dir(spark, "routed")
    topics = event_stream(spark, sf).select(F.col("event_type").alias("topic"), F.col("props").alias("value"))
    jobs.table_stream(events.of_topic(topics, "click"), out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema("topic STRING, value STRING").parquet(out)


@query("s9_event_source", "SELECT event_id::VARCHAR AS log_id FROM events")
def s9(spark, sf):
    folder = run_dir(spark, "lines")
    lines = b.table(spark, sf, "events").select(F.to_json(F.struct(
        F.lit("symptom-input").alias("topic"), F.col("event_id").cast("string").alias("log_id"))).alias("value"))
    lines.write.text(folder)
    out = run_dir(spark, "parsed")
    stream = events.parse(events.of_topic(events.read_event_files(spark, folder), "symptom-input"), schemas.SYMPTOM_EVENT)
    good, _ = events.good_and_bad(stream)
    jobs.table_stream(good.select("log_id"), out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema("log_id STRING").parquet(out)


@query("t4_chat_memory", """WITH pairs AS (SELECT h.conv_id::VARCHAR AS user_id, h.turn, h.text AS message, a.text AS reply,
  row_number() OVER (PARTITION BY h.conv_id ORDER BY h.turn DESC) AS newest FROM conversations h
  JOIN conversations a ON a.conv_id = h.conv_id AND a.turn = h.turn + 1 AND a.role = 'assistant' WHERE h.role = 'user'),
kept AS (SELECT user_id, turn, 0 AS side, 'human' AS role, message AS content FROM pairs WHERE newest <= 10
  UNION ALL SELECT user_id, turn, 1, 'ai', reply FROM pairs WHERE newest <= 10)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY turn, side) - 1)::INT AS seq, role, content FROM kept""")
def t4(spark, sf):
    rows = b.table(spark, sf, "conversations")
    asked = rows.filter("role = 'user'").selectExpr("conv_id", "turn", "text AS message")
    said = rows.filter("role = 'assistant'").selectExpr("conv_id", "turn - 1 AS turn", "text AS reply")
    folder = run_dir(spark, "chats")
    # Three files, a micro-batch each, with every third turn: later batches bring earlier messages.
    asked.join(said, ["conv_id", "turn"]).selectExpr(
        "CAST(conv_id AS STRING) AS user_id", "message", "reply", "timestamp_seconds(1704067200 + turn * 60) AS ts", "turn"
    ).repartition(3, "turn").drop("turn").write.parquet(folder)
    stream = events.read_table_files(spark, folder, "user_id STRING, message STRING, reply STRING, ts TIMESTAMP", files_per_trigger=1)
    out = run_dir(spark, "memory")

    def keep(batch, batch_id):
        jobs.write_batch(batch, f"{out}/memory", batch_id)

    jobs.chat_memory(stream).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    held = spark.read.parquet(f"{out}/memory")
    newest = held.groupBy("user_id").agg(F.max("batch_id").alias("batch_id"))
    return held.join(newest, ["user_id", "batch_id"]).select("user_id", "seq", "role", "content")


@query("t5_retrain_triggers", """SELECT i * 50 AS labelled, false AS force
FROM (SELECT unnest(range(1, count(*) FILTER (event_id % 3 = 0 AND NOT (event_id % 5 = 0)) // 50 + 1)) AS i FROM events)""")
def t5(spark, sf):
    out = run_dir(spark, "triggers")
    rows = jobs.retrain_triggers(log_stream(spark, sf))
    jobs.table_stream(rows, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query("t6_high_risk_alerts", f"SELECT event_id AS log_id, user_id FROM events WHERE {b.LEVEL} = 'HIGH'")
def t6(spark, sf):
    out = run_dir(spark, "alerts")
    rows = log_stream(spark, sf)
    jobs.table_stream(jobs.high_risk_alerts(rows.union(rows)).select("log_id", "user_id"), out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema("log_id BIGINT, user_id BIGINT").parquet(out)


def trend_rows(spark, sf):
    out = run_dir(spark, "trend")
    rows = jobs.trend_stream(log_stream(spark, sf))
    jobs.table_stream(rows, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query("t7_trend_stream", """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type AS top_disease, count(*) AS case_count FROM events GROUP BY 1, 2)
SELECT window_start, top_disease, case_count FROM w WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def t7(spark, sf):
    held = jobs.trend_totals(trend_rows(spark, sf))
    return held.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "top_disease", "case_count")


@query("t7_late_rows", """WITH numbered AS (SELECT *, event_id % 4 AS slice FROM events), closed AS (SELECT max(ts) - INTERVAL 1 HOUR AS watermark FROM numbered WHERE slice < 3)
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type AS top_disease, count(*) AS late_rows FROM numbered, closed
WHERE slice = 3 AND time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= watermark GROUP BY 1, 2""")
def t7_late(spark, sf):
    """Three slices in one batch and the fourth after them: what it has for windows that are closed by then are corrections."""
    folder, out = run_dir(spark, "events"), run_dir(spark, "trend")
    table = b.table(spark, sf, "events")
    for first, keep in ((True, "event_id % 4 < 3"), (False, "event_id % 4 = 3")):
        table.filter(keep).write.mode("append").parquet(folder)
        rows = jobs.trend_stream(logs_of(events.read_table_files(spark, folder, EVENTS)))
        jobs.table_stream(rows, out, f"{out}-checkpoint").awaitTermination()
    held = spark.read.schema(rows.schema).parquet(out).filter("late").groupBy("window_start", "top_disease").agg(F.sum("case_count").alias("late_rows"))
    return held.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "top_disease", "late_rows")
