"""The library's relations, derived from the driver tables: once for Spark, once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.lookups import seeds
from clinflow.lookups.severity import RISK_BANDS, SEVERITY_WEIGHTS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- SQL text helpers -------------------------------------------------------------------------

def text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(text, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(columns: list[str], rows) -> str:
    body = ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(columns)}))"


def rounded(value: str, places: int) -> str:
    """Half up on the shortest decimal text, as Spark rounds a double."""
    return f"round(CAST(CAST(({value})::DOUBLE AS VARCHAR) AS DECIMAL(38,22)), {places})::DOUBLE"


def joined(value: str) -> str:
    return f"coalesce(array_to_string({value}, '|'), '')"


def bar(column) -> F.col:
    return F.array_join(column, "|")


WHITE = "chr(32)||chr(9)||chr(10)||chr(13)"


# ---- symptom logs from events -----------------------------------------------------------------

LEVEL = "CASE WHEN least(floor(value), 100) >= 70 THEN 'HIGH' WHEN least(floor(value), 100) >= 40 THEN 'MEDIUM' ELSE 'LOW' END"
TERMS = seeds.ENTERED_TERMS
N_TERMS = len(TERMS)

LOGS_SQL = f"""
logs AS (
  SELECT event_id AS log_id, user_id, event_type AS top_disease,
         CAST(least(floor(value), 100) AS DOUBLE) AS severity, {LEVEL} AS risk_level, ts AS created_at,
         CAST(user_id % 90 AS INT) AS age, CAST(CAST(props->>'$.k' AS INT) % 15 AS INT) AS duration_days,
         event_id % 3 = 0 AS labeled,
         CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 5 = 1 THEN false END AS used_for_training,
         list_transform(range(0, event_id % 5 + 1),
           lambda i: {text(TERMS)}[((event_id * 7 + i * 11 + event_id // 13) % {N_TERMS}) + 1]) AS symptoms
  FROM events)"""


def logs(spark: SparkSession, sf: str) -> DataFrame:
    at = f"CAST((event_id * 7 + i * 11 + event_id DIV 13) % {N_TERMS} AS INT)"
    terms = "array(" + ", ".join("'" + t + "'" for t in TERMS) + ")"
    return table(spark, sf, "events").selectExpr(
        "event_id AS log_id", "user_id", "event_type AS top_disease",
        "CAST(least(floor(value), 100) AS DOUBLE) AS severity", f"{LEVEL} AS risk_level", "ts AS created_at",
        "CAST(user_id % 90 AS INT) AS age",
        "CAST(CAST(get_json_object(props, '$.k') AS INT) % 15 AS INT) AS duration_days",
        "event_id % 3 = 0 AS labeled",
        "CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 5 = 1 THEN false END AS used_for_training",
        f"transform(sequence(0, CAST(event_id % 5 AS INT)), i -> element_at({terms}, {at} + 1)) AS symptoms",
    )


REQUESTS_SQL = LOGS_SQL + """,
requests AS (SELECT log_id AS request_id, user_id, symptoms, duration_days, age FROM logs)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return logs(spark, sf).select(F.col("log_id").alias("request_id"), "user_id", "symptoms", "duration_days", "age")


DISEASES = list(seeds.DISEASE_FEATURES)

# Stand-in probabilities of a classifier: every disease per request, some of them zero.
SCORES_SQL = f"""
scores AS (
  SELECT event_id AS request_id, {text(DISEASES)}[i + 1] AS disease,
         CAST((event_id * 31 + i * 17) % 23 AS DOUBLE) / 253 AS probability
  FROM events, range(0, {len(DISEASES)}) AS r(i))"""


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    names = F.lit(DISEASES)
    rows = table(spark, sf, "events").select("event_id", F.posexplode(names).alias("i", "disease"))
    return rows.select(
        F.col("event_id").alias("request_id"), "disease",
        (((F.col("event_id") * 31 + F.col("i") * 17) % 23).cast("double") / 253).alias("probability"),
    )


# ---- messages from conversations --------------------------------------------------------------

PHRASES = [
    "I have fever and cough", "mujhe bukhar aur sar dard hai", "بخار اور کھانسی ہے", "what medicine for malaria?",
    "hello", "chest pain and sweating", "loose motions and stomachache", "which tablet should I take",
    "Dengue is likely", "kaise ho", "severe headache with high fever", "skin rash and joint pain",
    "tez bukhar, khansi", "thanks", "is it Heart attack or Migraine", "any treatment?", "weight_loss and night sweats",
    "salam!", "blood in stool", "the body ache and throat pain need water", "لا 123 ٹھیک ہے", "dawai batao",
    "breathlessness, feel sick",
]
N_PHRASES = len(PHRASES)

MESSAGES_SQL = f"""
messages AS (
  SELECT conv_id AS user_id, turn AS seq, CASE WHEN role = 'assistant' THEN 'ai' ELSE 'human' END AS role,
         CASE WHEN (conv_id + turn) % 3 = 0 THEN p ELSE text || ' ' || p END AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 977 + turn * 61) AS ts,
         (conv_id + turn) % 5 = 3 AS is_reset
  FROM (SELECT *, {text(PHRASES)}[((conv_id * 5 + turn * 3) % {N_PHRASES}) + 1] AS p FROM conversations))"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    at = ((F.col("conv_id") * 5 + F.col("turn") * 3) % N_PHRASES).cast("int")
    rows = table(spark, sf, "conversations").withColumn("p", F.get(F.lit(PHRASES), at))
    after = F.make_dt_interval(secs=(F.col("conv_id") * 977 + F.col("turn") * 61).cast("decimal(18,6)"))
    return rows.select(
        F.col("conv_id").alias("user_id"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "assistant", "ai").otherwise("human").alias("role"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("p")).otherwise(
            F.concat("text", F.lit(" "), "p")).alias("content"),
        (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + after).alias("ts"),
        ((F.col("conv_id") + F.col("turn")) % 5 == 3).alias("is_reset"),
    )


# ---- documents with vectors -------------------------------------------------------------------

def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a chunk (item_id, vector, content, disease, source); its vector is that of its id's remainder."""
    vectors = table(spark, sf, "embeddings")
    size = vectors.agg(F.count("*"))
    rows = table(spark, sf, "documents").withColumn("vec_id", F.col("doc_id") % size.scalar())
    return rows.join(vectors, "vec_id").select(
        F.col("doc_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("text").alias("content"),
        F.col("lang").alias("disease"), "source")


# ---- drugs from part --------------------------------------------------------------------------

DRUGS_SQL = """
drugs AS (
  SELECT p_type || ' ' || p_brand AS disease, p_name AS drug_name,
         CASE WHEN p_size % 2 = 0 THEN 'otc' ELSE 'prescription' END AS drug_type,
         p_partkey AS pos, CASE WHEN p_size <= 5 THEN 0 WHEN p_size <= 15 THEN 1 ELSE 2 END AS tier
  FROM part)"""


def drugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_type || ' ' || p_brand AS disease", "p_name AS drug_name",
        "CASE WHEN p_size % 2 = 0 THEN 'otc' ELSE 'prescription' END AS drug_type",
        "p_partkey AS pos", "CASE WHEN p_size <= 5 THEN 0 WHEN p_size <= 15 THEN 1 ELSE 2 END AS tier",
    )


# ---- lookup tables as SQL ---------------------------------------------------------------------

WEIGHTS_SQL = "weights AS " + values(["symptom", "weight"], SEVERITY_WEIGHTS.items())
FEATURES_SQL = "features AS " + values(["feature", "pos"], [(f, i) for i, f in enumerate(seeds.FEATURES)])
SYNONYMS_SQL = "synonyms AS " + values(["phrase", "features"], seeds.SYNONYMS.items())
DISEASES_SQL = "diseases AS " + values(["disease", "features"], seeds.DISEASE_FEATURES.items())
BANDS_SQL = "bands AS " + values(
    ["risk_level", "tests", "advice", "medicine_type"], [(b[1], "|".join(b[2]), b[3], b[4]) for b in RISK_BANDS]
)
SEED_DRUGS_SQL = "seed_drugs AS " + values(
    ["disease", "drug_name", "drug_type", "pos"], [(*m, i) for i, m in enumerate(seeds.MEDICINES)]
)
