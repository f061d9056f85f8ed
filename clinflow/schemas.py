"""Schemas of the tables and of the topic events."""

PREDICTION = "STRUCT<disease: STRING, confidence: DOUBLE>"

SYMPTOM_LOG = f"""
log_id STRING, user_id STRING, symptoms ARRAY<STRING>, duration_days INT, age INT, language STRING,
raw_text STRING, top_disease STRING, predictions ARRAY<{PREDICTION}>, severity DOUBLE, risk_level STRING,
created_at TIMESTAMP, labeled BOOLEAN, confirmed_disease STRING, used_for_training BOOLEAN, trained_at TIMESTAMP
"""
TREND = """
top_disease STRING, case_count BIGINT, avg_severity DOUBLE, high_risk_count BIGINT, medium_risk_count BIGINT,
low_risk_count BIGINT, window_start TIMESTAMP, window_end TIMESTAMP, updated_at TIMESTAMP
"""
# Producers send `duration` or `duration_days`; both are read.
SYMPTOM_EVENT = """
log_id STRING, user_id STRING, symptoms ARRAY<STRING>, duration INT, duration_days INT, age INT,
top_disease STRING, risk_level STRING, severity DOUBLE, _corrupt_record STRING
"""
CHAT_EVENT = "user_id STRING, message STRING, reply STRING, ts TIMESTAMP, _corrupt_record STRING"
RETRAIN_EVENT = "force BOOLEAN, _corrupt_record STRING"
LOG_EVENT = """
log_id STRING, user_id STRING, top_disease STRING, risk_level STRING, severity DOUBLE, created_at TIMESTAMP,
labeled BOOLEAN, confirmed_disease STRING, used_for_training BOOLEAN, _corrupt_record STRING
"""
TOPIC = "topic STRING, key STRING, value STRING"
