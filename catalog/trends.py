"""Symptom logs: scans, trends, dashboard, history, table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from clinflow.functions.text import normalise_term
from clinflow.lookups.tables import values_table
from clinflow.operators import cleanse, trends
from clinflow.plans.scoring import trend_batch
from clinflow.session import run_dir
from clinflow.sinks import tables
from clinflow.sinks.versioned import VersionedTable

AS_OF = "2024-01-29 12:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def as_of():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


AVERAGE = "sum(CAST(severity AS DECIMAL(18,4)))::DOUBLE / count(severity)"
FIGURES = f"""count(*) AS case_count, {b.rounded(AVERAGE, 2)} AS avg_severity,
  count(*) FILTER (risk_level = 'HIGH') AS high_risk_count,
  count(*) FILTER (risk_level = 'MEDIUM') AS medium_risk_count,
  count(*) FILTER (risk_level = 'LOW') AS low_risk_count"""

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


@query("s1_lookback_scan", f"""WITH {b.LOGS_SQL}
SELECT array_to_string(symptoms, '|') AS symptoms, top_disease, risk_level, severity, created_at FROM logs
WHERE created_at >= {AS_OF_SQL} - INTERVAL 72 HOUR""")
def s1(spark, sf):
    return trends.recent_logs(b.logs(spark, sf), as_of(), 72).withColumn("symptoms", b.bar("symptoms"))


# Logs with gaps: diseases, levels and severities missing here and there.
GAPS = ["nullif(top_disease, 'error') AS top_disease", "nullif(risk_level, 'MEDIUM') AS risk_level",
        "CASE WHEN duration_days <> 3 THEN severity END AS severity", "created_at", "user_id", "log_id"]
GAPPY_SQL = b.LOGS_SQL + f", gappy AS (SELECT {', '.join(GAPS)} FROM logs)"


def gappy(spark, sf):
    return b.logs(spark, sf).selectExpr(*GAPS)


@query("p8_default_fill", f"""WITH {GAPPY_SQL}
SELECT coalesce(top_disease, 'Unknown') AS top_disease, coalesce(risk_level, 'UNKNOWN') AS risk_level,
  coalesce(severity, 0.0) AS severity, created_at FROM gappy""")
def p8(spark, sf):
    return cleanse.fill_log_defaults(gappy(spark, sf))


@query("a1_disease_trend", f"WITH {b.LOGS_SQL} SELECT top_disease, {FIGURES} FROM logs GROUP BY top_disease")
def a1(spark, sf):
    return trends.disease_trend(b.logs(spark, sf))


@query("a1_trend_batch", f"""WITH {GAPPY_SQL}, filled AS (
  SELECT coalesce(top_disease, 'Unknown') AS top_disease, coalesce(risk_level, 'UNKNOWN') AS risk_level,
    coalesce(severity, 0.0) AS severity FROM gappy WHERE created_at >= {AS_OF_SQL} - INTERVAL 72 HOUR)
SELECT top_disease, {FIGURES} FROM filled GROUP BY top_disease""")
def a1_batch(spark, sf):
    return trend_batch(gappy(spark, sf), as_of(), 72)


@query("a2_window_trend", f"""WITH {b.LOGS_SQL}
SELECT time_bucket(INTERVAL 6 HOUR, created_at) AS window_start,
  time_bucket(INTERVAL 6 HOUR, created_at) + INTERVAL 6 HOUR AS window_end, top_disease, {FIGURES}
FROM logs GROUP BY 1, 2, 3""")
def a2(spark, sf):
    return trends.windowed_trend(b.logs(spark, sf))


@query("a3_common_symptoms", f"""WITH {b.LOGS_SQL}, counts AS (
  SELECT top_disease, symptom, count(*) AS n FROM (SELECT top_disease, unnest(symptoms) AS symptom FROM logs) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY top_disease ORDER BY n DESC, symptom) AS rank FROM counts)
SELECT top_disease, string_agg(symptom || '=' || n, '|' ORDER BY rank) AS symptoms FROM ranked WHERE rank <= 5 GROUP BY 1""")
def a3(spark, sf):
    out = trends.common_symptoms(b.logs(spark, sf))
    return out.withColumn("symptoms", b.bar(F.transform("symptoms", lambda s: F.concat(s["symptom"], F.lit("="), s["n"]))))


@query("a4_user_trend", f"""WITH {b.LOGS_SQL}, t AS (
  SELECT time_bucket(INTERVAL 6 HOUR, created_at) AS window_start, user_id, {FIGURES} FROM logs GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, user_id, case_count, avg_severity, high_risk_count,
  medium_risk_count, low_risk_count, case_count - lag(case_count) OVER w AS case_change,
  {b.rounded("avg_severity - lag(avg_severity) OVER w", 2)} AS severity_change
FROM t WINDOW w AS (PARTITION BY user_id ORDER BY window_start)""")
def a4(spark, sf):
    return trends.user_trend(b.logs(spark, sf))


@query("a5_user_totals", "SELECT user_id, count(*) AS total FROM events GROUP BY 1")
def a5(spark, sf):
    return trends.user_totals(b.logs(spark, sf))


@query("a6_risk_distribution", f"""WITH {GAPPY_SQL} SELECT user_id, count(*) FILTER (risk_level = 'HIGH') AS "HIGH",
  count(*) FILTER (risk_level = 'MEDIUM') AS "MEDIUM", count(*) FILTER (risk_level = 'LOW') AS "LOW" FROM gappy GROUP BY 1""")
def a6(spark, sf):
    return trends.risk_distribution(gappy(spark, sf))


TOP_SQL = """SELECT coalesce(top_disease, 'Unknown') AS disease, count(*) AS "count" FROM gappy
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""


@query("a7_top_diseases", f"WITH {GAPPY_SQL} {TOP_SQL}")
def a7(spark, sf):
    return trends.top_diseases(gappy(spark, sf))


LAST_SQL = """newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, log_id DESC) AS rn FROM gappy) WHERE rn = 1),
latest AS (SELECT user_id, coalesce(severity, 0.0) AS recent_severity, coalesce(top_disease, '—') AS recent_disease,
  coalesce(risk_level, 'UNKNOWN') AS recent_risk FROM newest)"""


@query("e1_latest_per_user", f"WITH {GAPPY_SQL}, {LAST_SQL} SELECT * FROM latest")
def e1(spark, sf):
    return trends.latest_result(gappy(spark, sf))


@query("e2_user_history", f"""WITH {b.LOGS_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, log_id DESC) AS rank FROM logs)
SELECT log_id, user_id, top_disease, severity, risk_level, created_at, rank FROM r WHERE rank <= 50""")
def e2(spark, sf):
    held = b.logs(spark, sf).select("log_id", "user_id", "top_disease", "severity", "risk_level", "created_at")
    return trends.user_history(held)


HISTORY_SQL = """hist AS (
  SELECT user_id, string_agg(strftime(created_at, '%m/%d %H:%M') || '=' || CAST(severity AS INT), '|' ORDER BY created_at, log_id) AS severity_history
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, log_id DESC) AS rn
        FROM gappy WHERE severity IS NOT NULL) WHERE rn <= 10 GROUP BY user_id)"""


def history_text(column):
    return b.bar(F.transform(column, lambda h: F.concat(h["date"], F.lit("="), h["severity"].cast("int"))))


@query("e3_severity_history", f"WITH {GAPPY_SQL}, {HISTORY_SQL} SELECT * FROM hist")
def e3(spark, sf):
    return trends.severity_history(gappy(spark, sf)).withColumn("severity_history", history_text("severity_history"))


@query("a8_dashboard", f"""WITH {GAPPY_SQL}, {LAST_SQL}, {HISTORY_SQL}, users AS (SELECT c_custkey AS user_id FROM customer),
top5 AS (SELECT string_agg(disease || '=' || "count", '|' ORDER BY "count" DESC, disease) AS disease_trend FROM ({TOP_SQL})),
agg AS (SELECT user_id, count(*) AS total, count(*) FILTER (risk_level = 'HIGH') AS high,
  count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low FROM gappy GROUP BY 1)
SELECT user_id, coalesce(total, 0) AS total_consultations, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
  coalesce(low, 0) AS low, coalesce(recent_severity, 0.0) AS recent_severity, coalesce(recent_disease, '—') AS recent_disease,
  coalesce(recent_risk, 'UNKNOWN') AS recent_risk, (SELECT disease_trend FROM top5) AS disease_trend,
  coalesce(severity_history, '') AS severity_history
FROM users LEFT JOIN agg USING (user_id) LEFT JOIN latest USING (user_id) LEFT JOIN hist USING (user_id)""")
def a8(spark, sf):
    users = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    out = trends.dashboard(users, gappy(spark, sf))
    risk = F.col("risk_distribution")
    return out.select(
        "user_id", "total_consultations", risk["HIGH"].alias("high"), risk["MEDIUM"].alias("medium"), risk["LOW"].alias("low"),
        "recent_severity", "recent_disease", "recent_risk",
        b.bar(F.transform("disease_trend", lambda d: F.concat(d["disease"], F.lit("="), d["count"]))).alias("disease_trend"),
        history_text("severity_history").alias("severity_history"),
    )


LIMITS = [("signup", 1), ("purchase", 2)]


@query("a14_rate_violations", f"""WITH {b.LOGS_SQL}, limits AS {b.values(["event_type", "allowed"], LIMITS)},
n AS (SELECT user_id, top_disease AS event_type, time_bucket(INTERVAL 1 DAY, created_at) AS window_start, count(*) AS n FROM logs GROUP BY ALL)
SELECT user_id, event_type, window_start, n, coalesce(allowed, 3) AS allowed FROM n LEFT JOIN limits USING (event_type)
WHERE n > coalesce(allowed, 3)""")
def a14(spark, sf):
    events = b.logs(spark, sf).withColumnRenamed("top_disease", "event_type")
    return trends.rate_violations(events, values_table(spark, ["event_type", "allowed"], LIMITS), 3, "1 day")


@query("p9_history_search", f"""WITH {b.LOGS_SQL}
SELECT log_id, user_id FROM logs WHERE contains(lower(array_to_string(symptoms, ', ') || ' ' || top_disease), 'ache')""")
def p9(spark, sf):
    return cleanse.search_history(b.logs(spark, sf), " Ache ").select("log_id", "user_id")


@query("p11_identity", "SELECT c_custkey, trim(lower('  ' || c_name || ' ')) AS email FROM customer")
def p11(spark, sf):
    users = b.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("email"))
    return cleanse.normalise_identity(users)


@query("k1_trend_upsert", f"""WITH {b.LOGS_SQL}, t AS (
  SELECT top_disease, time_bucket(INTERVAL 6 HOUR, created_at) AS window_start, {FIGURES} FROM logs GROUP BY 1, 2),
old AS (SELECT top_disease, time_bucket(INTERVAL 6 HOUR, created_at) AS window_start, {FIGURES} FROM logs
  WHERE duration_days < 10 GROUP BY 1, 2),
new AS (SELECT * FROM t WHERE window_start >= TIMESTAMP '2024-01-15 00:00:00')
SELECT * FROM new UNION ALL SELECT * FROM old WHERE (top_disease, window_start) NOT IN (SELECT (top_disease, window_start) FROM new)""")
def k1(spark, sf):
    logs = b.logs(spark, sf)
    stamp = lambda rows, day: rows.drop("window_end").withColumn("updated_at", F.expr(f"TIMESTAMP_NTZ '{day}'"))
    old = stamp(trends.windowed_trend(logs.filter("duration_days < 10")), "2024-02-01 00:00:00")
    new = stamp(trends.windowed_trend(logs), "2024-02-02 00:00:00").filter("window_start >= TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    path = run_dir(spark, "trends")
    tables.upsert_trends(spark, path, old)
    tables.upsert_trends(spark, path, new)
    return tables.trend_table(spark, path).read().drop("updated_at")


@query("k3_flag_used", f"""WITH {b.LOGS_SQL} SELECT log_id,
  CASE WHEN labeled AND NOT coalesce(used_for_training, false) THEN true ELSE used_for_training END AS used_for_training,
  CASE WHEN labeled AND NOT coalesce(used_for_training, false) THEN {AS_OF_SQL} END AS trained_at FROM logs""")
def k3(spark, sf):
    logs = b.logs(spark, sf).withColumn("trained_at", F.lit(None).cast("timestamp_ntz"))
    used = logs.filter("labeled AND NOT coalesce(used_for_training, false)").select("log_id")
    table = VersionedTable(spark, run_dir(spark, "logs"), ["log_id"])
    table.write(logs.select("log_id", "used_for_training", "trained_at"))
    tables.mark_used(table, used, as_of())
    return table.read()


@query("k4_update_prediction", f"""WITH {b.LOGS_SQL}, u AS (
  SELECT user_id * 3 AS log_id, max_by(top_disease, (created_at, log_id)) AS p, max(created_at) AS stamp FROM logs GROUP BY 1)
SELECT log_id, CASE WHEN stamp IS NOT NULL THEN p ELSE top_disease END AS prediction, stamp AS updated_at
FROM logs LEFT JOIN u USING (log_id)""")
def k4(spark, sf):
    logs = b.logs(spark, sf)
    updates = logs.select((F.col("user_id") * 3).alias("log_id"), F.col("top_disease").alias("prediction"),
                          F.col("created_at").alias("updated_at"))
    stored = logs.select("log_id", F.col("top_disease").alias("prediction"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    table = VersionedTable(spark, run_dir(spark, "logs"), ["log_id"])
    table.write(stored)
    tables.store_predictions(table, updates)
    return table.read()


@query("f1_term_normalise", f"""WITH {b.LOGS_SQL}, t AS (SELECT unnest(symptoms) AS raw FROM logs)
SELECT raw, replace(lower(trim(raw)), ' ', '_') AS norm, count(*) AS n FROM t GROUP BY ALL""")
def f1(spark, sf):
    terms = b.logs(spark, sf).select(F.explode("symptoms").alias("raw"))
    return terms.groupBy("raw", normalise_term("raw").alias("norm")).agg(F.count("*").alias("n"))

