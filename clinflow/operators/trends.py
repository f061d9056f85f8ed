"""Disease trends, per-user reports and dashboard figures over symptom logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinflow.operators.joining import latest, lookup_join, top_rows

LEVELS = ["HIGH", "MEDIUM", "LOW"]
NO_DISEASE = "—"


def exact_average(value: str) -> Column:
    """Average to two places from an exact decimal sum, so that it does not depend on the row order."""
    total = F.sum(F.col(value).cast("decimal(18,4)")).cast("double")
    return F.round(total / F.count(value), 2)


def _figures() -> list[Column]:
    counts = [F.count_if(F.col("risk_level") == level).alias(f"{level.lower()}_risk_count") for level in LEVELS]
    return [F.count("*").alias("case_count"), exact_average("severity").alias("avg_severity"), *counts]


def recent_logs(logs: DataFrame, as_of: Column, hours: int = 6) -> DataFrame:
    """The trend columns of logs not older than `hours` before `as_of`."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    held = ["symptoms", "top_disease", "risk_level", "severity", "created_at"]
    return logs.filter(F.col("created_at") >= since).select(*[name for name in held if name in logs.columns])


def disease_trend(logs: DataFrame) -> DataFrame:
    """A1: cases, average severity and risk counts per disease, commonest first."""
    return logs.groupBy("top_disease").agg(*_figures()).orderBy(F.desc("case_count"), F.asc("top_disease"))


def windowed_trend(logs: DataFrame, width: str = "6 hours", key: tuple[str, ...] = ("top_disease",)) -> DataFrame:
    """A2: the trend per tumbling window. Works on streams after a watermark."""
    grouped = logs.groupBy(F.window("created_at", width), *key).agg(*_figures())
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *[name for name in grouped.columns if name != "window"],
    )


def common_symptoms(logs: DataFrame, top: int = 5) -> DataFrame:
    """A3: the commonest symptoms per disease, with their counts."""
    counts = logs.select("top_disease", F.explode("symptoms").alias("symptom")).groupBy("top_disease", "symptom").agg(
        F.count("*").alias("n")
    )
    ranked = top_rows(counts, ["top_disease"], [F.desc("n"), F.asc("symptom")], top, "rank")
    lists = ranked.groupBy("top_disease").agg(F.array_sort(F.collect_list(F.struct("rank", "symptom", "n"))).alias("r"))
    return lists.select(
        "top_disease",
        F.transform("r", lambda s: F.struct(s["symptom"].alias("symptom"), s["n"].alias("n"))).alias("symptoms"),
    )


def user_trend(logs: DataFrame, width: str = "6 hours") -> DataFrame:
    """A4: A2 per user with the change since the user's window before.

    The change is taken after the aggregation: one row per window is left of each user.
    """
    trend = windowed_trend(logs, width, ("user_id",))
    before = Window.partitionBy("user_id").orderBy("window_start")
    return trend.withColumn("case_change", F.col("case_count") - F.lag("case_count").over(before)).withColumn(
        "severity_change", F.round(F.col("avg_severity") - F.lag("avg_severity").over(before), 2)
    )


def user_totals(logs: DataFrame) -> DataFrame:
    """A5."""
    return logs.groupBy("user_id").agg(F.count("*").alias("total"))


def risk_distribution(logs: DataFrame) -> DataFrame:
    """Counts of the three levels per user, zero where none."""
    counts = [F.count_if(F.col("risk_level") == level).alias(level) for level in LEVELS]
    return logs.groupBy("user_id").agg(*counts)


def top_diseases(logs: DataFrame, top: int = 5) -> DataFrame:
    """Commonest diseases over all users."""
    counts = logs.groupBy(F.coalesce("top_disease", F.lit("Unknown")).alias("disease")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("disease")).limit(top)


def latest_result(logs: DataFrame) -> DataFrame:
    """Newest log per user with defaults; combined before the shuffle."""
    newest = latest(
        logs.select("user_id", "severity", "top_disease", "risk_level", "created_at", "log_id"),
        ["user_id"], F.struct("created_at", "log_id"),
    )
    return newest.select(
        "user_id",
        F.coalesce("severity", F.lit(0.0)).alias("recent_severity"),
        F.coalesce("top_disease", F.lit(NO_DISEASE)).alias("recent_disease"),
        F.coalesce("risk_level", F.lit("UNKNOWN")).alias("recent_risk"),
    )


def user_history(logs: DataFrame, top: int = 50) -> DataFrame:
    """Newest logs per user."""
    return top_rows(logs, ["user_id"], [F.desc("created_at"), F.desc("log_id")], top, "rank")


def severity_history(logs: DataFrame, top: int = 10) -> DataFrame:
    """The last severities per user, oldest first, as (date, severity) structs."""
    kept = top_rows(
        logs.filter(F.col("severity").isNotNull()).select("user_id", "created_at", "log_id", "severity"),
        ["user_id"], [F.desc("created_at"), F.desc("log_id")], top,
    )
    lists = kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "log_id", "severity"))).alias("r"))
    return lists.select("user_id", F.transform("r", lambda x: F.struct(
        F.date_format(x["created_at"], "MM/dd HH:mm").alias("date"), x["severity"].alias("severity")
    )).alias("severity_history"))


def dashboard(users: DataFrame, logs: DataFrame) -> DataFrame:
    """One row per user, with defaults for users without logs."""
    figures = logs.groupBy("user_id").agg(
        F.count("*").alias("total_consultations"),
        *[F.count_if(F.col("risk_level") == level).alias(level) for level in LEVELS],
        F.max_by(F.struct("severity", "top_disease", "risk_level"), F.struct("created_at", "log_id")).alias("_last"),
    )
    trend = top_diseases(logs).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), F.col("disease")))),
            lambda d: F.struct(d["disease"].alias("disease"), (-d["order"]).alias("count")),
        )
    )
    empty = F.array().cast("array<struct<date:string,severity:double>>")
    joined = users.select("user_id").join(figures, "user_id", "left").join(severity_history(logs), "user_id", "left")
    return joined.select(
        "user_id",
        F.coalesce("total_consultations", F.lit(0)).alias("total_consultations"),
        F.struct(*[F.coalesce(level, F.lit(0)).alias(level) for level in LEVELS]).alias("risk_distribution"),
        F.coalesce("_last.severity", F.lit(0.0)).alias("recent_severity"),
        F.coalesce("_last.top_disease", F.lit(NO_DISEASE)).alias("recent_disease"),
        F.coalesce("_last.risk_level", F.lit("UNKNOWN")).alias("recent_risk"),
        trend.scalar().alias("disease_trend"),
        F.coalesce("severity_history", empty).alias("severity_history"),
    )


def rate_violations(events: DataFrame, limits: DataFrame, default: int = 60, width: str = "1 minute") -> DataFrame:
    """(client, event type, window) with more events than allowed.

    `limits` has (event_type, allowed); other types share the default.
    """
    counts = events.groupBy("user_id", "event_type", F.window("created_at", width).alias("w")).agg(F.count("*").alias("n"))
    judged = lookup_join(counts, limits, ["event_type"], spread=["user_id", "w"])
    allowed = F.coalesce("allowed", F.lit(default))
    return judged.filter(F.col("n") > allowed).select(
        "user_id", "event_type", F.col("w.start").alias("window_start"), "n", allowed.alias("allowed")
    )
