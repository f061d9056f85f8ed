"""Request and message validation, default fill, markup removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinflow.functions.text import printable_ratio, split_terms, strip, strip_markup_deep

MAX_SYMPTOMS = 20
MAX_SYMPTOM_LENGTH = 200
MAX_MESSAGE_LENGTH = 1000
MIN_PRINTABLE = 0.7


def as_terms(requests: DataFrame, column: str = "symptoms") -> DataFrame:
    """A text column of comma lists to an array column; arrays stay."""
    if requests.schema[column].dataType.typeName() == "string":
        return requests.withColumn(column, split_terms(column))
    return requests


def validate_requests(requests: DataFrame) -> DataFrame:
    """Defaults, integer casts and a `reason` (null when valid); the first failing rule wins.

    `duration_days` and `age` may be text, which must be a whole number, or numbers, which lose their fraction.
    Works on streams as well.
    """
    requests = as_terms(requests)
    duration, age = F.col("duration_days").cast("string"), F.col("age").cast("string")
    texts = {name for name, kind in requests.dtypes if kind == "string"}
    as_int = lambda name: F.expr(f"try_cast({f'trim({name})' if name in texts else name} as int)")
    bad_number = (duration.isNotNull() & as_int("duration_days").isNull()) | (age.isNotNull() & as_int("age").isNull())
    reason = (
        F.when(bad_number, F.lit("not an integer"))
        .when(F.coalesce(F.size("symptoms"), F.lit(0)) <= 0, F.lit("no symptoms"))
        .when(F.size("symptoms") > MAX_SYMPTOMS, F.lit("too many symptoms"))
        .when(F.exists("symptoms", lambda s: F.length(s) > MAX_SYMPTOM_LENGTH), F.lit("symptom too long"))
    )
    return requests.select(
        *[name for name in requests.columns if name not in ("duration_days", "age")],
        F.coalesce(as_int("duration_days"), F.when(duration.isNull(), F.lit(1))).alias("duration_days"),
        F.coalesce(as_int("age"), F.when(age.isNull(), F.lit(30))).alias("age"),
        reason.alias("reason"),
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with their reason."""
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def validate_messages(messages: DataFrame, column: str = "content") -> DataFrame:
    """Trimmed message and a `reason`, null when valid."""
    text = strip(F.coalesce(F.col(column), F.lit("")))
    reason = F.when(text == "", F.lit("empty")).when(F.length(text) > MAX_MESSAGE_LENGTH, F.lit("too long"))
    return messages.withColumn(column, text).withColumn("reason", reason)


def strip_all_markup(table: DataFrame) -> DataFrame:
    """P5 on every column, at any depth."""
    return table.select(*[strip_markup_deep(F.col(f.name), f.dataType).alias(f.name) for f in table.schema.fields])


def printable_gate(documents: DataFrame, column: str = "content", least: float = MIN_PRINTABLE) -> DataFrame:
    """Documents with a large enough share of printable ASCII."""
    return documents.withColumn("printable_ratio", printable_ratio(column)).filter(F.col("printable_ratio") >= least)


def fill_log_defaults(logs: DataFrame) -> DataFrame:
    """The flat form of a log; absent and null values get the same default."""
    def value(name: str, default, kind: str) -> Column:
        if name not in logs.columns:
            return F.lit(default).cast(kind).alias(name)
        return F.coalesce(F.col(name).cast(kind), F.lit(default)).alias(name)

    return logs.select(
        value("top_disease", "Unknown", "string"),
        value("risk_level", "UNKNOWN", "string"),
        value("severity", 0.0, "double"),
        F.col("created_at"),
    )


def search_history(logs: DataFrame, text: str) -> DataFrame:
    """Logs whose symptoms or disease contain `text`, in any case."""
    hay = F.concat(F.array_join("symptoms", ", "), F.lit(" "), F.coalesce("top_disease", F.lit("")))
    return logs.filter(F.contains(F.lower(hay), F.lit(text.strip().lower())))


def normalise_identity(users: DataFrame, column: str = "email") -> DataFrame:
    """P11."""
    return users.withColumn(column, strip(F.lower(column)))
