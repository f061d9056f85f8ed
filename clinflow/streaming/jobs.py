"""Streaming jobs.

Each job takes a streaming DataFrame and starts nothing it does not return. Sinks written per
micro-batch replace the part of a repeated batch, so a restart after a lost executor or driver
leaves no doubled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from clinflow import schemas
from clinflow.operators.cleanse import split_valid, validate_requests
from clinflow.operators.learning import MIN_SAMPLES, new_samples
from clinflow.operators.terms import TermStore
from clinflow.plans.scoring import Lookups, score_requests
from clinflow.session import send_by_value
from clinflow.sinks.tables import topic_records, write_batch
from clinflow.sources.events import good_and_bad, parse

send_by_value(__name__)

HISTORY = 20
HISTORY_MS = 24 * 60 * 60 * 1000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of the logs that alerts were given for.
BUCKETS = 4096
#: Parts that the rows of one window and disease are spread over.
SALTS = 16


def keep_state_on_disk(spark: SparkSession) -> None:
    """Keyed state of any size needs the store on disk; a store that the session names is left."""
    if spark.conf.get(STATE_STORE, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(STATE_STORE, None):
        spark.conf.set(STATE_STORE, ROCKS)


def requests_of(events: DataFrame) -> DataFrame:
    """Symptom events as requests; either name of the duration is read."""
    return events.select(
        F.col("log_id").alias("request_id"), "user_id", "symptoms",
        F.coalesce("duration_days", "duration").alias("duration_days"), "age",
    )


def audit_mirror(events: DataFrame, kind: str) -> DataFrame:
    """Every event as (type, payload)."""
    return events.select(F.lit(kind).alias("type"), F.col("value").alias("payload"))


def score_batch(batch: DataFrame, lookups: Lookups, native: bool = False, terms: TermStore | None = None,
                batch_id: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T1 on one micro-batch: result events, audit rows, dead letters. Only terms that `terms` hasn't seen are resolved."""
    parsed, bad = good_and_bad(parse(batch, schemas.SYMPTOM_EVENT))
    valid, rejected = split_valid(validate_requests(requests_of(parsed)))
    resolved = terms and terms.resolved(valid.select(F.explode_outer("symptoms").alias("raw")), batch_id)
    scored = score_requests(valid, lookups, native=native, resolved=resolved)
    results = scored.select(
        "user_id", F.col("request_id").alias("log_id"), "predictions", "risk_level", "severity"
    )
    letters = bad.select("value", F.lit("not readable").alias("reason")).unionByName(
        rejected.select(F.to_json(F.struct("request_id", "user_id", "symptoms")).alias("value"), "reason")
    )
    return topic_records(results, "prediction-result", "user_id"), audit_mirror(batch, "symptom-input"), letters


def scoring_stream(events: DataFrame, lookups: Lookups, out: str, checkpoint: str, native: bool = False,
                   **trigger) -> StreamingQuery:
    """T1 + T2: scores, audit rows and dead letters of each micro-batch below `out`, and the terms resolved so far."""
    terms = TermStore(f"{out}/terms", lookups.features, lookups.synonyms, native=native)

    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            results, audit, letters = score_batch(held, lookups, native, terms, batch_id)
            write_batch(results, f"{out}/results", batch_id)
            write_batch(audit, f"{out}/audit", batch_id)
            write_batch(letters, f"{out}/dead_letters", batch_id)
        finally:
            held.unpersist()

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def table_stream(rows: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to Parquet files."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
        "append"
    ).trigger(**(trigger or {"availableNow": True})).start()


MEMORY_ROW = "user_id string, seq int, role string, content string"


class Memory(StatefulProcessor):
    """The newest exchanges of a user, one state entry each, below the time and number of their message.

    A further exchange writes its own entry, and drops the oldest one of a full memory: what is written does not grow with the memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("exchanges", "at long, message string, reply string", "message string, reply string")
        self.last = handle.getValueState("last", "timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {place: tuple(text) for place, text in self.held.iterator()} if self.held.exists() else {}
        old = set(kept)
        for batch in rows:
            for ts, message, reply in zip(batch["ts"], batch["message"], batch["reply"]):
                at = int(pd.Timestamp(ts).timestamp() * 1000)
                kept[at, message or "", reply or ""] = (message, reply)
            # Only the newest exchanges can stay; older ones of a large group are dropped batch by batch.
            kept = dict(sorted(kept.items())[-(HISTORY // 2):])
        for place in old - set(kept):
            self.held.removeKey(place)
        for place in set(kept) - old:
            self.held.updateValue(place, kept[place])
        timer = max(max(place[0] for place in kept), timerValues.getCurrentWatermarkInMs()) + HISTORY_MS
        before = self.last.get()[0] if self.last.exists() else None
        if before != timer:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
            self.last.update((timer,))
        said = [(role, text) for _, (message, reply) in sorted(kept.items()) for role, text in (("human", message), ("ai", reply))]
        yield pd.DataFrame([(key[0], at, role, content) for at, (role, content) in enumerate(said)], columns=["user_id", "seq", "role", "content"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def chat_memory(chats: DataFrame, late: str = "1 hour") -> DataFrame:
    """T4: the last 20 messages per user as keyed state, forgotten 24 hours (of event time) after the last.

    Emits the whole memory of a user, in the order of event time, whenever it changes. A repeated exchange (same time, message and
    reply) is one. Rows of a user arrive in Arrow batches, of which only the last ten exchanges are kept at any time. Late
    exchanges find their place: the watermark moves the timers only.
    """
    keep_state_on_disk(chats.sparkSession)
    timed = chats.select("user_id", "ts", "message", "reply", F.col("ts").alias("_clock")).withWatermark("_clock", late).drop("_clock")
    return timed.groupBy("user_id").transformWithStateInPandas(Memory(), MEMORY_ROW, "update", "eventTime")


TRIGGER_ROW = "labelled long, force boolean"


class Counter(StatefulProcessor):
    """The number of labelled logs so far; a row for every further `least` of them."""

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.total.get()[0] if self.total.exists() else 0
        now = before + sum(int(batch["n"].sum()) for batch in rows)
        self.total.update((now,))
        fired = range(before // self.least + 1, now // self.least + 1)
        yield pd.DataFrame({"labelled": [n * self.least for n in fired], "force": [False] * len(fired)}).astype({"labelled": "int64", "force": bool})

    def close(self) -> None:
        pass


def counted_in_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row with the number of rows of a task."""
    yield pd.DataFrame({"n": [sum(len(batch) for batch in batches)]})


def retrain_triggers(logs: DataFrame, least: int = MIN_SAMPLES) -> DataFrame:
    """T5: a trigger row for every further `least` new labelled logs; `labelled` is the total that fires it.

    Each task counts its logs, and one key's state holds the sum: it is kept with the progress of the stream, so a restart goes on from it and a
    repeated micro-batch counts once. The total has no order, and neither have the files.
    """
    keep_state_on_disk(logs.sparkSession)
    counts = new_samples(logs).select(F.lit(1).alias("one")).mapInPandas(counted_in_part, "n long").filter("n > 0")
    return counts.withColumn("key", F.lit(0)).groupBy("key").transformWithStateInPandas(Counter(least), TRIGGER_ROW, "append", "none")


def retrain_stream(triggers: DataFrame, run, checkpoint: str, **trigger) -> StreamingQuery:
    """Calls `run(force)` for micro-batches with trigger events, in a query of its own, so scoring goes on."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        asked, _ = good_and_bad(parse(batch, schemas.RETRAIN_EVENT))
        row = asked.agg(F.count("*").alias("n"), F.max(F.coalesce("force", F.lit(False))).alias("force")).first()
        if row.n:
            run(bool(row.force))

    return triggers.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


class Once(StatefulProcessor):
    """The first row of each log of a bucket, and no other while the log is remembered.

    The logs of a bucket are a list: what is new is appended to it, so a micro-batch costs a few calls for each bucket, not for each log.
    """

    def __init__(self, days: int):
        self.keep = days * 24 * 60 * 60 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "id string, until long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            both = batch if first is None else pd.concat([first, batch])
            first = both.sort_values("clock_ms", kind="stable").drop_duplicates("log_id")
        known = {name for name, _ in self.seen.get()} if self.seen.exists() else set()
        ids = [None if pd.isna(name) else name for name in first["log_id"]]
        first = first[[name not in known for name in ids]]
        if len(first):
            until = (first["clock_ms"].clip(lower=timerValues.getCurrentWatermarkInMs()) + self.keep).tolist()
            self.seen.appendList(list(zip((name for name in ids if name not in known), until)))
            self.wake(min(until))
            yield first.drop(columns=["bucket", "clock_ms"])

    def wake(self, at: int) -> None:
        """The bucket's timer is at the first of its logs to be forgotten."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        kept = [entry for entry in map(tuple, self.seen.get()) if entry[1] > now]
        self.timer.clear()
        if kept:
            self.seen.put(kept)
            self.wake(min(until for _, until in kept))
        else:
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def high_risk_alerts(logs: DataFrame, days: int = 90, late: str = "1 hour") -> DataFrame:
    """HIGH logs, each log once, however late its event time is.

    The watermark drops no row; it only moves the timers that forget a log `days` of event time after it, or after the watermark if the log was later.
    A repeat within that time gives no second alert. Of repeats in one micro-batch the earliest counts; a null event time is the earliest.
    Logs are dealt into `BUCKETS` by a hash. Whole numbers pass Python as text, as a null beside them would make them floats.
    """
    keep_state_on_disk(logs.sparkSession)
    alerts = logs.filter(F.col("risk_level") == "HIGH").withColumn("created_at", F.col("created_at").cast("timestamp"))
    at = F.coalesce(F.unix_millis("created_at"), F.lit(0))
    bucket = F.pmod(F.xxhash64("log_id"), F.lit(BUCKETS))
    timed = alerts.withColumns({"clock_ms": at, "_clock": F.col("created_at"), "bucket": bucket}).withWatermark("_clock", late).drop("_clock")
    as_text = [field.name for field in alerts.schema if isinstance(field.dataType, IntegralType) or field.name == "log_id"]
    texts = timed.withColumns({name: F.col(name).cast("string") for name in as_text})
    kind = StructType([StructField(field.name, StringType() if field.name in as_text else field.dataType) for field in alerts.schema])
    found = texts.groupBy("bucket").transformWithStateInPandas(Once(days), kind, "append", "eventTime")
    return found.select(*[F.col(field.name).cast(field.dataType) for field in alerts.schema])


TREND_PART = ("window_start timestamp, window_end timestamp, top_disease string, case_count long, severity_count long, severity_sum decimal(28,4), "
              "high_risk_count long, medium_risk_count long, low_risk_count long, late boolean")
TREND_SUMS = ["case_count", "severity_count", "severity_sum", "high_risk_count", "medium_risk_count", "low_risk_count"]


class Window(StatefulProcessor):
    """Sums of a window until it closes; rows that come later leave at once, marked as late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "cases long, severities long, severity decimal(28,4), high long, medium long, low long, start timestamp, end timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, start, end = [0, 0, Decimal(0), 0, 0, 0], None, None
        for batch in rows:
            start, end = batch["window_start"].iloc[0], batch["window_end"].iloc[0]
            known = batch["severity"].dropna()
            level = batch["risk_level"]
            for i, more in enumerate((len(batch), len(known), sum(known, Decimal(0)), *(int((level == name).sum()) for name in ("HIGH", "MEDIUM", "LOW")))):
                total[i] += more
        closes = int(end.timestamp() * 1000)
        if self.sums.exists():
            total = [a + b for a, b in zip(total, self.sums.get())]
        elif closes <= timerValues.getCurrentWatermarkInMs():
            yield self.row(key, start, end, total, True)
            return
        else:
            self.handle.registerTimer(closes)
        self.sums.update((*total, start.to_pydatetime(), end.to_pydatetime()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *total, start, end = self.sums.get()
        self.sums.clear()
        yield self.row(key, start, end, total, False)

    def row(self, key, start, end, total, late: bool) -> pd.DataFrame:
        return pd.DataFrame([(start, end, key[1], *total, late)], columns=["window_start", "window_end", "top_disease", *TREND_SUMS, "late"])

    def close(self) -> None:
        pass


def trend_stream(logs: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """A2 on a stream, as sums: a window's rows come out once it is closed, rows that come after that as corrections (`late`).

    The watermark moves the timers only, so no row is dropped. A window and disease is spread over parts by a hash of the row, so that one of
    them may have a large share of the rows; `trend_totals` adds parts and corrections.
    """
    keep_state_on_disk(logs.sparkSession)
    timed = logs.select(
        F.window(F.col("created_at").cast("timestamp"), width).alias("w"), "top_disease", "risk_level",
        F.col("severity").cast("decimal(18,4)").alias("severity"), F.col("created_at").cast("timestamp").alias("_clock"),
        F.pmod(F.xxhash64(*[F.col(name) for name in logs.columns if not name.startswith("_")]), F.lit(SALTS)).alias("part"),
    ).withWatermark("_clock", late)
    rows = timed.select(
        F.col("w.start").cast("long").alias("key"), "top_disease", "part", F.col("w.start").cast("long").cast("timestamp").alias("window_start"),
        F.col("w.end").cast("long").cast("timestamp").alias("window_end"), "severity", "risk_level",
    )
    return rows.groupBy("key", "top_disease", "part").transformWithStateInPandas(Window(), TREND_PART, "append", "eventTime")


def trend_totals(parts: DataFrame) -> DataFrame:
    """Windows of A2 from the rows that `trend_stream` wrote; `corrected` is true where rows came after the window had closed."""
    sums = parts.groupBy("window_start", "window_end", "top_disease").agg(
        *[F.sum(name).alias(name) for name in TREND_SUMS], F.max("late").alias("corrected"))
    return sums.select(
        "window_start", "window_end", "top_disease", "case_count",
        F.round(F.col("severity_sum").cast("double") / F.col("severity_count"), 2).alias("avg_severity"),
        "high_risk_count", "medium_risk_count", "low_risk_count", "corrected",
    )
