import datetime as dt
import json

from pyspark.sql import functions as F

from clinflow import schemas
from clinflow.lookups import tables
from clinflow.operators.medicines import tier_lists
from clinflow.operators.trends import windowed_trend
from clinflow.plans.scoring import Lookups, score_requests
from clinflow.sources import events
from clinflow.streaming import jobs

LINES = [
    {"symptoms": ["fever", "cough"], "duration": 3, "age": 25, "top_disease": "x", "risk_level": "LOW", "severity": 27, "log_id": "1"},
    {"symptoms": ["chest pain"], "duration_days": 1, "age": 30, "user_id": "u", "log_id": "2"},
    {"symptoms": [], "log_id": "3"},
]


def lookups(spark):
    return Lookups(tables.features(spark), tables.synonyms(spark), tables.disease_features(spark), tables.risk_bands(spark),
                   [("static", tier_lists(tables.medicines(spark), "pos"))])


def test_scoring_stream_equals_batch(spark, rows, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(line) for line in LINES) + '\n{"symptoms": ["cut\n')
    out = str(tmp_path / "out")
    stream = events.read_event_files(spark, str(folder), "symptom-input")
    jobs.scoring_stream(stream, lookups(spark), out, out + "/checkpoint", native=True).awaitTermination()
    got = {}
    for row in spark.read.parquet(out + "/results").collect():
        value = json.loads(row.value)
        got[value["log_id"]] = (value["severity"], value["risk_level"], [p["disease"] for p in value["predictions"]])
    requests = rows("request_id STRING, user_id STRING, symptoms ARRAY<STRING>, duration_days INT, age INT",
                    ("1", None, ["fever", "cough"], 3, 25), ("2", "u", ["chest pain"], 1, 30))
    want = {r.request_id: (r.severity, r.risk_level, [p.disease for p in r.predictions]) for r in score_requests(requests, lookups(spark), native=True).collect()}
    assert got == want and got["1"][0] == 27
    letters = [r.reason for r in spark.read.parquet(out + "/dead_letters").collect()]
    assert sorted(letters) == ["no symptoms", "not readable"]
    assert spark.read.parquet(out + "/audit").count() == 4
    assert sorted(r.key for r in spark.read.parquet(out + "/results").collect()) == ["", "u"]


def test_scoring_stream_over_several_batches_and_a_restart(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        stream = events.read_event_files(spark, str(folder), "symptom-input", files_per_trigger=1)
        jobs.scoring_stream(stream, lookups(spark), out, out + "/checkpoint", native=True).awaitTermination()

    for name, terms in (("a", ["cough"]), ("b", ["fever", "zzzzqq"])):
        (folder / f"{name}.json").write_text(json.dumps({"symptoms": terms, "log_id": name}))
    run()
    (folder / "c.json").write_text(json.dumps({"symptoms": ["skin rash joint pain"], "log_id": "c"}))
    run()
    got = {json.loads(r.value)["log_id"]: len(json.loads(r.value)["predictions"]) for r in spark.read.parquet(out + "/results").collect()}
    assert set(got) == {"a", "b", "c"} and all(got.values())
    assert spark.read.parquet(out + "/results").count() == 3
    assert sorted(r.raw for r in spark.read.parquet(out + "/terms/*").collect()) == ["cough", "fever", "skin rash joint pain", "zzzzqq"]


def test_unknown_topics_are_ignored(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"topic": "retrain-trigger", "force": true}\n{"topic": "other"}\n')
    calls = []
    stream = events.of_topic(events.read_event_files(spark, str(folder)), "retrain-trigger")
    jobs.retrain_stream(stream, calls.append, str(tmp_path / "c")).awaitTermination()
    assert calls == [True]


def test_chat_memory_over_several_batches(spark, rows, tmp_path):
    at = dt.datetime(2024, 1, 1)
    data = [("u", f"m{i}", f"r{i}", at + dt.timedelta(minutes=i)) for i in range(14)] + [("v", "m", "r", at)]
    path = str(tmp_path / "in")
    for start in (0, 7):
        rows("user_id STRING, message STRING, reply STRING, ts TIMESTAMP", *data[start:start + 7]).coalesce(1).write.mode("append").parquet(path)
    rows("user_id STRING, message STRING, reply STRING, ts TIMESTAMP", *data[14:]).coalesce(1).write.mode("append").parquet(path)
    stream = events.read_table_files(spark, path, "user_id STRING, message STRING, reply STRING, ts TIMESTAMP", files_per_trigger=1)
    seen = {}

    def keep(batch, batch_id):
        for row in batch.collect():
            seen.setdefault((row.user_id, batch_id), []).append((row.seq, row.role, row.content))

    jobs.chat_memory(stream).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = max(batch for user, batch in seen if user == "u")
    memory = sorted(seen["u", last])
    assert len(memory) == 20 and memory[0][1:] == ("human", "m4") and memory[-1][1:] == ("ai", "r13")


LOGS = ("log_id INT, top_disease STRING, severity DOUBLE, risk_level STRING, created_at TIMESTAMP, labeled BOOLEAN, used_for_training BOOLEAN")
AT = dt.datetime(2024, 1, 1)


def log_rows(rows, n=120):
    return rows(LOGS, *[(i % 110, "ab"[i % 2], 50.0 if i % 7 else None, "HIGH" if i % 4 == 0 else "LOW", AT + dt.timedelta(minutes=10 * (i % 110)), True, None)
                        for i in range(n)])


def in_steps(spark, make, parts, schema, folder, out):
    """Each part of the rows as a further file, and the stream run to its end and started again after each."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        frame = make(events.read_table_files(spark, folder, schema, files_per_trigger=1))
        jobs.table_stream(frame, out, out + "-checkpoint").awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def test_trend_of_files_in_any_order(spark, rows, tmp_path):
    logs = log_rows(rows)
    late = logs.filter("log_id < 20")
    for name, parts in {"early": [logs], "late": [logs.filter("log_id >= 20"), late], "mixed": [logs.filter("log_id % 2 = 1"), logs.filter("log_id % 2 = 0")]}.items():
        held = in_steps(spark, jobs.trend_stream, parts, LOGS, str(tmp_path / name), str(tmp_path / f"{name}-out"))
        closed = F.lit(AT + dt.timedelta(minutes=10 * 109 - 60))
        want = windowed_trend(logs).filter(F.col("window_end") <= closed)
        got = jobs.trend_totals(held)
        assert got.count() == want.count() > 0 and got.drop("corrected").exceptAll(want.select(*got.drop("corrected").columns)).count() == 0
        corrected = {r.window_start for r in got.filter("corrected").collect()}
        assert corrected == ({AT, *([] if name == "late" else [r.window_start for r in got.collect()])} if name != "early" else set())


def test_every_high_log_alerts_once(spark, rows, tmp_path):
    logs = log_rows(rows)
    want = sorted(r.log_id for r in logs.filter("risk_level = 'HIGH'").select("log_id").distinct().collect())
    backwards = [logs.filter("log_id >= 60"), logs.filter("log_id < 60"), logs.filter("log_id < 100")]
    held = in_steps(spark, lambda stream: jobs.high_risk_alerts(stream).select("log_id"), backwards, LOGS, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(r.log_id for r in held.collect()) == want


def test_triggers_in_any_order_and_after_a_restart(spark, rows, tmp_path):
    logs = log_rows(rows, 170)
    for name, parts in {"one": [logs], "three": [logs.filter("log_id % 3 = 2"), logs.filter("log_id % 3 = 0"), logs.filter("log_id % 3 = 1")]}.items():
        held = in_steps(spark, jobs.retrain_triggers, parts, LOGS, str(tmp_path / name), str(tmp_path / f"{name}-out"))
        assert sorted((r.labelled, r.force) for r in held.collect()) == [(50, False), (100, False), (150, False)]


def test_schemas_parse(spark):
    for schema in (schemas.SYMPTOM_LOG, schemas.TREND, schemas.SYMPTOM_EVENT, schemas.CHAT_EVENT, schemas.RETRAIN_EVENT, schemas.LOG_EVENT):
        assert spark.createDataFrame([], schema).count() == 0


def test_micro_batches_of_events_have_a_file_for_each_task(spark, tmp_path, monkeypatch):
    from catalog import streams

    spark.range(4000).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "id AS user_id", "'view' AS event_type", "1D AS value", "'{}' AS props",
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(streams, "run_dir", lambda spark, label: str(tmp_path / label))
    streams.event_stream(spark, str(tmp_path))
    files = list((tmp_path / "events").glob("*.parquet"))
    assert len(files) == 4 * spark.sparkContext.defaultParallelism


class Held:
    """The state of one key in a test, and the calls that changed it."""

    def __init__(self):
        self.lists, self.values, self.timers, self.calls = {}, {}, set(), 0

    def getListState(self, name, schema):
        held = self

        class State:
            exists = lambda self: bool(held.lists.get(name))
            get = lambda self: iter(held.lists[name])

            def appendList(self, more):
                held.calls += 1
                held.lists[name] = held.lists.get(name, []) + more

            def put(self, more):
                held.lists[name] = more

            def clear(self):
                held.lists[name] = []
        return State()

    def getValueState(self, name, schema):
        held = self

        class State:
            exists = lambda self: name in held.values
            get = lambda self: held.values[name]
            update = lambda self, value: held.values.update({name: value})
            clear = lambda self: held.values.pop(name, None)
        return State()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class At:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark


def test_alerts_of_a_bucket_are_one_state(spark):
    import pandas as pd

    day, held, once = 24 * 60 * 60 * 1000, Held(), jobs.Once(90)
    once.init(held)

    def alerted(watermark, *logs):
        batches = [pd.DataFrame([(7, *log)], columns=["bucket", "log_id", "clock_ms"]) for log in logs]
        return sorted((str(name) for out in once.handleInputRows((7,), iter(batches), At(watermark)) for name in out["log_id"]))

    assert alerted(0, ("a", 5 * day), ("b", 9 * day), ("a", 2 * day), (None, 0)) == ["None", "a", "b"]
    assert held.calls == 1 and held.timers == {90 * day}
    assert alerted(0, ("b", 0), (None, 1), ("c", day)) == ["c"]
    held.timers.clear()
    list(once.handleExpiredTimer((7,), At(92 * day), None))
    assert sorted(map(str, held.lists["seen"])) == [str(("b", 99 * day))] and held.timers == {99 * day}
    assert alerted(92 * day, ("a", 3 * day), ("b", 3 * day)) == ["a"]
    assert held.timers == {99 * day} and ("a", 182 * day) in held.lists["seen"]


def test_alerts_with_large_and_missing_numbers(spark, rows, tmp_path):
    schema = "log_id BIGINT, user_id BIGINT, risk_level STRING, created_at TIMESTAMP, labeled BOOLEAN"
    big = 2**53
    logs = rows(schema, *[(big + i, None if i % 3 else big + 2 * i + 1, "HIGH", AT, None if i % 5 else True) for i in range(300)],
                (None, 1, "HIGH", AT, True), (None, 1, "HIGH", AT, True), (5, 5, "LOW", AT, True))
    held = in_steps(spark, jobs.high_risk_alerts, [logs, logs], schema, str(tmp_path / "in"), str(tmp_path / "out"))
    want = logs.filter("risk_level = 'HIGH'").distinct()
    assert held.count() == 301 and held.exceptAll(want).isEmpty()
