import datetime as dt

from pyspark.sql import functions as F

from clinflow.operators import cleanse, joining, trends
from clinflow.plans.scoring import trend_batch
from clinflow.sinks import tables

LOG = "log_id INT, user_id STRING, top_disease STRING, risk_level STRING, severity DOUBLE, created_at TIMESTAMP"
DAY = dt.datetime(2024, 1, 1, 12)


def hours(n):
    return DAY - dt.timedelta(hours=n)


def sample(rows):
    return rows(LOG, (1, "a", "Flu", "HIGH", 80.0, hours(1)), (2, "a", "Flu", "LOW", None, hours(2)),
                (3, "b", None, "MEDIUM", 45.0, hours(3)), (4, "b", "Flu", None, 10.0, hours(30)))


def test_batch_trend(rows, values):
    out = trend_batch(sample(rows), F.lit(DAY), 6)
    assert values(out) == [("Flu", 2, 40.0, 1, 0, 1), ("Unknown", 1, 45.0, 0, 1, 0)]


def test_dashboard_defaults(rows):
    users = rows("user_id STRING", ("a",), ("b",), ("none",))
    got = {r.user_id: r for r in trends.dashboard(users, sample(rows)).collect()}
    assert got["none"].total_consultations == 0 and got["none"].recent_disease == "—" and got["none"].severity_history == []
    assert got["a"].risk_distribution.asDict() == {"HIGH": 1, "MEDIUM": 0, "LOW": 1}
    assert got["a"].recent_severity == 80.0 and [h.severity for h in got["b"].severity_history] == [10.0, 45.0]
    assert [(d.disease, d["count"]) for d in got["b"].disease_trend] == [("Flu", 3), ("Unknown", 1)]


def test_history_search(rows):
    logs = rows("log_id INT, symptoms ARRAY<STRING>, top_disease STRING", (1, ["Head ache"], "Flu"), (2, ["x"], None))
    assert [r.log_id for r in cleanse.search_history(logs, " ACHE").collect()] == [1]


def test_numbering_and_frames_match_plain_windows(spark):
    from pyspark.sql import Window

    rows = spark.range(3_000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("user_id"),
        F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(100_000))).alias("ts"))
    numbered = joining.numbered(rows, ["user_id"], ["ts", "id"], F.date_trunc("hour", "ts"), "seq")
    plain = Window.partitionBy("user_id").orderBy("ts", "id")
    wrong = numbered.withColumn("want", F.row_number().over(plain) - 1).filter("want <> seq")
    assert wrong.count() == 0
    for width in (16, 4096):
        framed = joining.framed(numbered, "user_id", "seq", 4, {"before": lambda w: F.collect_list("id").over(w)}, width)
        want = F.collect_list("id").over(plain.rowsBetween(-4, -1))
        assert framed.withColumn("want", want).filter("want <> before").count() == 0
        assert framed.count() == 3_000


def test_upsert_rewrites_touched_days_only(spark, rows, tmp_path):
    path = str(tmp_path / "trends")
    first = rows("top_disease STRING, case_count INT, window_start TIMESTAMP, updated_at TIMESTAMP",
                 ("Flu", 1, hours(0), hours(0)), ("Flu", 2, hours(48), hours(0)), ("Cold", 3, hours(0), hours(0)))
    tables.upsert_trends(spark, path, first)
    tables.upsert_trends(spark, path, rows(
        "top_disease STRING, case_count INT, window_start TIMESTAMP, updated_at TIMESTAMP", ("Flu", 9, hours(0), hours(-1))))
    got = {(r.top_disease, r.window_start): r.case_count for r in tables.trend_table(spark, path).read().collect()}
    assert got == {("Flu", hours(0)): 9, ("Flu", hours(48)): 2, ("Cold", hours(0)): 3}


def test_flags_updates_and_records(spark, rows):
    logs = rows("log_id INT, used_for_training BOOLEAN, trained_at TIMESTAMP", (1, None, None), (2, True, hours(9)), (3, False, None))
    got = {r.log_id: (r.used_for_training, r.trained_at) for r in tables.flag_used(logs, rows("log_id INT", (1,), (1,)), F.lit(DAY)).collect()}
    assert got == {1: (True, DAY), 2: (True, hours(9)), 3: (False, None)}
    topic = tables.topic_records(rows("user_id STRING, n INT", ("u", 1), (None, 2)), "t", "user_id")
    assert sorted((r.topic, r.key, r.value) for r in topic.collect()) == [("t", "", '{"n":2}'), ("t", "u", '{"user_id":"u","n":1}')]


def test_records_are_published_once_in_batch_and_stream(spark, rows, values, tmp_path):
    records = tables.topic_records(rows("user_id STRING, n INT", ("u", 1), (None, 2)), "t", "user_id")
    tables.publish(records, "json", path=str(tmp_path / "batch"))
    want = [("t", "", '{"n":2}'), ("t", "u", '{"user_id":"u","n":1}')]
    read = lambda name: values(spark.read.schema("topic STRING, key STRING, value STRING").json(str(tmp_path / name)))
    assert read("batch") == want
    records.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "in"))
        query = tables.publish(stream, "json", path=str(tmp_path / "stream"), checkpointLocation=str(tmp_path / "c"))
        query.processAllAvailable()
        query.stop()
    assert read("stream") == want
