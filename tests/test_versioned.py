import pytest
from pyspark.sql import functions as F

from clinflow.operators.joining import latest
from clinflow.sinks import tables
from clinflow.sinks.versioned import Conflict, VersionedTable

LOGS = "log_id INT, prediction STRING, updated_at TIMESTAMP, used_for_training BOOLEAN, trained_at TIMESTAMP"


def upsert(held, new):
    rows = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(rows, ["id"], F.col("_new")).drop("_new")


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), ["id"], parts=4)


def content(rows):
    return {r.id: r.v for r in rows.collect()}


def test_versions_and_untouched_parts(spark, rows, table):
    with pytest.raises(ValueError):
        table.read()
    assert table.merge(rows("id INT, v STRING", *[(i, "a") for i in range(40)]), upsert) == 1
    old = table.read()
    before = table.current()[1]["folders"]
    assert table.merge(rows("id INT, v STRING", (3, "b"), (99, "c")), upsert) == 2
    after = table.current()[1]["folders"]
    assert 0 < sum(before[p] != after[p] for p in before) <= 2 and len(before) == 4
    want = {i: "a" for i in range(40)}
    assert content(old) == content(table.read(1)) == want and content(table.read()) == want | {3: "b", 99: "c"}
    assert table.merge(rows("id INT, v STRING"), upsert) == 2
    assert table.write(rows("id INT, v STRING", (1, None))) == 3 and content(table.read()) == {1: None}
    assert table.vacuum(keep=1) > 0 and table.versions() == [3] and content(table.read()) == {1: None}


def test_a_killed_write_leaves_the_old_version(spark, rows, table):
    table.write(rows("id INT, v STRING", (1, "a"), (2, "a")))
    broken = F.when(F.col("id") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("v"))
    with pytest.raises(Exception, match="killed"):
        table.merge(rows("id INT, v STRING", (1, "b"), (2, "b")), lambda held, new: upsert(held, new).withColumn("v", broken))
    table._write(rows("id INT, v STRING", (7, "x")))  # written, but the writer dies before its commit
    assert table.versions() == [1] and content(table.read()) == {1: "a", 2: "a"}
    assert table.merge(rows("id INT, v STRING", (2, "c")), upsert) == 2 and content(table.read()) == {1: "a", 2: "c"}


def test_two_writers(spark, rows, table):
    table.write(rows("id INT, v STRING", *[(i, "a") for i in range(8)]))
    tries = []

    def slow(held, new):
        if not tries:  # another writer commits in between
            tries.append(1)
            table.merge(rows("id INT, v STRING", (5, "other")), upsert)
        return upsert(held, new)

    assert table.merge(rows("id INT, v STRING", (6, "mine")), slow) == 3
    assert content(table.read()) == {i: "a" for i in range(8)} | {5: "other", 6: "mine"}
    with pytest.raises(Conflict):
        table._commit(3, table.current()[1])


def test_stored_flags_and_predictions(spark, rows, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "logs"), ["log_id"])
    table.write(rows(LOGS, *[(i, "old", None, None, None) for i in range(30)]))
    day = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert tables.mark_used(table, rows("log_id INT", (3,), (3,), (77,)), day) == 2
    assert tables.store_predictions(table, rows("log_id INT, prediction STRING", (4, "new"), (3, "x")).withColumn("updated_at", day)) == 3
    got = {r.log_id: r for r in table.read().collect()}
    assert len(got) == 30 and [i for i, r in got.items() if r.used_for_training] == [3] and got[3].trained_at is not None
    assert {i: r.prediction for i, r in got.items() if r.prediction != "old"} == {3: "x", 4: "new"} and got[5].updated_at is None
