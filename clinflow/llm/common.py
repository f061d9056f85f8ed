"""Helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinflow.session import written

BROADCAST_BYTES = 32 * 1024 * 1024
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of the batches that Python workers get, where the session says nothing smaller."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """The whole row as one column `_row`, so that no other name can clash with its columns, and `columns` beside it."""
    return docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"), *columns)


def keep_matching(rows: DataFrame, keys: DataFrame, on: list[str], row_bytes: int = 16) -> DataFrame:
    """Rows whose key is in `keys`, whose rows are distinct.

    The keys are counted: below `BROADCAST_BYTES` they are broadcast, so that long rows needn't
    move; beyond it this is a plain join.
    """
    small = keys.count() * row_bytes <= BROADCAST_BYTES
    return rows.join(F.broadcast(keys) if small else keys, on, "left_semi")


def prefix_sums(rows: DataFrame, order: list[str], value: str, label: str) -> DataFrame:
    """Adds `before` (the sum of `value` over all rows earlier in `order`), `rank` (their number)
    and `total` (of all rows).

    Rows are cut by range into blocks, which are written once, so that a lost executor can't
    change them. Only the totals of blocks, one row each, meet in one task. `rows` should have
    few narrow columns. Rows equal in all of `order` may stand in any order among themselves.
    """
    n = partitions_of(rows.sparkSession)
    blocks = written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), label)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("_range").agg(F.sum(value).alias("_size"), F.count("*").alias("_rows"))
    offsets = sums.select(
        "_range",
        F.coalesce(F.sum("_size").over(ahead), F.lit(0)).cast("long").alias("_size_ahead"),
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).cast("long").alias("_rows_ahead"),
        F.sum("_size").over(Window.partitionBy()).cast("long").alias("total"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.join(F.broadcast(offsets), "_range")
        .withColumn("before", F.col("_size_ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
        .withColumn("rank", F.col("_rows_ahead") + F.count(F.lit(1)).over(inside))
        .drop("_range", "_size_ahead", "_rows_ahead")
    )


def smallest_reachable(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): for every node of the undirected edges (a, b) the least node it is connected to.

    Alternates the large-star and small-star steps of Kiveris and others (Connected Components in
    MapReduce and Beyond, 2014); every step is two keyed joins. Each round is written. It goes on until
    the links are stars, each node with one link to its root, however many rounds that takes.
    """
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{label}-links")
    while True:
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
            links.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        roles = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if roles.where("below > 1 or below + above > 1").isEmpty():
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}-round")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
