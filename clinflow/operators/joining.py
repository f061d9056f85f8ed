"""Joins and numbering that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def lookup_join(facts: DataFrame, table: DataFrame, on: list[str], how: str = "left",
                spread: list[str] | None = None, salts: int = 1) -> DataFrame:
    """Join facts to a lookup table; a plan only, no job.

    The adaptive engine broadcasts a table that turns out to be small, and splits the partitions of a hot
    key. Where that is not enough, `salts` cuts every key of the facts into that many parts by a
    hash of `spread`, and each row of the table goes to all parts.
    """
    if salts <= 1:
        return facts.join(table, on, how)
    spread = spread or [name for name in facts.columns if name not in on]
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key into as many parts as the session shuffles into, all of which stay.

    The adaptive engine merges parts by their bytes in the shuffle. Ids and repeated names are small there and many times larger in the
    sorts and hash tables of a task, so a step that keeps every key of a part at once is dealt this way.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def numbered(rows: DataFrame, key: list[str], order: list, bucket: Column, name: str = "ordinal") -> DataFrame:
    """Dense numbers 0, 1, 2 … per key in `order`, without one task seeing a whole key.

    `bucket` must rise with the order (a time or id range). Rows are numbered inside (key, bucket),
    and shifted by the number of rows in the earlier buckets of the key.
    """
    cut = rows.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        cut.groupBy(*key, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order)
    local = cut.withColumn(name, F.row_number().over(inside) - 1)
    return (
        local.join(shift, [*key, "_bucket"])
        .withColumn(name, (F.col(name) + F.col("_shift")).cast("long"))
        .drop("_bucket", "_shift")
    )


def framed(rows: DataFrame, key: str, seq: str, back: int, columns: dict, width: int = 4096) -> DataFrame:
    """Window columns over the `back` rows before each row, in blocks of `width` rows per key.

    `seq` numbers the rows of a key without gaps. The last `back` rows of a block are copied to the
    next block, so every frame is whole inside its block and no task needs a whole key.
    `columns` maps a name to a function of the window.
    """
    block = F.floor(F.col(seq) / width)
    tail = F.pmod(F.col(seq), F.lit(width)) >= width - back
    homes = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    spread = rows.select("*", block.alias("_home"), F.explode(homes).alias("_block"))
    frame = Window.partitionBy(key, "_block").orderBy(seq).rowsBetween(-back, -1)
    out = spread.select("*", *[make(frame).alias(name) for name, make in columns.items()])
    return out.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def top_rows(rows: DataFrame, key: list[str], order: list, n: int, name: str | None = None) -> DataFrame:
    """The first `n` rows per key. Spark limits each input partition per key before the shuffle."""
    rank = name or "_rank"
    out = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(rank) <= n)
    return out if name else out.drop(rank)


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key, the one with the largest `order`; combined before the shuffle."""
    rest = [name for name in rows.columns if name not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*key, "_row.*").select(*rows.columns)


def first(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key, the one with the smallest `order`; combined before the shuffle."""
    rest = [name for name in rows.columns if name not in key]
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*key, "_row.*").select(*rows.columns)
