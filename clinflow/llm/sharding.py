"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.llm.common import prefix_sums, table

SHARDS = 8


def place(docs: DataFrame, shards: int = SHARDS, order: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): where every row goes.

    The size of a row is the UTF-8 bytes of its text plus one. The rows are put in `order` (by
    default doc_id, then the text's hashes) and the running sum of sizes is cut at equal targets:
    a row goes to the shard in which its first byte lies, so shards are contiguous, and differ by
    no more than the largest row. Slots count the rows of a shard from 0.

    A null text has size 1 and the checksum of an empty text. Null ids come first. Equal rows are
    placed one by one. An empty table gives no rows; with fewer rows than shards some shards stay
    empty. Other columns are not read.
    """
    sized = docs.select(
        *(order or []), "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.xxhash64("text").alias("_tie"),
    )
    summed = prefix_sums(sized, order or ["doc_id", "_tie", "text_crc32"], "size", "shard-blocks")
    cut = summed.withColumn("shard", F.expr(f"before div ((total + {shards - 1}) div {shards})").cast("int"))
    first = cut.groupBy("shard").agg(F.min("rank").alias("_first"))
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"))
