"""Documents to training shards: quality rules, near duplicates, decontamination, mixing, sharding.

Every stage gets the rows that the stage before it left, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.llm.common import table
from clinflow.llm.decontam import without_leaks
from clinflow.llm.mixing import mixed
from clinflow.llm.near_dups import without_copies
from clinflow.llm.quality import judged
from clinflow.llm.sharding import place
from clinflow.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go. The corpus counts are those of `docs`.

    A null or empty text has no words and goes, as the base rules ask for fifty. Long texts are judged whole, repeated rows one by one, so equal
    texts share their verdict. Without labels, or in an empty table, the ratio rejects none. Nulls and clashing names in other columns stay as they are.
    """
    return judged(docs, table(spark, sf_dir, "labels")).where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least doc_id.

    Rows without an id stay. Of rows that share an id one stays, and their texts are linked. A text of fewer than five words is one shingle, and
    all texts without words, null and empty ones among them, are one class. Long texts are compared whole. An empty table stays empty; other
    columns stay as they are.
    """
    return without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none, and null or empty items are held by none. Long texts are searched whole; repeated rows share their
    fate. An empty table, or an empty benchmark, changes nothing; other columns stay as they are.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule: later rows and files come later in the mix.

    A null source is a source of its own. A null text takes one byte; a text longer than a block fills it, and goes with the block in which
    its first byte lies. Rows of a source stand by doc_id (nulls first) and a hash of their text. Repeated rows all stay. An empty table stays empty.
    """
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): contiguous shards along the mix.

    The order of the mix is that of the files and of the rows in them; a table that isn't read from files
    is cut in the order of doc_id. A null text has size 1; a text larger than a shard's share fills its shard, and the next ones
    may stay empty. Repeated rows have a slot each. An empty table gives no rows; other columns are not read.
    """
    if docs.inputFiles():
        docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return place(docs, order=["_file", "_row"])
    return place(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Hashes and edit distances are beyond the SQL of the check; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


