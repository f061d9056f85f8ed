"""Mixing sources to target weights by a proportionate fair schedule."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.llm.common import BROADCAST_BYTES, packed, prefix_sums, table
from clinflow.session import send_by_value

send_by_value(__name__)

BLOCK_BYTES = 64 * 1024
#: Slots of a period, for callers that want weights rounded to parts of one.
PERIOD = 4096
#: Blocks that one task deals.
STEP = 65_536
#: Default target: the share of a source goes with this power of its bytes.
TEMPER = 0.5


def quanta(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of a period for each source, at least one, by largest remainder. Weights below zero count as zero."""
    while period < 4 * len(weights):
        period *= 2
    names = sorted(weights)
    total = sum(max(weights[name], 0.0) for name in names)
    free = period - len(names)
    ideal = {name: free * (max(weights[name], 0.0) / total if total else 1 / len(names)) for name in names}
    slots = {name: 1 + int(ideal[name]) for name in names}
    rest = period - sum(slots.values())
    for name in sorted(names, key=lambda name: (int(ideal[name]) - ideal[name], name))[:rest]:
        slots[name] += 1
    return slots


def whole_shares(weights: Mapping[str, float]) -> tuple[dict[str, int], list[str]]:
    """(shares, rest): the weights as whole numbers in the same proportions, exactly, and the names that have none.

    Weights not above 2**-40 of the sum count as zero: their second block would come after 70 PB of the mix. If no
    weight is above zero, all names have equal shares.
    """
    exact = {name: Fraction(max(w, 0.0)) for name, w in sorted(weights.items())}
    total = sum(exact.values())
    if not total:
        return dict.fromkeys(exact, 1), []
    held = {name: w for name, w in exact.items() if w * 2**40 > total}
    scale = math.lcm(*(w.denominator for w in held.values()))
    return {name: int(w * scale) for name, w in held.items()}, [name for name in exact if name not in held]


def dealt(shares: list[int], blocks: list[int], counts: list[int] | None = None, slot: int = 0) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) by earliest deadline first, from a state of `counts` blocks dealt before `slot`.

    Block j of a source with share w is released at floor(j / w) and due at ceil((j + 1) / w). The shares
    sum to one and one block goes to a slot, so no deadline is missed, and after every slot each
    source is within one block of its share. A source whose blocks are used up leaves its slots to
    blocks that are released by then, or empty. Shares are whole numbers, parts of their sum, and nothing is rounded.
    """
    whole = sum(shares)
    counts = counts or [0] * len(shares)
    waiting = [(j * whole // shares[k], k, j) for k, j in enumerate(counts) if j < blocks[k]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * whole // shares[k]), k, j))
        _, k, j = heapq.heappop(ready)
        yield k, j, slot
        slot += 1
        if j + 1 < blocks[k]:
            heapq.heappush(waiting, ((j + 1) * whole // shares[k], k, j + 1))


def period_schedule(slots: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, block in the period, slot) of one period. After it all sources are exactly at their shares."""
    names = sorted(slots)
    return [(names[k], j, slot) for k, j, slot in dealt([slots[name] for name in names], [slots[name] for name in names])]


def states(shares: list[int], blocks: list[int], step: int) -> tuple[list[tuple[int, list[int]]], int]:
    """(first slot, blocks of each source dealt before it) after every `step` blocks, and the slot after the last."""
    counts, found, last = [0] * len(shares), [], -1
    for n, (k, _, slot) in enumerate(dealt(shares, blocks)):
        if n % step == 0:
            found.append((slot, counts.copy()))
        counts[k] += 1
        last = slot
    return found, last + 1


def schedule(spark: SparkSession, shares: list[int], blocks: list[int], first: int = 0) -> tuple[DataFrame, int]:
    """(_k, _block, _slot) of all blocks, and the slot after the last. Slots begin at `first`.

    The driver deals the blocks once and keeps the state of every `STEP` blocks only; tasks deal them again from there.
    """
    step = max(STEP, 4 * len(shares))
    found, end = states(shares, blocks, step)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slot, counts in zip(batch["slot"], batch["counts"]):
                part = islice(dealt(shares, blocks, [int(n) for n in counts], int(slot)), step)
                yield pd.DataFrame([(k, j, first + at) for k, j, at in part], columns=["_k", "_block", "_slot"])

    rows = spark.createDataFrame(found, "slot long, counts array<long>")
    return rows.mapInPandas(deal, "_k int, _block long, _slot long"), first + end


def named_source() -> Column:
    """The source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("_source")


def scheduled(docs: DataFrame, weights: Mapping[str, float] | None = None, block_bytes: int = BLOCK_BYTES,
              period: int | None = None) -> DataFrame:
    """`docs` with `_block` (number of the source's block), `_slot` (of the schedule) and `_within` (bytes ahead in the source).

    The documents of a source stand in the order of doc_id and are cut into blocks of `block_bytes`: a
    document belongs to the block in which its first byte lies. All blocks are dealt to slots by earliest
    deadline first, from the weights themselves. Sorted by (_slot, _within), every prefix holds each source
    to within one block of its target share as long as sources last, however long the corpus is; one that is
    used up leaves its slots empty, and the others keep their proportions. All documents are kept.

    `weights` maps sources to targets; sources without a weight above zero come evenly after the last slot of the
    others. By default the weights are the bytes of the sources to the power `TEMPER`. With a `period` they are first
    rounded to slots of a period, at least one for every source. Only one row for each source comes to
    the driver. A null source is a source of its own, beside ''. Null texts take one byte. Rows equal
    in doc_id and text may change places. Other columns stay.
    """
    sized = docs.select(named_source(), "doc_id", F.xxhash64("text").alias("_tie"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("_size"))
    summed = prefix_sums(sized, ["_source", "doc_id", "_tie"], "_size", "mix-blocks")
    starts = summed.groupBy("_source").agg(F.min("before").alias("_start"), F.sum("_size").alias("_all"))
    sizes = {r["_source"]: r["_all"] for r in starts.collect()}
    if weights is None:
        targets = {name: n**TEMPER for name, n in sizes.items()}
    else:
        targets = {name: weights.get(name[1:] if name != "null" else None, 0.0) for name in sizes}
    if period:
        targets = quanta(targets, period) if sizes else {}
    spark = docs.sparkSession
    shares, rest = whole_shares(targets)
    names = [*shares, *rest]
    blocks = [-(-sizes[name] // block_bytes) for name in names]
    frame, end = schedule(spark, list(shares.values()), blocks[: len(shares)])
    if rest:
        after, _ = schedule(spark, [1] * len(rest), blocks[len(shares) :], end)
        frame = frame.unionByName(after.withColumn("_k", F.col("_k") + len(shares)))
    if sum(blocks) * 32 <= BROADCAST_BYTES:
        frame = F.broadcast(frame)
    numbers = spark.createDataFrame([(name, k) for k, name in enumerate(names)], "_source string, _k int")
    placed = (
        summed.join(F.broadcast(starts.select("_source", "_start")), "_source").join(F.broadcast(numbers), "_source")
        .withColumn("_within", F.col("before") - F.col("_start"))
        .withColumn("_block", F.expr(f"_within div {block_bytes}"))
        .join(frame, ["_k", "_block"])
    )
    return placed.select("doc_id", "_tie", "_source", "_block", "_slot", "_within")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """`docs` in the order of the schedule: every later part of the table comes later in the mix.

    Rows that are equal in source, doc_id and text are one place of the schedule.
    """
    places = scheduled(docs, weights).groupBy("doc_id", "_tie", "_source").agg(
        F.min("_slot").alias("_slot"), F.min("_within").alias("_within"))
    rows = packed(docs, F.col("doc_id"), F.xxhash64("text").alias("_tie"), named_source())
    on = rows["doc_id"].eqNullSafe(places["doc_id"]) & (rows["_tie"] == places["_tie"]) & (rows["_source"] == places["_source"])
    return rows.join(places, on).orderBy("_slot", "_within", places["_source"]).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    places = scheduled(docs)
    ordered = prefix_sums(places.withColumn("_one", F.lit(1).cast("long")), ["_slot", "_within", "_source"], "_one", "mix-order")
    return ordered.select(
        "doc_id", F.when(F.col("_source") != "null", F.expr("substring(_source, 2)")).alias("source"),
        F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("rank").alias("position"))
