"""Near duplicates of documents by BagMinHash signatures of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinflow.llm.common import bound_batches, keep_matching, packed, smallest_reachable, table
from clinflow.llm.hashing import band_keys, blocks, counted, mix, word_shingles
from clinflow.llm.similar import classes
from clinflow.session import send_by_value, written

send_by_value(__name__)

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 20, 5


def bag_min_hash(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """BagMinHash signatures (n by `size`) of n bags, whose elements have weights 1, 2, 3, …

    Weights are discretised at the integers, and the axis of weights is cut into [0, 1), [1, 2),
    [2, 4), [4, 8) … Every element has for each interval below its weight a Poisson process of its own, the
    same in all bags, with `size` points per unit of weight and time on average; a point has a component and
    a place in the interval, and counts if the place is below the weight. A component's value is the
    time of its first point. Two bags agree in a component with the probability of their weighted
    Jaccard. Points are made in order of time, and an interval rests when its time has passed the
    latest of its bag's first points.
    """
    signature = np.full(n * size, np.inf)
    levels = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
    element = np.repeat(np.arange(len(owner)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1, low)
    state = mix(hashes[element] ^ mix(level.astype(np.uint64)))
    weight, bag = counts[element], owner[element]
    time = np.zeros(len(element))
    while len(state):
        state = mix(state)
        time = time - np.log1p(-((state >> np.uint64(11)) * 2.0**-53)) / (size * width)
        other = mix(state ^ np.uint64(0x5851F42D4C957F2D))
        component = (other % np.uint64(size)).astype(np.int64)
        place = np.floor(low + width * ((other >> np.uint64(32)) * 2.0**-32))
        counts_here = place < weight
        np.minimum.at(signature, bag[counts_here] * size + component[counts_here], time[counts_here])
        going = time < signature.reshape(n, size).max(axis=1)[bag]
        state, time, low, width, weight, bag = (x[going] for x in (state, time, low, width, weight, bag))
    return signature.reshape(n, size)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, first, second, bands): two hashes of the text, and the band keys of its signature."""
    bound_batches(docs.sparkSession)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch.text)
            for start, stop in blocks(texts):
                n = stop - start
                signatures = bag_min_hash(*counted(*word_shingles(texts[start:stop], width)), n, bands * rows)
                bandings = list(band_keys(signatures.view(np.uint64), bands, rows))
                yield batch.iloc[start:stop][["doc_id", "first", "second"]].assign(bands=bandings)

    text = F.coalesce("text", F.lit(""))
    sent = docs.where("doc_id is not null").select(
        "doc_id", text.alias("text"), F.xxhash64(text).alias("first"), F.xxhash64(F.lit("again"), text).alias("second"))
    return sent.mapInPandas(keys, "doc_id long, first long, second long, bands array<long>")


def groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id): the class of every document that has an id.

    Texts are multisets of runs of five words, in lower case; two are near duplicates from a
    weighted Jaccard of `least` on. A class is a connected component, its id the least doc_id. Equal
    texts are one item from the beginning. Candidates share one of 20 bands of 5 components each,
    which misses a pair at 0.8 with a chance of 4 in 10,000; every candidate is checked exactly.

    Null texts count as empty texts, and all texts without words are one class. A text of fewer than five
    words is one shingle. Rows without doc_id are not in the result. Rows that repeat a doc_id are
    one document, whose texts are linked. An empty table gives no rows. Other columns are not read.
    """
    signatures = written(signed(docs), "near-signatures")
    items = signatures.groupBy("first", "second").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"))
    nodes = items.groupBy("node").agg(F.flatten(F.collect_set("bands")).alias("bands"))
    texts = docs.select(F.col("doc_id").alias("node"), F.coalesce("text", F.lit("")).alias("text"))

    def fetch(needed: DataFrame) -> DataFrame:
        return keep_matching(texts, needed, ["node"])

    roots = classes(nodes, fetch, word_shingles, WIDTH, least, True, "near")
    copies = signatures.join(items.select("first", "second", "node"), ["first", "second"])
    found = written(copies.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")), "near-found")
    result = found.groupBy("doc_id").agg(F.min("root").alias("class_id"), F.max("root").alias("_other"))
    if not result.where("class_id != _other").isEmpty():  # a doc_id has texts of several classes, which are then one
        links = found.join(result, "doc_id").select(F.col("root").alias("a"), F.col("class_id").alias("b"))
        joined = smallest_reachable(links, "near-joined").select(F.col("node").alias("class_id"), "root")
        result = result.join(joined, "class_id", "left").withColumn("class_id", F.coalesce("root", "class_id"))
    return result.select("doc_id", "class_id")


def without_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """`docs` with one document of each class, that of the least doc_id; rows without an id stay."""
    kept = groups(docs, least).where("doc_id = class_id").select("doc_id")
    rows = packed(docs, F.col("doc_id"), F.xxhash64("text").alias("_hash"))
    order = Window.partitionBy("doc_id").orderBy("_hash", F.xxhash64("_row"))
    first = rows.join(kept, "doc_id", "left_semi").withColumn("_turn", F.row_number().over(order)).where("_turn = 1")
    return first.select("_row.*").unionByName(docs.where("doc_id is null"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
