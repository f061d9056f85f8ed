"""Classes of similar items from band keys: candidate pairs, exact checks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinflow.llm.common import BROADCAST_BYTES, bound_batches, smallest_reachable
from clinflow.llm.hashing import blocks, counted, mix, overlaps, set_overlaps
from clinflow.session import send_by_value, written

send_by_value(__name__)

#: Buckets of at most so many items are compared pair by pair, larger ones in blocks of items.
PAIRED = 32
BLOCK = 512
#: Different shingles whose counts are multiplied at a time.
COLUMNS = 4096


def checked(pairs: DataFrame, texts: DataFrame, shingles: Callable, width: int, least: float, multiset: bool) -> DataFrame:
    """(a, b, similar) of the pairs (a, b) by the exact Jaccard of their shingles."""
    sides = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    )

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = list(batch.text_a), list(batch.text_b)
            for first, last in blocks([x + y for x, y in zip(left, right)]):
                sides = shingles(left[first:last], width), shingles(right[first:last], width)
                alike = overlaps(*sides, last - first, True) if multiset else set_overlaps(*sides, last - first)
                part = batch.iloc[first:last][["a", "b"]]
                yield part.assign(similar=alike >= least)

    kind = pairs.schema["a"].dataType.simpleString()
    return sides.select("a", "b", "text_a", "text_b").mapInPandas(check, f"a {kind}, b {kind}, similar boolean")


def links_within(texts: list[str], roots: list, shingles: Callable, width: int, least: float, multiset: bool) -> list[tuple[int, int]]:
    """Pairs of places that link texts of different roots by exact Jaccard: a spanning forest of such links."""
    n = len(texts)
    owner, hashes, count = counted(*shingles(texts, width))
    if multiset:  # the k-th copy of a shingle is an element of its own
        copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner, hashes = np.repeat(owner, count), mix(np.repeat(hashes, count) ^ mix(copy.astype(np.uint64)))
    size = np.bincount(owner, minlength=n)
    _, column, held = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    near = np.triu((common >= least * union - 1e-6) | (union == 0), 1)
    parent = {root: root for root in roots}

    def top(root):
        while parent[root] != root:
            root = parent[root]
        return root

    links = []
    for x, y in zip(*np.nonzero(near)):
        a, b = top(roots[x]), top(roots[y])
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((x, y))
    return links


def linked_in_blocks(members: DataFrame, texts: DataFrame, shingles: Callable, width: int, least: float, multiset: bool) -> DataFrame:
    """(a, b, similar) links between the classes in large buckets; `members` has (key, node, root, n).

    The items of a bucket are dealt into blocks of about `BLOCK`, and a task compares two blocks, so it
    holds a bounded number of texts however large the bucket is.
    """
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), "parts").cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
        F.least("part", other).alias("i"), F.greatest("part", other).alias("j")))
    dealt = members.withColumn("parts", count).withColumn("part", mine).select(
        "key", "node", "root", F.explode(every).alias("pair")).select("key", "pair.i", "pair.j", "node", "root").distinct()
    kind = members.schema["node"].dataType.simpleString()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        nodes = list(group.node)
        found = links_within(list(group.text), list(group.root), shingles, width, least, multiset) if group.root.nunique() > 1 else []
        return pd.DataFrame({"a": [min(nodes[x], nodes[y]) for x, y in found], "b": [max(nodes[x], nodes[y]) for x, y in found],
                             "similar": True}, columns=["a", "b", "similar"])

    return dealt.join(texts, "node").groupBy("key", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}, similar boolean")


def classes(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], shingles: Callable, width: int, least: float,
            multiset: bool, label: str) -> DataFrame:
    """(node, root) of all nodes that are linked to another; root is the least node of the class.

    `nodes` has (node, bands): different items, and the keys of their bands. Items that share a band
    key are candidates, and `fetch` gives (node, text) for a table of nodes. A class is a connected
    component of the candidate pairs whose similarity is at least `least`.
    """
    bound_batches(nodes.sparkSession)
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{label}-shared")
    small = shared.count() * 24 <= BROADCAST_BYTES
    members = written(keys.join(F.broadcast(shared) if small else shared, "key"), f"{label}-members")
    return linked(members, fetch, shingles, width, least, multiset, label)


def linked(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], shingles: Callable, width: int, least: float,
           multiset: bool, label: str) -> DataFrame:
    """(node, root) as `classes` gives it, from the buckets: (key, node, n), n items with the key.

    First the items of every bucket are checked against its pivot, the item that shares its keys with most
    others: the original of many copies, as a rule. That is one pair for an item of a bucket, however large.
    Buckets whose items are then one class are done. In the others the items of different classes are
    compared: pair by pair in buckets of at most `PAIRED`, in blocks of items in larger ones, where a task
    gives back no more links than join its items. Together no candidate pair is lost.
    """
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    ranked = members.join(fame, "node")
    pivots = ranked.groupBy("key").agg(F.min(F.struct((-F.col("fame")).alias("fame"), "node")).alias("p")).select("key", F.col("p.node").alias("p"))
    pairs = members.join(pivots, "key").where("p != node").select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"))
    pairs = written(pairs.distinct(), f"{label}-pairs")
    first = written(checked(pairs, fetch(ends_of(pairs)), shingles, width, least, multiset), f"{label}-checked")
    roots = written(smallest_reachable(first.where("similar"), label), f"{label}-roots")

    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    placed = written(placed.join(mixed, "key"), f"{label}-placed")
    few = placed.where(F.col("n") <= PAIRED).select("key", "node", "root")
    other = few.select("key", F.col("node").alias("other"), F.col("root").alias("other_root"))
    pairs = few.join(other, "key").where("node < other and root != other_root").select(F.col("node").alias("a"), F.col("other").alias("b"))
    pairs = written(pairs.distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"), f"{label}-cross")
    many = placed.where(F.col("n") > PAIRED)
    cross = checked(pairs, fetch(ends_of(pairs)), shingles, width, least, multiset)
    blocked = linked_in_blocks(many, fetch(many.select("node").distinct()), shingles, width, least, multiset)
    rest = written(cross.where("similar").unionByName(blocked), f"{label}-rest")
    if rest.isEmpty():
        return roots
    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest.select("a", "b"))
    return written(smallest_reachable(joined, label), f"{label}-roots")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
