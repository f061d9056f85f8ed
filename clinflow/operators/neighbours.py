"""Exact k nearest vectors for tables of queries and items of any size.

Equal vectors count once: items become classes of equal vectors with their k first ids, queries distinct vectors. A query that has k
items at its own vector is answered by one join; only the rest are searched for among the classes.

For that, classes are grouped around pivots. The distances of items to their pivot bound how far the k-th
neighbour of a query can be, so a query only visits cells that can hold a nearer item (triangle
inequality). Cells are cut into blocks of bounded size on both sides. Blocks hold an approximation of each
item, a byte for each dimension and the length of what it leaves out, which gives a lower and an upper bound of
every distance. Only items whose lower bound is within the k-th upper bound of a query are
compared by their own vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from clinflow.operators.joining import top_rows
from clinflow.session import send_by_value, written

send_by_value(__name__)

PIVOTS = 64
BLOCK_ITEMS = 20_000
BLOCK_QUERIES = 5_000
TILE = 64


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _plain(keys: pd.Series) -> np.ndarray:
    """Keys as a plain array; text as Python strings."""
    return keys.to_numpy() if pd.api.types.is_numeric_dtype(keys) else keys.astype(object).to_numpy()


def _column(values: np.ndarray) -> pd.Series:
    """Text stays in one piece: Arrow-backed strings may come in several, which Spark does not take."""
    return pd.Series(values, dtype=object if values.dtype == object else None)


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    squared = (left ** 2).sum(1)[:, None] + (right ** 2).sum(1)[None, :] - 2 * left @ right.T
    return np.sqrt(np.maximum(squared, 0))


def _with_cell(items: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    held = items.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("struct<cell:int,reach:double,code:binary,low:double,step:double,error:double>")
    def placed(vectors: pd.Series) -> pd.DataFrame:
        points = _matrix(vectors)
        found = _distances(points, held.value)
        cell = found.argmin(1)
        codes, low, step, error = _approximated(points)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": found[np.arange(len(cell)), cell],
                             "code": [row.tobytes() for row in codes], "low": low, "step": step, "error": error})

    return items.withColumn("_c", placed(vector)).select("*", "_c.*", F.xxhash64(vector).alias("mark")).drop("_c")


def _approximated(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, step, error): each vector as low + step * code, and the distance of that to the vector."""
    low = points.min(1)
    step = (points.max(1) - low) / 255
    held = np.where(step > 0, step, 1)
    scaled = np.rint((points - low[:, None]) / held[:, None])
    codes = np.clip(np.nan_to_num(scaled), 0, 255).astype(np.uint8)
    error = np.sqrt(((points - (low[:, None] + step[:, None] * codes)) ** 2).sum(1))
    return codes, low, step, error


def _visited_cells(queries: DataFrame, vector: str, pivots: np.ndarray, k: int,
                   radius: np.ndarray, near: list[np.ndarray]) -> DataFrame:
    """Adds `cells`, every cell that can hold one of the k nearest items of the query."""
    held = queries.sparkSession.sparkContext.broadcast((pivots, radius, near))

    @F.pandas_udf("array<int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        points, reach, known = held.value
        owner = np.concatenate([np.full(len(d), c) for c, d in enumerate(known)]).astype(int)
        inner = np.concatenate(known)
        for vectors in batches:
            far = _distances(_matrix(vectors), points)
            upper = far[:, owner] + inner[None, :]
            if upper.shape[1] >= k:
                bound = np.partition(upper, k - 1, axis=1)[:, k - 1]
            else:
                bound = np.full(len(far), np.inf)
            slack = 1e-6 * (1 + far.max(1))
            open_cells = (far - reach[None, :] <= (bound + slack)[:, None]) & (reach[None, :] >= 0)
            yield pd.Series([np.flatnonzero(row).astype("int32") for row in open_cells])

    return queries.withColumn("cells", cells(vector))


def _bounds_in_block(k: int):
    """(query_id, item_id, lower, upper) of the items of a block that can be among the k nearest of its items."""

    def bounds(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(items):
            ids, mark, error = _plain(items["item_id"]), items["mark"].to_numpy(), items["error"].to_numpy()
            order = np.lexsort((ids, error, mark))  # of equal vectors the k first ids are enough
            new = np.ones(len(order), bool)
            new[1:] = (mark[order][1:] != mark[order][:-1]) | (error[order][1:] != error[order][:-1])
            turn = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            chosen = np.sort(order[turn < k])
            ids, error = ids[chosen], error[chosen] * (1 + 1e-9)
            held = items.iloc[chosen]
            codes = np.stack([np.frombuffer(code, np.uint8) for code in held["code"]])
            points = held["low"].to_numpy()[:, None] + held["step"].to_numpy()[:, None] * codes
            norms = (points ** 2).sum(1)
            for start in range(0, len(queries), TILE):
                part = queries.iloc[start:start + TILE]
                asked = _matrix(part["vector"])
                square = (asked ** 2).sum(1)
                rough = square[:, None] + norms[None, :] - 2 * asked @ points.T
                slack = (1e-9 * (1 + square + norms.max()))[:, None]
                lower = np.sqrt(np.maximum(rough - slack, 0)) - error[None, :]
                upper = np.sqrt(np.maximum(rough, 0) + slack) + error[None, :]
                edge = np.partition(upper, k - 1, axis=1)[:, k - 1] if k <= len(ids) else np.full(len(part), np.inf)
                row, col = np.nonzero(lower <= edge[:, None])
                out.append((_plain(part["query_id"])[row], ids[col], lower[row, col], upper[row, col]))
        names = ("query_id", "item_id", "lower", "upper")
        none = np.array([], dtype=object)
        parts = zip(*out) if out else ([none], [none], [none.astype(float)], [none.astype(float)])
        return pd.DataFrame({name: _column(np.concatenate(arrays)) for name, arrays in zip(names, parts)})

    return bounds


@F.pandas_udf(DoubleType())
def _exact(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(((_matrix(left) - _matrix(right)) ** 2).sum(1) if len(left) else np.array([], float))


def _candidates(bounded: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id) of the pairs that can be among the k nearest of a query over all blocks."""
    edge = top_rows(bounded, ["query_id"], [F.asc("upper"), F.asc("item_id")], k).groupBy("query_id").agg(F.max("upper").alias("edge"))
    return bounded.join(edge, "query_id").where("lower <= edge").select("query_id", "item_id").distinct()


def _classes(items: DataFrame, k: int) -> DataFrame:
    """(vector, ids, number): the distinct vectors of the items, each with its `k` first ids in order."""
    few = top_rows(items.filter(F.col("item_id").isNotNull()).select("item_id", "vector"), ["vector"], [F.asc("item_id")], k)
    lists = few.groupBy("vector").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    return lists.withColumn("number", F.monotonically_increasing_id())


def nearest(queries: DataFrame, items: DataFrame, k: int = 3, pivots: int = PIVOTS,
            block_items: int = BLOCK_ITEMS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, item_id, distance, rank): the k items at the least squared distance; ties by item_id.

    `queries` has (query_id, vector) and `items` (item_id, vector), vectors as float arrays.
    Only pivots and per-cell figures (bounded by `pivots` and k) come to the driver.
    """
    if dict(queries.dtypes)["vector"] != dict(items.dtypes)["vector"]:
        queries, items = (rows.withColumn("vector", F.col("vector").cast("array<double>")) for rows in (queries, items))
    asked = written(queries.filter(F.col("query_id").isNotNull()).select("query_id", "vector"), "asked")
    classes = written(_classes(items, k), "classes")
    # Outer from the queries: each distinct vector keeps a row, with the items that lie at it.
    own = asked.select("vector").distinct().join(classes.select("vector", "ids"), "vector", "left")
    met = written(own.withColumn("query", F.monotonically_increasing_id()), "met")
    full = F.coalesce(F.size("ids"), F.lit(0)) >= k
    found = met.filter(full).select("vector", F.explode("ids").alias("item_id"), F.lit(0.0).alias("distance"))
    left = met.filter(~full).select("query", "vector")
    if not left.isEmpty():
        pairs = _near_pairs(left.withColumnRenamed("query", "query_id"), classes.select(F.col("number").alias("item_id"), "vector"),
                            k, pivots, block_items, block_queries)
        ids = classes.select(F.col("number").alias("item_id"), "ids", F.col("vector").alias("held"))
        both = pairs.join(left.withColumnRenamed("query", "query_id"), "query_id").join(ids, "item_id")
        far = both.select("vector", "ids", _exact("vector", "held").alias("distance"))
        found = found.unionByName(top_rows(
            far.select("vector", F.explode("ids").alias("item_id"), "distance"), ["vector"], [F.asc("distance"), F.asc("item_id")], k))
    # An id that comes several times has one ranking over the items of all its rows.
    return top_rows(asked.join(found, "vector").select("query_id", "item_id", "distance"),
                    ["query_id"], [F.asc("distance"), F.asc("item_id")], k, "rank")


def _near_pairs(queries: DataFrame, items: DataFrame, k: int, pivots: int, block_items: int, block_queries: int) -> DataFrame:
    """(query_id, item_id) of the pairs that can be among the k nearest items of a query; ids are numbers, each once."""
    schema = "query_id long, item_id long, lower double, upper double"
    chosen = items.orderBy(F.xxhash64("vector"), "item_id").limit(pivots).select("vector").collect()
    if not chosen:
        return queries.limit(0).select("query_id", F.lit(None).cast("long").alias("item_id"))
    points = np.array([row.vector for row in chosen], dtype=np.float64)
    # Written once: the figures below then read two small columns instead of all vectors again.
    placed = written(_with_cell(items.select("item_id", "vector"), "vector", points), "cells")
    near_rows = top_rows(placed.select("cell", "reach", "item_id"), ["cell"], [F.asc("reach"), F.asc("item_id")], k)
    figures = (
        placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius"))
        .join(near_rows.groupBy("cell").agg(F.collect_list("reach").alias("near")), "cell").collect()
    )
    radius = np.full(len(points), -1.0)
    near = [np.array([])] * len(points)
    parts = np.ones(len(points), dtype=int)
    for row in figures:
        radius[row.cell], near[row.cell] = row.radius, np.array(row.near)
        parts[row.cell] = -(-row.n // block_items)
    routed = written(_visited_cells(queries.select("query_id", "vector"), "vector", points, k, radius, near), "routes")
    visits = routed.select("query_id", "vector", F.explode("cells").alias("cell"))
    asked = {row.cell: row.n for row in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    turns = [-(-asked.get(cell, 0) // block_queries) or 1 for cell in range(len(points))]
    parts_of = F.get(F.lit([int(n) for n in parts]), F.col("cell"))
    turns_of = F.get(F.lit([int(n) for n in turns]), F.col("cell"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = visits.withColumn("turn", F.pmod(F.xxhash64("query_id"), turns_of).cast("int")).withColumn("part", upto(parts_of))
    right = placed.withColumn("part", F.pmod(F.xxhash64("item_id"), parts_of).cast("int")).withColumn("turn", upto(turns_of))
    keys = ["cell", "part", "turn"]
    shown = right.select(*keys, "item_id", "mark", "code", "low", "step", "error")
    bounded = written(left.groupBy(*keys).cogroup(shown.groupBy(*keys)).applyInPandas(_bounds_in_block(k), schema), "bounds")
    return _candidates(bounded, k)


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 3, **sizes: int) -> DataFrame:
    """The k nearest chunks per query with content, disease, source and the score to four places.

    `chunks` has (item_id, vector, content, disease, source).
    """
    found = nearest(queries, chunks.select("item_id", "vector"), k, **sizes)
    shown = chunks.select("item_id", "content", F.coalesce("disease", F.lit("Unknown")).alias("disease"),
                          F.coalesce("source", F.lit("Unknown")).alias("source"))
    return found.join(shown, "item_id").select(
        "query_id", "rank", "item_id", "content", "disease", "source", F.round("distance", 4).alias("score")
    )
