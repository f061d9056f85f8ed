"""Random forests of deep trees: MLlib grows their tops, counts over all rows split what stays large, groups of rows grow the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.session import send_by_value, written

send_by_value(__name__)

BINS = 32
#: Rows that a node of the top's last level has on average, at most; a group of rows grows it to its end.
GROUP_ROWS = 1 << 17
#: No group has more than so many times these rows: larger nodes are split by counts over all rows.
UNEVEN = 4
#: Cells of the class counts that are held at a time: they should fit a cache.
CELLS = 1 << 17
#: Rows that are counted at a time.
ROWS = 1 << 14
#: Bytes of nodes, or of class counts of large nodes, that a task holds while rows pass.
HELD = 32 << 20
#: Bytes of a batch that a task sends or gets.
SENT = 8 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
NODES = "tree int, leaf int, feature binary, cut binary, child binary, shares binary"
KINDS = (np.int16, np.uint8, np.int32, np.float32)
BLOCKS = "rows binary, bins binary, label binary, leaf binary"
#: Chances that a row is drawn at most 0, 1, 2 … times.
DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def drawn(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, by a hash (SplitMix64) of the row, so it is the same in every pass."""
    x = (rows.astype(np.uint64) + np.random.default_rng([seed, tree]).integers(1 << 63, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(DRAWS, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, side="right").astype(np.uint8)


def looked_at(rng, nodes: int, wide: int) -> np.ndarray:
    """A random choice of features for each node, as many as the root of their number."""
    some = math.ceil(math.sqrt(wide))
    return np.argpartition(rng.random((nodes, wide)), some - 1, axis=1)[:, :some]


def counted(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, rows: np.ndarray, own: np.ndarray, looked: np.ndarray, classes: int) -> np.ndarray:
    """Weights by node, feature looked at, bin and class of `rows`, which are in the nodes `own`."""
    (n, some), wide, flat = looked.shape, bins.shape[1], bins.ravel()
    counts, start = np.zeros(n * some * BINS * classes), (np.arange(n * some) * (BINS * classes)).reshape(n, some)
    for first in range(0, len(rows), ROWS):
        row, node = rows[first:first + ROWS], own[first:first + ROWS]
        cell = flat.take((row * wide)[:, None] + looked.take(node, axis=0)).astype(np.int64)
        cell *= classes
        cell += start.take(node, axis=0)
        cell += label[row][:, None]
        counts += np.bincount(cell.ravel(), np.repeat(weight[row], some), len(counts))
    return counts.reshape(n, some, BINS, classes)


def best_cuts(counts: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the place of the best feature among those looked at, the best cut, and whether it gains (Gini impurity)."""
    n, size = len(counts), total.sum(1)
    low = counts.cumsum(axis=2)[:, :, :-1]
    n_low = low.sum(3)
    n_high = size[:, None, None] - n_low
    valid = (n_low > 0) & (n_high > 0)
    # Sums of squares of whole numbers, so those of the other side are exact as well.
    low_squares, cross = np.einsum("nsbc,nsbc->nsb", low, low), np.einsum("nsbc,nc->nsb", low, total)
    high_squares = (total**2).sum(1)[:, None, None] - 2 * cross + low_squares
    pure = np.where(valid, low_squares / np.maximum(n_low, 1) + high_squares / np.maximum(n_high, 1), -np.inf).reshape(n, -1)
    choice = pure.argmax(1)
    gains = pure[np.arange(n), choice] - (total**2).sum(1) / size > 1e-9
    return choice // (BINS - 1), choice % (BINS - 1), gains


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, depth: int, rng) -> tuple[np.ndarray, ...]:
    """A tree of at most `depth` levels by Gini impurity, all nodes of a level at once: (feature, cut, child, shares).

    Each node looks at a random choice of features, as many as the root of their number. Rows with bin > cut go to node child + 1,
    the others to node child. A leaf has feature -1, and its child is the row of its class shares.
    """
    wide = bins.shape[1]
    some = math.ceil(math.sqrt(wide))
    feature, cut, child, shares, made, leaves = [], [], [], [], 1, 0
    held, at, k = np.flatnonzero(weight > 0), np.zeros(int((weight > 0).sum()), np.int64), 1
    for level in range(depth + 1):
        order = np.argsort(at, kind="stable")
        held, at = held[order], at[order]
        total = np.bincount(at * classes + label[held], weight[held], k * classes).reshape(k, classes)
        size = total.sum(1)
        best, edge = np.full(k, -1, np.int16), np.zeros(k, np.uint8)
        mixed = np.flatnonzero((total > 0).sum(1) > 1) if level < depth else np.zeros(0, np.int64)
        step = max(CELLS // (some * BINS * classes), 1)
        for first in range(0, len(mixed), step):
            nodes = mixed[first:first + step]
            place = np.full(k, -1)
            place[nodes] = np.arange(len(nodes))
            a, b = np.searchsorted(at, (nodes[0], nodes[-1] + 1))
            rows, own = held[a:b], place[at[a:b]]
            rows, own = rows[own >= 0], own[own >= 0]
            looked = looked_at(rng, len(nodes), wide)
            which, where, gains = best_cuts(counted(bins, label, weight, rows, own, looked, classes), total[nodes])
            best[nodes[gains]] = looked[np.arange(len(nodes)), which][gains]
            edge[nodes[gains]] = where[gains]
        inner = best >= 0
        down = np.zeros(k, np.int32)
        down[inner] = made + 2 * np.arange(inner.sum())
        down[~inner] = leaves + np.arange((~inner).sum())
        feature.append(best), cut.append(edge), child.append(down)
        shares.append((total[~inner] / np.maximum(size[~inner], 1)[:, None]).astype(np.float32))
        leaves += int((~inner).sum())
        going = inner[at]
        held, at = held[going], at[going]
        right = bins[held, best[at]] > edge[at]
        at = (down[at] - made) + right
        k = 2 * int(inner.sum())
        made += k
        if not k:
            break
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(child), np.concatenate(shares)


def ends(bins: np.ndarray, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The leaf that each row of `bins` comes to from the node where it is."""
    at, open_ = at.astype(np.int64), np.arange(len(bins))
    while len(open_):
        open_ = open_[feature[at[open_]] >= 0]
        node = at[open_]
        at[open_] = child[node] + (bins[open_, feature[node]] > cut[node])
    return at


def fall(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The row of class shares that each row of `bins` comes to."""
    return child[ends(bins, np.zeros(len(bins), np.int64), feature, cut, child)]


def unpacked(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def blocks_of(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, bins, label, leaf) of each block; `leaf` has a row for each tree."""
    for batch in batches:
        for block in zip(*batch.columns):
            rows, bins, label, leaf = (np.frombuffer(part.as_buffer(), kind) for part, kind in zip(block, (np.int64, np.uint8, np.int32, np.int32)))
            yield rows, bins.reshape(-1, wide), label, leaf.reshape(-1, len(rows))


def leaves(deeper: dict, tree: int, leaf: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Where rows are in a tree: leaves of its top, or nodes below those that were split further."""
    return ends(bins, leaf, *deeper[tree]) if tree in deeper else leaf


def runs(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of `at`, and where it is."""
    order = np.argsort(at, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        if len(part):
            yield int(at[part[0]]), part


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `SENT` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(value) if isinstance(value, bytes) else 8 for value in row)
        if size >= SENT:
            yield pa.RecordBatch.from_arrays([pa.array(part, kind) for part, kind in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(part, kind) for part, kind in zip(zip(*held), schema.types)], schema=schema)


def thresholds(rows: DataFrame, features: str) -> list[list[float]]:
    """For each feature the upper bounds of its bins: all values of a feature of few, else quantiles."""
    values = rows.select(F.posexplode(vector_to_array(features)).alias("i", "x"))
    quantiles = F.percentile_approx("x", [q / BINS for q in range(1, BINS)], 10_000)
    kinds = values.groupBy("i").agg(quantiles.alias("q"), F.approx_count_distinct("x").alias("n")).collect()
    found = {row.i: row.q for row in kinds}
    few = [row.i for row in kinds if row.n <= 2 * BINS]
    if few:
        for row in values.where(F.col("i").isin(few)).groupBy("i").agg(F.array_sort(F.collect_set("x")).alias("v")).collect():
            if len(row.v) <= BINS:
                found[row.i] = row.v[:-1]
    return [sorted(set(found[i])) for i in range(len(found))]


@contextmanager
def small_batches(spark: SparkSession):
    """Within, Python workers get batches of about `SENT` bytes, where the session names no size: the rows sent here are long."""
    named = spark.conf.get(BATCH_BYTES, None) is not None
    if not named:
        spark.conf.set(BATCH_BYTES, str(SENT))
    try:
        yield
    finally:
        if not named:
            spark.conf.unset(BATCH_BYTES)


class DeepForest(Estimator):
    """A random forest whose trees are as deep as their rows allow.

    MLlib counts classes by bin for every node in every part of the rows, however few rows a node has: at depth 30 nearly all of its
    work is for nodes of a few rows. Here `top` goes to the depth where a node has about `group_rows` rows. Nodes that then have over `UNEVEN` times
    as many, and only these, are split further by counts over all rows. The rows below any other node are one group, drawn with replacement
    once more, which a task grows to the end. The trees are kept as a table, one row for each such node, and are never together in the driver or in one task:
    the driver holds what is above groups, some nodes for every `group_rows` rows and tree.
    """

    def __init__(self, top: RandomForestClassifier, group_rows: int = GROUP_ROWS):
        super().__init__()
        self.top, self.depth, self.group_rows = top, top.getMaxDepth(), group_rows

    def _fit(self, dataset: DataFrame) -> DeepForestModel:
        with small_batches(dataset.sparkSession):
            return self.fitted(dataset)

    def fitted(self, dataset: DataFrame) -> DeepForestModel:
        features, label = self.top.getFeaturesCol(), self.top.getLabelCol()
        rows = written(dataset.select(features, F.col(label).cast("double").alias(label)), "forest-rows")
        count, classes = rows.agg(F.count("*"), F.max(label)).first()
        depth, classes = min(max(math.ceil(math.log2(max(count, 1) / self.group_rows)), 0), self.depth), int(classes or 0) + 1
        numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "forest-numbered")
        bounds = thresholds(rows, features)
        top = self.top.copy({self.top.maxDepth: depth, self.top.leafCol: "_leaf"}).fit(numbered)
        model = DeepForestModel(top, bounds, classes, None)
        blocks = written(model.blocks(numbered, F.col(label).cast("int")), "forest-blocks")
        seed, trees, wide = self.top.getSeed(), top.getNumTrees, len(bounds)
        sizes = self.sizes(blocks, seed, trees, wide, depth)
        bare = {}
        for tree, leaf, drawings in sizes:
            if not drawings:
                bare.setdefault(tree, []).append(leaf)

        def weights(tree: int, rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
            """Leaves of the top none of whose rows is drawn have all of them once."""
            found = drawn(seed, tree, rows)
            if tree in bare:
                found[np.isin(leaf, bare[tree])] = 1
            return found

        levels, ended = self.split_large(model, blocks, weights, sizes, depth)
        deeper, closed, left = model.deeper, {}, self.depth - depth
        for tree, leaf, *_ in ended:
            closed.setdefault(tree, []).append(leaf)
        lefts = {node: self.depth - level for node, level in levels.items()}

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def parts():
                for rows, bins, label, leaf in blocks_of(batches, wide):
                    for tree in range(trees):
                        weight, at = weights(tree, rows, leaf[tree]), leaves(deeper, tree, leaf[tree], bins)
                        held = np.flatnonzero((weight > 0) & ~np.isin(at, closed[tree]) if tree in closed else weight > 0)
                        for node, part in runs(at[held]):
                            part = held[part]
                            yield tree, node, bins[part].tobytes(), label[part].tobytes(), weight[part].tobytes()
            yield from batched(parts(), PIECES)

        def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            bins, label, weight = unpacked(group.bins, np.uint8).reshape(-1, wide), unpacked(group.label, np.int32), unpacked(group.weight, np.uint8)
            key = tuple(map(int, key))
            tree = grow(bins, label.astype(np.int64), weight.astype(float), classes, lefts.get(key, left), np.random.default_rng([seed, *key]))
            return pd.DataFrame([(*key, *(part.tobytes() for part in tree))], columns=["tree", "leaf", "feature", "cut", "child", "shares"])

        sent = blocks.mapInArrow(pieces, "tree int, leaf int, bins binary, label binary, weight binary")
        nodes = sent.repartition(parts_of(sent), "tree", "leaf").groupBy("tree", "leaf").applyInPandas(finish, NODES)
        model.nodes = written(nodes.union(nodes.sparkSession.createDataFrame(ended, NODES)) if ended else nodes, "forest-nodes")
        return model

    def sizes(self, blocks: DataFrame, seed: int, trees: int, wide: int, depth: int) -> list[tuple[int, int, int]]:
        """(tree, leaf, drawings of its rows) for the leaves of the tops."""
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((2, trees, 1 << depth), np.int64)
            for rows, _, _, leaf in blocks_of(batches, wide):
                for tree in range(trees):
                    found[0, tree] += np.bincount(leaf[tree], minlength=1 << depth)
                    found[1, tree] += np.bincount(leaf[tree], drawn(seed, tree, rows), 1 << depth).astype(np.int64)
            tree, leaf = np.nonzero(found[0])
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(leaf), pa.array(found[1, tree, leaf])], names=["tree", "leaf", "drawings"])

        found = blocks.mapInArrow(sums, "tree long, leaf long, drawings long").groupBy("tree", "leaf").agg(F.sum("drawings"))
        return sorted(map(tuple, found.collect()))

    def split_large(self, model: DeepForestModel, blocks: DataFrame, weights, sizes: list[tuple[int, int, int]], depth: int) -> tuple[dict, list[tuple]]:
        """Splits nodes of over `UNEVEN * group_rows` drawings level by level: (levels of nodes below the tops, the leaves among the large nodes).

        The splits are added to `model.deeper`. A pass sends the class counts of each large node once for each task, so there are as many tasks as cores.
        """
        limit, seed, classes, wide = UNEVEN * self.group_rows, self.top.getSeed(), model.classes, len(model.bounds)
        some = math.ceil(math.sqrt(wide))
        levels, ended, grown = {}, [], {}
        large = [(tree, leaf) for tree, leaf, drawings in sizes if drawings > limit]
        first_free = {tree: leaf + 1 for tree, leaf, _ in sizes}
        blocks = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)
        step = max(HELD // (some * BINS * classes * 8), 1)

        def looked(tree: int, node: int) -> np.ndarray:
            return looked_at(np.random.default_rng([seed, tree, node, 1]), 1, wide)

        while large:
            found = []
            for first in range(0, len(large), step):
                nodes, deeper = {}, model.deeper
                for tree, node in large[first:first + step]:
                    nodes.setdefault(tree, []).append(node)

                def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    counts, sees = {}, {tree: np.concatenate([looked(tree, node) for node in own]) for tree, own in nodes.items()}
                    for rows, bins, label, leaf in blocks_of(batches, wide):
                        for tree, own in nodes.items():
                            weight, at = weights(tree, rows, leaf[tree]), leaves(deeper, tree, leaf[tree], bins)
                            place = np.full(max(at.max(), *own) + 1, -1)
                            place[own] = np.arange(len(own))
                            here = np.flatnonzero((place[at] >= 0) & (weight > 0))
                            more = counted(bins, label, weight.astype(float), here, place[at[here]], sees[tree], classes)
                            counts[tree] = counts[tree] + more if tree in counts else more
                    yield from batched(((tree, node, counts[tree][i].tobytes()) for tree in counts for i, node in enumerate(nodes[tree])), COUNTS)

                def best(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
                    counts = sum(unpacked([part], float) for part in group.counts).reshape(1, some, BINS, classes)
                    total = counts[:, 0].sum(1)
                    which, where, gains = best_cuts(counts, total)
                    low = counts[0, which[0], :where[0] + 1].sum()
                    feature = int(looked(*map(int, key))[0, which[0]]) if gains[0] else -1
                    return pd.DataFrame([(*key, feature, int(where[0]), low, total.sum() - low, (total[0] / total.sum()).astype(np.float32).tobytes())],
                                        columns=["tree", "node", "feature", "cut", "low", "high", "shares"])

                counts = blocks.mapInArrow(count, "tree int, node int, counts binary").groupBy("tree", "node")
                found += counts.applyInPandas(best, "tree int, node int, feature int, cut int, low double, high double, shares binary").collect()
            large = []
            for row in sorted(found):
                key, level = (row.tree, row.node), levels.pop((row.tree, row.node), depth)
                if row.feature < 0 or level == self.depth:
                    ended.append((*key, *(np.array([value], kind).tobytes() for value, kind in zip((-1, 0, 0), KINDS)), bytes(row.shares)))
                    continue
                child = first_free[row.tree]
                first_free[row.tree] += 2
                grown.setdefault(row.tree, {})[row.node] = (row.feature, row.cut, child)
                for node, size in ((child, row.low), (child + 1, row.high)):
                    levels[row.tree, node] = level + 1
                    if size > limit:
                        large.append((row.tree, node))
            model.deeper = {tree: linked(splits, first_free[tree]) for tree, splits in grown.items()}
        return levels, ended


PIECES = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("bins", pa.binary()), ("label", pa.binary()), ("weight", pa.binary())])
COUNTS = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("counts", pa.binary())])
SCORED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("tree", pa.int32()), ("leaf", pa.int32())] + [(name, pa.binary()) for name in "abcd"])


def linked(splits: dict[int, tuple[int, int, int]], size: int) -> tuple[np.ndarray, ...]:
    """(feature, cut, child) by node; nodes without a split have feature -1."""
    feature, cut, child = np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size, np.int32)
    for node, (feature[node], cut[node], child[node]) in splits.items():
        pass
    return feature, cut, child


def parts_of(rows: DataFrame) -> int:
    """Four parts for each core, which stay: groups are small in the shuffle and long in the work."""
    return max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class DeepForestModel(Model, MLWritable, MLReadable):
    """Adds rawPrediction (class shares, summed over the trees), probability and prediction, as MLlib's forest does."""

    def __init__(self, top: RandomForestClassificationModel, bounds: list[list[float]], classes: int, nodes: DataFrame | None, deeper: dict | None = None):
        super().__init__()
        self.top, self.bounds, self.classes, self.nodes, self.deeper = top, bounds, classes, nodes, deeper or {}

    def blocks(self, rows: DataFrame, label: Column) -> DataFrame:
        """Rows with `_row` in blocks of a batch: a byte for each feature, and the leaf of each tree's top."""
        bounds = [np.array(bound) for bound in self.bounds]
        schema = pa.schema([(name, pa.binary()) for name in ("rows", "bins", "label", "leaf")])

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                row, label, values, leaf = (part.flatten().to_numpy().reshape(n, -1) if i > 1 else part.to_numpy() for i, part in enumerate(batch.columns))
                bins = np.stack([np.searchsorted(bound, values[:, i]) for i, bound in enumerate(bounds)], axis=1).astype(np.uint8)
                parts = (row, bins, label, leaf.T.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in parts], schema=schema)

        held = self.top.transform(rows).select("_row", label.alias("label"), vector_to_array(self.top.getFeaturesCol()).alias("x"), vector_to_array("_leaf").alias("leaf"))
        return held.mapInArrow(block, BLOCKS)

    def spread(self) -> dict[int, dict[int, int]]:
        """By tree and node the part that it is in: of about `HELD` bytes, or less, so that there are four for each core."""
        size = sum((F.length(name) for name in ("cut", "child", "shares")), F.length("feature"))
        sizes = sorted(map(tuple, self.nodes.select("tree", "leaf", size).collect()))
        most = min(HELD, sum(size for *_, size in sizes) // (4 * self.nodes.sparkSession.sparkContext.defaultParallelism) + 1)
        found, before = {}, 0
        for tree, leaf, size in sizes:
            found.setdefault(tree, {})[leaf] = before // most
            before += size
        return found

    def _transform(self, dataset: DataFrame) -> DataFrame:
        with small_batches(dataset.sparkSession):
            return self.scored(dataset)

    def scored(self, dataset: DataFrame) -> DataFrame:
        names, features = dataset.columns, self.top.getFeaturesCol()
        rows = written(dataset.withColumn("_row", F.monotonically_increasing_id()), "forest-scored")
        classes, wide, deeper, spread = self.classes, len(self.bounds), self.deeper, self.spread()
        trees = {}
        for tree, parts in spread.items():
            for part in set(parts.values()):
                trees.setdefault(part, []).append(tree)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The rows of a block to each part that has a node they come to, once."""
            part_of = {}
            for tree, parts in spread.items():
                part_of[tree] = np.full(max(parts) + 1, -1)
                part_of[tree][list(parts)] = list(parts.values())

            def parts():
                for rows, bins, _, leaf in blocks_of(batches, wide):
                    at = {tree: leaves(deeper, tree, leaf[tree], bins) for tree in spread}
                    for part, own in trees.items():
                        here = np.flatnonzero(np.any([part_of[tree][at[tree]] == part for tree in own], axis=0))
                        if len(here):
                            yield part, 1, -1, -1, rows[here].tobytes(), bins[here].tobytes(), np.stack([at[tree][here] for tree in own]).astype(np.int32).tobytes(), b""
            yield from batched(parts(), SCORED)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The nodes of a part come before its rows, which pass block by block."""
            now, held = None, {}
            for batch in batches:
                for part, kind, tree, leaf, *data in zip(*batch.columns):
                    if part.as_py() != now:
                        now, held = part.as_py(), {}
                    if kind.as_py() == 0:
                        held[tree.as_py(), leaf.as_py()] = [np.frombuffer(value.as_py(), as_) for value, as_ in zip(data, KINDS)]
                        continue
                    rows, bins, at = (np.frombuffer(value.as_buffer(), as_) for value, as_ in zip(data, (np.int64, np.uint8, np.int32)))
                    bins, sums = bins.reshape(-1, wide), np.zeros((len(rows), classes))
                    for tree, own in zip(trees[now], at.reshape(-1, len(rows))):
                        for node, here in runs(own):
                            if (tree, node) in held:
                                feature, cut, child, shares = held[tree, node]
                                sums[here] += shares.reshape(-1, classes)[fall(bins[here], feature, cut, child)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(sums[:, i]) for i in range(classes))], names=["_row", *kinds])

        kinds = [f"s{i}" for i in range(classes)]
        spark = dataset.sparkSession
        table = spark.createDataFrame([(tree, leaf, part) for tree, parts in spread.items() for leaf, part in parts.items()], "tree int, leaf int, part int")
        nodes = self.nodes.join(F.broadcast(table), ["tree", "leaf"]).select(
            "part", F.lit(0).alias("kind"), "tree", "leaf", F.col("feature").alias("a"), F.col("cut").alias("b"), F.col("child").alias("c"), F.col("shares").alias("d"))
        sent = self.blocks(rows, F.lit(0)).mapInArrow(deal, "part int, kind int, tree int, leaf int, a binary, b binary, c binary, d binary")
        met = nodes.union(sent).repartition(max(4 * len(trees), parts_of(rows)), "part").sortWithinPartitions("part", "kind")
        found = met.mapInArrow(score, ", ".join(["_row long", *(f"{kind} double" for kind in kinds)]))
        sums = written(found.groupBy("_row").agg(*(F.sum(kind).alias(kind) for kind in kinds)).select("_row", F.array(*kinds).alias("_raw")), "forest-sums")
        scored = rows.join(sums, "_row")
        share = F.transform("_raw", lambda x: x / F.lit(float(self.top.getNumTrees)))
        return scored.select(
            *[F.col(f"`{name}`") for name in names], array_to_vector("_raw").alias("rawPrediction"), array_to_vector(share).alias("probability"),
            (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double").alias("prediction"))

    def write(self) -> MLWriter:
        return DeepForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DeepForestReader()


class DeepForestWriter(MLWriter):
    def __init__(self, model: DeepForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        held = {"bounds": model.bounds, "classes": model.classes,
                "deeper": [[tree, *(part.tolist() for part in parts)] for tree, parts in model.deeper.items()]}
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, held)
        model.top.save(f"{path}/top")
        model.nodes.write.parquet(f"{path}/nodes")


class DeepForestReader(MLReader):
    def load(self, path: str) -> DeepForestModel:
        held = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.schema(NODES).parquet(f"{path}/nodes")
        deeper = {tree: tuple(np.array(part, kind) for part, kind in zip(parts, KINDS)) for tree, *parts in held.get("deeper", [])}
        model = DeepForestModel(RandomForestClassificationModel.load(f"{path}/top"), held["bounds"], held["classes"], nodes, deeper)
        model._resetUid(held["uid"])
        return model
