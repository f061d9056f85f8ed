"""Whitening of embeddings by an incremental eigendecomposition.

Each task keeps mean, eigenvalues and eigenvectors of the rows it has seen and changes them by one centred rank-one update a row. The spectra
of tasks are combined by further rank-one updates, and a last pass over all rows refines them (Rayleigh-Ritz).
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clinflow.llm.common import bound_batches, table
from clinflow.session import send_by_value, written

send_by_value(__name__)

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Spectra that one task combines.
FAN_IN = 16
#: Below this share of the largest eigenvalue or weight, a difference or a weight is none (deflation).
DEFLATION = 1e-13
#: Error of a root, against the sum of its terms: vectors stay orthogonal, and the last pass mends the rest.
ROOT_ERROR = 1e-11
ROUNDS = 60
#: Eigenvalues below this share of the largest one are taken for zero: their components can't be whitened.
RANK = 1e-12
ROWS_AT_ONCE = 4096
BIGGEST_LONG = 2.0**63


class Spectrum:
    """Mean, and eigenvalues (rising) and eigenvectors (columns) of the scatter of `n` rows of integers.

    Rows are held less `base`, the first of them, so that sums lose no digits; `sums` are exact.
    """

    def __init__(self, base: np.ndarray):
        size = len(base)
        self.n, self.base, self.sums = 0, base, np.zeros(size, np.int64)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def add(self, row: np.ndarray) -> None:
        """One row: a rank-one update with its distance from the mean of the rows before."""
        if self.n:
            self.update((row - self.base) - self.sums / self.n, self.n / (self.n + 1))
        self.sums += row - self.base
        self.n += 1

    def update(self, vector: np.ndarray, weight: float) -> None:
        """Adds weight × vector vectorᵀ to the matrix."""
        parts = self.vectors.T @ vector
        self.values, turn = rank_one(self.values, parts * np.sqrt(weight))
        if turn is not None:
            self.vectors = self.vectors @ turn

    def merge(self, other: "Spectrum") -> None:
        """Adds the rows of the other one: an update for each of its eigenvectors, and one for the distance of the means."""
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector, value)
        shift = other.base - self.base
        apart = (other.sums / other.n + shift) - self.sums / self.n
        self.update(apart, self.n * other.n / (self.n + other.n))
        self.sums += other.sums + other.n * shift
        self.n += other.n


def rank_one(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Eigenvalues (rising) and eigenvectors of diag(d) + z zᵀ for rising d; None stands for unchanged vectors.

    Deflation: equal values of d are turned so that one of them takes the whole weight, and values without weight stay. For the
    others the secular equation 1 = Σ z²/(λ - d) is solved, and z is computed anew from its roots so that the vectors are orthogonal (Gu and Eisenstat, 1994).
    """
    size = len(d)
    norm = z @ z
    if not norm > 0:
        return d, None
    scale = max(abs(d[-1]), norm)
    z, turn = z.copy(), None
    close = np.flatnonzero(np.diff(d) <= DEFLATION * scale)
    if len(close):
        turn, first = np.eye(size), 0
        for run in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
            first, last = run[0], run[-1] + 2
            part = z[first:last].copy()
            length = np.sqrt(part @ part)
            if length == 0 or length == abs(part[-1]):
                continue
            part[-1] += length if part[-1] >= 0 else -length  # a reflection that leaves the weight to the last one
            mirror = np.eye(last - first) - 2 * np.outer(part, part) / (part @ part)
            z[first:last] = mirror @ z[first:last]
            z[first:last - 1] = 0
            turn[:, first:last] = turn[:, first:last] @ mirror
    active = np.flatnonzero(np.abs(z) > DEFLATION * np.sqrt(scale))
    if not len(active):
        return d, turn
    roots, vectors = secular(d[active], z[active])
    values = d.copy()
    values[active] = roots
    whole = np.eye(size) if turn is None else turn
    whole[:, active] = whole[:, active] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], whole[:, order]


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots λ of 1 + Σ z²/(d - λ) = 0, one above each d, and the eigenvectors that belong to them.

    All roots go on together, as distances from the nearer pole: steps interpolate the terms below and above a root by one pole each (Li, 1993),
    and are halved into their bracket where they leave it.
    """
    k = len(d)
    if k == 1:
        return d + z * z, np.ones((1, 1))
    weight = z * z
    top = d[-1] + weight.sum()
    gap = np.diff(np.append(d, top))
    poles = d[:, None] - d[None, :]  # row: pole, column: root, seen from the pole below the root
    middle = 1 + (weight[:, None] / (poles - gap / 2)).sum(axis=0)
    right = middle < 0  # the root lies in the right half: seen from the pole above
    right[-1] = False
    shift = np.where(right, gap, 0.0)
    poles = poles - shift
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    if middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    else:
        high[-1] = gap[-1] / 2
    left, above = -shift, gap - shift  # the poles on both sides
    below = np.tri(k, dtype=bool).T  # poles up to that of the root
    at = (low + high) / 2
    for _ in range(ROUNDS):
        apart = poles - at
        terms = weight[:, None] / apart
        value = 1 + terms.sum(axis=0)
        done = np.abs(value) <= ROOT_ERROR * (1 + np.abs(terms).sum(axis=0))
        if done.all():
            break
        slopes = terms / apart
        slope = slopes.sum(axis=0)
        under = (slopes * below).sum(axis=0)
        low, high = np.where(value < 0, at, low), np.where(value < 0, high, at)
        one, two = left - at, above - at
        c = value - one * under - two * (slope - under)
        a = (one + two) * value - one * two * slope
        b = one * two * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = at + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        at = np.where(done, at, new)
    apart = poles - at  # d_i - λ_j
    steps = d[None, :] - d[:, None]
    np.fill_diagonal(steps, 1.0)
    ratio = -apart / np.where(steps == 0, 1.0, steps)  # (λ_j - d_i) / (d_j - d_i)
    anew = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.where(z < 0, -1.0, 1.0)
    vectors = anew[:, None] / apart
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    return d + shift + at, vectors


def usable(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there, without nulls, and finite."""
    entry = F.col(column)
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(entry.isNotNull() & finite & (F.size(column) > 0))


def whole_numbers(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    """The vectors of a batch as long integers: floor(1024 c) + 100000."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(lists), -1) + SHIFT


SPECTRUM = "part int, n long, base array<bigint>, sums array<bigint>, values array<double>, vectors array<double>"


def packed_spectrum(part: int, held: Spectrum) -> pd.DataFrame:
    return pd.DataFrame([(part, held.n, held.base, held.sums, held.values, held.vectors.ravel())],
                        columns=["part", "n", "base", "sums", "values", "vectors"])


def unpacked(row) -> Spectrum:
    held = Spectrum(np.array(row.base, np.int64))
    held.n, held.sums, held.values = int(row.n), np.array(row.sums, np.int64), np.array(row.values)
    held.vectors = np.array(row.vectors).reshape(len(held.base), -1)
    return held


def spectrum_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spectrum of the rows of one task."""
    held, part = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        for row in whole_numbers(batch):
            if held is None:
                held = Spectrum(row)
            held.add(row)
    if held is not None:
        yield pa.RecordBatch.from_pandas(packed_spectrum(part, held), schema=SPECTRUM_ARROW, preserve_index=False)


_longs, _doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
SPECTRUM_ARROW = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("base", _longs), ("sums", _longs), ("values", _doubles), ("vectors", _doubles)])


def combined(group: pd.DataFrame) -> pd.DataFrame:
    """Some spectra as one, in the order of their parts."""
    group = group.sort_values("part")
    rows = list(group.itertuples())
    held = unpacked(rows[0])
    for row in rows[1:]:
        held.merge(unpacked(row))
    return packed_spectrum(int(rows[0].part) // FAN_IN, held)


def whole_spectrum(vectors: DataFrame) -> Spectrum | None:
    """The spectrum of all rows: one for each task, combined by tens until one is left."""
    parts = written(vectors.withColumn("part", F.spark_partition_id()).mapInArrow(spectrum_of, SPECTRUM), "whitening-spectra")
    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return None
    while most > 0:
        parts = written(parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(combined, SPECTRUM), "whitening-spectra")
        most //= FAN_IN
    return unpacked(parts.first())


def refined(vectors: DataFrame, held: Spectrum) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean less shift, eigenvalues falling, vectors): the covariance of all rows in the basis found, decomposed and turned back.

    One pass over the rows, centred before they are multiplied; each task gives the products of its rows.
    """
    base, offset, basis = held.base, held.sums / held.n, held.vectors
    size = len(base)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums, some = np.zeros((size, size)), False
        for batch in batches:
            turned = ((whole_numbers(batch) - base) - offset) @ basis
            sums += turned.T @ turned
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], _doubles)], ["sums"])

    matrix = added(vectors.mapInArrow(products, "sums array<double>"), size) / held.n
    values, turn = np.linalg.eigh((matrix + matrix.T) / 2)
    return offset, values[::-1], (basis @ turn)[:, ::-1]


def added(sums: DataFrame, size: int) -> np.ndarray:
    """The sum of square matrices, one for each task, added in Spark; the driver gets one."""
    each = sums.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size * size)
    for row in each.collect():
        out[row.place] = row.value
    return out.reshape(size, size)


class Whitening:
    """What turns a vector into its whitened components: fitted on all rows of a table."""

    def __init__(self, held: Spectrum, offset: np.ndarray, values: np.ndarray, vectors: np.ndarray, components: int):
        kept = min(components, int((values > max(values[0], 0) * RANK).sum())) if len(values) else 0
        self.n, self.base, self.sums, self.offset = held.n, held.base, held.sums, offset
        self.values, self.vectors, self.trace = values[:kept], vectors[:, :kept], float(values.sum())

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        return (((rows - self.base) - self.offset) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Σ (n x - S)² of each row, exact; None beyond a long."""
        apart = self.n * (rows - self.base) - self.sums
        rough = (apart.astype(np.float64) ** 2).sum(axis=1)
        if rough.max(initial=0) < BIGGEST_LONG / 2:
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in apart]
        return [v if v < 2**63 else None for v in exact]


def common_size(vectors: DataFrame) -> int | None:
    """The commonest length of the vectors; of equally common ones the largest."""
    sizes = vectors.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return sizes.size if sizes else None


def fitted(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of vectors, or None where no row can be used.

    Rows whose vector is null, empty, or holds nulls or numbers that aren't finite are left out, as are those whose length isn't the commonest one. Entries
    are floor(1024 c) + 100000. Components whose eigenvalue is zero (constant or too few vectors) can't be whitened and are left out. Repeated
    rows count as often as they stand.
    """
    bound_batches(embeddings.sparkSession)
    vectors = usable(embeddings, column).select(F.col(column).alias("vector"))
    size = common_size(vectors)
    if size is None:
        return None
    vectors = vectors.where(F.size("vector") == size)
    held = whole_spectrum(vectors)
    return Whitening(held, *refined(vectors, held), components)


def whitened(embeddings: DataFrame, key: str, fit: Whitening, column: str = "embedding") -> DataFrame:
    """(key, deviation, whitened) for every usable row: Σ (n x - S)², and the list of its whitened components."""
    bound_batches(embeddings.sparkSession)
    kind = embeddings.schema[key].dataType
    rows = usable(embeddings, column).where(F.size(column) == len(fit.base)).select(F.col(key).alias("key"), F.col(column).alias("vector"))
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                numbers = whole_numbers(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").cast(arrow), pa.array(fit.deviations(numbers), pa.int64()), pa.array(list(fit.whiten(numbers)), _doubles)],
                    ["key", "deviation", "whitened"])

    return rows.mapInArrow(run, f"key {kind.simpleString()}, deviation long, whitened array<double>").withColumnRenamed("key", key)


def identity_error(embeddings: DataFrame, fit: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the covariance of all whitened rows less the identity, measured in a pass over them."""
    k = len(fit.values)
    if not k:
        return 0.0
    size = len(fit.base)
    vectors = usable(embeddings, column).where(F.size(column) == size).select(F.col(column).alias("vector"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = np.zeros((k + 1, k + 1)), False
        for batch in batches:
            rows = np.column_stack([fit.whiten(whole_numbers(batch)), np.ones(batch.num_rows)])
            sums += rows.T @ rows
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], _doubles)], ["sums"])

    sums = added(vectors.mapInArrow(products, "sums array<double>"), k + 1) / fit.n
    covariance = sums[:k, :k] - np.outer(sums[k, :k], sums[k, :k])
    return float(np.abs(covariance - np.eye(k)).max())


OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Rows left out, ties and repeats are as in `fitted`. Equal eigenvalues may be turned among themselves, in the same way for all rows. An
    empty table, or one of equal vectors, gives no rows. Other columns are not read. `deviation` is null where a long can't hold it.
    """
    fit = fitted(embeddings, column, components)
    if fit is None or not len(fit.values):
        kind = embeddings.schema[key].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"`{key}` {kind}, {OUTPUT}")
    error = identity_error(embeddings, fit, column)
    explained = F.array(*[F.lit(float(value / fit.trace)) for value in fit.values])
    rows = whitened(embeddings, key, fit, column).select(key, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select(
        key, (F.col("_at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))
