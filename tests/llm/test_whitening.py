import numpy as np
import pytest
from clinflow.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int"


def numbers(vectors):
    return np.floor(1024 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100_000


def brute(vectors, components=8):
    """Eigenvectors of the exact covariance, and what follows from them, for all vectors."""
    x = numbers(vectors)
    n, sums = len(x), x.sum(axis=0)
    exact = [[n * int(v) - int(s) for v, s in zip(row, sums)] for row in x]
    apart = np.array(exact, dtype=np.float64) / n
    values, basis = np.linalg.eigh(apart.T @ apart / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, int((values > values[0] * 1e-12).sum()))
    return [sum(v * v for v in row) for row in exact], apart @ basis[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def clouds(n, size, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, size)) * np.linspace(0.3, 0.05, size) + rng.normal(size=size)).astype(np.float32)


def compared(rows, vectors, ids):
    deviation, whitened, explained = brute(vectors)
    k = whitened.shape[1]
    assert len(rows) == len(vectors) * k
    got = np.zeros((len(vectors), k))
    for r in rows:
        i = ids.index(r.vec_id)
        got[i, r.component - 1] = r.whitened
        assert r.deviation == deviation[i] and r.n == len(vectors)
        assert abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[r.component - 1]
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * signs - whitened).max() < 1e-7
    covariance = got.T @ got / len(got) - np.outer(got.mean(axis=0), got.mean(axis=0))
    error = {r.identity_error for r in rows}
    assert len(error) == 1 and error.pop() == pytest.approx(np.abs(covariance - np.eye(k)).max(), abs=1e-9) and np.abs(covariance - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize("n,size,parts", [(700, 16, 20), (40, 24, 3), (6, 12, 2), (300, 5, 40)])
def test_components_equal_numpy(spark, n, size, parts):
    vectors = clouds(n, size, n)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)
    compared(w.whitened_components(table).collect(), vectors, list(range(n)))


def test_unusable_rows_repeats_and_other_columns(spark):
    vectors = clouds(60, 6)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(100 + i, vectors[0].tolist(), 1) for i in range(5)]
    odd = [(200, None, 0), (201, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (202, [float("nan")] * 6, 0), (203, [float("inf")] + [0.0] * 5, 0), (204, [], 0), (205, [1.0], 0)]
    table = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 as key", "2 as vector", "3 as whitened", "4 as part")
    compared(w.whitened_components(table).collect(), np.array([r[1] for r in rows]), [r[0] for r in rows])


def test_tables_without_spread(spark):
    assert w.whitened_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert w.whitened_components(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0
    same = w.whitened_components(spark.createDataFrame([(i, [0.5, 0.25], 0) for i in range(9)], SCHEMA))
    assert same.count() == 0 and same.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = w.whitened_components(spark.createDataFrame([(i, [0.5 * i, 0.0], 0) for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and {r.explained for r in line} == {1.0}


def test_rank_one_updates_equal_numpy():
    rng = np.random.default_rng(0)
    for trial in range(300):
        k = rng.integers(1, 20)
        d = rng.random(k) * 10.0 ** rng.integers(-3, 5)
        if trial % 3 == 0:
            d[: k // 2] = d[0]
        if trial % 7 == 0:
            d[:] = 0
        d, z = np.sort(d), rng.normal(size=k) * 10.0 ** rng.integers(-4, 3)
        if trial % 4 == 0:
            z[::2] = 0
        values, turn = w.rank_one(d, z)
        turn = np.eye(k) if turn is None else turn
        matrix = np.diag(d) + np.outer(z, z)
        assert np.abs(turn @ np.diag(values) @ turn.T - matrix).max() <= 1e-9 * max(np.abs(matrix).max(), 1e-300)
        assert np.abs(turn.T @ turn - np.eye(k)).max() < 1e-10 and (np.diff(values) >= 0).all()


def test_merged_spectra_equal_the_whole():
    x = numbers(clouds(500, 12))
    parts = []
    for first in range(0, 500, 60):
        held = w.Spectrum(x[first])
        for row in x[first:first + 60]:
            held.add(row)
        parts.append(held)
    whole = parts[0]
    for part in parts[1:]:
        whole.merge(part)
    apart = x - x.mean(axis=0)
    scatter = apart.T @ apart
    assert whole.n == 500 and ((whole.sums + whole.n * whole.base) == x.sum(axis=0)).all()
    assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - scatter).max() < 1e-8 * scatter.max()


def test_deviations_beyond_a_long():
    fit = w.Whitening.__new__(w.Whitening)
    fit.n, fit.base, fit.sums = 10**7, np.array([100_000, 100_000]), np.array([0, 0])
    assert fit.deviations(np.array([[100_003, 100_000], [100_000 + 10**3, 100_000]])) == [9 * 10**14, None]
