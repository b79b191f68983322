from __future__ import annotations

import numpy as np
import pytest

from headroom.llm import catalog, whitening


def brute(vectors, most=8):
    x = np.floor(1024 * np.array(vectors, np.float64)) + 100_000
    n, centred = len(x), x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    sums = [int(v) for v in x.sum(axis=0)]
    deviations = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return values[order], centred @ vectors[:, order] / np.sqrt(np.abs(values[order])), deviations, values.sum()


@pytest.fixture
def table(spark):
    def make(vectors, ids=None):
        data = [(i, v, 1, "x", [0.5]) for i, v in zip(ids or range(len(vectors)), vectors)]
        return spark.createDataFrame(data, "vec_id long, embedding array<float>, row int, `a.b c` string, whitened array<double>")

    return make


@pytest.mark.parametrize("matrix", ["random", "equal values", "clusters", "diagonal", "tiny", "graded"])
def test_leading_pairs(matrix):
    rng = np.random.default_rng(3)
    base = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    values = {
        "random": rng.standard_normal(40),
        "equal values": np.r_[[2.0] * 10, [1.0] * 30],
        "clusters": np.r_[3 - 1e-9 * np.arange(20), np.ones(20)],
        "diagonal": np.arange(40.0),
        "tiny": 1e-200 * np.arange(40.0),
        "graded": 10.0 ** -np.arange(40),
    }[matrix]
    a = np.diag(values) if matrix == "diagonal" else base @ np.diag(values) @ base.T
    a = (a + a.T) / 2
    found, vectors = whitening.leading_pairs(a, 12)
    size = np.abs(values).max()
    assert np.abs(found - np.sort(values)[::-1][:12]).max() < 1e-13 * size
    assert np.abs(a @ vectors.T - vectors.T * found).max() < 1e-13 * size
    assert np.abs(vectors @ vectors.T - np.eye(12)).max() < 1e-13


def test_sturm_counts():
    rng = np.random.default_rng(5)
    d, e = rng.standard_normal(9), np.r_[rng.standard_normal(4), 0, rng.standard_normal(3)]
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 33)
    assert whitening.count_below(d, e, at).tolist() == [int((values < x).sum()) for x in at]


def test_products_are_exact():
    rng = np.random.default_rng(7)
    for size in (10**3, 10**7, 10**10):
        numbers = rng.integers(-size, size, (50, 4))
        exact = numbers.astype(object)
        assert (whitening.products(numbers) == exact.T @ exact).all()


def test_whitened_equals_brute_force(table, small_batches):
    rng = np.random.default_rng(11)
    vectors = (rng.standard_normal((60, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:20], np.repeat(vectors[:1], 30, axis=0)])  # equal rows stay
    bad = [None, [], [None] * 12, [float("nan")] + [0.0] * 11, [float("-inf")] + [0.0] * 11, [1.0] * 5]
    ids = [*range(100), *[7] * 9, None, *range(200, 206)]
    df = whitening.whitened(table([*vectors.tolist(), *bad], ids).repartition(5))
    rows = df.select("row.vec_id", "row.`a.b c`", *df.columns[1:]).collect()
    values, projected, deviations, trace = brute(vectors)
    assert len(rows) == 110 * 8 and {r.n for r in rows} == {110} and {r["a.b c"] for r in rows} == {"x"}
    for k in range(8):
        own = sorted((round(abs(r.whitened), 9), int(r.deviation), r.vec_id is None) for r in rows if r.component == k + 1)
        expected = sorted((round(abs(v), 9), d, i is None) for v, d, i in zip(projected[:, k], deviations, ids))
        assert np.allclose([o[0] for o in own], [e[0] for e in expected], atol=1e-8) and sorted(o[1] for o in own) == sorted(deviations)
        assert {round(r.explained, 9) for r in rows if r.component == k + 1} == {round(values[k] / trace, 9)}
    assert max(r.identity_error for r in rows) < 1e-10


def test_rank_and_emptiness(table):
    line = [[float(i), 2.0 * i, 5.0] for i in range(9)]
    assert {r.component for r in whitening.whitened(table(line)).collect()} == {1}  # the others have no variance
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [[], []]):
        assert whitening.whitened(table(vectors)).collect() == []


def test_large_entries(table):
    vectors = [[1e6 * i, -3e6 * i**2, 7.0] for i in range(6)]
    rows = whitening.whitened(table(vectors)).collect()
    assert {int(r.deviation) for r in rows} == set(brute(vectors)[2])
    with pytest.raises(Exception, match="must be below"):
        whitening.whitened(table([[1e30], [2.0]])).collect()


def test_query(spark, sf_dir):
    rows = catalog.op13_embedding_whitening(spark, sf_dir).toPandas()
    stored = [r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    values, projected, deviations, trace = brute(stored)
    found = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(found) - np.abs(projected)).max() < 1e-8
    assert rows[rows.component == 1].sort_values("vec_id").deviation.tolist() == deviations
    assert np.abs(rows.groupby("component").explained.first().to_numpy() / (values / trace) - 1).max() < 1e-9
    assert rows.identity_error.nunique() == 1 and rows.identity_error.max() < 1e-10
