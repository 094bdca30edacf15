"""Whitening against a direct eigendecomposition, and awkward vectors."""

import numpy as np
import pytest

from trackloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, deviation int, _v string"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "c", 2, "x") for i, v in vectors], schema).repartition(3)


def brute(x):
    u = np.unique(x, axis=0)
    mean = u.mean(0)
    cov = (u - mean).T @ (u - mean) / len(u)
    value, vector = np.linalg.eigh(cov)
    return len(u), u.sum(0), value[::-1], vector[:, ::-1], (x - mean) @ vector[:, ::-1]


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    base = (r.normal(size=(300, 6)) * [1, .8, .6, .4, .2, .1]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(200)] + [(None, base[1].tolist())]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("-inf")] + [0.0] * 5), (2005, [1.0, 2.0])]
    return rows, bad


def test_whitening_equals_direct_decomposition(spark, vectors):
    rows, bad = vectors
    df = table(spark, rows + bad)
    model = whitening.fit(df)
    got = {r.vec_id: r for r in whitening.whiten(df, model).collect()}
    assert set(got) == {i for i, _ in rows}
    x = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(int)
    n, sums, value, _, whole = brute(x)
    assert (model.n, model.sums) == (n, sums.tolist()) and n < len(rows)
    assert np.allclose(model.values, value[:4], rtol=1e-12) and np.isclose(model.trace, value.sum(), rtol=1e-12) and model.error < 1e-9
    out = np.array([got[i].whitened for i, _ in rows])
    for k in range(4):
        want = whole[:, k] / np.sqrt(value[k])
        assert min(np.abs(out[:, k] - want).max(), np.abs(out[:, k] + want).max()) < 1e-9
    assert [got[i].deviation for i, _ in rows] == ((n * x - sums) ** 2).sum(1).tolist()


def test_query_has_a_row_for_each_vector_and_component(spark, vectors, tmp_path):
    rows, bad = vectors
    table(spark, rows + bad).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op11_embedding_whitening(spark, str(tmp_path))
    assert got.count() == 4 * len(rows)
    shares = {r.component: r.explained for r in got.select("component", "explained").distinct().collect()}
    x = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(int)
    value = brute(x)[2]
    assert np.allclose([shares[k + 1] for k in range(4)], (value / value.sum())[:4], rtol=1e-9)


def test_few_or_no_dimensions(spark, tmp_path):
    flat = table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])
    model = whitening.fit(flat)
    assert len(model.values) == 1 and model.error < 1e-9
    assert all(len(r.whitened) == 1 for r in whitening.whiten(flat, model).collect())
    single = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(whitening.fit(single).values) == 0
    assert [r.whitened for r in whitening.whiten(single, whitening.fit(single)).collect()] == [[], []]
    none = table(spark, [])
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    none.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.op11_embedding_whitening(spark, str(tmp_path)).count() == 0


def test_very_large_entries(spark):
    df = table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e9, 5.0])])
    model = whitening.fit(df)
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, model).collect()}
    assert got[1] is None and len(got) == 3
    x = [2 ** 53, -2 ** 53, int(256 * 1e9)]
    assert model.sums[0] == sum(x)


def test_cholesky_and_jacobi_are_accurate():
    r = np.random.default_rng(5)
    a = r.normal(size=(40, 20)) * np.logspace(0, -6, 20)
    scatter = a.T @ a
    factor, order = whitening.pivoted_cholesky(scatter)
    assert np.allclose(factor @ factor.T, scatter[np.ix_(order, order)], atol=1e-12 * scatter.max())
    values, vectors = whitening.decomposed(scatter)
    assert np.allclose(vectors.T @ vectors, np.eye(20), atol=1e-13)
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False) ** 2, rtol=1e-3) and np.allclose(scatter @ vectors, vectors * values, atol=1e-13 * scatter.max())
