"""Whitening against numpy's eigenvectors of the covariance."""

import numpy as np
import pytest

from tickweave.llm import queries as q
from tickweave.llm import whitening

DIR = "/root/testdata/sf0.001"


def plain(vectors):
    """(n, integer rows, their sums, variances, components) by an eigendecomposition of the covariance."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return n, x, s, e[::-1], u[:, ::-1], centred


def good(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def test_query_is_numpy(spark):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    kept = {k: v for k, v in table.items() if good(v)}
    n, x, s, e, u, centred = plain(kept.values())
    rows = q.op12_whitening(spark, DIR).collect()
    assert len(rows) == 32 * n and {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    got = {(r["vec_id"], r["component"]): r for r in rows}
    deviation = {k: sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for k, row in zip(kept, x, strict=True)}
    assert all(got[k, c]["deviation"] == deviation[k] for k in kept for c in (1, 32))
    for c in range(1, 33):
        mine = np.array([got[k, c]["whitened"] for k in kept])
        want = centred @ u[:, c - 1] / np.sqrt(e[c - 1])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert abs(got[next(iter(kept)), c]["explained"] / (e[c - 1] / e.sum()) - 1) < 1e-9


def test_narrow_blocks_iterate_to_the_same_components(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((600, 24)) * (1.25 ** -np.arange(24) * 20)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = whitening.fit(df, k=4, block=9)
    _, _, _, e, u, _ = plain(data)
    assert got.passes > 3 and got.residuals.max() <= 4096 * whitening.EPS * e[0]
    assert np.abs(got.variances / e[:4] - 1).max() < 1e-12 and np.abs(np.abs((got.components * u[:, :4]).sum(axis=0)) - 1).max() < 1e-12
    assert whitening.identity_error(df, got) < 1e-10
    with pytest.raises(RuntimeError, match="widen"):
        whitening.fit(df, k=4, block=4, max_passes=2)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [2.0, 3.5]), (3, None), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [1.0]), (8, []), (None, [4.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, component int")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r["n"] for r in got} == {4} and got[0]["identity_error"] < 1e-12
    none = whitening.whiten(df.where("vec_id > 90"))
    assert none.count() == 0 and none.columns == whitening.whiten(df).columns
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0  # no vector differs
    with pytest.raises(Exception, match="entry of a vector"):
        whitening.fit(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))


def test_a_flat_direction_is_no_component(spark):
    df = spark.createDataFrame([(k, [float(k % 7), float(k % 3), 5.0, float(k % 7)]) for k in range(60)], "vec_id long, embedding array<double>")
    assert len(whitening.fit(df).variances) == 2


def test_exact_beyond_64_bits():
    y = np.array([[1 << 39, 5]])
    got = whitening.centred(y, 10**9, np.array([3, -(10**20)], object))
    assert got.tolist() == [[10**9 * (1 << 39) - 3, 5 * 10**9 + 10**20]]
