"""Whitening against eigenvectors of the whole covariance and sums of Python integers."""

import math

import numpy as np
import pytest

from loreweave.llm import whitening
from loreweave.llm.queries import QUERIES

VECTOR = "vec_id long, embedding array<float>"


def integers(vectors):
    fine = [(i, v) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in fine)
    return [i for i, _ in fine], [[math.floor(1024 * x) + 100_000 for x in [*v, *[0.0] * (width - len(v))]] for _, v in fine]


def check(df, vectors, components=8):
    """Rows of df against a plain computation; vec_ids are distinct."""
    ids, x = integers(vectors)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    rows = df.collect()
    own = {(r.vec_id, r.component): r for r in rows}
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    cov = centred.T @ centred / n
    values, columns = np.linalg.eigh(cov)
    values, columns = values[::-1], columns[:, ::-1]
    k = min(components, int((values > 1e-11 * values[0]).sum()))
    assert len(rows) == len(own) == n * k
    got = np.array([[own[i, c + 1].whitened for c in range(k)] for i in ids])
    want = centred @ columns[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        gap = min(abs(values[c] - values[j]) for j in range(len(values)) if j != c) if len(values) > 1 else values[0]
        if gap > 1e-6 * values[0]:  # equal values: any turn of their vectors is right
            assert np.abs(got[:, c] * np.sign(got[:, c] @ want[:, c]) - want[:, c]).max() < 1e-8 / min(1, gap / values[0])
    assert np.allclose(np.cov(got.T, bias=True).reshape(k, k), np.eye(k), atol=1e-7)
    for i, v in zip(ids, x, strict=True):
        r = own[i, 1]
        assert r.n == n and r.deviation == min(2**63 - 1, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)))
    for c in range(k):
        assert math.isclose(own[ids[0], c + 1].explained, values[c] / values.sum(), rel_tol=1e-6)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-6


def test_query_against_whole_covariance(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op12_whitening"](spark, sf), vectors)


def test_odd_vectors(spark):
    """Nulls, non-finite entries, several widths, empty vectors, a null id, clashing columns."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), 1) for i in range(60)]
    rows += [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [float("nan")] * 6, 1), (103, [float("inf"), 1.0], 1), (104, [3.0, 1.0], 1), (105, [], 1), (106, [-2.5] * 6, 1)]
    df = spark.createDataFrame(rows, VECTOR + ", i int").repartition(3)
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    check(whitening.op12(df), vectors)
    again = df.unionByName(df.where("vec_id = 5").selectExpr("cast(null as long) as vec_id", "embedding", "i"))
    assert whitening.op12(again).where("vec_id is null").count() == 6


@pytest.mark.parametrize("rank", [1, 2, 5])
def test_few_distinct_vectors_have_few_components(spark, rank):
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(rank + 1, 12))
    vectors = [(i, base[i % (rank + 1)].astype(np.float32).tolist()) for i in range(40)]
    check(whitening.op12(spark.createDataFrame(vectors, VECTOR)), vectors)


def test_equal_values_and_wide_ranges(spark):
    cube = [(i, [float(i >> b & 1) for b in range(4)]) for i in range(16)]  # four equal eigenvalues
    check(whitening.op12(spark.createDataFrame(cube, VECTOR)), cube)
    large = [(i, [float(x) for x in np.random.default_rng(i).normal(size=3) * 1e9]) for i in range(30)]
    large = [(i, np.array(v, np.float32).tolist()) for i, v in large]
    check(whitening.op12(spark.createDataFrame(large, VECTOR)), large)


def test_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], VECTOR)
    assert whitening.op12(df).count() == 0  # all equal
    assert whitening.op12(df.limit(0)).count() == 0
    assert whitening.op12(df.where("vec_id = 3")).count() == 0
    far = spark.createDataFrame([(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 5.0])], VECTOR)
    assert whitening.op12(far).where("component = 1").count() == 3


def test_wide_vectors_stop_when_the_triplets_stand():
    rng = np.random.default_rng(3)
    width, scales = 400, np.concatenate((2.0 ** -np.arange(12) * 100, np.full(388, 0.01)))
    x = rng.normal(size=(900, width)) * scales
    steps = []

    def product(v, p):
        steps.append(1)
        w = x @ v
        return w @ w, (x @ p).T @ w, x.T @ w, (x * x).sum()

    sigma, right, _ = whitening.bidiagonalise(product, width, 8)
    _, want, rows = np.linalg.svd(x)
    assert len(steps) < 200 and np.allclose(sigma[:8], want[:8], rtol=1e-12)
    assert np.allclose(np.abs((rows[:8] * right[:, :8].T).sum(axis=1)), 1, atol=1e-10)
