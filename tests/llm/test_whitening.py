"""Whitening against one decomposition of the whole list."""

import random

import numpy as np
import pytest

from lodestar.llm import queries
from lodestar.llm.whitening import Summary, merged_all, whiten


def plain(vectors, components=16):
    """Eigenvectors of the covariance of the distinct vectors, centred in extended precision."""
    x = np.array(sorted(set(map(tuple, vectors))), dtype=np.int64)
    sums = x.sum(axis=0)
    centred = (x.astype(np.longdouble) - sums.astype(np.longdouble) / len(x)).astype(float)
    values, directions = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)[:components]
    return len(x), sums, values[order], directions[:, order], values.sum()


def table(spark, vectors, ids=None):
    rows = [(ids[i] if ids else i, [int(c) for c in v], "extra") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, x array<bigint>, component string").repartition(5)


def test_merging_loses_nothing():
    draw = np.random.default_rng(2)
    x = draw.integers(-60, 60, (700, 12)) @ draw.integers(-2, 3, (12, 12)) + 1_000_000
    whole = Summary.of(x)
    for cuts in ([1, 2, 3, 350], [100, 200, 300, 400, 500, 600], list(range(7, 700, 7))):
        parts = merged_all([Summary.of(p) for p in np.split(x, cuts)])
        assert (parts.n, parts.sums) == (whole.n, whole.sums) == (700, x.sum(axis=0).tolist())
        assert np.allclose(parts.singular, whole.singular, rtol=1e-11)
        assert np.allclose((parts.singular**2) @ parts.vectors**2, (whole.singular**2) @ whole.vectors**2, rtol=1e-10)


@pytest.mark.parametrize("dims,components", ((5, 16), (24, 16), (7, 3)))
def test_equals_one_decomposition(spark, dims, components):
    draw = np.random.default_rng(dims)
    x = (draw.normal(0, 1, (400, dims)) * np.arange(1, dims + 1) * 9).astype(int) + 1_000_000
    vectors = np.concatenate([x, np.repeat(x[:3], 150, axis=0)])  # a third are copies
    n, sums, values, directions, trace = plain(vectors, components)
    got = whiten(table(spark, vectors), "x", components, ("vec_id",)).collect()
    assert len(got) == len(vectors) * min(dims, components)
    signs = {}
    for r in got:
        v, k = vectors[r.vec_id], r.component - 1
        want = (v - sums / n) @ directions[:, k] / np.sqrt(values[k])
        if abs(want) > 1e-3:
            signs.setdefault(k, np.sign(want * r.whitened))
        assert abs(r.whitened - signs.get(k, 1) * want) < 1e-6 or abs(want) <= 1e-3
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
        assert r.explained == pytest.approx(values[k] / trace, rel=1e-8) and r.identity_error < 1e-9


def test_few_vectors_and_constant_directions(spark):
    assert whiten(table(spark, []), "x").collect() == []
    assert whiten(table(spark, [[3, 4], [3, 4]]), "x", carry=("vec_id",)).collect() == []
    got = whiten(table(spark, [[3, 4], [5, 4], [5, 4]]), "x", carry=("vec_id",)).collect()
    assert sorted((r.vec_id, r.component, round(r.whitened, 9), r.n, r.explained) for r in got) == [(0, 1, -1.0, 2, 1.0), (1, 1, 1.0, 2, 1.0), (2, 1, 1.0, 2, 1.0)]


def test_shorter_and_very_large_vectors(spark):
    got = whiten(table(spark, [[7], [7, 1], [1, 1], [2, 5]]), "x", carry=("vec_id",), fill=1).collect()
    assert len(got) == 8 and {r.n for r in got} == {3}
    a, b = ({r.component: r.whitened for r in got if r.vec_id == i} for i in (0, 1))
    assert a == b
    huge = whiten(table(spark, [[1 << 50, 0], [0, 1], [0, 5]]), "x", carry=("vec_id",)).collect()
    assert {r.deviation for r in huge if r.vec_id == 0} == {None}


def test_query_drops_unusable_rows(spark, tmp_path):
    draw = random.Random(4)
    inf, nan = float("inf"), float("nan")
    good = [(i, [draw.gauss(0, 0.2) for _ in range(6)], 1) for i in range(60)]
    bad = [(100, None, 1), (101, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (102, [inf] * 6, 1), (103, [nan] + [0.0] * 5, 1), (104, [-inf] + [0.0] * 5, 1)]
    odd = [(None, good[0][1], None), good[1], (5, good[2][1], 3)]
    spark.createDataFrame(good + bad + odd, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_svd_whitening"](spark, str(tmp_path)).collect()
    assert len(got) == 63 * 6 and {r.n for r in got} == {60} and not {r.vec_id for r in got} & set(range(100, 105))
    x = [np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000 for _, v, _ in good + odd]
    n, sums, values, directions, _ = plain(x)
    first = {r.component: r.whitened for r in got if r.vec_id is None}
    want = (x[0] - sums / n) @ directions / np.sqrt(values)
    assert np.allclose(np.abs([first[k] for k in sorted(first)]), np.abs(want), atol=1e-7)
