"""Hard negatives against all scores of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import queries
from lodestar.llm.negatives import Lists, MiningRules, best_in_windows, fitted_centroids, mine_negatives, nearest_centroid, scores_of, visits
from lodestar.llm.vectors import fixed_point, usable

SMALL = MiningRules(list_rows=16, anchor_rows=8, first_lists=2)


def plain(rows, every, rules):
    """All windows from a sort of all rows for each anchor."""
    rows = sorted({(i, label, tuple(x)) for i, label, x in rows if i is not None and label is not None})
    dims = max((len(x) for _, _, x in rows), default=0)
    x = np.array([list(v) + [0] * (dims - len(v)) for _, _, v in rows], dtype=object).reshape(len(rows), dims)
    out = []
    for a, (i, label, _) in enumerate(rows):
        if i % every:
            continue
        ranked = sorted((-int(np.dot(x[a], x[b])) if dims else 0, rows[b][0], rows[b][1], b) for b in range(len(rows)) if b != a)
        for p, positive, _, _ in [r for r in ranked if r[2] == label][: rules.positives]:
            inside = [(n, j) for n, j, other, _ in ranked if other != label and rules.least_percent * -p <= 100 * -n <= rules.most_percent * -p]
            out += [(i, positive, k, j, -p, -n) for k, (n, j) in enumerate(inside[: rules.negatives], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, label, x, 1) for i, label, x in rows], "vec_id long, label int, x array<bigint>, cluster int").repartition(4)


def mined(spark, rows, every=10, rules=SMALL):
    return sorted(map(tuple, mine_negatives(table(spark, rows), F.col("vec_id") % every == 0, rules).collect()))


def clustered(seed, n, dims, spread, labels=4):
    draw = np.random.default_rng(seed)
    middles = draw.normal(0, 60, (8, dims))
    return [(i, int(draw.integers(labels)), (middles[draw.integers(8)] + draw.normal(0, spread, dims)).astype(int).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed,spread", ((1, 1), (2, 10), (3, 200)))
def test_equals_all_scores(spark, seed, spread):
    rows = clustered(seed, 300, 6, spread)
    got = mined(spark, rows)
    assert got == plain(rows, 10, SMALL) and len(got) > 100


def test_one_label_a_third_of_the_rows_and_many_ties(spark):
    draw = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else draw.randint(1, 5), [draw.randint(0, 2) for _ in range(3)]) for i in range(400)]
    rows += [(1000 + i, draw.randint(0, 3), [1, 1, 1]) for i in range(200)]
    assert mined(spark, rows, 20) == plain(rows, 20, SMALL)


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (0, 1, [3, 4]), (0, 2, [3, 4]), (10, 1, [5]), (11, 2, [4, 1]), (12, 3, [2, 3]), (13, None, [9, 9]), (None, 1, [9, 9]), (20, 7, []), (30, 1, [-5, -9]), (31, 2, [0, 0])]
    rows += [(40, 5, [0, 0]), (41, 5, [0, 0])]
    assert mined(spark, rows) == plain(rows, 10, SMALL)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [2])]) == [] and mined(spark, [(0, 1, [2])]) == []


def test_large_components_stay_exact(spark):
    draw = random.Random(7)
    rows = [(i, i % 3, [draw.randint(-(1 << 25), 1 << 25) for _ in range(5)]) for i in range(120)]
    assert mined(spark, rows) == plain(rows, 10, SMALL)
    assert scores_of(np.array([[1 << 25, 3]]), np.array([[1 << 25, -7]])).tolist() == [[(1 << 50) - 21]]


def index_of(x, k):
    centroids = fitted_centroids(x, k)
    nearest, distance = nearest_centroid(x, centroids)
    radii = np.array([distance[nearest == c].max(initial=0) for c in range(len(centroids))])
    return nearest, Lists(centroids, radii, np.bincount(nearest, minlength=len(centroids)).astype(float))


def test_bounds_hold_and_lists_are_left_out():
    x = np.array([v for _, _, v in clustered(4, 500, 8, 2)])
    nearest, lists = index_of(x, 20)
    lowest, highest, _ = lists.bounds(x[:50])
    scores = scores_of(x[:50], x)
    for c in set(nearest.tolist()):
        assert (scores[:, nearest == c] <= highest[:, [c]]).all() and (scores[:, nearest == c] >= lowest[:, [c]]).all()
    wide = np.full((50, 1), -(1 << 62)), np.full((50, 1), 1 << 62)
    first = visits(lists, x[:50], *wide, None, 3)
    kth = np.sort(np.where(first[:, 0][:, nearest], scores, -(1 << 62)), axis=1)[:, [-5]]
    later = visits(lists, x[:50], *wide, kth, 3)
    assert not (first & later).any() and first.sum() == 150
    assert later.sum() < 0.2 * 50 * len(lists.radii)
    missed = ~(first | later)[:, 0][:, nearest]
    assert (scores < kth)[missed].all()  # strictly below
    window = visits(lists, x[:50], kth - 10, kth, None, 20)
    inside = (scores >= kth - 10) & (scores <= kth)
    assert not (inside & ~window[:, 0][:, nearest]).any() and window.sum() < 0.6 * window.size


def test_best_in_windows():
    scores, ids = np.array([[5, 9, 5, 1, 7], [2, 2, 2, 2, 2]]), np.array([3, 4, 6, 8, 9])
    low, high = np.array([[2, 0], [2, 3]]), np.array([[8, 5], [2, 9]])
    row, window, column = best_in_windows(scores, ids, low, high, 2)
    assert list(zip(row.tolist(), window.tolist(), ids[column].tolist(), strict=True)) == [(0, 0, 9), (0, 0, 3), (0, 1, 3), (0, 1, 6), (1, 0, 3), (1, 0, 4)]


def test_query_takes_usable_rows(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(4)], draw.randint(0, 9)) for i in range(500)]
    rows += [(700, None, 1), (800, [0.1, None, 0.2, 0.3], 1), (900, [float("nan")] * 4, 2), (1000, [float("inf")] * 4, 2), (1100, [0.5] * 4, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.QUERIES["op11_cluster_hard_negatives"](spark, str(tmp_path)).collect()))
    fixed = [(i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v, label in rows[:500]]
    assert got == plain(fixed, 100, MiningRules()) and got


def test_fixed_point_and_usable(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([1e300, -1e300],), ([float("nan")],), ([None, 1.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(usable(F.col("v"))).collect()] == [True, True, False, False, False, True]
    got = [r[0] for r in df.where(usable(F.col("v"))).select(fixed_point(F.col("v"), 64, 10, 1000)).collect()]
    assert got == [[42, 9], [1010, -990], []]
