"""Joins and quantiles that stay linear, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import scores
from lodestar.operators import quantiles, resolve, setjoin, similarity, timeline


def plain_matches(left, right, least, margin, sure):
    out = {}
    for i, block, words in left:
        x, ranked = set(words), []
        for j, other, theirs in right:
            y = set(theirs)
            if block is not None and block == other and x and y:
                ranked.append((-len(x & y) / min(len(x), len(y)), j))
        ranked.sort()
        if ranked:
            best, second = -ranked[0][0], -ranked[1][0] if len(ranked) > 1 else 0
            if best >= least and (best - second >= margin or best >= sure):
                out[i] = (ranked[0][1], round(best, 9))
    return out


def rows_of(seed, n, first_id, blocks, vocabulary):
    draw = random.Random(seed)
    base = [[draw.choice(vocabulary) for _ in range(draw.randint(1, 9))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(draw.choice(base))
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        out.append((first_id + i, draw.choice(blocks), words[: draw.randint(0, 9)]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matched_sets_equal_all_pairs(spark, seed):
    left = rows_of(seed, 120, 0, ["p", "q", None], [f"w{i}" for i in range(30)])
    right = rows_of(seed + 100, 150, 1000, ["p", "q", "r", None], [f"w{i}" for i in range(30)])
    right += [(3000 + i, "p", right[0][2]) for i in range(5)]
    df = [spark.createDataFrame(rows, "id long, block string, words array<string>").repartition(3) for rows in (left, right)]
    got = setjoin.matched_sets(df[0], df[1].withColumnRenamed("id", "found"), "id", "found", (F.col("block"), F.col("block")), (F.col("words"), F.col("words")), 0.6, 0.1, 0.9)
    assert {r.id: (r.found, round(r.score, 9)) for r in got.collect()} == plain_matches(left, right, 0.6, 0.1, 0.9)


def test_pairs_of_sets_are_complete_and_no_product(spark):
    """A block of 400 rows a side whose sets share two common words: few pairs meet, and all alike ones do."""
    draw = random.Random(8)
    left = [(i, ["the", "of", f"a{i}", f"b{i}", f"c{i}"]) for i in range(400)]
    right = [(i, ["the", "of", f"a{i}", f"b{i}", "x" if i % 2 else f"c{i}", f"r{draw.random()}"]) for i in range(400)]
    sets = []
    for rows in (left, right):
        df = spark.createDataFrame(rows, "id long, words array<string>")
        sets.append(setjoin.distinct_sets(df, "id", F.lit("one"), F.col("words")))
    pairs = setjoin.similar_sets(*sets, 0.8)
    assert sorted((r.left, r.right) for r in pairs.collect()) == [(i, i) for i in range(400)]
    joins = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert all("(w#" in x or "block#" in x for x in joins) and not any("Cartesian" in x for x in joins)


def test_copies_don_t_multiply(spark):
    rows = [(i, ["same", "few", "words"]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    one = setjoin.distinct_sets(df, "id", F.lit(1), F.col("words"))
    assert [(r.left, r.right, r.copies) for r in setjoin.similar_sets(one, one, 0.5).collect()] == [(0, 0, 300)]
    got = setjoin.matched_sets(df, df.withColumnRenamed("id", "found"), "id", "found", (F.lit(1), F.lit(1)), (F.col("words"), F.col("words")))
    assert got.count() == 300 and got.where("found = 0 and score = 1").count() == 300


def plain_nearest(left, right):
    out = {}
    for i, key, value in left:
        near = [(abs(value - v), j, v) for j, k, v in right if k == key and v is not None] if value is not None and key is not None else []
        if near:
            apart, j, v = min(near)
            out[i] = (j, v, apart)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_nearest_equals_all_pairs_with_a_hot_key(spark, seed):
    draw = random.Random(seed)
    key = lambda: "hot" if draw.random() < 0.6 else draw.choice([f"k{i}" for i in range(20)] + [None])
    value = lambda: draw.choice([None, draw.randint(0, 40), draw.randint(0, 4000)])
    left, right = [(i, key(), value()) for i in range(500)], [(10_000 - i, key(), value()) for i in range(300)]
    frames = spark.createDataFrame(left, "id int, k string, a int").repartition(5), spark.createDataFrame(right, "other int, k string, b int").repartition(5)
    got = resolve.nearest(*frames, ["k"], "id", "a", "b", ["other"])
    assert {r.id: (r.other, r.b, r.apart) for r in got.collect()} == plain_nearest(left, right)


def test_nearest_meets_no_product_and_carries_across_ranges(spark):
    left = spark.range(3000).select("id", F.lit("hot").alias("k"), F.col("id").cast("double").alias("a"))
    right = spark.createDataFrame([(1, "hot", -5.0), (2, "hot", 2990.5)], "other int, k string, b double")
    got = {r.id: r.other for r in resolve.nearest(left, right, ["k"], "id", "a", "b", ["other"]).collect()}
    assert got == {i: 1 if i + 5 <= 2990.5 - i else 2 for i in range(3000)}
    assert resolve.nearest(left.limit(0), right, ["k"], "id", "a", "b", ["other"]).count() == 0


FRACTIONS = [0.0, 0.2, 0.5, 0.9, 0.97, 1.0]


@pytest.mark.parametrize("kind", ("spread", "ties", "hot"))
def test_quantiles_equal_percentile(spark, kind):
    draw = random.Random(2)
    value = {"spread": lambda: draw.gauss(0, 1e6), "ties": lambda: float(draw.randint(0, 3)), "hot": lambda: 7.0 if draw.random() < 0.9 else draw.random() * 100}[kind]
    rows = [(draw.choice(["a"] * 8 + ["b", "c", None]), draw.choice([value(), value(), value(), None])) for _ in range(5000)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    want = df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, FRACTIONS))).alias("q"), F.count("v").alias("n")).where("n > 0")
    got = {r.k: (r.n, r.quantiles) for r in quantiles.exact_quantiles(df, ["k"], "v", FRACTIONS).collect()}
    assert got == {r.k: (r.n, pytest.approx(r.q, rel=1e-12, abs=1e-9)) for r in want.collect()}


def test_bounds_that_are_too_tight_are_widened(spark):
    """A coarse sketch and a large group; then no groups, and none at all."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double").alias("v"))
    for accuracy in (4, 60, 100_000):
        got = quantiles.exact_quantiles(df, ["k"], "v", [0.1, 0.5], accuracy).collect()
        want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect()}
        assert {r.k: r.quantiles for r in got} == {k: pytest.approx(q) for k, q in want.items()}
    marks = quantiles._enclosed(df, ["k"], "v", [0.5], 100).withColumn("__marks", F.transform("__marks", lambda m: m.withField("high", m["low"] - 1)))
    assert quantiles._picked(df, ["k"], "v", marks).where("a is not null").count() == 0
    assert quantiles.exact_quantiles(df, [], "v", [0.5]).first().quantiles[0] == df.agg(F.percentile("v", 0.5)).first()[0]
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_no_task_sorts_a_hot_group(spark):
    """Of 60,000 values of one key the ranked rows are those between the bounds alone."""
    df = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    marks = quantiles._enclosed(df, ["k"], "v", [0.5], quantiles.ACCURACY)
    m = marks.first()["__marks"][0]
    assert m.low <= 29_999.5 <= m.high and m.high - m.low < 60_000 * 6 / quantiles.ACCURACY


def test_weighted_jaccard_with_a_key_that_all_have(spark):
    draw = random.Random(5)
    weights = {i: {k: draw.randint(1, 9) / 2 for k in ["hot", *draw.sample("abcdefgh", draw.randint(0, 3))]} for i in range(200)}
    df = spark.createDataFrame([(i, k, w) for i, own in weights.items() for k, w in own.items()], "id int, k string, w double")
    refs = spark.createDataFrame([(i,) for i in range(0, 200, 20)], "id int")
    want = {}
    for a in range(0, 200, 20):
        for b in weights:
            if a != b:
                keys = weights[a].keys() | weights[b].keys()
                least, most = (sum(pick(weights[a].get(k, 0), weights[b].get(k, 0)) for k in keys) for pick in (min, max))
                want[a, b] = pytest.approx(least / most)
    for salts in (1, 7):
        assert {(r.ref, r.id): r.jaccard for r in similarity.pair_jaccard(df, "id", "k", "w", refs, salts).collect()} == want


def test_weighted_jaccard_exchanges_no_pairs(spark):
    """Missing weights and keys as a join on the key has them; and no exchange holds a row for each pair."""
    rows = [(1, "a", 2.0), (1, "b", None), (2, "a", 1.0), (2, None, 4.0), (3, "b", 3.0), (4, "b", None), (5, "c", 0.0), (6, "c", 0.0), (None, "a", 1.0), (7, "b", None)]
    df = spark.createDataFrame(rows, "id int, k string, w double")
    refs = spark.createDataFrame([(1,), (4,), (5,)], "id int")
    got = {(r.ref, r.id): r.jaccard for r in similarity.pair_jaccard(df, "id", "k", "w", refs).collect()}
    assert got == {(1, 2): 1 / 6, (1, 3): 3 / (3 + 2 - 3), (1, 4): None, (1, 7): None, (4, 1): None, (4, 3): None, (4, 7): None, (5, 6): None}
    plan = similarity.pair_jaccard(df, "id", "k", "w", refs)._jdf.queryExecution().optimizedPlan().toString()
    after = plan[: plan.index("FlatMapGroupsInArrow")]
    assert not any(step in after for step in ("Join", "Aggregate", "Repartition"))


def test_weighted_jaccard_writes_few_bytes_a_pair(spark, tmp_path):
    """Rows of a task stand by score, so that a column file holds equal scores once and ids in the bits of their block."""
    weights = spark.range(3000).select("id", F.explode(F.array(*map(F.lit, "abcd"))).alias("k"))
    weights = weights.select("id", "k", (F.pmod(F.xxhash64("id", "k"), F.lit(50_000)) / 100).alias("w"))
    pairs = similarity.pair_jaccard(weights, "id", "k", "w", spark.range(1500), 1)
    pairs.withColumn("jaccard", scores.rounded(F.col("jaccard"), 6)).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 1500 * 2999
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 5.5 * 1500 * 2999


def test_weighted_jaccard_runs_each_block_in_its_own_task(spark):
    weights = spark.range(400).select("id", F.lit("hot").alias("k"), (F.col("id") % 7 + 1).cast("double").alias("w"))
    pairs = similarity.pair_jaccard(weights, "id", "k", "w", spark.range(5), 16)
    assert pairs.select(F.spark_partition_id().alias("task")).distinct().count() == 16


def test_weighted_jaccard_rounds_as_columns_do(spark):
    x = [0.4999995, 0.49999949999999994, 2.5e-6, -2.5e-6, 4.9999999999999994e-7, -1e-9, 1 / 3, 16.520001499999998, 0.0, 1.0, 123456.7890125]
    want = [r.x for r in spark.createDataFrame([(v,) for v in x], "x double").select(scores.rounded(F.col("x"), 6).alias("x")).collect()]
    got = similarity._rounded(np.array(x), 6).tolist()
    assert list(map(str, got)) == list(map(str, want))
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None)], "id int, k string, w double")
    found = similarity.pair_jaccard(df, "id", "k", "w", spark.createDataFrame([(1,)], "id int"), digits=6).collect()
    assert {(r.ref, r.id): r.jaccard for r in found} == {(1, 2): 0.333333, (1, 3): None}


def test_benchmark_candidates_of_equal_ids(spark, tmp_path):
    """Texts of one id are compared one by one, and words that several items have find no pairs."""
    from lodestar.plans import registry

    candidates = registry.QUERIES["fuzzy_anti"].__globals__["benchmark_candidates"]
    docs = [(1, "Alpha beta"), (1, "gamma DELTA"), (2, "common words alone"), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(10, "alpha beta gamma delta"), (11, "common words"), (12, "words common"), (13, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, candidates(spark, str(tmp_path)).collect())) == [(1, 10, 1.0), (1, 10, 1.0)]


def test_caps_with_missing_values(spark):
    rows = [(i, None if i % 4 == 0 else f"body{i % 9}", f"s{i % 3}" if i % 7 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, body string, source string").repartition(4)
    seen, count, want = set(), {}, []
    for i, body, source in rows:
        if body is None or body not in seen:
            seen.add(body)
            count[source] = count.get(source, 0) + 1
            if count[source] <= 5:
                want.append(i)
    assert [r.id for r in timeline.capped(df, ["body"], {"source": 5}, [F.col("id")], 12).collect()] == want[:12]
