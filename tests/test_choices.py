"""The running greedy choice against a loop over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import timeline

SCHEMA = "id int, score int, artist string, names string, title string, code string, seed boolean, extra int"


def plain(rows, limit, caps=(3, 5, 8)):
    ranked, chosen = sorted(rows, key=lambda r: (-r[1], r[0])), []
    for cap in caps:
        for r in ranked:
            if (
                r in chosen or (r[5] and any(c[5] == r[5] for c in chosen)) or any((c[3], c[4]) == (r[3], r[4]) for c in chosen)
                or sum(c[2] == r[2] for c in chosen) >= cap or (sum(c[3] == r[3] for c in chosen) >= 2 and not r[6])
            ):
                continue
            chosen.append(r)
            if len(chosen) == limit:
                return [c[0] for c in chosen]
    return [c[0] for c in chosen]


def chosen(spark, rows, limit):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = timeline.running_greedy(df, "id", -F.col("score"), F.col("artist"), F.col("names"), F.col("title"), F.col("code"), F.col("seed"), limit)
    assert got.columns == [*df.columns, "place"]
    return [r.id for r in got.orderBy("place").collect()]


def drawn(seed, n, artists, functional, codes):
    draw, rows = random.Random(seed), []
    for i in range(n):
        artist = f"a{draw.randint(0, artists)}" if draw.random() > 0.02 else None
        names = f"{artist if functional else ''}+{draw.randint(0, 4)}"
        code = draw.choice([None, "", f"c{draw.randint(0, codes)}", f"u{i}"])
        rows.append((i, draw.randint(0, 6), artist, names, f"t{draw.randint(0, 9)}", code, draw.random() < 0.03, 1))
    return rows


@pytest.mark.parametrize("seed,artists,functional,codes,limit", ((1, 5, True, 4, 60), (2, 30, True, 30, 500), (3, 5, False, 10, 40), (4, 12, False, 3, 25), (5, 2, True, 100, 7)))
def test_equals_a_loop(spark, seed, artists, functional, codes, limit):
    rows = drawn(seed, 500, artists, functional, codes)
    assert chosen(spark, rows, limit) == plain([(*r[:2], r[2] or "\0", *r[3:]) for r in rows], limit)


def test_one_artist_has_most_rows_and_few_are_kept(spark):
    rows = [(i, 9, "hot", f"hot+{i % 50}", f"t{i}", "same" if i % 4 else None, False, 1) for i in range(3000)] + [(5000 + i, 1, f"a{i}", f"a{i}", "t", None, False, 1) for i in range(30)]
    assert chosen(spark, rows, 30) == plain(rows, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    named = df.select(F.col("id").alias("key"), F.col("artist").alias("primary"), F.col("names").alias("combo"), "title", "code", F.col("seed").alias("exempt"), F.struct(-F.col("score"), "id").alias("order"))
    assert timeline.choosable(named, 8, 2).count() < 300


def test_no_rows(spark):
    assert chosen(spark, [], 10) == []
