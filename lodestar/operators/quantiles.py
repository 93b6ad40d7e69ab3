"""Exact quantiles of groups of any size, by distributed selection (AGG-19 to AGG-22).

No task ever holds a group's values: a mergeable sketch gives each group and fraction two bounds that enclose the wanted
ranks; one pass counts what lies below the bounds and the values between them; the ranks are picked among the latter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import shared_path

#: Rank error of the sketch, as one part of a group's rows.
ACCURACY = 1000


def _enclosed(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], accuracy: int) -> DataFrame:
    """Keys, ``n``, and for each fraction a struct of the wanted ranks (from 0) and bounds of their values."""
    slack = 2.0 / accuracy
    points = sorted({min(1.0, max(0.0, f + s)) for f in fractions for s in (-slack, slack)})
    sketch = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("__min"), F.max(value).alias("__max"),
        F.percentile_approx(value, [float(p) for p in points], accuracy).alias("__at"),
    )

    def bound(f: float, edge: str) -> Column:
        return F.col(edge) if not 0 < f < 1 else F.col("__at")[points.index(f)]

    marks = []
    for i, f in enumerate(fractions):
        place = F.lit(float(f)) * (F.col("n") - 1)
        marks.append(F.struct(
            F.lit(i).alias("i"), F.floor(place).alias("lower"), F.ceil(place).alias("upper"), (place - F.floor(place)).alias("part"),
            bound(min(1.0, max(0.0, f - slack)), "__min").alias("low"), bound(min(1.0, max(0.0, f + slack)), "__max").alias("high"),
        ))
    return sketch.select(*keys, "n", F.array(*marks).alias("__marks"))


def _picked(df: DataFrame, keys: Sequence[str], value: str, marks: DataFrame) -> DataFrame:
    """Keys, ``i``, and the values at the two ranks; null where the bounds don't enclose them."""
    own = [f"__k{j}" for j in range(len(keys))]
    named = marks.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), "__marks")
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    # One row a group: broadcast by Spark where that is small, else dealt by key, where adaptive execution splits a hot one.
    rows = df.select(*keys, F.col(value).alias("__v")).join(named, same) if keys else df.select(F.col(value).alias("__v")).crossJoin(F.broadcast(named))
    spread = rows.select(*keys, "__v", F.explode("__marks").alias("m")).where(F.col("__v") <= F.col("m.high"))
    inside = F.when(F.col("__v") >= F.col("m.low"), F.col("__v"))  # all below are one value: null
    counts = spread.groupBy(*keys, F.col("m.i").alias("i"), F.col("m.lower").alias("lower"), F.col("m.upper").alias("upper"), F.col("m.part").alias("part"), inside.alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).where("v is not null")
    holds = lambda rank: F.max(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank)), F.col("v")))
    return placed.groupBy(*keys, "i").agg(holds("lower").alias("a"), holds("upper").alias("b"), F.first("part").alias("part"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Keys, ``n`` (values) and ``quantiles`` (an array, one for each fraction), equal to Spark's ``percentile``.

    Nulls don't count; groups without a value are left out; a null key is a group. Between two ranks the value is
    interpolated. Bounds that a sketch has drawn too tight are found out, and drawn four times as wide for those groups."""
    spark, rows = df.sparkSession, df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__value"))
    parts = []
    while True:
        marks = _enclosed(rows, keys, "__value", fractions, accuracy)
        found = _picked(rows, keys, "__value", marks)
        whole = found.where("a is not null and b is not null").groupBy(*keys).agg(
            F.count("*").alias("__found"), F.sort_array(F.collect_list(F.struct("i", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("q")))).alias("__q")
        )
        joined = marks.select(*keys, "n").join(whole.select(*(F.col(k).alias(f"__w{j}") for j, k in enumerate(keys)), "__found", "__q"), [F.col(k).eqNullSafe(F.col(f"__w{j}")) for j, k in enumerate(keys)], "left") if keys else marks.select("n").crossJoin(F.broadcast(whole))
        path = shared_path(spark, "quantiles")  # one row a group
        joined.select(*keys, "n", F.coalesce(F.col("__found") == len(fractions), F.lit(False)).alias("__done"), F.transform("__q", lambda x: x["q"]).alias("quantiles")).write.parquet(path)
        written = spark.read.parquet(path)
        parts.append(written.where("__done").drop("__done"))
        left = written.where("not __done")
        if accuracy <= 4 or not left.limit(1).count():
            break
        accuracy = max(4, accuracy // 4)
        rows = rows.join(left.select(*(F.col(k).alias(f"__l{j}") for j, k in enumerate(keys))), [F.col(k).eqNullSafe(F.col(f"__l{j}")) for j, k in enumerate(keys)], "left_semi") if keys else rows
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_quantiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """``df`` with the quantiles of each row's group, named."""
    found = exact_quantiles(df, keys, value, list(fractions.values()))
    named = found.select(*(F.col(k).alias(f"__q{j}") for j, k in enumerate(keys)), *(F.col("quantiles")[i].alias(n) for i, n in enumerate(fractions)))
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"__q{j}")) for j, k in enumerate(keys)], "left").drop(*(f"__q{j}" for j in range(len(keys))))
