"""Aggregates: counts, coverage, modes, medians, scaling (AGG-01 to AGG-09, AGG-14 to AGG-23, AGG-24, AGG-25 to AGG-36)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.quantiles import with_quantiles


def play_stats(events: DataFrame, key: str, amount: str, at: str, qualified: Column) -> DataFrame:
    """Events, qualified ones, total, first and last of each key (AGG-01)."""
    return events.groupBy(key).agg(
        F.count("*").alias("plays"),
        F.count_if(qualified).alias("qualified"),
        F.round(F.sum(F.coalesce(F.col(amount), F.lit(0.0))), 4).alias("total"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
    )


def coverage(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """``metric``, ``n``, ``percent`` for conditions on the same rows, in one pass (AGG-03, AGG-04, DOM-22)."""
    counted = df.agg(F.count("*").alias("__all"), *(F.count_if(c).alias(m) for m, c in metrics.items()))
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    percent = F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col("n"), F.col("__all")), 2), F.lit(0.0))
    return counted.selectExpr("__all", f"stack({len(metrics)}, {pairs}) AS (metric, n)").select("metric", "n", percent.alias("percent"))


def has_all(df: DataFrame, key: str, stage: str, count: int) -> DataFrame:
    """Keys with ``count`` distinct stages (AGG-05)."""
    return df.groupBy(key).agg(F.countDistinct(stage).alias("stages")).where(F.col("stages") == count)


def idf(occurrences: DataFrame, term: str, doc: str, documents: Column | int) -> DataFrame:
    """Documents of each term and 1 + ln((N + 1) / (df + 1)) (AGG-14)."""
    total = F.lit(documents) if isinstance(documents, int) else documents
    return occurrences.groupBy(term).agg(F.countDistinct(doc).alias("df")).withColumn("idf", 1 + F.log((total + 1) / (F.col("df") + 1)))


def mode_share(df: DataFrame, keys: Sequence[str], value: str, least: float = 0.60, mixed: str = "mixed_or_variable") -> DataFrame:
    """Most frequent value of each key, its share, and a verdict (``mixed`` below ``least``); ties go to the smaller
    value (AGG-17, AGG-18)."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("top"))
    share = F.col("top.n") / F.col("total")
    return top.select(
        *keys, F.col(f"top.{value}").alias("mode"), F.round(share, 6).alias("share"),
        F.when(share < least, mixed).otherwise(F.col(f"top.{value}")).alias("verdict"),
    )


def z_score(value: Column, partition: Sequence[str] = ()) -> Column:
    """(value - mean) / population deviation over present values; a deviation of 0 counts as 1 (AGG-16)."""
    w = Window.partitionBy(*partition)
    deviation = F.coalesce(F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)), F.lit(1.0))
    return (value - F.avg(value).over(w)) / deviation


def with_z_scores(df: DataFrame, values: Sequence[str], prefix: str = "z_") -> DataFrame:
    """``z_score`` of whole columns by one aggregate row instead of one window over all rows (AGG-16)."""
    aggregates = [x for v in values for x in (F.avg(v).alias(f"__m_{v}"), F.stddev_pop(v).alias(f"__s_{v}"))]
    joined = df.crossJoin(F.broadcast(df.agg(*aggregates)))  # one row
    for v in values:
        deviation = F.coalesce(F.nullif(F.col(f"__s_{v}"), F.lit(0.0)), F.lit(1.0))
        joined = joined.withColumn(f"{prefix}{v}", (F.col(v) - F.col(f"__m_{v}")) / deviation)
    return joined.drop(*(f"__{k}_{v}" for v in values for k in "ms"))


def robust_unit(value: Column, low: Column, high: Column) -> Column:
    """Scaling between two percentiles, held within 0..1; 0 where they coincide (AGG-21)."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(value - low, high - low))), F.lit(0.0))


def energy_weights(df: DataFrame, keys: Sequence[str], energy: str) -> DataFrame:
    """Weights that sum to 1 in each key: energy, but at least 0.35 of its 20th percentile (AGG-22)."""
    floored = with_quantiles(df, keys, energy, {"p20": 0.2}).withColumn("floored", F.greatest(energy, 0.35 * F.col("p20")))
    totals = floored.groupBy(*keys).agg(F.sum("floored").alias("total"))
    return floored.join(totals, list(keys)).withColumn("weight", F.try_divide("floored", "total")).drop("p20", "floored", "total")


def weighted_mean_vector(df: DataFrame, keys: Sequence[str], vector: str, weight: str) -> DataFrame:
    """``dim``, ``value``: weighted mean of vectors, divided by its length (AGG-23). Long form: partial sums of a key's
    dimensions are all that moves."""
    long = df.select(*keys, weight, F.posexplode(vector).alias("dim", "x"))
    sums = long.groupBy(*keys, "dim").agg(F.sum(F.col("x").cast("double") * F.col(weight)).alias("s"))
    norms = sums.groupBy(*keys).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return sums.join(norms, list(keys)).select(*keys, "dim", F.try_divide("s", "norm").alias("value"))


def share_of_top(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """``amount`` over the largest of its key, in 0..1 (AGG-32)."""
    top = df.groupBy(*keys).agg(F.max(amount).alias("__top"))
    return df.join(top, list(keys)).withColumn("share", F.coalesce(F.try_divide(amount, "__top"), F.lit(0.0))).drop("__top")


def quarantine(df: DataFrame, keys: Sequence[str], failed: Column, error: Column, at: Column, least: int = 3) -> DataFrame:
    """Keys that failed at least so often, with their last error (AGG-33)."""
    return (
        df.where(failed)
        .groupBy(*keys)
        .agg(F.count("*").alias("failures"), F.max_by(error, at).alias("last_error"))
        .where(F.col("failures") >= least)
    )


def broad_classes(df: DataFrame, keys: Sequence[str], label: str, score: str, separator: str = "---") -> DataFrame:
    """Scores summed by the part of the label before the separator, and their ratio to the key's largest (AGG-35)."""
    sums = df.groupBy(*keys, F.split_part(F.col(label), F.lit(separator), F.lit(1)).alias("class")).agg(F.sum(score).alias("score"))
    return share_of_top(sums, keys, "score") if keys else sums.crossJoin(F.broadcast(sums.agg(F.max("score").alias("__top")))).withColumn(
        "share", F.try_divide("score", "__top")
    ).drop("__top")


def tag_shares(windows: DataFrame, id_col: str, window: str, tag: str) -> DataFrame:
    """Share of an entity's windows in which a tag occurs (AGG-24): ``id_col``, ``tag``, ``share``."""
    totals = windows.groupBy(id_col).agg(F.countDistinct(window).alias("__windows"))
    counts = windows.groupBy(id_col, tag).agg(F.countDistinct(window).alias("__with"))
    return counts.join(totals, id_col).select(id_col, tag, (F.col("__with") / F.col("__windows")).alias("share"))
