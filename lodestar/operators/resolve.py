"""entity resolution by exact keys, blocked fuzzy matching with margins, nearest values (JON-05 to JON-15, JON-20,
JON-25, JON-27, WIN-18, DOM-15, DOM-19, DOM-20, DOM-23)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import scores, text
from lodestar.operators.timeline import accept_by_margin
from lodestar.session import shared_path


def unique_keys(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Keys that name exactly one entity, with that entity (JON-10, JON-27)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias(id_col), F.countDistinct(id_col).alias("__n")).where("__n = 1").drop("__n")


def fuzzy_candidates(left: DataFrame, right: DataFrame, block: str, left_text: str, right_text: str, ratio=text.token_overlap) -> DataFrame:
    """Pairs with an equal block, and ``score``: how alike their texts are (JON-11, JON-12).

    For a right side that has few rows a block: each left row meets all of them. Where both sides have many, use
    ``setjoin.matched_sets``. ``ratio`` is a Column function; ``text.matching_ratio`` is the exact, slower one.
    """
    return left.join(right, block).withColumn("score", ratio(F.col(left_text), F.col(right_text)))


def cascade(df: DataFrame, matches: Sequence[tuple[str, DataFrame, float | None]], id_col: str, found: str) -> DataFrame:
    """``found``, ``method`` and ``confidence`` from the first stage that knows a row (JON-11).

    Each stage is its name, a frame of ``id_col``, ``found`` (and ``confidence`` where the constant is None).
    """
    out = df
    for i, (_, frame, constant) in enumerate(matches):
        confidence = F.lit(constant).cast("double") if constant is not None else F.col("confidence")
        out = out.join(frame.select(id_col, F.col(found).alias(f"__f{i}"), confidence.alias(f"__c{i}")), id_col, "left")
    places = range(len(matches))
    method = F.coalesce(*(F.when(F.col(f"__f{i}").isNotNull(), F.lit(matches[i][0])) for i in places), F.lit("unmatched"))
    return out.select(
        *df.columns,
        F.coalesce(*(F.col(f"__f{i}") for i in places)).alias(found),
        method.alias("method"),
        F.coalesce(*(F.when(F.col(f"__f{i}").isNotNull(), F.col(f"__c{i}")) for i in places), F.lit(0.0)).alias("confidence"),
    )


def match_with_margin(candidates: DataFrame, id_col: str, other: str, score: Column, least: float = 0.82, margin: float = 0.08, sure: float = 0.95) -> DataFrame:
    """The accepted candidate of each row: good enough, and clearly better than the second (WIN-18)."""
    return accept_by_margin(candidates.withColumn("score", score), [id_col], "score", [F.col(other)], least, margin, sure)


def title_score(artist: Column, duration: Column) -> Column:
    """0.72 of the artists' likeness and 0.28 of the durations', both fixed values (JON-11)."""
    return 0.72 * artist + 0.28 * duration


def identity_confidence(title: Column, artist: Column, seconds: Column, other_seconds: Column) -> Column:
    """How sure two records are one recording (DOM-20)."""
    return 0.5 * title + 0.3 * artist + 0.2 * scores.duration_score(seconds, other_seconds)


def review_verdict(title_ratio: Column, artist_ratio: Column, equal: Column, conflict: Column, reject: float = 0.55) -> Column:
    """Accept equal names without a conflict of codes, reject if neither name is alike, else keep (DOM-19)."""
    return F.when(equal & ~conflict, "accept").when((title_ratio < reject) & (artist_ratio < reject), "reject").otherwise("keep")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, a: str, b: str, pick: Sequence[str]) -> DataFrame:
    """For each left row the right row of equal keys with the nearest value, ties by ``pick`` (JON-20).

    An as-of merge: both sides are ranged by key and value and written down; within a range each left row sees the last right value
    before it and the next after it, and where its range has none, those of the ranges beside it, which are carried in from
    a few rows a range. So a hot key is many ranges, and no left row meets more than two values. Rows with a null key or value
    have no nearest."""
    spark, path = left.sparkSession, shared_path(left.sparkSession, "merge")
    present = lambda df, v: df.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*keys, v))))
    firsts = present(right, b).groupBy(*keys, F.col(b).alias("__v")).agg(F.min(F.struct(*pick)).alias("__r"))
    marks = firsts.select(*keys, "__v", F.struct("__v", "__r").alias("__r"), F.lit(None).cast(left.schema[left_id].dataType).alias("__id"))
    asks = present(left, a).select(*keys, F.col(a).alias("__v"), F.lit(None).cast(marks.schema["__r"].dataType).alias("__r"), F.col(left_id).alias("__id"))
    marks.unionByName(asks).repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()).write.parquet(path)
    both = spark.read.parquet(path)
    here = Window.partitionBy(*keys, "__range").orderBy("__v", F.col("__r").isNull())
    before = F.last("__r", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__r", ignorenulls=True).over(here.rowsBetween(0, Window.unboundedFollowing))
    seen = both.select(*keys, "__range", "__v", "__id", F.col("__r").isNull().alias("__asks"), before.alias("__before"), after.alias("__after")).where("__asks")
    edges = both.groupBy(*keys, "__range").agg(F.min("__r").alias("__low"), F.max("__r").alias("__high"))
    beside = Window.partitionBy(*keys).orderBy("__range")
    edges = edges.select(
        *keys, "__range", F.last("__high", ignorenulls=True).over(beside.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"),
        F.first("__low", ignorenulls=True).over(beside.rowsBetween(1, Window.unboundedFollowing)).alias("__later"),
    )
    found = seen.join(edges, [*keys, "__range"])
    near = lambda r: F.when(r.isNotNull(), F.struct(F.abs(F.col("__v") - r["__v"]).alias("apart"), r["__r"].alias("r"), r["__v"].alias("v")))
    best = F.least(near(F.coalesce("__before", "__earlier")), near(F.coalesce("__after", "__later")))
    taken = found.select(F.col("__id").alias(left_id), best.alias("best")).where("best is not null")
    return taken.select(left_id, *(F.col(f"best.r.{c}").alias(c) for c in pick), F.col("best.v").alias(b), F.col("best.apart").alias("apart"))


def absent(df: DataFrame, *others: tuple[DataFrame, str], key: str) -> DataFrame:
    """Rows whose key none of the others has (JON-05, JON-06, JON-25): one anti join each."""
    for other, column in others:
        df = df.join(other.select(F.col(column).alias(key)), key, "left_anti")
    return df


def repair_plan(entries: DataFrame, path: str, exists: str, replacement: str, most: float = 0.25) -> DataFrame:
    """Counts of entries to keep, repair and delete, and whether deleting stays within a share of all (DOM-23)."""
    action = F.when(F.col(exists), "keep").when(F.col(replacement).isNotNull(), "repair").otherwise("delete")
    counted = entries.agg(*(F.count_if(action == a).alias(a) for a in ("keep", "repair", "delete")), F.count(path).alias("entries"))
    return counted.withColumn("safe", F.coalesce(F.col("delete") <= most * F.col("entries"), F.lit(True)))
