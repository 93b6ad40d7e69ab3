"""one preferred value for each entity and field out of many sources that disagree.

Observations are long: entity, field, source, value, confidence. Policies (rank or weight of a source for a field) are
small tables of the caller; their size is that of the code that names the sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(source: Column | str, order: dict[str, int], default: int) -> Column:
    """Rank of a source by a literal policy (PRJ-07): a CASE, no join."""
    source = F.col(source) if isinstance(source, str) else source
    out = F.when(F.lit(False), F.lit(default))
    for name, rank in order.items():
        out = out.when(source == name, F.lit(rank))
    return out.otherwise(F.lit(default))


def unpivot_fields(wide: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Wide observations to long ones; absent values go."""
    return wide.unpivot(list(keys), list(fields), "field", "value").where(F.col("value").isNotNull())


def preferred(observations: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Sequence[str] = ("value", "source")) -> DataFrame:
    """The first observation of each key in ``order`` (WIN-03, WIN-04, DOM-01, AGG-10, AGG-11, AGG-12).

    ``order`` ends in columns that tell all observations of a key apart, so the choice doesn't hang on the order of
    rows. A minimum over an ordering struct: partial minima are taken before the shuffle, and a hot key costs one row a
    task.
    """
    best = F.min_by(F.struct(*value), F.struct(*order)).alias("best")
    return observations.groupBy(*keys).agg(best).select(*keys, *(F.col(f"best.{v}").alias(v) for v in value))


def descending(c: Column | str) -> Column:
    """A number as a part of an ordering struct in which larger comes first and null last."""
    c = F.col(c) if isinstance(c, str) else c
    return F.struct(c.isNull(), -c)


def pivot_values(long: DataFrame, keys: Sequence[str], by: str, names: Sequence[str], value: str) -> DataFrame:
    """One column for each named source or field, by one conditional aggregate each (PRJ-02, PRJ-03)."""
    return long.groupBy(*keys).agg(*(F.max(F.when(F.col(by) == n, F.col(value))).alias(n) for n in names))


def joined_distinct(df: DataFrame, keys: Sequence[str], value: str, separator: str, name: str) -> DataFrame:
    """Distinct values of a key in order, joined (AGG-06). Sets of a key are as large as its distinct values."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(value)), separator).alias(name))


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key (WIN-01, WIN-02): ``row_number`` = 1, which Spark turns into a group limit that drops
    most rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def compare_sources(observations: DataFrame, key: str, source: str, a, b) -> DataFrame:
    """Rows of two sources of one entity side by side, all columns with ``_a`` and ``_b`` (JON-01, DOM-03)."""
    others = [c for c in observations.columns if c not in (key, source)]
    left = observations.where(F.col(source) == a).select(key, *(F.col(c).alias(f"{c}_a") for c in others))
    right = observations.where(F.col(source) == b).select(key, *(F.col(c).alias(f"{c}_b") for c in others))
    return left.join(right, key)
