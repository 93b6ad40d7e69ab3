"""queues, merges and audits (FLT-07 to FLT-12, SNK-01 to SNK-08, SNK-20, SNK-21, SET-05, SET-09, SET-10, DOM-14).

Without a table format that merges, an upsert is a join of the base and the new rows; ``sources.storage`` writes the
result beside the base and swaps a pointer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.session import shared_path


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """New rows replace the listed columns (by default all) of rows with their keys; others are added (SNK-01, SNK-02)."""
    if columns is None:
        return base.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
    fresh = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__new"))
    joined = base.withColumn("__old", F.lit(True)).join(fresh, list(keys), "full")
    pick = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
    return joined.select(*(pick(c) for c in base.columns))


def insert_absent(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with new keys are added, others left as they are (SNK-03)."""
    return base.unionByName(new.join(base.select(*keys), list(keys), "left_anti"))


def fill_missing(base: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], prefer_new: bool = False) -> DataFrame:
    """Missing values are filled from the new rows (SNK-04); with ``prefer_new`` new values win where present (SNK-05)."""
    joined = base.join(new.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns)), list(keys), "left")
    both = lambda c: F.coalesce(f"__{c}", c) if prefer_new else F.coalesce(c, f"__{c}")
    return joined.select(*(both(c).alias(c) if c in columns else F.col(c) for c in base.columns))


def replace_source(base: DataFrame, new: DataFrame, source_col: str, source) -> DataFrame:
    """All rows of one source are replaced: a derivation that can run again (SNK-06)."""
    return base.where(~F.col(source_col).eqNullSafe(F.lit(source))).unionByName(new)


def merge_states(base: DataFrame, new: DataFrame, key: str, state: str, protected: Sequence[str], weakest: str) -> DataFrame:
    """States of the new rows, except that a protected state isn't overwritten by the weakest one (SNK-07)."""
    fresh = new.select(key, *(F.col(c).alias(f"__{c}") for c in new.columns if c != key), F.lit(True).alias("__new"))
    joined = base.join(fresh, key, "full")
    held = F.col(state).isin(*protected) & (F.col(f"__{state}") == weakest)
    out = []
    for c in base.columns:
        if c == key or f"__{c}" not in joined.columns:
            out.append(F.col(c))
        elif c == state:
            out.append(F.when(F.col("__new") & ~F.coalesce(held, F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("__new"), F.coalesce(f"__{c}", c)).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def reset_if_changed(base: DataFrame, new: DataFrame, key: str, signature: Sequence[str], status: str, pending: str) -> DataFrame:
    """New signatures; the status starts again only where the signature differs (SNK-08, FLT-07)."""
    fresh = new.select(key, *(F.col(c).alias(f"__{c}") for c in signature), F.lit(True).alias("__new"))
    joined = base.join(fresh, key, "full")
    changed = F.lit(False)
    for c in signature:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    again = F.col("__new") & changed
    update = {c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in signature} | {status: F.when(again, F.lit(pending)).otherwise(F.col(status))}
    return joined.select(*(update[c].alias(c) if c in update else F.col(c) for c in base.columns))


def change_set(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key``, ``field``, ``before``, ``after`` of what differs, nulls told apart (SET-10, SNK-16)."""
    pair = old.select(key, *(F.col(c).cast("string").alias(f"__o_{c}") for c in columns)).join(
        new.select(key, *(F.col(c).cast("string").alias(f"__n_{c}") for c in columns)), key
    )
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"__o_{c}").alias("before"), F.col(f"__n_{c}").alias("after")) for c in columns))
    return pair.select(key, F.inline(rows)).where(~F.col("before").eqNullSafe(F.col("after")))


def keep_success(old: DataFrame, new: DataFrame, key: str, status: str, success: str) -> DataFrame:
    """Two runs merged: a success isn't lost to a later failure (SET-09)."""
    joined = old.select(key, F.col(status).alias("__o")).join(new.select(key, F.col(status).alias("__n")), key, "full")
    return joined.select(key, F.when(F.col("__o") == success, F.col("__o")).otherwise(F.coalesce("__n", "__o")).alias(status))


def due(df: DataFrame, status: str, terminal: Sequence[str], attempts: str, most: int, next_at: str, now: Column) -> DataFrame:
    """Rows to try again: not finished, not tried too often, and their time has come (FLT-08, FLT-09)."""
    open_ = ~F.coalesce(F.col(status), F.lit("")).isin(*terminal)
    return df.where(open_ & (F.coalesce(attempts, F.lit(0)) < most) & (F.col(next_at).isNull() | (F.col(next_at) <= now)))


def release_stale(status: Column, running: str, pending: str, updated: Column, now: Column, hours: float) -> Column:
    """A run that nobody has updated for so long is pending again (FLT-12)."""
    stale = (status == running) & (updated < now - F.expr(f"INTERVAL '{int(hours * 3600)}' SECOND"))
    return F.when(stale, pending).otherwise(status)


def acquisition_state(path: Column, verified: Column, there: Column, any_: Column, missing: Column) -> Column:
    """Struct of local state, acquisition state and reason by what is known of an entity (DOM-14)."""
    state = lambda a, b, c: F.struct(F.lit(a).alias("local"), F.lit(b).alias("acquisition"), F.lit(c).alias("reason"))
    return (
        F.when(path.isNotNull() & verified, state("verified", "complete", "verified_local"))
        .when(path.isNotNull(), state("present_unverified", "verify_local", "local_index"))
        .when(there, state("collection_present", "locate_existing", "collection_path"))
        .when(any_ & ~missing, state("claimed_local", "locate_existing", "not_in_missing_list"))
        .when(missing, state("missing", "needs_source", "missing_list"))
        .otherwise(state("missing", "needs_source", "catalogue_only"))
    )


def liveness(known: Column, owned: Column, age: Column, idle: Column, status_idle: Column, hard: float = 240, grace: float = 45, quiet: float = 25, unmanaged: float = 15) -> Column:
    """Whether a worker lives: ``kill`` or ``working`` by age, owner and progress, in minutes (STR-07)."""
    return (
        F.when(~known, "kill")
        .when(age > hard, "kill")
        .when(~owned & (age > unmanaged), "kill")
        .when(status_idle <= quiet, "working")
        .when(age <= grace, "working")
        .when(F.least(idle, age) > quiet, "kill")
        .otherwise("working")
    )


def edit_cells(df: DataFrame, key: str, ids: Sequence, column: str, value: Column, allowed: Sequence[str]) -> DataFrame:
    """One column of some rows set (SNK-21); a column that isn't listed is refused."""
    if column not in allowed:
        raise ValueError(f"{column!r} can't be edited")
    return df.withColumn(column, F.when(F.col(key).isin(*ids), value).otherwise(F.col(column)))


def find_replace(df: DataFrame, column: str, find: str, replacement: str, allowed: Sequence[str]) -> DataFrame:
    """Text replaced in one column, and ``changed`` (SNK-21)."""
    if column not in allowed:
        raise ValueError(f"{column!r} can't be edited")
    after = F.replace(F.col(column), F.lit(find), F.lit(replacement))
    return df.withColumn("changed", ~after.eqNullSafe(F.col(column))).withColumn(column, after)


def swap_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(*(F.col({a: b, b: a}.get(c, c)).alias(c) for c in df.columns))


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of a unique key, without a window over all rows.

    Spark cuts the keys into ranges of about equally many rows, whatever their values. The ranges are written down, as
    their borders come from a sample and are used twice: their counts (a row for each shuffle partition) are summed up,
    and each range numbers its own rows.
    """
    from pyspark.sql import Window

    path = shared_path(df.sparkSession, "ranges")
    df.repartitionByRange(key).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    spread = df.sparkSession.read.parquet(path)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("__range").agg(F.count("*").alias("__n"))
    counts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return spread.join(F.broadcast(counts), "__range").select(*df.columns, (F.col("__before") + inside - 1).alias(name))
