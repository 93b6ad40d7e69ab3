"""Ordered sequences: gaps, local maxima, tiling, even spacing, budgets, top rows (WIN-05 to WIN-18)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import shared_path


def gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column) -> DataFrame:
    """``gap``: difference to the row before; null on the first (WIN-10)."""
    return df.withColumn("gap", at - F.lag(at).over(Window.partitionBy(*keys).orderBy(*order)))


def local_maxima(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, radius: int) -> DataFrame:
    """``around``: largest value within ``radius`` rows, and ``is_peak`` (WIN-11)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius)
    return df.withColumn("around", F.max(value).over(w)).withColumn("is_peak", F.col(value) == F.col("around"))


def onset(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """``onset``: rise of log(1 + value) since the row before, 0 if none (WIN-12)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("onset", F.coalesce(F.greatest(F.lit(0.0), F.log1p(value) - F.log1p(F.lag(value).over(w))), F.lit(0.0)))


def tile_starts(length: Column, size: int, hop: int) -> Column:
    """Starts of windows of ``size``, every ``hop``; one more is flush with the end if the last leaves a rest (WIN-13)."""
    last = F.greatest(length - size, F.lit(0))
    starts = F.sequence(F.lit(0), (F.floor(last / hop) * hop).cast("int"), F.lit(hop))
    return F.array_distinct(F.concat(starts, F.array(last.cast("int"))))


def evenly_spaced(count: Column, picks: Column | int) -> Column:
    """Places (from 0) of so many evenly spaced rows out of ``count``, both ends among them (WIN-14). Halves round to
    even."""
    picks = F.lit(picks) if isinstance(picks, int) else picks
    step = F.try_divide((count - 1).cast("double"), picks - 1)
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(0), picks - 1), lambda i: F.bround(i * step).cast("int")))
    every = F.sequence(F.lit(0), (count - 1).cast("int"))
    return F.when(count <= picks, every).when(picks == 1, F.array(F.lit(0))).otherwise(spaced)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, with their place ``rank`` (WIN-05, WIN-16, SRT-07)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def accept_by_margin(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[Column], least: float, margin: float, sure: float) -> DataFrame:
    """The best row of each key if its score suffices and beats the second by ``margin``, or is ``sure`` (WIN-18)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *order)
    ranked = df.withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    good = (F.col(score) >= least) & ((F.col(score) - F.col("second") >= margin) | (F.col(score) >= sure))
    return ranked.where(F.col("rank") == 1).withColumn("accepted", good).drop("rank")


def capped(df: DataFrame, unique: Sequence[str], caps: dict[str, int], order: Sequence[Column], limit: int) -> DataFrame:
    """First row of each value of the ``unique`` columns, then at most so many rows of each capped column's value, then
    the first ``limit`` (WIN-06, WIN-08 as ranks: each cap on what the one before left)."""
    for c in unique:
        # Nulls are no value and are split off, so that the ranks of the others end early (window group limit).
        first = F.row_number().over(Window.partitionBy(c).orderBy(*order))
        named = df.where(F.col(c).isNotNull()).withColumn("__n", first).where("__n = 1")
        df = named.unionByName(df.where(F.col(c).isNull()).withColumn("__n", F.lit(1)))
    for c, cap in caps.items():
        df = df.withColumn("__n", F.row_number().over(Window.partitionBy(c).orderBy(*order))).where(F.col("__n") <= cap)
    return df.drop("__n").orderBy(*order).limit(limit)


def running_choice(rows: Sequence[tuple], caps: Sequence[int], per_combo: int, limit: int) -> tuple[list, bool]:
    """Keys chosen in turn from ordered rows (key, primary, combo, title, code, exempt), and whether the first pass has
    reached the limit. One pass for each cap; what a pass leaves the next one tries again."""
    chosen, taken, codes, recordings = [], set(), set(), set()
    of_primary, of_combo = Counter(), Counter()
    for n, cap in enumerate(caps):
        for key, primary, combo, title, code, exempt in rows:
            blocked = key in taken or (code is not None and code in codes) or (combo, title) in recordings
            if blocked or of_primary[primary] >= cap or (of_combo[combo] >= per_combo and not exempt):
                continue
            chosen.append(key)
            taken.add(key)
            codes.add(code)
            recordings.add((combo, title))
            of_primary[primary] += 1
            of_combo[combo] += 1
            if len(chosen) == limit:
                return chosen, n == 0
    return chosen, False


def choosable(rows: DataFrame, most: int, per_combo: int) -> DataFrame:
    """Rows (key, primary, combo, title, code, exempt, order) without those that a running choice can never take.

    A row is sure if no other row of another recording has its code: only its recording, its combo or its primary can block
    it, and those block every later row of the same one too. So these go: rows behind a sure row of their own recording;
    behind ``per_combo`` sure recordings of their combo and primary; behind ``most`` sure rows of their primary; and of those of a combo
    that share a code all but the first ``per_combo``."""
    name = ["primary", "combo", "title"]
    first = rows.groupBy(*name, "code", "exempt").agg(F.min(F.struct("order", "key")).alias("f")).select(*name, "code", "exempt", "f.order", "f.key")
    shared = first.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code", F.lit(True).alias("shared"))
    marked = first.join(shared, "code", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    sure = marked.where("not shared and not exempt").groupBy(*name).agg(F.min("order").alias("sure_order"))
    ranked = sure.withColumn("n", F.row_number().over(Window.partitionBy("primary", "combo").orderBy("sure_order"))).where(F.col("n") <= per_combo)
    last_of_combo = ranked.where(F.col("n") == per_combo).select("primary", "combo", F.col("sure_order").alias("combo_order"))
    # Only combos of one primary block nothing but that one's rows.
    single = first.groupBy("combo").agg(F.min("primary").alias("a"), F.max("primary").alias("b")).where("a = b").select("combo")
    of_primary = ranked.join(single, "combo", "left_semi")
    of_primary = of_primary.withColumn("n", F.row_number().over(Window.partitionBy("primary").orderBy("sure_order", "combo"))).where(F.col("n") <= most)
    last_of_primary = of_primary.where(F.col("n") == most).select("primary", F.col("sure_order").alias("primary_order"))
    limited = marked.join(sure, name, "left").join(last_of_combo, ["primary", "combo"], "left").join(last_of_primary, "primary", "left")
    for limit in ("sure_order", "combo_order", "primary_order"):
        limited = limited.where(F.col("exempt") | F.col(limit).isNull() | (F.col("order") <= F.col(limit)))
    limited = limited.select(*first.columns, "shared")
    some = limited.where("shared and not exempt")
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("primary", "combo", "code").orderBy("order"))).where(F.col("n") <= per_combo)
    return limited.where("not shared or exempt").select(*first.columns).unionByName(some.select(*first.columns))


def running_greedy(
    df: DataFrame, key: str, order: Column, primary: Column, combo: Column, title: Column, code: Column, exempt: Column, limit: int,
    caps: Sequence[int] = (3, 5, 8), per_combo: int = 2,
) -> DataFrame:
    """The running greedy choice of ``limit`` rows, with their ``place`` from 1 (WIN-06).

    Rows are tried in ``order`` (smallest first, ties by the unique ``key``), once for each cap. A row is left out if its code was
    taken, or its title and combo; if its primary has ``cap`` rows; or if its combo has ``per_combo`` and the row isn't
    exempt. Null or empty codes block nothing; other nulls are values. The result equals that of a loop over all rows: what
    can never be chosen goes first, by aggregates and short windows; then the loop runs over the first rows of what is left,
    twice as many whenever they don't suffice. Each primary keeps few rows, so they suffice at a small multiple of the limit."""
    spark = df.sparkSession
    text = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    rows = df.select(
        F.col(key).alias("key"), text(primary).alias("primary"), text(combo).alias("combo"), text(title).alias("title"),
        F.nullif(code.cast("string"), F.lit("")).alias("code"), F.coalesce(exempt, F.lit(False)).alias("exempt"), F.struct(order, F.col(key)).alias("order"),
    )
    path = shared_path(spark, "choice")
    choosable(rows, max(caps), per_combo).write.parquet(path)
    candidates, at_once = spark.read.parquet(path), max(1000, 4 * limit)
    while True:
        tried = candidates.orderBy("order").limit(at_once).select("key", "primary", "combo", "title", "code", "exempt").collect()
        chosen, enough = running_choice(list(map(tuple, tried)), caps, per_combo, limit)
        if enough or len(tried) < at_once:
            break
        at_once *= 2
    kind = df.schema[key].dataType.simpleString()
    places = spark.createDataFrame([(k, i) for i, k in enumerate(chosen, 1)], f"`{key}` {kind}, place int")
    return df.join(F.broadcast(places), key)  # ``limit`` rows at most


def round_robin(df: DataFrame, bucket: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Rows of the buckets in turn, smaller buckets first, up to ``limit`` (WIN-07, DOM-16)."""
    sizes = df.groupBy(bucket).agg(F.count("*").alias("bucket_size"))
    # No more than ``limit`` rows of a bucket can be taken.
    ranked = top_per_key(df, [bucket], order, limit).withColumnRenamed("rank", "turn")
    return ranked.join(sizes, bucket).orderBy("turn", "bucket_size", bucket).limit(limit)


def chunks(place: Column, size: int) -> Column:
    """Number (from 1) of the part that a row (place from 1) falls into (SRT-11, SNK-15)."""
    return F.ceil(place / size).cast("long")
