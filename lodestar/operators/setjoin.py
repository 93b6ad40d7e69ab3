"""Set-similarity joins by prefix filter (JON-11, JON-12).

Two sets whose overlap (shared words over the smaller number of words) reaches a threshold share, of the smaller one's words
in order of rarity, one of the first few: so those alone are looked up among the words of the larger one. Equal sets of a
side are one row, so that copies don't multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_sets(df: DataFrame, id_col: str, block: Column, words: Column) -> DataFrame:
    """One row for each block and set: ``block``, ``words`` (sorted hashes), ``first`` (smallest id), ``copies``, and ``name``: a
    hash that tells sets of one id apart."""
    hashed = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))
    sets = df.select(F.col(id_col).alias("id"), block.alias("block"), hashed.alias("words")).where("block is not null and size(words) > 0")
    grouped = sets.groupBy("block", "words").agg(F.min("id").alias("first"), F.countDistinct("id").alias("copies"))
    return grouped.withColumn("name", F.xxhash64("block", "words"))


def rarest_first(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """``words`` in order of rarity within the block."""
    each = sets.select("block", "first", "copies", "name", F.explode("words").alias("w")).join(counts, ["block", "w"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"])
    return each.groupBy("block", "first", "copies", "name").agg(ordered.alias("words"))


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of sets (of ``distinct_sets``) with equal blocks whose overlap is ``least`` at least: ``block``, ``left`` and ``right``
    (the smallest ids), ``name`` of the left one, ``copies`` of the right one, ``score``.

    A pair meets once for each word of the prefix that both have, and stays where that is the first such word."""
    both = left.select("block", "words").unionByName(right.select("block", "words"))
    counts = both.select("block", F.explode("words").alias("w")).groupBy("block", "w").agg(F.count("*").alias("n"))
    sides = [rarest_first(side, counts).withColumn("size", F.size("words")) for side in (left, right)]

    def looked_up(small: DataFrame, large: DataFrame, smaller: Column) -> DataFrame:
        # Fewer than ``need`` words are shared if none of the first ``size - need + 1`` is.
        need = F.greatest(F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9)), F.lit(1)).cast("int")
        prefix = F.slice("words", F.lit(1), F.col("size") - need + 1)
        mine = small.select("block", F.col("first").alias("a"), F.col("name").alias("a_name"), F.col("copies").alias("a_copies"), F.col("words").alias("x"), F.col("size").alias("m"), prefix.alias("prefix"), F.explode(prefix).alias("w"))
        theirs = large.select("block", F.col("first").alias("b"), F.col("name").alias("b_name"), F.col("copies").alias("b_copies"), F.col("words").alias("y"), F.col("size").alias("k"), F.explode("words").alias("w"))
        met = mine.join(theirs, ["block", "w"]).where(smaller & (F.array_intersect("prefix", "y")[0] == F.col("w")))
        return met.withColumn("score", F.size(F.array_intersect("x", "y")) / F.col("m")).where(F.col("score") >= least - 1e-9)

    one = looked_up(*sides, F.col("m") <= F.col("k")).select("block", F.col("a").alias("left"), F.col("a_name").alias("name"), F.col("b").alias("right"), F.col("b_copies").alias("copies"), "score")
    other = looked_up(*sides[::-1], F.col("m") < F.col("k")).select("block", F.col("b").alias("left"), F.col("b_name").alias("name"), F.col("a").alias("right"), F.col("a_copies").alias("copies"), "score")
    return one.unionByName(other)


def matched_sets(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: tuple[Column, Column], words: tuple[Column, Column], least: float = 0.82,
    margin: float = 0.08, sure: float = 0.95,
) -> DataFrame:
    """``left_id``, ``right_id``, ``score`` of each left row whose best right row of its block is accepted: the score reaches
    ``least`` and beats the second by ``margin``, or is ``sure`` (WIN-18). Ties go to the smaller id.

    Only pairs within ``margin`` of ``least`` matter, so that is the threshold of the join. Null blocks and texts without a word
    match nothing."""
    lefts, rights = distinct_sets(left, left_id, block[0], words[0]), distinct_sets(right, right_id, block[1], words[1])
    pairs = similar_sets(lefts, rights, least - margin)
    w = Window.partitionBy("left", "name").orderBy(F.desc("score"), "right")
    second = F.when(F.col("copies") > 1, F.col("score")).otherwise(F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    best = pairs.withColumn("n", F.row_number().over(w)).withColumn("second", second).where("n = 1")
    good = best.where((F.col("score") >= least) & ((F.col("score") - F.col("second") >= margin) | (F.col("score") >= sure)))
    # Back from the distinct sets to the rows that have them.
    hashed = F.array_sort(F.array_distinct(F.transform(words[0], lambda x: F.xxhash64(x))))
    named = left.select(F.col(left_id), block[0].alias("block"), hashed.alias("words"))
    of = lefts.select("block", "words", "name", F.col("first").alias("left")).join(good.select("left", "name", "right", "score"), ["left", "name"])
    return named.join(of, ["block", "words"]).select(left_id, F.col("right").alias(right_id), "score")
