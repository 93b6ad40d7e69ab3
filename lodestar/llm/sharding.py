"""Sharding by bytes: global prefix sums of sizes, cut at equal targets.

DataFrame functions only. Rows are ranged by id, each range adds up its own sizes and counts, the running sums of
those few totals give every range its offset, and a running sum inside each range completes the global prefix sum.
The driver sees nothing; the only broadcasts are one row per range and one row per shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import staged, text_bytes


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contiguous shards (in id order) of near-equal bytes.

    Returns id, ``size`` (UTF-8 bytes of the text, plus 1), ``text_crc32``, ``shard`` (0 to ``n_shards - 1``) and
    ``slot`` (0, 1, ... within the shard). A row belongs to the shard in which the middle of its byte range lies, so
    each shard's bytes differ from the target by less than one row at either end. Null texts count as empty; null ids
    come first; rows with equal ids stay in order of size and checksum; an empty table gives no rows; other columns
    are not carried.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        (text_bytes(F.col(text_col)) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # The ranges are written down: their borders come from a sample and must be the same in both uses below.
    ranged = staged(rows.repartitionByRange(F.col("id"), F.col("text_crc32")).withColumn("range", F.spark_partition_id()))

    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("range")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "range",
            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("total"),
        )
    )
    inside = Window.partitionBy("range").orderBy(F.asc_nulls_first("id"), "text_crc32", "size")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select(
        "*", F.sum("size").over(running).alias("bytes_to_here"), F.row_number().over(inside).alias("row_in_range")
    ).join(F.broadcast(offsets), "range")  # one row per range, as many as shuffle partitions
    middle = "2 * (bytes_before + bytes_to_here) - size"  # doubled
    placed = summed.select(
        "id",
        "size",
        "text_crc32",
        F.expr(f"cast(least({n_shards - 1}, (({middle}) * {n_shards}) div (2 * total)) as int)").alias("shard"),
        (F.col("rows_before") + F.col("row_in_range") - 1).alias("row"),
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )
