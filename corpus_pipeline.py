"""The corpus pipeline: raw documents to packed sequences, by way of five operators.

Language identification, fuzzy line deduplication, near duplicates, repeated passages, packing. Every stage works on all
that the one before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, lines, minhash, packing, suffix_dedup
from lodestar.llm.common import small_batches, staged, unstage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents whose language is less certain are rejected.
LEAST_SCORE = 0.4
#: A word character in the sense of the operators: anything but the six blanks.
WORD = r"[^\x20\x09-\x0D]"
#: As Unicode and ``langid`` have it.
LETTER = r"\p{L}"


def plain(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with names for its other columns that clash with nobody's, and what gives a result its columns again."""
    other = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    return docs.withColumnsRenamed(other), lambda df: df.select(*(F.col(other.get(c, c)).alias(c) for c in docs.columns))


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents; those without a letter or with an uncertain language go.

    Where no document is labelled no language is uncertain, and all with a letter stay.
    """
    small_batches(spark)
    net = langid.train_on(docs)
    if not net.languages:
        return docs.where(F.col("text").rlike(LETTER))
    rows, restored = plain(docs)
    named = langid.identify(rows, net, carry=tuple(rows.columns))
    return restored(named.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which no other line has a word. ``n_chars`` follows the text."""
    small_batches(spark)
    rows, restored = plain(docs)
    left = lines.without_lines(rows, lines.repeated_lines(rows))
    return counted(restored(left.where((F.col("lines_removed") == 0) | F.col("text").rlike(WORD))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays; of rows that are equal in id and
    text one. Rows without an id stay."""
    small_batches(spark)
    found = minhash.near_duplicates(docs, minhash.PIPELINE_RULES, with_print=True).where("kept")
    kept = staged(found.groupBy(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).count())
    # A row is told by its id and its text: rows of one id may have several.
    own = docs["doc_id"].eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__print"))
    left = docs.join(kept, own, "left_semi").select(*docs.columns)
    often = kept.where("count > 1 and __id is not null").select("__id").distinct()
    if often.limit(1).count():
        repeated = docs["doc_id"] == F.col("__id")
        once = left.join(often, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(often, repeated, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
    return left


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; so do documents of which no word is left."""
    small_batches(spark)
    rows, restored = plain(docs)
    cut = suffix_dedup.dedup_substrings(rows, carry=tuple(c for c in rows.columns if c not in ("doc_id", "text")), decoded=True)
    cut = cut.withColumnRenamed("kept", "text")
    return counted(restored(cut.where((F.size("removed") == 0) | F.col("text").rlike(WORD))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("pack", pack),
]

#: SQL can express none of the stages but the fourth; the tests hold them against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        if i:
            unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
