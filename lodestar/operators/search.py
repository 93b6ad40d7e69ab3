"""Search: word filters, paging, ranked full text (FLT-01, FLT-02, FLT-06, SRT-02, JON-26, PRJ-01)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_contains(columns: Sequence[str], needle: str) -> Column:
    """Whether any column holds the text, in any case (FLT-01)."""
    pattern = "%" + needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns))


def every_word(columns: Sequence[str], query: str) -> Column:
    """Whether each word of the query is in one of the columns (FLT-02)."""
    return reduce(lambda a, b: a & b, (any_contains(columns, w) for w in query.split()), F.lit(True))


def page(df: DataFrame, catalogue: dict[str, Column], sort: str, default_sort: str, id_col: str, offset: int, limit: int) -> DataFrame:
    """One page of named expressions in the order of a listed column; an unknown one falls back (SRT-02, PRJ-01).

    The sort column and id decide the page; the other expressions are computed for its rows alone, by a join.
    """
    by = catalogue.get(sort, catalogue[default_sort])
    ids = df.select(F.col(id_col), by.alias("__by")).orderBy(F.asc_nulls_first("__by"), id_col).offset(offset).limit(limit).select(id_col)
    return df.join(ids, id_col, "left_semi").select(*(c.alias(n) for n, c in catalogue.items()))


def bm25(docs: DataFrame, id_col: str, text_col: str, words: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 of documents that hold any of the words (FLT-06, JON-26): ``id_col``, ``score``.

    Words are runs of a-z and digits. One aggregate gives what is known of the corpus: documents, their mean length, and
    how many hold each word; a second pass folds only texts that contain one of them. Null texts count for nothing.
    """
    lower, whole = F.lower(text_col), "(?<![a-z0-9]){}(?![a-z0-9])"
    holds = [F.contains(lower, F.lit(w)) for w in words]
    times = [F.when(h, F.regexp_count(lower, F.lit(whole.format(w)))).otherwise(0) for h, w in zip(holds, words)]
    length = F.greatest(F.lit(1), F.regexp_count(lower, F.lit("[a-z0-9]+")))
    known = docs.where(F.col(text_col).isNotNull())
    corpus = known.agg(F.count("*").alias("n"), F.avg(length).alias("mean_len"), *(F.count_if(t > 0).alias(f"df{i}") for i, t in enumerate(times)))
    found = known.where(reduce(lambda x, y: x | y, holds)).select(id_col, length.alias("len"), *(t.alias(f"tf{i}") for i, t in enumerate(times)))
    joined = found.crossJoin(F.broadcast(corpus))  # one row

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        rarity = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        return rarity * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))

    hits = reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(words))))
    return joined.where(hits).select(id_col, reduce(lambda x, y: x + y, map(part, range(len(words)))).alias("score"))
