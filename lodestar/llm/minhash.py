"""Near duplicates by min-max hashing: each permutation gives a smallest and a largest value.

Half as many hash evaluations as plain MinHash fill a signature; bands mix minima and maxima of different
permutations. Documents with equal shingle sets are one class from the start; classes that share a band are candidates,
and a link holds only if the full shingle sets confirm it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, small_batches, staged, texts_of, tidy, unstage
from lodestar.llm.linking import DIFFERENCES, Compare, differences, link_buckets

#: Distinct words whose hashes a worker keeps.
KEPT_WORDS = 200_000
NAMES = [part.split()[0] for part in DIFFERENCES.split(", ")]
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class NearRules:
    """Two documents are linked if 100 * shared shingles >= ``percent`` * shingles of both."""

    words: int = 5  #: in a shingle
    percent: int = 80
    permutations: int = 60
    rows: int = 5  #: values in a band; 2 * permutations / rows bands

    #: What is near is linked.
    ordered = False

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.rows

    def need(self, n, m):
        return -(-self.percent * (n + m) // (100 + self.percent))

    def need_of(self, n: Column, m: Column) -> Column:
        return F.ceil(self.percent * (n + m) / (100 + self.percent)).cast("int")

    def least_of(self, n: Column) -> Column:
        return F.ceil(self.percent * n / 100).cast("int")

    def possible(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)


#: Chance to miss a link that is just similar enough: 7 in a million at 80 %, 1 in a million at 85 %.
PIPELINE_RULES = NearRules(words=5, percent=80, permutations=75)
QUERY_RULES = NearRules(words=3, percent=85, permutations=60)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * FACTORS[0]
    x = (x ^ (x >> np.uint64(29))) * FACTORS[1]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes. Words: lower case of A-Z, split at six blanks."""

    def __init__(self, words: int):
        self.words, self.kept = words, {}

    def _hash(self, word: bytes) -> int:
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        value = self.kept[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def set_of(self, text: str | None) -> np.ndarray:
        """Distinct shingles; of a text with fewer words, its words as one; empty without words."""
        found = (text or "").encode().lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        kept = self.kept
        words = np.array([kept.get(w) or self._hash(w) for w in found], np.uint64)
        size = min(self.words, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out = mixed(out * FACTORS[2] + words[k : len(words) - size + 1 + k])
        return np.unique(out)


def permutation_factors(permutations: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    factors = draw.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
    return factors.astype(kind), draw.integers(0, 1 << 63, permutations, np.uint64).astype(kind)


def band_keys(values: np.ndarray, starts: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """One row of band keys for each set: ``values`` (64 or 32 bits) holds the sets' elements, set after set, none empty."""
    factors, shifts = permutation_factors(permutations, values.dtype)
    half = values.dtype.type(values.dtype.itemsize * 4 - 1)
    signature = np.empty((2, permutations, len(starts)), values.dtype)
    for k in range(permutations):
        hashed = (values ^ shifts[k]) * factors[k]
        hashed ^= hashed >> half
        signature[0, k] = np.minimum.reduceat(hashed, starts)
        signature[1, k] = np.maximum.reduceat(hashed, starts)
    # Neighbouring rows of a band come from different permutations: first all minima, then all maxima.
    signature = signature.reshape(-1, rows, len(starts))
    keys = np.repeat(np.arange(len(signature), dtype=np.uint64)[:, None], len(starts), axis=1)
    for r in range(rows):
        keys = mixed(keys * FACTORS[2] + signature[:, r])
    return keys.T


def signatures(docs: DataFrame, rules: NearRules, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``print`` (64-bit hash of the text), ``n`` (shingles), ``set`` (128-bit hash of the set; null if empty), ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rules.words)
        for batch in pieces(batches):
            sets = [shingler.set_of(x) for x in texts_of(batch)]
            full = [i for i, s in enumerate(sets) if len(s)]
            names, bands = [None] * len(sets), [None] * len(sets)
            if full:
                some = [sets[i] for i in full]
                keys = band_keys(np.concatenate(some), np.cumsum([0, *map(len, some[:-1])]), rules.permutations, rules.rows)
                for i, row in zip(full, keys.view(np.int64)):
                    names[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "print", "n", "set", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, print long, n long, set binary, bands array<long>")


def comparer(texts: DataFrame, rules: NearRules) -> Compare:
    """Compares the full shingle sets of pairs of ``texts`` (``id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rules.words)
        for batch in batches:
            for pair in pieces(pieces([batch], "x"), "y"):
                keys = [pair.column(k).to_pylist() for k in range(2)]
                # Pairs come in order of their hubs: each set of a piece is made once.
                found = dict(zip((*keys[0], *keys[1]), (*pair.column(2).to_pylist(), *pair.column(3).to_pylist())))
                at = {key: i for i, key in enumerate(found)}
                sets = [shingler.set_of(x) for x in found.values()]
                offsets = np.cumsum([0, *map(len, sets)])
                hub, own = (np.array([at[x] for x in k], np.int64) for k in keys)
                values = np.concatenate([*sets, np.zeros(0, np.uint64)])
                linked, more = differences(values, offsets, hub, own, rules, lambda near: np.ones(len(near), bool), whole)
                made = pa.RecordBatch.from_arrays([*pair.columns[:2], pa.array(linked), *more], ["a", "b", "linked", *NAMES[: len(more)]])
                yield made if whole else made.filter(made.column(2))

    def compare(pairs: DataFrame, whole: bool) -> DataFrame:
        first = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
        second = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
        shape = f"a binary, b binary, linked boolean{', ' + DIFFERENCES if whole else ''}"
        return pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(tidy(lambda batches: run(batches, whole)), shape)

    return compare


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules(), id_col: str = "doc_id", text_col: str = "text", with_print: bool = False) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable over links, its own included) and ``kept``; if asked,
    ``print``, a 64-bit hash of the text that tells rows of one id apart.

    Documents without words, and null texts, have empty sets and link with nothing. Documents with equal sets are linked.
    Rows with equal ids are documents of their own, each with its text: links join texts, so the same id may come with
    several components. Rows with a null id take no part: a null component, kept. An empty table gives no rows; other
    columns are not carried.
    """
    small_batches(docs.sparkSession)  # pairs of documents come to Python with their texts
    found = staged(signatures(docs, rules, id_col, text_col))
    # Equal sets are one class, named by the set's hash; copies meet as partial aggregates.
    classes = staged(found.where("n > 0 and id is not null").groupBy("set").agg(F.min(F.struct("id", "print")).alias("least"), F.min("n").alias("n"), F.first("bands").alias("bands")))
    members = classes.select(F.col("set").alias("id"), F.col("n").cast("int").alias("n"), F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    candidates = staged(members.join(shared, "key").select("key", "id", "n").distinct())
    # One text for each class that has candidates: that of the smallest of its ids, told from others of the id by its hash.
    wanted = classes.join(candidates.select(F.col("id").alias("set")).distinct(), "set", "left_semi").select("set", "least.*")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    texts = staged(texts.join(wanted, ["id", "print"]).select(F.col("set").alias("id"), "text").dropDuplicates(["id"]))
    labels = link_buckets(candidates, comparer(texts, rules), rules).withColumnRenamed("id", "set")
    for table in (candidates, texts):
        unstage(table)
    named = classes.select("set", "least.id").withColumnRenamed("id", "least").join(labels, "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("set", "component_id")
    has_id = F.col("id").isNotNull()
    return found.join(named, "set", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(has_id, F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
        *(["print"] if with_print else []),
    )
