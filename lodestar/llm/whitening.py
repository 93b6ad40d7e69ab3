"""Whitening by hierarchical merging of singular value decompositions.

Each partition of the distinct vectors keeps its number, exact sums, and all singular values and right singular vectors of
its centred rows. Two such summaries merge without loss: their scaled vectors are stacked, a row for the difference of
the means is added, and the stack, a few times as many rows as dimensions, is decomposed again. Summaries merge in
groups, level by level, until one is left; the eigenvectors of the covariance are its right singular vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import staged, tidy, tidy_group, unstage
from lodestar.llm.vectors import dimensions, matrix, padded

#: Numbers of a block that is decomposed at once, and summaries that one task merges.
BLOCK, FAN_IN = 1 << 19, 16
SHAPE = "slot long, n long, sums array<long>, singular array<double>, vectors binary"


@dataclass
class Summary:
    """Of ``n`` vectors: exact sums, singular values of the centred rows, and right singular vectors (one a row)."""

    n: int
    sums: list[int]
    singular: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, block: np.ndarray) -> Summary:
        """From rows of whole numbers. They are centred on whole numbers first, so that large means cost no digits."""
        pivot = block[0]
        near = (block - pivot).astype(np.float64)
        _, singular, vectors = np.linalg.svd(near - near.mean(axis=0), full_matrices=False)
        sums = [int(s) + int(p) * len(block) for s, p in zip((block - pivot).sum(axis=0), pivot, strict=True)]
        return cls(len(block), sums, singular, vectors)

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = [(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)]
        rows = [self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, np.sqrt(self.n * other.n / n) * np.array([apart])]
        _, singular, vectors = np.linalg.svd(np.concatenate(rows), full_matrices=False)
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], singular, vectors)

    def row(self, slot: int) -> pa.RecordBatch:
        values = [[slot], [self.n], [self.sums], [self.singular.tolist()], [self.vectors.tobytes()]]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["slot", "n", "sums", "singular", "vectors"])

    @classmethod
    def read(cls, row) -> Summary:
        singular = np.array(row["singular"])
        return cls(row["n"], list(row["sums"]), singular, np.frombuffer(row["vectors"]).reshape(len(singular), -1))


def merged_all(summaries: list[Summary]) -> Summary:
    """Neighbours first, so that few merges lie between a row and the result."""
    while len(summaries) > 1:
        pairs = zip(summaries[::2], summaries[1::2], strict=False)
        summaries = [a.merged(b) for a, b in pairs] + summaries[len(summaries) // 2 * 2 :]
    return summaries[0]


@dataclass
class Whitening:
    """Exact sums of the fit list, and the leading eigenvalues and unit eigenvectors (one a row) of its covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @classmethod
    def of(cls, summary: Summary | None, components: int) -> Whitening:
        """Directions in which the vectors don't vary, to double precision, are no components."""
        if summary is None:
            return cls(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
        s = summary.singular
        rank = int((s > s.max(initial=0) * 8 * len(summary.sums) * np.finfo(float).eps).sum())
        kept = min(components, rank)
        vectors = summary.vectors[:kept]
        signs = np.sign(vectors[np.arange(kept), np.abs(vectors).argmax(axis=1)]) if kept else np.ones(0)
        return cls(summary.n, summary.sums, s[:kept] ** 2 / summary.n, vectors * signs[:, None], float((s**2).sum() / summary.n))

    def _near(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows less the whole part of the mean, and what of ``n`` times the mean that leaves."""
        pivot = np.array([s // self.n for s in self.sums], np.int64)
        return block - pivot, np.array([s % self.n for s in self.sums], np.int64)

    def project(self, block: np.ndarray) -> np.ndarray:
        near, rest = self._near(block)
        return ((near - rest / self.n) @ self.vectors.T) / np.sqrt(self.values)

    def deviations(self, block: np.ndarray) -> list[int | None]:
        """The exact sum of the squares of ``n * x - sums``; null where it needs more than 64 bits."""
        near, rest = self._near(block)
        if float(np.abs(near).max(initial=0) + 1) ** 2 * float(self.n) ** 2 * max(1, block.shape[1]) < 2.0**62:
            return (((near * self.n - rest) ** 2).sum(axis=1)).tolist()
        exact = [sum((int(x) * self.n - int(r)) ** 2 for x, r in zip(row, rest, strict=True)) for row in near]
        return [e if e < 1 << 63 else None for e in exact]


def blocks(batches: Iterator[pa.RecordBatch], dims: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, BLOCK // max(1, dims))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, matrix(part.column(column), dims)


def fit(distinct: DataFrame, dims: int, components: int = 16) -> Whitening:
    """The whitening of a table of vectors (its only column, ``array<bigint>`` of ``dims`` entries)."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Summary] = []
        for _, block in blocks(batches, dims):
            held.append(Summary.of(block))
            if len(held) == FAN_IN:
                held = [merged_all(held)]
        if held:
            yield merged_all(held).row(TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["slot"])
        return pa.Table.from_batches([merged_all([Summary.read(r) for r in rows]).row(rows[0]["slot"] // FAN_IN)])

    summaries, width = distinct.mapInArrow(tidy(summarize), SHAPE), distinct.rdd.getNumPartitions()
    while width > 1:
        summaries = summaries.groupBy((F.col("slot") / FAN_IN).cast("long").alias("group")).applyInArrow(tidy_group(merge), SHAPE)
        width = -(-width // FAN_IN)
    last = summaries.collect()  # one row
    return Whitening.of(Summary.read(last[0]) if last else None, components)


def identity_error(distinct: DataFrame, dims: int, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance less the identity, measured on its rows."""
    k = len(model.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for _, block in blocks(batches, dims):
            w = model.project(block)
            total += np.column_stack([w.T @ w, w.sum(axis=0)])
        i, j = np.divmod(np.arange(total.size), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "total"])

    if not k:
        return 0.0
    found = distinct.mapInArrow(tidy(products), "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k, k + 1))
    for r in found:  # k * (k + 1)
        total[r["i"], r["j"]] = r["total"] / model.n
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, vector_col: str, components: int = 16, carry: tuple[str, ...] = (), fill: int = 0) -> DataFrame:
    """Whitened coordinates of each row: ``carry`` columns, ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``.

    ``vector_col`` is an ``array<bigint>`` without nulls. The fit list is each distinct vector once. ``deviation`` is the
    exact sum of the squares of ``n * x - S``, null where it needs more than 64 bits. A shorter vector counts as filled up
    with ``fill``. Each row, repeated or not, gets its rows of components; directions without variance are no
    components, so fewer than two distinct vectors, like an empty table, give no rows. Signs are such that the largest
    entry of a component is positive. The model, its dimensions by ``components`` numbers, is sent to the tasks.
    """
    dims = dimensions(vectors, vector_col)
    rows = vectors.select(padded(F.col(vector_col), dims, fill).alias("__x"), *carry)
    distinct = staged(rows.select("__x").distinct())
    model = fit(distinct, dims, components)
    error = identity_error(distinct, dims, model)
    unstage(distinct)
    k = len(model.values)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, dims):
            each = np.repeat(np.arange(len(block)), k)
            names = [c.take(pa.array(each)) for c in part.columns[1:]]
            columns = [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(block))), pa.array(np.full(len(each), model.n, np.int64)),
                pa.array(model.deviations(block), pa.int64()).take(pa.array(each)), pa.array(model.project(block).ravel()),
                pa.array(np.tile(explained, len(block))), pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays([*names, *columns], [*carry, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kinds = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in carry)
    shape = f"{kinds}component int, n long, deviation long, whitened double, explained double, identity_error double"
    return (rows if k else rows.where("false")).mapInArrow(tidy(run), shape)
