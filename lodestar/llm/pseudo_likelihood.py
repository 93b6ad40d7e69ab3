"""Masked pseudo-likelihood of documents: every byte predicted from the bytes on both of its sides.

The corpus gives the counts of all windows (a byte and its neighbours). A small network learns from them to name the
middle byte: replicas train on shares of the counted windows, drawn by count, and their weights are averaged after
each round. A document's score is the sum of its bytes' conditional log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, staged, texts_of

RADIUS = 2  #: bytes on either side
SIDES = [k for k in range(2 * RADIUS + 1) if k != RADIUS]
#: Distinct windows that a task counts, or a worker remembers, before it starts anew.
KEPT_WINDOWS = 3_000_000
#: Distinct windows of a replica of the network, fewest and most replicas: the driver averages as many times the weights.
#: Beyond the most, replicas learn from more windows each.
REPLICA_WINDOWS = 250_000
FEWEST, MOST = 8, 256


@dataclass(frozen=True)
class NetShape:
    embed: int = 8
    hidden: int = 48
    rounds: int = 3
    batch: int = 512
    draws: int = 40  #: batches for each 10,000 distinct windows or part of them
    rate: float = 0.004


def window_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The window around each byte of the texts as one number, and the texts' lengths. Beyond a text: zeros."""
    sizes = np.array([len(x) for x in texts], np.int64)
    pad = b"\0" * RADIUS
    joined = np.frombuffer(pad + (pad + pad).join(texts) + pad if texts else pad + pad, np.uint8).astype(np.uint64)
    inside = np.arange(sizes.sum()) + RADIUS + np.repeat(2 * RADIUS * np.arange(len(sizes)), sizes)
    code = np.zeros(len(inside), np.uint64)
    for k in range(-RADIUS, RADIUS + 1):
        code = code << np.uint64(8) | joined[inside + k]
    return code, sizes


def window_bytes(codes: np.ndarray) -> np.ndarray:
    shifts = np.uint64(8) * np.arange(2 * RADIUS, -1, -1, dtype=np.uint64)
    return (codes[:, None] >> shifts & np.uint64(255)).astype(np.int64)


def count_windows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``window``, ``n`` over all bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], ["window", "n"])

        for batch in pieces(batches):
            found, n = np.unique(window_codes([x.encode() for x in texts_of(batch) if x])[0], return_counts=True)
            both, weights = np.concatenate([codes, found]), np.concatenate([counts, n])
            order = np.argsort(both, kind="stable")
            both, weights = both[order], weights[order]
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
            codes, counts = both[first], np.add.reduceat(weights, first) if len(first) else weights
            if len(codes) > KEPT_WINDOWS:
                yield batch_of()
                codes, counts = codes[:0], counts[:0]
        yield batch_of()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "window long, n long")
    return rows.groupBy("window").agg(F.sum("n").alias("n"))


class WindowNet:
    """Embedded neighbours, one hidden layer, softmax over the middle byte."""

    def __init__(self, shape: NetShape, seed: int = 5):
        draw = np.random.default_rng(seed)
        wide = shape.embed * len(SIDES)
        self.shape = shape
        self.weights = {
            "embed": draw.normal(0, 0.3, (256, shape.embed)), "in": draw.normal(0, wide**-0.5, (wide, shape.hidden)),
            "in_bias": np.zeros(shape.hidden), "out": draw.normal(0, shape.hidden**-0.5, (shape.hidden, 256)), "out_bias": np.zeros(256),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _forward(self, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        x = w["embed"][sides].reshape(len(sides), -1)
        h = np.tanh(x @ w["in"] + w["in_bias"])
        z = h @ w["out"] + w["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return x, h, z

    def log_probabilities(self, codes: np.ndarray, at_once: int = 4096) -> np.ndarray:
        """Of each window's middle byte."""
        out = np.empty(len(codes), np.float64)
        for i in range(0, len(codes), at_once):
            window = window_bytes(codes[i : i + at_once])
            out[i : i + at_once] = self._forward(window[:, SIDES])[2][np.arange(len(window)), window[:, RADIUS]]
        return out

    def gradients(self, window: np.ndarray) -> dict[str, np.ndarray]:
        w, sides, n = self.weights, window[:, SIDES], len(window)
        x, h, z = self._forward(sides)
        p = np.exp(z)
        p[np.arange(n), window[:, RADIUS]] -= 1
        p /= n
        back = (p @ w["out"].T) * (1 - h * h)
        to_x = (back @ w["in"].T).reshape(n * len(SIDES), -1)
        embed = np.stack([np.bincount(sides.ravel(), c, 256) for c in to_x.T], axis=1)
        return {"embed": embed, "in": x.T @ back, "in_bias": back.sum(axis=0), "out": h.T @ p, "out_bias": p.sum(axis=0)}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.weights.values()])

    def from_flat(self, values: np.ndarray) -> WindowNet:
        at = 0
        for k, v in self.weights.items():
            self.weights[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self


def counted_batches(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and their counts, so many at a time, however large Spark's batches are."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        while size >= rows:
            table = pa.Table.from_batches(held)
            yield numbers(table.slice(0, rows))
            held = table.slice(rows).to_batches()
            size -= rows
    if size:
        yield numbers(pa.Table.from_batches(held))


def numbers(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return counts.column(0).to_numpy().view(np.uint64), counts.column(1).to_numpy().astype(np.float64)


def train_on(counts: DataFrame, shape: NetShape = NetShape()) -> WindowNet:
    """A network trained on the counted windows: every window may be drawn, by its count; replicas, whose weights are
    averaged after each round, have a share of the windows each and draw in proportion to its distinct windows."""
    spark = counts.sparkSession
    replicas = min(MOST, max(FEWEST, -(-counts.count() // REPLICA_WINDOWS)))
    net = WindowNet(shape)
    for turn in range(shape.rounds):
        start = spark.sparkContext.broadcast(net.flat())  # a few ten thousand weights

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            mine, t, seen = WindowNet(shape).from_flat(start.value), 0, 0
            first = {k: np.zeros_like(v) for k, v in mine.weights.items()}
            second = {k: np.zeros_like(v) for k, v in mine.weights.items()}
            for codes, n in counted_batches(batches):
                order = np.argsort(codes)
                codes, n = codes[order], n[order]
                seen += n.sum()
                draw = np.random.default_rng(int(codes[0] % np.uint64(1 << 32)) + turn)
                edges = np.cumsum(n)
                for _ in range(shape.draws):
                    t += 1
                    pick = np.searchsorted(edges, draw.random(shape.batch) * edges[-1], side="right")
                    for k, g in mine.gradients(window_bytes(codes[pick])).items():
                        first[k] = 0.9 * first[k] + 0.1 * g
                        second[k] = 0.999 * second[k] + 0.001 * g * g
                        move = first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                        mine.weights[k] = (mine.weights[k] - shape.rate / (1 + turn) * move).astype(np.float32)
            if t:
                made = [pa.array([float(seen)]), pa.array([mine.flat().astype("<f4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["seen", "weights"])

        # In an order that is the windows' own and mixes them: shuffled blocks arrive in any order.
        mine = counts.repartition(replicas, "window").sortWithinPartitions(F.xxhash64("window"), "window")
        rows = mine.mapInArrow(run, "seen double, weights binary").collect()
        if not rows:
            break
        share = np.array([r["seen"] for r in rows])
        order = np.lexsort(([bytes(r["weights"]) for r in rows], share))
        stack = np.stack([np.frombuffer(bytes(rows[i]["weights"]), "<f4") for i in order]).astype(np.float64)
        net.from_flat((stack * share[order, None]).sum(axis=0) / share.sum())
    return net


def score(docs: DataFrame, net: WindowNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` (bytes), ``log_likelihood`` (natural logarithm, sum) and ``mean_log_likelihood``.

    Null and empty texts have no bytes, sum 0 and a null mean; repeated rows get equal results up to rounding; an
    empty table gives no rows; other columns are not carried.
    """
    weights, shape = docs.sparkSession.sparkContext.broadcast(net.flat()), net.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WindowNet(shape).from_flat(weights.value)
        known, values = np.zeros(0, np.uint64), np.zeros(0)
        for batch in pieces(batches):
            codes, sizes = window_codes([(x or "").encode() for x in texts_of(batch)])
            found, inverse = np.unique(codes, return_inverse=True)
            at = np.searchsorted(known, found)
            new = np.ones(len(found), bool)
            if len(known):
                new = known[np.minimum(at, len(known) - 1)] != found
            if len(known) + new.sum() > KEPT_WINDOWS:
                known, values, new = known[:0], values[:0], np.ones(len(found), bool)
            both, worth = np.concatenate([known, found[new]]), np.concatenate([values, model.log_probabilities(found[new])])
            order = np.argsort(both, kind="stable")
            known, values = both[order], worth[order]
            each = values[np.searchsorted(known, found)][inverse] if len(found) else np.zeros(0)
            edges = np.r_[0, np.cumsum(sizes)]
            # sums of each text's own values: no differences of running sums
            total = np.array([each[a:b].sum() for a, b in zip(edges[:-1], edges[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(total, pa.float64())], ["id", "n_tokens", "log_likelihood"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"id {kind}, n_tokens long, log_likelihood double")
    return rows.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_tokens")).withColumnRenamed("id", id_col)


def score_corpus(docs: DataFrame, shape: NetShape = NetShape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the corpus's windows, train on them, score every document."""
    return score(docs, train_on(staged(count_windows(docs, text_col)), shape), id_col, text_col)
