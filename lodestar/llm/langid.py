"""Language identification by a convolutional network over bytes.

Bytes are embedded, filters of several widths run over windows of fixed length, each filter's largest response in the
window is kept, and a softmax layer over those names the language. Training (numpy, on the driver) sees a bounded
sample of windows; prediction sees every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, texts_of, tidy

UNDETERMINED = "und"


@dataclass(frozen=True)
class NetShape:
    window: int = 256  #: bytes
    embed: int = 4
    widths: tuple[int, ...] = (3, 4, 5)
    filters: int = 8  #: of each width
    steps: int = 400
    batch: int = 64
    rate: float = 0.01


#: Bound of the training sample: texts of each language, and windows of each text.
SAMPLE_TEXTS = 500
SAMPLE_WINDOWS = 4
#: Languages up to which each has that many texts and ``steps`` suffice; more share the texts and get more steps.
FEW_LANGUAGES = 200


def windows_of(text: bytes, size: int) -> np.ndarray:
    """A text cut into windows: one after another, the last one flush with the end; a short text padded with zeros."""
    if len(text) <= size:
        return np.frombuffer(text.ljust(size, b"\0"), np.uint8)[None]
    whole = np.frombuffer(text, np.uint8)
    full = len(text) // size
    rows = whole[: full * size].reshape(full, size)
    return rows if full * size == len(text) else np.concatenate([rows, whole[None, -size:]])


class ByteNet:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, shape: NetShape, languages: list[str], seed: int = 17):
        draw = np.random.default_rng(seed)
        self.shape, self.languages = shape, languages
        self.span, n = max(shape.widths), shape.filters * len(shape.widths)
        self.mask = np.repeat([np.arange(self.span) < w for w in shape.widths], shape.filters, axis=0).T  # span x n
        self.mask = np.repeat(self.mask, shape.embed, axis=0).astype(np.float32)
        self.weights = {
            "embed": draw.normal(0, 0.5, (256, shape.embed)),
            "filters": draw.normal(0, (shape.embed * 4) ** -0.5, (self.span * shape.embed, n)) * self.mask,
            "bias": np.zeros(n),
            "out": draw.normal(0, n**-0.5, (n, len(languages))),
            "out_bias": np.zeros(len(languages)),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        e, (b, size) = self.shape.embed, windows.shape
        x = self.weights["embed"][windows]
        step = x.strides
        view = np.lib.stride_tricks.as_strided(x, (b, size - self.span + 1, self.span * e), (step[0], step[1], step[2]))
        return np.ascontiguousarray(view).reshape(-1, self.span * e)

    def _forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        patches = self._patches(windows)
        response = (patches @ w["filters"]).reshape(len(windows), -1, len(w["bias"]))
        peak = response.max(axis=1) + w["bias"]
        pooled = np.maximum(peak, 0)
        z = pooled @ w["out"] + w["out_bias"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return patches, response, pooled, p / p.sum(axis=1, keepdims=True)

    def probabilities(self, windows: np.ndarray, at_once: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(windows[i : i + at_once])[3] for i in range(0, len(windows), at_once)])

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, b, e = self.weights, len(windows), self.shape.embed
        patches, response, pooled, p = self._forward(windows)
        p[np.arange(b), labels] -= 1
        p /= b
        back = (p @ w["out"].T) * (pooled > 0)  # b x n, lands on each filter's best position
        best = response.argmax(axis=1)
        rows = patches.reshape(b, -1, patches.shape[1])[np.arange(b)[:, None], best]  # b x n x span*e
        to_patch = back[:, :, None] * w["filters"].T[None]  # b x n x span*e
        bytes_there = windows[np.arange(b)[:, None, None], best[:, :, None] + np.arange(self.span)]  # b x n x span
        to_embed = np.stack(
            [np.bincount(bytes_there.ravel(), to_patch.reshape(b, -1, self.span, e)[..., k].ravel(), 256) for k in range(e)], axis=1
        )
        return {
            "embed": to_embed, "filters": np.einsum("bn,bnk->kn", back, rows) * self.mask, "bias": back.sum(axis=0),
            "out": pooled.T @ p, "out_bias": p.sum(axis=0),
        }

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 3) -> ByteNet:
        """Adam over batches that hold the languages in equal shares."""
        draw = np.random.default_rng(seed)
        by_language = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        steps = max(self.shape.steps, -(-self.shape.steps * len(self.languages) // FEW_LANGUAGES))
        for t in range(1, steps + 1):
            pick = draw.integers(0, len(by_language), self.shape.batch)
            rows = np.array([draw.choice(by_language[k]) for k in pick])
            rate = self.shape.rate * (1 - t / (steps + 1))
            for k, g in self._gradients(windows[rows], labels[rows]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                self.weights[k] = (self.weights[k] - rate * move).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and mean probability over all windows of each text; ``und`` and 0 without letters."""
        spoken = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))]  # Unicode's letters (category L)
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if spoken and self.languages:
            cut = [windows_of(texts[i].encode(), self.shape.window) for i in spoken]
            p = self.probabilities(np.concatenate(cut))
            sizes = np.array([len(c) for c in cut])
            mean = np.add.reduceat(p.astype(np.float64), np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]
            for i, k, m in zip(spoken, mean.argmax(axis=1), mean, strict=True):
                names[i], scores[i] = self.languages[k], float(min(1.0, m[k]))
        return names, scores


def training_windows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, shape: NetShape) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, sampled windows and their labels.

    For each language the texts with the smallest hashes of their ids are taken; ids and languages alone are read for
    that, then the texts of those ids, of which executors send a few evenly spaced windows.
    """
    spark = labelled.sparkSession
    narrow = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    languages = sorted(r["lang"] for r in narrow.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((0, shape.window), np.uint8), np.zeros(0, int)
    texts = min(SAMPLE_TEXTS, max(1, SAMPLE_TEXTS * FEW_LANGUAGES // len(languages)))
    # Tasks send the first few of each language only (window group limit).
    first = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    chosen = narrow.withColumn("place", F.row_number().over(first)).where(F.col("place") <= texts).collect()
    kind = labelled.schema[id_col].dataType.simpleString()
    wanted = spark.createDataFrame([(r["id"], r["lang"]) for r in chosen], f"id {kind}, lang string").distinct()
    texts = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(wanted), ["id", "lang"])  # SAMPLE_TEXTS x FEW_LANGUAGES rows, or one a language

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs, out = [], []
            for lang, x in zip(batch.column(1).to_pylist(), texts_of(batch), strict=True):
                rows = windows_of((x or "").encode(), shape.window)
                for k in np.unique(np.linspace(0, len(rows) - 1, SAMPLE_WINDOWS).astype(int)):
                    langs.append(lang)
                    out.append(rows[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    got = sorted((r["lang"], bytes(r["window"])) for r in texts.mapInArrow(tidy(cut), "lang string, window binary").collect())
    at = {lang: k for k, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, shape.window)
    return languages, windows, np.array([at[lang] for lang, _ in got])


def held_out(id_col: str):
    """Every fifth document by checksum of its id: never seen in training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shape: NetShape = NetShape()) -> ByteNet:
    """A network trained on documents that have a language and are not held out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    languages, windows, labels = training_windows(labelled, id_col, text_col, lang_col, shape)
    net = ByteNet(shape, languages)
    return net.train(windows, labels) if languages else net


def identify(docs: DataFrame, net: ByteNet, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns plus ``lang_pred`` and ``score`` of every whole text.

    Null texts and texts without a letter are ``und`` with score 0; repeated rows get equal results; an empty table
    gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", 1 << 20):
            names, scores = model.value.predict(texts_of(batch, "__text"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*carry, "lang_pred", "score"]
            )

    rows = docs.select(F.col(text_col).alias("__text"), *carry)
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(tidy(run), f"{shape}, lang_pred string, score double")
