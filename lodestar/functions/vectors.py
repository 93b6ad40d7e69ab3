"""Vectors: cosine, norms, packed arrays (FUN-18, FUN-30, FUN-36, SRC-27)."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either has length 0 (FUN-18)."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_distance(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2, in 0..1."""
    return (1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(a, b)))) / 2


def unit(a: Column) -> Column:
    """The vector over its length; null for the zero vector."""
    length = F.sqrt(dot(a, a))
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))


def cosine_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices; NaN with a zero row (FUN-18)."""
    with np.errstate(invalid="ignore"):
        return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1)))


def first_closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus the distances of the first components (FUN-19)."""
    return -np.abs(a[:, :1] - b[:, 0])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_vector(blobs: pd.Series) -> pd.Series:
    """zlib-compressed little-endian half floats to floats; Spark has neither (FUN-36, SRC-27). Null stays null."""
    return blobs.map(lambda b: np.frombuffer(zlib.decompress(bytes(b)), "<f2").astype(np.float32), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def pack_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: zlib.compress(np.asarray(v, "<f2").tobytes()), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_text(values: pd.Series) -> pd.Series:
    """The same in base64 (FUN-36)."""
    return values.map(lambda s: np.frombuffer(zlib.decompress(base64.b64decode(s)), "<f2").astype(np.float32), na_action="ignore")


def of_dimension(vector: Column, size: int) -> Column:
    """The vector if it has the expected length, else null (SRC-27)."""
    return F.when(F.size(vector) == size, vector)


def encoded_key(text: Column, field: str = "key") -> Column:
    """A field of base64-coded JSON; the text itself where it isn't that (FUN-30)."""
    decoded = F.try_to_binary(text, F.lit("base64")).cast("string")
    return F.coalesce(F.get_json_object(F.when(F.is_valid_utf8(decoded), decoded), f"$.{field}"), text)
