"""Fixed-point vectors of embedding tables, shared by the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a fixed-point vector are held at this size, so that sums of a few thousand stay within 64 bits.
LARGEST = 1 << 50
#: At this one so do inner products of up to 2,048 entries.
LARGEST_FACTOR = 1 << 25


def usable(vector: Column) -> Column:
    """Whether a vector is there and none of its entries is null, infinite or no number."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def fixed_point(vector: Column, scale: int, offset: int = 0, largest: int = LARGEST) -> Column:
    """``floor(scale * c) + offset`` of each entry, as ``array<bigint>``; products beyond ``largest`` are held there."""
    held = lambda c: F.greatest(F.least(F.lit(scale) * c.cast("double"), F.lit(float(largest))), F.lit(-float(largest)))
    return F.transform(vector, lambda c: F.floor(held(c)).cast("bigint") + F.lit(offset).cast("bigint"))


def padded(vector: Column, dims: int, fill: int = 0) -> Column:
    """A vector of ``dims`` entries: those that a shorter one lacks are ``fill``."""
    missing = F.array_repeat(F.lit(fill).cast("bigint"), F.lit(dims) - F.size(vector))
    return F.when(F.size(vector) < dims, F.concat(vector, missing)).otherwise(vector)


def dimensions(rows: DataFrame, vector_col: str) -> int:
    return rows.agg(F.max(F.size(vector_col))).first()[0] or 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow list column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)
