"""What the operators on vectors share: which rows take part, and their components as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 256


def usable(vector: str) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def largest(dims: int) -> int:
    """Components saturate here, so that 100 times an inner product or a squared distance of dims components fits 63 bits."""
    return 1 << (54 - max(1, dims - 1).bit_length()) // 2


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    """A row of dims int64 components for each vector; shorter vectors are followed by zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    most = largest(dims)
    # floor(256 * x) of what saturates is cut before it is made a whole number
    flat = np.floor(np.clip(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), -most, most) * SCALE)
    flat = np.clip(flat, -most, most).astype(np.int64)
    if (lengths == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out
