"""Vectors in array columns: which may take part, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(col: str) -> Column:
    """True where the array is not null and holds neither null nor non-finite components."""
    x = F.col(col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(x.isNotNull() & fine, F.lit(False))


def matrix(col: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    """A row for each array, padded with zeros to ``dim`` places."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return np.ascontiguousarray(flat.reshape(-1, dim), kind)
    out = np.zeros((len(size), dim), kind)
    out[np.arange(dim) < size[:, None]] = flat
    return out
