"""Vectors of Arrow batches as integer matrices: shared by the operators on ``embeddings``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_vector(name: str) -> Column:
    """True for a vector that is there and holds neither null nor a non-finite component."""
    bad = F.exists(F.col(name), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(name).isNotNull() & ~bad


def integer_rows(column: pa.Array, scale: int, limit: int) -> np.ndarray:
    """``floor(scale * x)`` of each component as int64 (rows x longest length), within ``-limit`` and
    ``limit``. Shorter vectors are filled up with zeros at their end."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    flat = pc.cast(column.values, pa.float64()).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    flat = np.clip(np.floor(flat * scale), -limit, limit).astype(np.int64)
    sizes = np.diff(offsets)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    """The matrix with zero columns added up to ``width``."""
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
