"""Vectors from array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix_rows(column: pa.Array) -> list[np.ndarray | None]:
    """A float64 vector for each list; None if the list is null or holds nulls or non-finite numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = np.isfinite(numbers)
    if values.null_count:
        good &= ~values.is_null().to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~good)]
    ends, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return [numbers[a:b] if ok and bad[a] == bad[b] else None for a, b, ok in zip(ends, ends[1:], valid)]
