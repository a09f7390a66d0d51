"""Arrow lists as padded arrays and back, for helpers that advance many rows together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS = 2048  # rows that are padded together


def lengths(lists: pa.Array) -> np.ndarray:
    """A null list counts as empty."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in it) of every item of lists of these sizes."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def padded(lists: pa.Array, fill: float = 0.0) -> np.ndarray:
    """A list of numbers a row (nulls inside read as ``fill``) -> rows x longest."""
    sizes = lengths(lists)
    out = np.full((len(sizes), int(sizes.max(initial=0))), fill)
    out[places(sizes)] = pc.fill_null(lists.flatten().cast(pa.float64()), fill).to_numpy(zero_copy_only=False)
    return out


def padded_vectors(lists: pa.Array, width: int) -> np.ndarray:
    """A list of vectors a row -> rows x longest x ``width`` at least."""
    sizes = lengths(lists)
    inner = padded(lists.flatten())
    out = np.zeros((len(sizes), int(sizes.max(initial=0)), max(width, inner.shape[1])))
    out[(*places(sizes), slice(0, inner.shape[1]))] = inner
    return out


def ragged(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The first ``sizes[i]`` values of each row as lists."""
    return as_lists(values[places(sizes)] if values.size else values.reshape(-1), sizes, kind)


def as_lists(flat, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Items that lie one behind the other, cut into lists of these sizes."""
    items = flat if isinstance(flat, pa.Array) else pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items)
