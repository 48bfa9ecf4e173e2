"""Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as one two-dimensional array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def vectors(rows: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array as a list column."""
    rows = np.ascontiguousarray(rows, dtype=np.float64)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def one_row(key: tuple, names: list[str], types: pa.Schema | list[pa.DataType], values: list) -> pa.Table:
    """A single result row: the group's key followed by computed values."""
    arrays = [pa.array([k.as_py()], k.type) for k in key]
    arrays += [pa.array([v], t) for v, t in zip(values, types)]
    return pa.Table.from_arrays(arrays, names=names)


def keyed_rows(key: tuple, key_names: list[str], columns: dict[str, np.ndarray | pa.Array]) -> pa.Table:
    """Result columns with the group's key repeated on every row."""
    n = len(next(iter(columns.values())))
    arrays = [pa.repeat(k, n) for k in key] + [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.Table.from_arrays(arrays, names=[*key_names, *columns])
