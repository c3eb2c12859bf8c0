"""Arrow columns in pieces, so that what is made of a batch of long texts stays small."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST = 200_000


def ranges(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `most`, one row at least."""
    ends, out, at = np.cumsum(size), [], 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        out.append((at, to))
        at = to
    return out


def in_pieces(f: Callable[..., pa.Array], *columns: pa.Array, most: int = MOST) -> pa.Array:
    """f of the columns, row by row the same, in pieces of about `most` elements of the first column, which holds lists."""
    size = pc.fill_null(pc.list_value_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [f(*(c.slice(a, b - a) for c in columns)) for a, b in ranges(size, most)]
    return pa.concat_arrays(parts) if parts else f(*columns)
