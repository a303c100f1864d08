"""Vectors as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCALE, MOST = 256, 2.0**62


def scaled(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that count, and their components ``floor(256 * x)`` as rows of 64-bit integers.

    A null vector doesn't count, nor does one with a null or non-finite component.  Shorter vectors are filled up with zeros.
    A component beyond 2 ** 62 raises ValueError.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.floor(pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE)  # a null is NaN here
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.zeros(len(lengths), bool)
    bad[owner[~np.isfinite(x)]] = True
    good = np.flatnonzero(~bad & vectors.is_valid().to_numpy(zero_copy_only=False))
    out = np.zeros((len(good), int(lengths[good].max(initial=0))), np.int64)
    taken = ~bad[owner]
    x, owner = x[taken], owner[taken]
    if (np.abs(x) > MOST).any():
        raise ValueError("a component is too large for whole numbers of 64 bits")
    place = np.full(len(lengths), -1)
    place[good] = np.arange(len(good))
    out[place[owner], np.arange(len(owner)) - np.repeat(np.cumsum(lengths[good]) - lengths[good], lengths[good])] = x
    return good, out


def matrix(vectors: pa.Array) -> np.ndarray:
    """The rows that ``scaled`` made, read back from a list column."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), int(lengths[0]))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def column(rows: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), pa.array(rows.reshape(-1), pa.int64()))
