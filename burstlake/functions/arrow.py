"""Arrow column functions over arrays of samples.

Each function gets whole Arrow batches; rows of equal length are handled as one
matrix. Arrays per row are bounded by a frame, block or segment length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

DOUBLES = "array<double>"


#: Values per matrix handed to a function at once (16 MB of doubles).
CHUNK = 2_000_000


def matrices(*cols: pa.Array):
    """Yield (row numbers, one matrix per column) for sets of rows with equal lengths."""
    cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
    sizes = np.stack([np.diff(c.offsets.to_numpy()) for c in cols], axis=1)
    for shape in np.unique(sizes, axis=0):
        same = np.flatnonzero((sizes == shape).all(axis=1))
        step = max(1, CHUNK // max(1, int(shape.max())))
        for rows in (same[i:i + step] for i in range(0, len(same), step)):
            take = pa.array(rows)
            yield rows, [np.asarray(c.take(take).flatten().to_numpy(zero_copy_only=False),
                                    dtype=np.float64).reshape(len(rows), -1) for c in cols]


def lists(rows: Sequence[np.ndarray]) -> pa.Array:
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate(rows) if len(rows) else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                    pa.array(flat, type=pa.float64()))


def row_function(fn: Callable[..., np.ndarray | tuple[np.ndarray, ...]],
                 returns: Sequence[tuple[str, str]] | str):
    """Column function from ``fn(matrix, ...)``, which works on equally long rows.

    ``returns`` is a type for one result or (name, type) pairs for a struct.
    """
    single = isinstance(returns, str)
    spec = [("value", returns)] if single else list(returns)
    types = {DOUBLES: T.ArrayType(T.DoubleType()), "double": T.DoubleType()}
    result = types[returns] if single else T.StructType([T.StructField(n, types[t]) for n, t in spec])

    def apply(*cols: pa.Array) -> pa.Array:
        out = [[None] * len(cols[0]) for _ in spec]
        for rows, mats in matrices(*cols):
            res = fn(*mats)
            for slot, values in zip(out, (res,) if single else res):
                for r, v in zip(rows, values):
                    slot[r] = v
        made = [lists(s) if t == DOUBLES else
                pa.array(np.array(s, dtype=np.float64), type=pa.float64(), from_pandas=True)
                for s, (_, t) in zip(out, spec)]
        return made[0] if single else pa.StructArray.from_arrays(made, [n for n, _ in spec])

    arity = fn.__code__.co_argcount
    if arity == 1:
        def call(a: pa.Array) -> pa.Array:
            return apply(a)
    elif arity == 2:
        def call(a: pa.Array, b: pa.Array) -> pa.Array:
            return apply(a, b)
    else:
        def call(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return apply(a, b, c)
    return arrow_udf(call, result)
