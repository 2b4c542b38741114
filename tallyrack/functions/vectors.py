"""Array-as-vector helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _row_sums(a: pa.Array, b: pa.Array) -> pa.Array:
    sizes = pc.list_value_length(a)
    good = pc.fill_null(pc.and_(pc.equal(sizes, pc.list_value_length(b)), pc.greater(sizes, 0)), False)
    out = np.zeros(len(a))
    mask = good.to_numpy(zero_copy_only=False).astype(bool)
    if mask.any():
        x, y = (side.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for side in (a, b))
        ends = np.cumsum(sizes.filter(good).to_numpy(zero_copy_only=False))
        out[mask] = np.add.reduceat(x * y, np.concatenate([[0], ends[:-1]]))
    return pa.array(out, pa.float64(), mask=~mask)


@F.arrow_udf(T.DoubleType())
def dot_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """``dot`` on Arrow batches, for many or long vectors; null where lengths differ."""
    return _row_sums(a, b)


def pad(history: Column, n: int, value: int = 0) -> Column:
    """Extend an array to ``n`` entries; longer arrays are kept whole."""
    missing = F.greatest(F.lit(n) - F.size(history), F.lit(0))
    return F.concat(history, F.array_repeat(F.lit(value), missing))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def or_zeros(vector: Column, dim: int) -> Column:
    """The vector, or the zero vector where it is missing."""
    return F.coalesce(vector, zeros(dim))
