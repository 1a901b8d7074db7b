"""What the embedding operators share: valid rows, matrices and blobs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_vector(column: str) -> Column:
    """Not null, not empty, all components present and finite, one of them not zero."""
    c = F.col(column)
    return F.coalesce(F.size(c) > 0, F.lit(False)) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)


def norm2(column: str) -> Column:
    return F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def shape(df: DataFrame, column: str) -> tuple[int, int, float, float] | None:
    """(dimension, rows, least and largest norm) of the most frequent dimension (ties: the larger); None if there are no rows."""
    found = df.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"), F.min(norm2(column)).alias("low"), F.max(norm2(column)).alias("high")).orderBy(F.desc("n"), F.desc("d")).first()
    return (found.d, found.n, found.low**0.5, found.high**0.5) if found else None


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def name(*arrays: np.ndarray) -> int:
    """A long that names the content of arrays: the same after any recomputation."""
    h = hashlib.blake2b(digest_size=8)
    for a in arrays:
        h.update(np.ascontiguousarray(a).tobytes())
    return int.from_bytes(h.digest(), "big", signed=True)
