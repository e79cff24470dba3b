"""Integer vectors: what the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer vectors of this squared length or more have products that a long cannot hold in all sums; they take no part.
LONGEST = float(1 << 56)


def usable(vector: Column) -> Column:
    """The vector is there, and every component is a finite number."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """Each component x as floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def squared(vector: Column) -> Column:
    """Squared length of an integer vector as a double."""
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def integer_rows(df: DataFrame, vector: str, scale: int, columns: dict[str, Column]) -> DataFrame:
    """``columns``, and the vector as integers ``v``, of the rows with a usable one that is not too long."""
    own = df.where(usable(F.col(vector))).select(*(c.alias(name) for name, c in columns.items()), integers(F.col(vector), scale).alias("v"))
    return own.where(squared(F.col("v")) < LONGEST)


def padded(v: Column, dim: int) -> Column:
    """v with zeros up to ``dim``."""
    return F.when(F.size(v) >= dim, v).otherwise(F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(v))))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of ``dim`` components, one a row, as int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: in doubles where every partial sum fits their 53 bits, else in int64."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), np.int64)
    if np.einsum("ij,ij->i", x, x).max() * np.einsum("ij,ij->i", y, y).max() < float(1 << 104):
        return (x @ y.T).astype(np.int64)
    return a @ b.T
