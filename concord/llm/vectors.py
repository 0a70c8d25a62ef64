"""Vectors as whole numbers: Spark expressions that make them, and numpy tables of them in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest size of a component. A squared distance of up to 256 components, and any inner product of them, fits in a long.
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """Not NULL, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, taken as a double. A component beyond `LARGEST` is an error, as its
    products would not fit."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.forall(whole, lambda x: F.abs(x) <= F.lit(LARGEST))
    return F.when(fits, F.transform(whole, lambda x: x.cast("int"))).otherwise(
        F.raise_error(F.lit(f"a vector has a component whose whole number is beyond {LARGEST}")).cast("array<int>")
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of `width` numbers a row as a table."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def working(x: np.ndarray, largest: int) -> np.ndarray:
    """The table in the type in which sums of its products with numbers up to `largest` are exact: doubles, for which
    there are fast routines, as long as no sum passes 2^53."""
    size = max(largest, int(np.abs(x).max(initial=0)))
    return x.astype(np.float64 if 4 * x.shape[1] * size * size < 1 << 53 else np.int64)
