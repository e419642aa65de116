"""Vectors as whole numbers, for operators whose results must be exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Whole components stay under this size, so that 2,048 squares of their differences fit a long.
LIMIT = 1 << 25


def whole(vector: Column, scale: int) -> Column:
    """Each component times ``scale``, rounded down, as ``array<int>``."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("int"))


def usable(vector: Column, scale: int) -> Column:
    """No null, NaN, infinite or outsized component; false for a null vector."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(LIMIT / scale), F.lit(False))), F.lit(False))


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, *others: Column) -> DataFrame:
    """``(vec_id, v array<int>)`` and ``others`` of the rows with a usable vector; further columns are left out."""
    return rows.where(usable(F.col(vector_col), scale)).select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col), scale).alias("v"), *others)


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column of ``dim`` numbers a row as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
