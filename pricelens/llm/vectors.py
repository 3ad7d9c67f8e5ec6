"""Whole-number vectors, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
# Components count at most this much, so that sums of squares stay exact in 64 bits.
LIMIT = 1 << 26


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id``, ``label`` and ``v``, the components as ``floor(256 * x)``.

    Rows whose vector is null or empty, or holds a null or a non-finite
    component, are left out.  Components beyond 2^26 in size count as that
    bound.  Other columns are ignored whatever their names.
    """
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return x.filter((F.size("x") > 0) & fine).select("id", "label", whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)
