"""Integer vectors, which the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest absolute integer component. Squares of differences and products of 2^27 leave room in a long for sums over 256 components.
MOST = 1 << 27


def common_length(frame: DataFrame, column: str) -> int:
    """The commonest length of valid vectors, of equally common ones the longest; 0 where there are none."""
    found = frame.groupBy(F.size(column).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    return max(found[0].n, 0) if found else 0


def valid(column: str, scale: int) -> Column:
    """True for a vector without null or non-finite components, whose scaled integers are at most MOST."""
    inside = F.forall(column, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(MOST / scale), F.lit(False)))
    return F.coalesce(inside, F.lit(False)) & (F.size(column) > 0)


def integers(frame: DataFrame, column: str, scale: int, keep: list[str]) -> tuple[DataFrame, int]:
    """(``keep`` columns, x) and the length of x: floor(scale * component) of each valid vector of the commonest length.

    Vectors that are null or empty, hold null or non-finite components or ones whose integers exceed MOST, or have
    another length, are left out. A kept column named x is the caller's to rename.
    """
    found = frame.where(valid(column, scale))
    length = common_length(found, column)
    x = F.transform(column, lambda e: F.floor(e.cast("double") * scale).cast("int"))
    return found.where(F.size(column) == length).select(*keep, x.alias("x")), length


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list array without nulls, all of ``width``, as a matrix of int64."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(lists), width)
