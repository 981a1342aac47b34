"""Embedding whitening: a distributed centred scatter, and symmetric Jacobi rotations on the driver.

Vectors become integers floor(64 * c) + 1,000,000. Spark writes each distinct vector once (the fit list), sums it,
and adds up the scatter about the rounded mean: products of whole numbers, which doubles hold without rounding as
long as they stay below 2^53. The covariance follows from them in exact fractions. The driver holds that one matrix,
whose size is the square of the vectors' length and doesn't grow with rows, and rotates it until its off-diagonals
vanish against the diagonal entries they join, which keeps small eigenvalues accurate. Each sweep takes all pairs in rounds of disjoint
ones (round robin), so that a round is a few numpy operations. The whitening matrix goes to the tasks.

Defined cases: vectors that are null or empty or hold null or non-finite components (or integers over 2^27) are
dropped, as are those of another length than the commonest. Repeated rows and equal vectors count once in the fit and
are all whitened. A component without variance (fewer distinct vectors than components, or constant sums) has a null
``whitened``, explains 0, and takes no part in identity_error, which is 0 where no component is left. ``deviation`` is null where a long can't
hold it (from about 10^7 distinct vectors on). An empty table gives an empty table. Columns named as results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import Workspace, bound_batches
from lumenfold.llm.vectors import integers, matrix

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Sweeps after which rotation stops in any case; ten or fewer are usual.
MOST_SWEEPS = 60
#: An eigenvalue below this share of the trace is what rounding leaves of zero.
NOTHING = 1e-13
RESULTS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def rounds(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of 0 .. size - 1 in rounds of disjoint pairs, as in a round-robin tournament."""
    places = list(range(size + size % 2))
    found = []
    for _ in range(len(places) - 1):
        half = len(places) // 2
        pairs = [sorted(p) for p in zip(places[:half], reversed(places[half:])) if max(p) < size]
        found.append(tuple(np.array(pairs, np.int64).reshape(-1, 2).T))
        places = [places[0], places[-1], *places[1:-1]]
    return found


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as columns, by cyclic Jacobi rotations."""
    a, size = np.array(symmetric, np.float64), len(symmetric)
    vectors = np.eye(size)
    order = rounds(size) if size > 1 else []
    for _ in range(MOST_SWEEPS):
        turned = False
        for p, q in order:
            off, first, second = a[p, q], a[p, p], a[q, q]
            # What is left is small against both diagonal entries, or nothing beside the matrix.
            rotate = np.abs(off) > np.maximum(1e-17 * np.sqrt(np.abs(first * second)), np.finfo(np.float64).tiny)
            if not rotate.any():
                continue
            turned = True
            p, q, off, first, second = p[rotate], q[rotate], off[rotate], first[rotate], second[rotate]
            ratio = (second - first) / (2 * off)
            tangent = np.where(ratio >= 0, 1.0, -1.0) / (np.abs(ratio) + np.hypot(1, ratio))
            cosine = 1 / np.hypot(1, tangent)
            sine = tangent * cosine
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = cosine[:, None] * rows_p - sine[:, None] * rows_q, sine[:, None] * rows_p + cosine[:, None] * rows_q
            for m in (a, vectors):
                columns_p, columns_q = m[:, p], m[:, q]
                m[:, p], m[:, q] = cosine * columns_p - sine * columns_q, sine * columns_p + cosine * columns_q
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = first - tangent * off, second + tangent * off
        if not turned:
            break
    values = np.diag(a).copy()
    falling = np.argsort(-values, kind="stable")
    vectors = vectors[:, falling]
    return values[falling], vectors / np.linalg.norm(vectors, axis=0)


def _summed(frame: DataFrame, compute, width: int) -> np.ndarray:
    """The sum over all rows of (rows, width) -> (k, m) matrices, added up by cell in Spark; each task gives one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = compute(matrix(batch.column(0), width))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel().astype(np.float64))], names=["i", "j", "part"])

    cells = frame.select("x").mapInArrow(run, "i bigint, j bigint, part double").groupBy("i", "j").agg(F.sum("part").alias("total")).collect()
    out = np.zeros((1 + max(r.i for r in cells), 1 + max(r.j for r in cells)))
    for r in cells:
        out[r.i, r.j] = r.total
    return out


@dataclass
class Whitening:
    """What the fit list gives: its size, sums (of x without SHIFT), eigenvalues and eigenvectors, and the error it leaves."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def matrix(self) -> np.ndarray:
        """(length, components): columns of components without variance are NaN."""
        scale = np.where(self.values > NOTHING * self.trace, self.values, np.nan)
        return self.vectors / np.sqrt(scale)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, components) of integer vectors; the mean is taken off before anything is multiplied."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return ((x - whole) - rest) @ self.matrix()

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S)^2 in whole numbers; null where a long can't hold it."""
        off = [max(abs(self.n * int(v) - s) for v in (lo, hi)) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), self.sums)]
        if sum(o * o for o in off) < 1 << 63:
            return pa.array(((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1), pa.int64())
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct integer vectors of ``embeddings(embedding)``; None where there are none."""
    spark = embeddings.sparkSession
    bound_batches(spark)
    work = Workspace(spark, "whitening")
    vectors, length = integers(embeddings, "embedding", SCALE, [])
    distinct = work.save(vectors.distinct(), "distinct")
    sums = distinct.select(F.posexplode("x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum("col").alias("s")).collect()
    if not sums:
        work.drop("distinct")
        return None
    n, sums = sums[0].n, [r.s for r in sorted(sums, key=lambda r: r.pos)]
    middle = np.array([round(Fraction(s, n)) for s in sums], np.int64)

    def scatter(x: np.ndarray) -> np.ndarray:
        off = (x - middle).astype(np.float64)
        return off.T @ off

    products = _summed(distinct, scatter, length)
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    covariance = np.array([[float(Fraction(n * Fraction(products[i, j]) - rest[i] * rest[j]) / (n * n)) for j in range(length)] for i in range(length)])
    values, axes = jacobi(covariance)
    found = Whitening(n, sums, values[:components], axes[:, :components], float(np.trace(covariance)))

    def moments(x: np.ndarray) -> np.ndarray:
        white = np.nan_to_num(found.project(x))
        return np.vstack([white.T @ white, white.sum(axis=0)])

    kept = found.values > NOTHING * found.trace
    sums_of = _summed(distinct, moments, length)
    mean = sums_of[-1] / n
    off_identity = (sums_of[:-1] / n - np.outer(mean, mean) - np.eye(len(kept)))[np.ix_(kept, kept)]
    found.identity_error = float(np.abs(off_identity).max()) if kept.any() else 0.0
    work.drop("distinct")
    return found


def whiten(embeddings: DataFrame, whitening: Whitening | None, keep: list[str] | None = None) -> DataFrame:
    """One row for each row that isn't dropped and each component, with RESULTS beside its own (or its ``keep``) columns."""
    bound_batches(embeddings.sparkSession)
    kept = [c for c in (embeddings.columns if keep is None else keep) if c not in (*RESULTS, "embedding")]
    renamed = embeddings.select(F.struct(*kept).alias("row"), "embedding")
    vectors, length = integers(renamed, "embedding", SCALE, ["row"])
    vectors = vectors.where(F.lit(whitening is not None and length == len(whitening.sums)))
    white = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("row", renamed.schema["row"].dataType), T.StructField("deviation", T.LongType()), T.StructField("white", white)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), length)
                made = whitening.project(x)
                flat = pa.array(made.ravel(), pa.float64(), from_pandas=True)  # NaN is null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), whitening.deviation(x), lists], names=["row", "deviation", "white"])

    found = vectors.mapInArrow(run, schema).select("row", "deviation", F.posexplode("white").alias("at", "whitened"))
    share = [] if whitening is None or not whitening.trace else [max(float(v) / whitening.trace, 0.0) if v > NOTHING * whitening.trace else 0.0 for v in whitening.values]
    explained = F.element_at(F.array(*(F.lit(s) for s in share)), F.col("at") + 1) if share else F.lit(0.0)
    n, error = (whitening.n, whitening.identity_error) if whitening else (0, 0.0)
    return found.select(
        *(F.col("row")[c].alias(c) for c in kept), (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
