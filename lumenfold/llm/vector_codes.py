"""Vector code compression: product codes whose nearest entries are found by VA-file filtering.

A vector of integers floor(256 * x) is cut into 16 parts; each part position has a codebook of at most 64 entries,
which starts as that part of the vectors with the smallest ids and is moved by two rounds of assignment and mean.

Assignment filters as a vector-approximation file does. Each coordinate of a codebook's entries is put in one of
16 cells (4 bits). A part looks up, for each coordinate, how near and how far any member of each cell can be from it;
sums of those give a lower and an upper bound for every entry. Only entries whose lower bound is no more than the
least upper bound are refined with integer distances, so the nearest entry is never missed; ties go to the lower index.

Spark scans the table once for each round and once for the codes. A task sums the parts of its own rows into at
most 64 x length counters, which are added up by key; the driver holds codebooks only, whose size is 64 x length.

Defined cases: vectors that are null or empty or hold null or non-finite components (or integers over 2^27) are
dropped, as are those of another length than the commonest; a length that 16 doesn't divide is filled with zeros.
Rows that repeat an id are all coded, and order among the first 64 by their vectors; rows without id come last there.
With fewer than 64 rows codebooks have as many entries. An empty table gives an empty table. Columns beside the
vector are carried along; those named code or error are replaced, and label_error in ``with_label_errors``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import Workspace, bound_batches
from lumenfold.llm.vectors import integers, matrix

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CELL_BITS = 4
#: Parts that are compared with a codebook at once.
AT_ONCE = 2_048
#: Ways in which the rows of one label are dealt to meet its sum.
WAYS = 16


@dataclass
class Cells:
    """One codebook as a vector-approximation file: each entry's cell in each coordinate, and what each cell spans."""

    entries: np.ndarray
    bits: int = CELL_BITS
    cell: np.ndarray = field(init=False)
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n, width = self.entries.shape
        cells = 1 << self.bits
        self.cell = np.empty((n, width), np.int64)
        self.low = np.zeros((width, cells), np.int64)
        self.high = np.zeros((width, cells), np.int64)
        for d in range(width):
            values = self.entries[:, d]
            least, span = values.min(), values.max() - values.min() + 1
            self.cell[:, d] = (values - least) * cells // span
            for c in np.unique(self.cell[:, d]):
                held = values[self.cell[:, d] == c]
                self.low[d, c], self.high[d, c] = held.min(), held.max()

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each part to each entry, from one lookup table a part and coordinate."""
        lower = np.zeros((len(parts), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(parts.shape[1]):
            below, above = self.low[d][None, :] - parts[:, d, None], parts[:, d, None] - self.high[d][None, :]
            nearest = np.maximum(np.maximum(below, above), 0) ** 2
            farthest = np.maximum(np.abs(below), np.abs(above)) ** 2
            lower += nearest.take(self.cell[:, d], axis=1)
            upper += farthest.take(self.cell[:, d], axis=1)
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each part's nearest entry, and how many entries were refined."""
        index, distance, refined = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64), 0
        for at in range(0, len(parts), AT_ONCE):
            some = parts[at : at + AT_ONCE]
            lower, upper = self.bounds(some)
            rows, candidates = np.nonzero(lower <= upper.min(axis=1)[:, None])
            exact = np.full(lower.shape, np.iinfo(np.int64).max)
            exact[rows, candidates] = ((some[rows] - self.entries[candidates]) ** 2).sum(axis=1)
            index[at : at + AT_ONCE] = best = exact.argmin(axis=1)
            distance[at : at + AT_ONCE] = exact[np.arange(len(some)), best]
            refined += len(rows)
        return index, distance, refined


def _parts(x: pa.Array, length: int) -> np.ndarray:
    """(rows, PARTS, width) of integer vectors, filled with zeros up to a multiple of PARTS."""
    rows = matrix(x, length)
    rows = np.pad(rows, ((0, 0), (0, -length % PARTS)))
    return rows.reshape(len(rows), PARTS, -1)


def _sums(vectors: DataFrame, books: np.ndarray, length: int) -> list:
    """(part, entry, at, n, total): counts and sums of the parts assigned to each entry."""
    schema = "part int, entry int, at int, n bigint, total bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [Cells(book) for book in books]
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            parts = _parts(batch.column(0), length)
            for p, cells in enumerate(files):
                index, _, _ = cells.nearest(parts[:, p])
                n[p] += np.bincount(index, minlength=books.shape[1])
                np.add.at(total[p], index, parts[:, p])
        p, e, at = np.nonzero(np.broadcast_to(n[:, :, None], total.shape))
        arrays = [p.astype(np.int32), e.astype(np.int32), at.astype(np.int32), n[p, e], total[p, e, at]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["part", "entry", "at", "n", "total"])

    return vectors.select("x").mapInArrow(run, schema).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()


@dataclass
class Codebooks:
    """(PARTS, entries, width) integers, for vectors of ``length``."""

    entries: np.ndarray
    length: int

    def sha256(self) -> str:
        """Of all integers by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def fit(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks:
    """Codebooks of all vectors of ``embeddings(vec_id, embedding)``; an empty table gives codebooks without entries."""
    bound_batches(embeddings.sparkSession)
    vectors, length = integers(embeddings, "embedding", SCALE, ["vec_id"])
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    width = -(-length // PARTS)
    books = np.zeros((len(first), PARTS * width), np.int64)
    books[:, :length] = np.array([r.x for r in first], np.int64).reshape(len(first), length)
    books = books.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        for r in _sums(vectors, books.copy(), length):
            books[r.part, r.entry, r.at] = r.total // r.n
    return Codebooks(books, length)


def encode(embeddings: DataFrame, books: Codebooks, keep: list[str] | None = None) -> DataFrame:
    """``embeddings`` without its vectors (or its ``keep`` columns), with code (two hex digits a part) and error."""
    bound_batches(embeddings.sparkSession)
    kept = [c for c in (embeddings.columns if keep is None else keep) if c not in ("code", "error", "embedding")]
    renamed = embeddings.select(F.struct(*kept).alias("row"), "embedding")
    vectors, length = integers(renamed, "embedding", SCALE, ["row"])
    schema = T.StructType([T.StructField("row", renamed.schema["row"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    vectors = vectors.where(F.lit(length == books.length and books.entries.size > 0))
    entries = books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [Cells(book) for book in entries]
        digits = np.array([f"{i:02x}" for i in range(entries.shape[1])])
        for batch in batches:
            parts = _parts(batch.column(1), length)
            found = [cells.nearest(parts[:, p]) for p, cells in enumerate(files)]
            codes = ["".join(r) for r in digits[np.stack([i for i, _, _ in found], axis=1)].tolist()]
            error = np.sum([d for _, d, _ in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["row", "code", "error"])

    return vectors.mapInArrow(run, schema).select(*(F.col("row")[c].alias(c) for c in kept), "code", "error")


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with label_error: its error summed over the rows of its label, nulls together.

    Codes are written once and read twice. Rows of one label are dealt in WAYS parts to meet its sum, so that a label
    with a third of all rows isn't one task.
    """
    work = Workspace(coded.sparkSession, "codes")
    rows = coded.select(F.struct(*(c for c in coded.columns if c != "label_error")).alias("row"), F.col(label).alias("of"), F.col("error").alias("own"))
    rows = work.save(rows, "coded").withColumn("way", F.pmod(F.xxhash64("row"), F.lit(WAYS)))
    sums = rows.groupBy(F.col("of").alias("label"), "way").agg(F.sum("own").alias("part"))
    total = sums.groupBy("label").agg(F.sum("part").alias("label_error")).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1)).cast("array<bigint>")))
    found = rows.join(total, rows["of"].eqNullSafe(total["label"]) & (rows["way"] == total["to"]))
    return found.select(*(F.col("row")[c].alias(c) for c in coded.columns if c != "label_error"), "label_error")
