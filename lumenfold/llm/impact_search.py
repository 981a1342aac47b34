"""Exact top-k search by inner product over an impact-ordered index, score at a time.

The index holds vectors of integers floor(256 * x) in blocks of about 32,000. In a block every dimension has posting
segments: the rows whose component has one sign and one quantised size (its impact). Queries take the segments
of all dimensions in descending order of impact, each adding one number - its own component times the impact - to its
accumulators of a segment's rows. What a row can still gain or lose is known at every point: in each dimension the query's
component times the largest size not yet taken, or times half the width of a quantised size. A query
stops only where that proves that few rows can be among its k best (or after the last segment), and those possible members are
rescored exactly. So no result depends on quantisation, on order or on when it stops.

Spark deals queries in lanes of 512 and meets every block with every lane by an equality join on (block, lane):
a stated query set against all rows, in blocks. A task holds one block and one lane. The k best of each block are ranked by a
window a query.

Defined cases: vectors that are null or empty or hold null or non-finite components (or integers over 2^27), or have another length
than the commonest, take no part, nor do rows without id. Rows that repeat an id and its vector are one row; of
rows that share an id only, each is a query and none is the other's candidate. Ties go to the smaller id. A query with fewer than k
candidates returns them all. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import Workspace, bound_batches
from lumenfold.llm.vectors import integers, matrix

SCALE = 256
#: Rows a block and queries a lane, about: both are dealt by hash. A row's place in its block fits in 16 bits up to 65,536.
BLOCK, LANE = 32_000, 512
#: Steps of impact up to the 99th percentile of a block's components; larger ones go on in the same steps.
STEPS = 10
#: The share of a block's postings after which queries look, impact by impact, whether the rest can be proven needless.
LOOK_FROM = 0.3
#: Queries that go through a block's segments together.
AT_ONCE = 128
#: A query stops once at most this share of a block, beside 8 k rows, can be members.
FEW = 1 / 8
_BYTES = {"ids": np.int64, "x": np.int32, "places": np.uint16, "segments": np.int64}


@dataclass
class Segments:
    """One block's index. ``segments`` has a row for each, in falling order of impact: impact, dimension, sign, first place, end, least and largest size."""

    ids: np.ndarray
    x: np.ndarray
    places: np.ndarray
    segments: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, x: np.ndarray) -> Segments:
        """Rows in order of id; postings by dimension, sign and quantised size."""
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        step = max(1, -(-int(np.quantile(np.abs(x), 0.99)) // STEPS))
        places, segments, at = [], [], 0
        for d in range(x.shape[1]):
            column = x[:, d]
            size = np.abs(column)
            impact = size // step
            signed = (impact + 1) * np.sign(column)
            by_impact = np.argsort(signed, kind="stable")
            cuts = np.flatnonzero(np.diff(signed[by_impact], prepend=signed[by_impact[0]] - 1))
            sizes = size[by_impact]
            for first, end in zip(cuts, np.append(cuts[1:], len(column))):
                row = by_impact[first]
                if column[row]:  # a component of 0 adds nothing
                    part = sizes[first:end]
                    segments.append((impact[row], d, np.sign(column[row]), at + first, at + end, part.min(), part.max()))
            places.append(by_impact)
            at += len(column)
        table = np.array(segments, np.int64).reshape(-1, 7)
        return Segments(ids, x, np.concatenate(places), table[np.lexsort((table[:, 1], -table[:, 0]))])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
        """For each query ids and scores of the k best rows but its own; how many additions and how many exact scores that took.

        Queries go through the segments together, and each leaves when its own proof holds.
        """
        dims = self.x.shape[1]
        impact, d, sign, first, end, least, size = self.segments.T
        middle = (least + size) // 2
        weight = np.abs(queries)
        widest, left = np.zeros(dims, np.int64), np.zeros((len(np.unique(impact)) + 1, dims), np.int64)
        np.maximum.at(widest, d, size - middle)
        starts = np.flatnonzero(np.diff(impact, prepend=-1))
        stops = np.append(starts[1:], len(d))
        for level, (a, b) in reversed(list(enumerate(zip(starts, stops)))):  # the largest size in each dimension from this impact down
            left[level] = left[level + 1]
            np.maximum.at(left[level], d[a:b], size[a:b])
        most = int((weight.max(axis=0, initial=0) * left[0]).sum())
        totals = np.zeros((len(self.ids), len(queries)), np.int32 if most < 1 << 30 else np.int64)
        own = np.searchsorted(self.ids, query_ids), np.searchsorted(self.ids, query_ids, side="right")
        found: list[tuple[np.ndarray, np.ndarray]] = [None] * len(queries)
        asking, adds, rescored, seen = np.arange(len(queries)), 0, 0, 0
        postings = int((end - first).sum())
        for level, (a, b) in enumerate(zip(starts, stops), 1):
            for s in range(a, b):
                places = self.places[first[s] : end[s]]
                rows = totals.take(places, axis=0)
                rows += (queries[asking, d[s]] * (sign[s] * middle[s])).astype(totals.dtype)
                totals[places] = rows
                seen += len(places)
                adds += rows.size
            last = level == len(starts)
            if seen < LOOK_FROM * postings and not last:
                continue
            # In each dimension a total is wrong by the largest size not taken yet at most, or by half the width of those taken.
            doubt = weight[asking] @ np.maximum(left[level], widest)
            stay = []
            for column, q in enumerate(asking):
                members = self._members(totals[:, column], slice(own[0][q], own[1][q]), queries[q], k, int(doubt[column]))
                if last or len(members) <= 8 * k + FEW * len(self.ids):
                    scores = self.x[members] @ queries[q]
                    best = np.argsort(-scores, kind="stable")[:k]  # members are in order of id
                    found[q] = self.ids[members[best]], scores[best]
                    rescored += len(members)
                else:
                    stay.append(column)
            if len(stay) < len(asking):
                asking, totals = asking[stay], np.ascontiguousarray(totals[:, stay])
            if not len(asking):
                break
        for q in asking:  # a block of zeros has no segments
            members = self._members(totals[:, 0], slice(own[0][q], own[1][q]), queries[q], k, 0)
            found[q] = self.ids[members[:k]], np.zeros(min(k, len(members)), np.int64)
        return found, adds, rescored

    def _members(self, totals: np.ndarray, own: slice, query: np.ndarray, k: int, doubt: int) -> np.ndarray:
        """Rows that can be among the k best when each total is right to within ``doubt``.

        k rows that reach a score bound the k-th best from below; those with the highest totals, scored exactly, bound it well.
        """
        masked = totals.astype(np.int64)
        masked[own] = np.iinfo(np.int64).min
        others = len(totals) - (own.stop - own.start)
        if others <= k:
            return np.flatnonzero(masked > np.iinfo(np.int64).min)
        tried = min(2 * k, others)
        high = np.argpartition(masked, len(masked) - tried)[len(masked) - tried :]
        reached = np.sort(self.x[high] @ query)[-k]
        return np.flatnonzero(masked >= reached - doubt)


@dataclass
class Index:
    """A written table (block, ids, x, places, segments), and how many blocks and what length it has."""

    table: DataFrame
    blocks: int
    length: int


def _vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(id, x), each pair once."""
    vectors, length = integers(embeddings.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("id"), "embedding"), "embedding", SCALE, ["id"])
    return vectors.distinct(), length


def build(embeddings: DataFrame, work: Workspace, block: int = BLOCK) -> Index:
    """Indexes every valid row of ``embeddings(vec_id, embedding)``; blocks are dealt by hash of id and vector."""
    bound_batches(embeddings.sparkSession)
    vectors, length = _vectors(embeddings)
    vectors = work.save(vectors, "vectors")
    blocks = max(1, -(-vectors.count() // block))
    schema = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in _BYTES)])

    def one(table: pa.Table) -> pa.Table:
        made = Segments.build(table.column("id").to_numpy(), matrix(table.column("x").combine_chunks(), length))
        held = {c: pa.array([np.ascontiguousarray(getattr(made, c), kind).tobytes()], pa.binary()) for c, kind in _BYTES.items()}
        return pa.table({"block": table.column("block").slice(0, 1)} | held)

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)))
    index = work.save(dealt.groupBy("block").applyInArrow(one, schema), "index")
    work.drop("vectors")
    return Index(index, blocks, length)


def search(index: Index, queries: DataFrame, k: int = 5, lane: int = LANE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``index`` with the highest inner product for each row of ``queries(vec_id, embedding)``."""
    bound_batches(queries.sparkSession)
    asked, length = _vectors(queries)
    lanes = max(1, -(-asked.count() // lane))
    asked = asked.where(F.lit(length == index.length)).withColumn("lane", F.pmod(F.xxhash64("x", "id"), F.lit(lanes)))
    asked = asked.groupBy("lane").agg(F.collect_list("id").alias("id"), F.flatten(F.collect_list("x")).alias("query"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(index.blocks - 1)).cast("array<bigint>")))
    table = index.table.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)).cast("array<bigint>")))
    met = table.join(asked, ["block", "lane"]).select("id", "query", *_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                held = {c: np.frombuffer(batch.column(2 + i)[r].as_buffer(), kind) for i, (c, kind) in enumerate(_BYTES.items())}
                block = Segments(held["ids"], held["x"].astype(np.int64).reshape(-1, length), held["places"].astype(np.int64), held["segments"].reshape(-1, 7))
                ids, flat = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in (0, 1))
                asked = flat.astype(np.int64).reshape(len(ids), length)
                found = [f for at in range(0, len(ids), AT_ONCE) for f in block.search(ids[at : at + AT_ONCE], asked[at : at + AT_ONCE], k)[0]]
                n = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, n)), pa.array(np.repeat(_keys(flat.reshape(len(ids), length)), n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                    names=["query_id", "key", "vec_id", "score"],
                )

    best = met.mapInArrow(run, "query_id bigint, key bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keys(queries: np.ndarray) -> np.ndarray:
    """Tells apart queries that share an id."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(np.ascontiguousarray(q, np.int32).tobytes()) for q in queries], np.uint64).view(np.int64)
