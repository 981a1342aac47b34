"""Undo histories of editors: the log of edits, undos and redos replayed in blocks of time that compose.

A history is a list of at most MOST states with a cursor. An edit cuts what lies after the cursor and adds a state, whose
oldest goes when there are too many; undo and redo move the cursor within the list. A block of the log is summed up without
knowing the history that it meets: how it moves the cursor before its first edit, for each length of that history, and what
it leaves from its first edit on, for each number of old states that the edit keeps.

The log is dealt by ranges of (clip, seq), so that a long log lies in several tasks and many short ones in one. In a task's
sorted rows only the first clip may have begun elsewhere: it is summed up, BLOCK entries at a time, and every other clip is
replayed as it comes. So there are about as many pieces as clips and tasks, and they are applied one after the other.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MOST = 50
#: Entries of a clip's log that are summed up at once.
BLOCK = 100_000
#: Rows of a batch.
ROWS = 1_000
EDIT, UNDO, REDO = "edit", "undo", "redo"


def advance(states: list, cursor: int, kind: str, state) -> int:
    """One entry of the log applied to a history in place; gives the cursor. Other kinds change nothing."""
    if kind == EDIT:
        del states[cursor + 1 :]
        states.append(state)
        del states[:-MOST]
        return min(cursor + 1, MOST - 1)
    if kind == UNDO:
        return max(0, cursor - 1)
    if kind == REDO:
        return min(len(states) - 1, cursor + 1)
    return cursor


def _moves(kinds: list[str]) -> list[tuple[int, int, int]]:
    """For each length of history up to MOST, undos and redos alone as (by, low, high): the cursor moves by that, kept between them."""
    out = []
    for length in range(1, MOST + 1):
        by, low, high = 0, 0, length - 1
        for kind in kinds:
            d = -1 if kind == UNDO else 1 if kind == REDO else 0
            by, low, high = by + d, min(max(low + d, 0), length - 1), min(max(high + d, 0), length - 1)
        out.append((by, low, high))
    return out


def summarise(kinds: list[str], states: list) -> dict:
    """What a block of the log does to any history: ``moves`` before its first edit, and ``left`` by the number of states that this keeps.

    ``left`` holds (first old state kept, how many, new states, cursor).
    """
    first = next((i for i, k in enumerate(kinds) if k == EDIT), len(kinds))
    left = []
    if first < len(kinds):
        for kept in range(1, MOST + 1):
            own, cursor = [("old", i) for i in range(kept)], kept - 1
            for kind, state in zip(kinds[first:], states[first:]):
                cursor = advance(own, cursor, kind, ("new", state))
            old = [i for what, i in own if what == "old"]
            left.append((old[0] if old else 0, len(old), [s for what, s in own if what == "new"], cursor))
    return {"moves": _moves(kinds[:first]), "left": left}


def apply(states: list, cursor: int, summary: dict) -> tuple[list, int]:
    """A history after a block."""
    by, low, high = summary["moves"][len(states) - 1]
    cursor = min(max(cursor + by, low), high)
    if not summary["left"]:
        return states, cursor
    first, n, new, after = summary["left"][cursor]
    return [*states[first : first + n], *new], after


def pieces(log: DataFrame, first=0, block: int = BLOCK) -> DataFrame:
    """(clip_id, seq, piece): what each task's part of a clip's log(clip_id, seq, kind, state) does, from ``seq`` on, as a history or as summaries."""
    by = ["clip_id", "seq"]
    rows = log.select(*by, "kind", F.col("state").cast("bigint").alias("state"))
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)

    def made(entries: Iterator[tuple]) -> Iterator[tuple]:
        for nth, (key, run) in enumerate(groupby(entries, itemgetter(0))):
            if nth == 0:
                while part := list(islice(run, block)):
                    _, at, kinds, states = zip(*part)
                    yield key, at[0], pickle.dumps(summarise(list(kinds), list(states)))
                continue
            states, cursor, at = [first], 0, None
            for _, seq, kind, state in run:
                at = seq if at is None else at
                cursor = advance(states, cursor, kind, state)
            yield key, at, pickle.dumps((states, cursor))

    return _by_rows(rows, made, StructType([*rows.select(*by).schema, *StructType.fromDDL("piece binary")]))


def replay(log: DataFrame, first=0, block: int = BLOCK) -> DataFrame:
    """(clip_id, states, cursor, current): the history of each clip after its log(clip_id, seq, kind, state), by seq.

    It begins with the state ``first``; ``state`` is a whole number that stands for an edit's timeline, such as its place where
    timelines are stored. seq numbers the log's entries, each once.
    """

    def applied(found: Iterator[tuple]) -> Iterator[tuple]:
        for key, run in groupby(found, itemgetter(0)):
            states, cursor = [first], 0
            for *_, piece in run:
                piece = pickle.loads(piece)
                states, cursor = apply(states, cursor, piece) if isinstance(piece, dict) else piece
            yield key, states, cursor, states[cursor]

    found = pieces(log, first, block).repartition("clip_id").sortWithinPartitions("clip_id", "seq")
    return _by_rows(found, applied, StructType([found.schema["clip_id"], *StructType.fromDDL("states array<bigint>, cursor int, current bigint")]))


def _by_rows(frame: DataFrame, made: Callable[[Iterator[tuple]], Iterator[tuple]], out: StructType) -> DataFrame:
    """``made`` over the rows of each partition as they come; ROWS of what it gives are a batch."""
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = made(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        while part := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    return frame.mapInArrow(run, out)
