"""What the operators share: Arrow column helpers and written intermediate tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What separates words, as a Java and Python regular expression class.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A local session without it gets a temporary folder; on a cluster its executors would each write to their own
    disk and rows would be missed, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")

        folder = f"file://{tempfile.gettempdir()}/lumenfold-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: About how many bytes of a batch a Python worker works on at once.
PIECE_BYTES = 2 << 20
#: Rows and bytes of an Arrow batch, where the session sets nothing: with Spark's 10,000 rows, texts of some KB
#: make batches of tens of MB in the executor's memory beside its heap, for each task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Sets BATCH in a session that has Spark's own values."""
    for name, value in BATCH.items():
        if spark.conf.get(name, "10000") == "10000":
            spark.conf.set(name, value)


#: Deletes an execution's shuffle files when it ends, and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block only."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


class Workspace:
    """Tables written to the shared folder to cut lineage; every one outlives the executor that wrote it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        """Writes ``frame`` and reads it again; the shuffle files of its making are gone once it is written."""
        path = f"{self.root}/{name}"
        with setting(self.spark, CLEANUP, "true"):
            frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def add_columns(
    frame: DataFrame, inputs: list[str], added: T.StructType, compute: Callable[..., list], keep: list[str] | None = None
) -> DataFrame:
    """``frame`` (or its ``keep`` columns) with the ``added`` columns computed batch by batch from ``inputs``.

    ``compute`` gets one Arrow array per input and returns one array per added column. A column of ``frame``
    that has the name of an added one is replaced.
    """
    bound_batches(frame.sparkSession)
    names = set(added.fieldNames())
    kept = [c for c in (frame.columns if keep is None else keep) if c not in names]
    carried = [c for c in inputs if c not in kept]
    schema = T.StructType([frame.schema[c] for c in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, whole.num_rows * PIECE_BYTES // max(whole.nbytes, 1))
            for at in range(0, whole.num_rows, rows):  # in pieces, which bounds what a worker holds
                batch = whole.slice(at, rows)
                made = compute(*(batch.column(batch.schema.get_field_index(c)) for c in inputs))
                arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(x) if not isinstance(x, pa.Array) else x for x in made]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return frame.select(*kept, *carried).mapInArrow(run, schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and its n + 1 offsets; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and len(texts) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows that hold about ``most`` bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j
