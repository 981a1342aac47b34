"""Tables that are written to: a folder of Parquet parts under numbered manifests, and batches that a stream delivers once.

A manifest lists the parts of every bucket of keys. A writer puts new parts beside the old ones and then makes the next
manifest; making it fails where another writer was first, so nobody overwrites a state that it hasn't read. A change
rewrites the buckets whose keys it holds and leaves the files of all others. Readers see one manifest, old or new.

Files go through Hadoop's file systems, so a folder is any that Spark can write; on a cluster it must be shared.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenfold.operators import catalog

BUCKETS = 64


class StaleWriter(Exception):
    """Another writer has made the version that this one wanted to make."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A local session without it gets a temporary one; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/lumenfold-tables"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Files:
    """Small files of a folder: whole texts that are made once and never changed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def make(self, name: str, text: str) -> bool:
        """Makes a file with all of ``text``, or gives False where there is one: a temporary file is renamed, which only one of two writers can."""
        folder, _, last = name.rpartition("/")
        part = self._path(f"{folder}/.{last}-{uuid.uuid4().hex}".lstrip("/"))
        stream = self.fs.create(part, True)
        stream.write(text.encode())
        stream.close()
        nothing = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(nothing.getClass(), 1)
        options[0] = nothing
        try:
            self.context.rename(part, self._path(name), options)
            return True
        except Exception as error:
            self.fs.delete(part, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Manifest:
    """One version: its parts by bucket, and the last batch of each stream that it holds."""

    version: int
    schema: str
    key: list[str]
    buckets: int
    parts: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """A table of one row a key, in BUCKETS parts by hash of the key. Choose as many buckets as make one a task's work."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    @staticmethod
    def create(spark: SparkSession, root: str, rows: DataFrame, key: list[str], buckets: int = BUCKETS) -> VersionedTable:
        """Version 1 of a new table; an error where there is one."""
        table = VersionedTable(spark, root)
        parts = table._write(rows, key, buckets)
        table._commit(Manifest(1, json.dumps(rows.schema.jsonValue()), key, buckets, parts), parts)
        return table

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest, or that of an older version."""
        if version is None:
            found = [n for n in self.files.names("versions") if not n.startswith(".")]
            if not found:
                raise FileNotFoundError(f"no table at {self.root}")
            version = int(found[-1].removesuffix(".json"))
        return Manifest(**json.loads(self.files.read(f"versions/{version:020}.json")))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows of a version, or those of some buckets."""
        m = self.manifest(version)
        return self._rows(m, [p for b, parts in m.parts.items() if buckets is None or int(b) in buckets for p in parts])

    def upsert(self, changes: DataFrame, order: str, expected: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """``changes`` over the table, the last of a key by ``order``; gives the version. Rewrites the buckets that hold their keys."""

        def merged(now: DataFrame, new: DataFrame) -> DataFrame:
            rows = catalog.upsert(now, new, self.manifest().key, order)
            return rows.select(*now.columns)

        return self.rewrite(changes, merged, expected, batch)

    def delete(self, keys: DataFrame, expected: int | None = None) -> int:
        """Without the rows of ``keys``."""

        def kept(now: DataFrame, gone: DataFrame) -> DataFrame:
            return now.join(gone.select(*self.manifest().key), self.manifest().key, "left_anti").select(*now.columns)

        return self.rewrite(keys, kept, expected)

    def rewrite(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], expected: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """The buckets that hold keys of ``changes`` become ``merge(their rows, changes)``; gives the version.

        A batch that the table holds already changes nothing. ``expected`` is the version that the caller has read; a
        newer one is a StaleWriter, as is a version that another writer makes meanwhile.
        """
        m = self.manifest()
        if batch is not None and m.batches.get(batch[0], -1) >= batch[1]:
            return m.version
        if expected is not None and m.version != expected:
            raise StaleWriter(f"version {m.version} instead of {expected}")
        touched = [r.bucket for r in changes.select(self._bucket(m.key, m.buckets)).distinct().collect()]  # at most m.buckets
        now = self._rows(m, [p for b in touched for p in m.parts.get(str(b), [])])
        parts = self._write(merge(now, changes), m.key, m.buckets) if touched else {}
        rest = {b: p for b, p in m.parts.items() if int(b) not in touched}
        return self._commit(Manifest(m.version + 1, m.schema, m.key, m.buckets, rest | parts, m.batches | ({batch[0]: batch[1]} if batch else {})), parts)

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """New rows, beside what is there; another writer's version is no conflict, so it goes on top of that."""
        m = self.manifest()
        parts = self._write(rows.select(*(f.name for f in self._schema(m))), m.key, m.buckets)
        while True:
            if batch is not None and m.batches.get(batch[0], -1) >= batch[1]:
                self._take_back(parts)
                return m.version
            both = {b: m.parts.get(b, []) + parts.get(b, []) for b in m.parts | parts}
            made = Manifest(m.version + 1, m.schema, m.key, m.buckets, both, m.batches | ({batch[0]: batch[1]} if batch else {}))
            try:
                return self._commit(made, {})
            except StaleWriter:
                m = self.manifest()

    def expire(self, keep: int = 1) -> int:
        """Deletes manifests but the newest ``keep`` and the parts that only they list; gives the number of parts. Not while others write."""
        versions = [n for n in self.files.names("versions") if not n.startswith(".")]
        held = {p.split("/")[0] for n in versions[-keep:] for parts in self.manifest(int(n.removesuffix(".json"))).parts.values() for p in parts}
        gone = [n for n in self.files.names("data") if n not in held]
        for n in versions[:-keep]:
            self.files.delete(f"versions/{n}")
        for n in gone:
            self.files.delete(f"data/{n}")
        return len(gone)

    @staticmethod
    def _bucket(key: list[str], buckets: int):
        return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")

    @staticmethod
    def _schema(m: Manifest) -> StructType:
        return StructType.fromJson(json.loads(m.schema))

    def _rows(self, m: Manifest, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self._schema(m))
        return self.spark.read.schema(self._schema(m)).parquet(*(f"{self.root}/data/{p}" for p in parts))

    def _write(self, rows: DataFrame, key: list[str], buckets: int) -> dict[str, list[str]]:
        name = uuid.uuid4().hex
        by = rows.select(self._bucket(key, buckets).alias("_bucket"), "*")
        by.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/data/{name}")
        return {n.split("=")[1]: [f"{name}/{n}"] for n in self.files.names(f"data/{name}") if n.startswith("_bucket=")}

    def _commit(self, m: Manifest, own: dict[str, list[str]]) -> int:
        """Makes the manifest, or takes back what this writer wrote for it (``own``) where another was first."""
        if self.files.make(f"versions/{m.version:020}.json", json.dumps(vars(m))):
            return m.version
        self._take_back(own)
        raise StaleWriter(f"another writer has made version {m.version} of {self.root}")

    def _take_back(self, own: dict[str, list[str]]) -> None:
        for name in {p.split("/")[0] for parts in own.values() for p in parts}:
            self.files.delete(f"data/{name}")


class Deliveries:
    """Batches of a stream, each delivered once: rows are written first, and count from when the batch's number is noted.

    A batch that is run again finds its number and writes nothing; one that was stopped between the two is written anew, and what
    it had left counts for nobody.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def has(self, number: int) -> bool:
        return self.files.read(f"noted/{number}.json") is not None

    def write(self, rows: DataFrame, number: int) -> bool:
        """Whether the batch was delivered now."""
        if self.has(number):
            return False
        name = f"{number}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/rows/{name}")
        return self.files.make(f"noted/{number}.json", json.dumps({"rows": name, "schema": rows.schema.jsonValue()}))

    def note(self, name: str, value: dict) -> dict:
        """Stores a value once; gives the stored one, whoever stored it."""
        self.files.make(f"{name}.json", json.dumps(value))
        return json.loads(self.files.read(f"{name}.json"))

    def read(self) -> DataFrame:
        """All delivered rows, with their batch in ``batch``."""
        noted = {int(n.removesuffix(".json")): json.loads(self.files.read(f"noted/{n}")) for n in self.files.names("noted") if not n.startswith(".")}
        if not noted:
            raise FileNotFoundError(f"nothing was delivered to {self.root}")
        schema = StructType.fromJson(next(iter(noted.values()))["schema"])
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/rows/{v['rows']}" for v in noted.values()))
        return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/rows/(-?\d+)-[0-9a-f]+/", 1).cast("bigint"))
