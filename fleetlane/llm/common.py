"""Helpers that several operators share."""

from __future__ import annotations

import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of text that an operator hands back to Spark in one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder's address under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing on a single machine, as in tests, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='fleetlane-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame, shuffles: bool = True) -> None:
    """Deletes what stored() wrote for these tables; nothing that is still to run may read them.

    Shuffle files of jobs that have ended go when the driver's JVM collects its garbage, which a driver with much
    memory rarely does by itself; so it is asked to, unless there are few.
    """
    for df in tables:
        fs, root = open_fs(df.stored_at)
        fs.delete_dir(root)
    if tables and shuffles:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def open_fs(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's address (file:, hdfs:, s3:, gs: or a plain path) and the path in it."""
    if "://" not in address and address.startswith("file:"):
        address = "file://" + address[5:]
    return pafs.FileSystem.from_uri(address)


def slices(batches: Iterator[pa.RecordBatch], sized_by: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has few rows and at most so many bytes of the column sized_by (or a single row)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(sized_by))
        lengths = [n or 0 for n in pa.compute.binary_length(col).to_pylist()]
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and (total + n > most or i - start >= BATCH_ROWS):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def strings_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: What per_worker() keeps at a time: a worker's next tasks are mostly of the same operator.
KEPT_OF_WORKER = 3


def per_worker(key, make):
    """make()'s result, kept for all tasks of a Python worker until others have taken its place."""
    kept = sys.modules.setdefault("fleetlane_worker_cache", types.ModuleType("fleetlane_worker_cache")).__dict__.setdefault("kept", {})
    value = kept.pop(key) if key in kept else make()
    kept[key] = value
    while len(kept) > KEPT_OF_WORKER:
        del kept[next(iter(kept))]
    return value


class Shared:
    """A broadcast whose classes workers needn't be able to import; a worker's tasks share its value."""

    def __init__(self, spark: SparkSession, value):
        self.key, self.packed = uuid.uuid4().hex, spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return per_worker(("shared", self.key), lambda: pickle.loads(self.packed.value))
