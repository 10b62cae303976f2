"""Files that tasks write under temporary names, and a manifest that commits them.

A task writes each file once, under a name no other attempt uses, and reports it only when it is complete,
with its final name. The reports are a table, written by Spark's own commit protocol, so that each file is
reported by one attempt. Tasks then rename the files and write the manifest, a table too; a rename that was
done before is left at that, so a lost executor's work is done again. What failed or speculative attempts left
stays in _temporary and is removed. A reader trusts the manifest alone. Neither names nor files pass the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import open_fs


def temporary() -> str:
    return f"_temporary/{uuid.uuid4().hex}"


def committed(written: DataFrame, out: str, extra=None) -> DataFrame:
    """The manifest of the files that `written` reports (file: temporary name; name: final name; and more), which
    commits them. extra(reports) may add columns before the manifest is written."""
    fs, root = open_fs(out)
    fs.create_dir(root, recursive=True)
    spark = written.sparkSession
    written.write.parquet(f"{out}/_written")
    reports = spark.read.schema(written.schema).parquet(f"{out}/_written")
    reports = extra(reports) if extra else reports

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out)
        for batch in batches:
            for file, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                there = fs.get_file_info([f"{root}/{file}", f"{root}/{name}"])
                if there[0].type == pa.fs.FileType.File:
                    fs.move(f"{root}/{file}", f"{root}/{name}")
                elif there[1].type != pa.fs.FileType.File:
                    raise FileNotFoundError(f"{out}/{file}")
            yield batch

    names = ["file", "name", *(c for c in reports.columns if c not in ("file", "name"))]
    moved = reports.select(*names)
    moved.mapInArrow(run, moved.schema).drop("file").write.parquet(f"{out}/manifest")
    for left in ("_temporary", "_written"):
        if fs.get_file_info(f"{root}/{left}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{root}/{left}")
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/manifest")


def dealt(files: DataFrame) -> DataFrame:
    """A manifest's rows, each in a partition of its own, up to 65,536 of these."""
    return files.repartition(max(1, min(1 << 16, files.count())))
