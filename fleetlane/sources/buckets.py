"""Tables that are updated by copy on write: rows lie in buckets of their keys, a manifest names each bucket's folder.

An upsert writes new folders for the buckets that its rows touch, and then a manifest with the next number; it neither
reads nor writes the others. Readers take the newest manifest that is complete, so they see a table before or after an
upsert; an upsert that fails leaves folders that no manifest names. Two upserts at a time fail but for one, as the
second finds its manifest there.
"""

from __future__ import annotations

import json
import os
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _versions(path: str) -> list[int]:
    """The numbers of complete manifests."""
    fs, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    found = fs.get_file_info(pafs.FileSelector(f"{root}/manifests", recursive=True, allow_not_found=True))
    return sorted(int(f.path.split("/")[-2].removeprefix("v=")) for f in found if f.base_name == "_SUCCESS")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """bucket, folder, rows, keys, buckets and schema of each bucket of a version, of the newest one if none is named."""
    return spark.read.parquet(f"{path}/manifests/v={_versions(path)[-1] if version is None else version:08d}")


def _written(rows: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """The entries of the folders that these rows are written to."""
    folder = f"data-{uuid.uuid4().hex}"
    rows.withColumn("__bucket", _bucket(keys, buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/{folder}")
    counts = rows.sparkSession.read.parquet(f"{path}/{folder}").groupBy(F.col("__bucket").cast("int").alias("bucket")).agg(F.count("*").alias("rows"))
    return counts.select("bucket", F.concat(F.lit(f"{folder}/__bucket="), F.col("bucket").cast("string")).alias("folder"), "rows")


def _commit(entries: DataFrame, path: str, version: int, keys: list[str], buckets: int, schema: T.StructType) -> None:
    about = {"keys": F.lit(json.dumps(keys)), "buckets": F.lit(buckets), "schema": F.lit(schema.json())}
    entries.withColumns(about).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifests/v={version:08d}")


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 256) -> None:
    """A new table of rows, whose keys are unique; buckets rows in the manifest at most."""
    _commit(_written(rows, path, keys, buckets), path, 0, keys, buckets, rows.schema)


def _entries(spark: SparkSession, path: str, version: int | None = None) -> list:
    return manifest(spark, path, version).collect()  # as many rows as buckets


def _rows(spark: SparkSession, path: str, entries: list, schema: T.StructType) -> DataFrame:
    folders = [f"{path}/{e['folder']}" for e in entries]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    entries = _entries(spark, path, version)
    return _rows(spark, path, entries, T.StructType.fromJson(json.loads(entries[0]["schema"]))) if entries else spark.createDataFrame([], T.StructType())


def upsert(new: DataFrame, path: str) -> int:
    """Rows of new take the place of those with equal keys; the number of buckets that were written anew. Of rows of new with
    equal keys any one counts."""
    spark = new.sparkSession
    version = _versions(path)[-1]
    entries = _entries(spark, path, version)
    keys, buckets, schema = json.loads(entries[0]["keys"]), entries[0]["buckets"], T.StructType.fromJson(json.loads(entries[0]["schema"]))
    new = new.select(*schema.names).dropDuplicates(keys)
    touched = {r["b"] for r in new.select(_bucket(keys, buckets).alias("b")).distinct().collect()}  # as many rows as buckets
    if not touched:
        return 0
    old = _rows(spark, path, [e for e in entries if e["bucket"] in touched], schema)
    made = _written(old.join(new.select(*keys), keys, "left_anti").select(*schema.names).unionByName(new), path, keys, buckets)
    kept = manifest(spark, path, version).filter(~F.col("bucket").isin(*touched)).select("bucket", "folder", "rows")
    _commit(kept.unionByName(made), path, version + 1, keys, buckets, schema)
    return len(touched)
