"""From landed JSON files to the raw archive and the track table, and to status and event tables."""

from __future__ import annotations

import json
import os

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from fleetlane.functions.text import is_blank
from fleetlane.operators import live, lookups
from fleetlane.sources import ingest

from . import machines, trackers

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accepted(messages: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Normalized positions without reject reason. Those with a runtime id alone get their device's imei, where a table of
    devices (imei, runtime_id) has it."""
    rows = ingest.checked(ingest.normalized(ingest.positions(messages))).filter("reject_reason is null")
    return rows if devices is None else lookups.with_runtime_ids(rows, devices)


def unresolved(messages: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Accepted positions whose device isn't known yet, to be tried again once it is."""
    return accepted(messages, devices).filter("imei is null").select("runtime_device_id", "position_id", "fix_time", "item")


def rejected(messages: DataFrame) -> DataFrame:
    rows = ingest.checked(ingest.normalized(ingest.positions(messages))).filter("reject_reason is not null")
    return rows.select("reject_reason", "imei", "runtime_device_id", "item")


def track(messages: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Accepted positions as track points; late ones too, as the archive takes all. One without any time gets that of
    its arrival."""
    rows = accepted(messages, devices).filter("imei is not null")
    kind = F.when(~is_blank(F.col("result")), "command").when(F.col("alarm").isNotNull(), "alarm").otherwise("gps")
    rows = rows.withColumns({"type": kind, "packet_date": F.coalesce(F.timestamp_millis(F.coalesce("fix_time", "device_time", "server_time")), F.current_timestamp()), "direction": F.col("course")})
    return ingest.track_points(rows).withColumn("day", F.to_date("packet_date"))


def append(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Appends all that is there to Parquet, each row once, and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.partitionBy(partition) if partition else writer).trigger(availableNow=True).start()


def archive_and_track(spark: SparkSession, landing: str, out: str, checkpoints: str, devices: DataFrame | None = None) -> list[StreamingQuery]:
    """The file streams of a landing folder: raw archive, track points, positions of unknown devices, rejects, and lines
    that aren't JSON."""
    messages = ingest.stream_messages(spark, landing)
    return [
        append(ingest.raw_archive(messages, F.current_timestamp()), f"{out}/raw", f"{checkpoints}/raw"),
        append(track(messages, devices), f"{out}/track", f"{checkpoints}/track", "day"),
        append(unresolved(messages, devices), f"{out}/unresolved", f"{checkpoints}/unresolved"),
        append(rejected(messages), f"{out}/rejects", f"{checkpoints}/rejects"),
        append(messages.filter(~ingest.is_json(F.col("body"))).select("body"), f"{out}/quarantine", f"{checkpoints}/quarantine"),
    ]


def keep_status(stream: DataFrame, checkpoint: str, initial: DataFrame | None = None) -> StreamingQuery:
    """Keeps each device's status in state, by the rules of live.status_table(): messages are imei, seq, and what
    live.STATUS_MESSAGE names. The table is read from the state (status()); nothing is rewritten, and one version is on
    the disk besides those that the state store keeps to recover."""
    rows = machines.run(live.status_message(stream), trackers.StatusTable(), initial=initial)
    return rows.writeStream.format("noop").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The status table of keep_status() after its last micro-batch."""
    return trackers.status_rows(spark, checkpoint)


def waiting(stream: DataFrame, devices: DataFrame, keep_ms: int = 600_000) -> DataFrame:
    """Positions without imei (a stream of runtime_device_id, fix_time, position_id, item) with the imei that a stream of devices
    (imei, runtime_id) tells, before or after them; `why` tells those that waited in vain for keep_ms."""
    key = F.col("runtime_device_id").try_cast("double").cast("string").alias("runtime_id")
    rows = stream.select(key, F.col("fix_time").alias("at"), "position_id", "item")
    known = devices.select(F.col("runtime_id").cast("double").cast("string").alias("runtime_id"), "imei")
    return machines.run(trackers.merged(known, rows), trackers.Waiters(keep_ms), "runtime_id", "ProcessingTime")


class Progress(StreamingQueryListener):
    """Appends what each micro-batch of the session's streams did to a table: a JSON file for each, which no other run names.

    Columns: query, run, batch, at, rows_in, rows_out, state_rows, late_rows, took_ms, watermark and error (of an end)."""

    SCHEMA = "query string, run string, batch long, at string, rows_in long, rows_out long, state_rows long, late_rows long, took_ms long, watermark string, error string"

    def __init__(self, path: str):
        self.path = path

    def _append(self, name: str, row: dict) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{os.path.abspath(self.path)}")
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_{name}.tmp") as f:
            f.write(json.dumps(row).encode() + b"\n")
        fs.move(f"{root}/_{name}.tmp", f"{root}/{name}.json")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = p.stateOperators
        row = {"query": p.name or str(p.id), "run": str(p.runId), "batch": p.batchId, "at": p.timestamp, "rows_in": p.numInputRows, "rows_out": p.sink.numOutputRows}
        row |= {"state_rows": sum(s.numRowsTotal for s in states), "late_rows": sum(s.numRowsDroppedByWatermark for s in states), "took_ms": p.durationMs.get("triggerExecution"), "watermark": p.eventTime.get("watermark")}
        self._append(f"{p.runId}-{p.batchId}", row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._append(f"{event.runId}-end", {"query": str(event.id), "run": str(event.runId), "error": event.exception})


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The table that a Progress listener appends to."""
    return spark.read.schema(Progress.SCHEMA).json(path)


def outbox(events: DataFrame, title: str) -> DataFrame:
    """Notifications to send: a title and the event's values as text; nothing is sent from here."""
    return events.select("imei", F.lit(title).alias("title"), F.map_from_arrays(F.array(*[F.lit(c) for c in events.columns]), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in events.columns])).alias("data"))
