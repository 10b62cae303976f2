"""Ordered device series: windows, pairs and runs that reports and events share.

Points have imei, packet_date, latitude, longitude, speed, ignition and position_id; a series is ordered
by (packet_date, position_id). Within one operator all windows have the same partitioning, so Spark
exchanges and sorts the points once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlane.functions.clock import ZONE, local_date, millis
from fleetlane.functions.geo import coordinates, haversine_km, jump_guard

ORDER = ("t", "position_id")


def window(keys: tuple[str, ...] = ("imei",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*ORDER)


def so_far(keys: tuple[str, ...]) -> WindowSpec:
    return window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(keys: tuple[str, ...]) -> WindowSpec:
    return window(keys).rowsBetween(Window.unboundedPreceding, -1)


def timed(points: DataFrame) -> DataFrame:
    """Points with t, milliseconds of their instant, and a speed that is never null."""
    return points.withColumn("t", millis(F.col("packet_date"))).withColumn("speed", F.coalesce(F.col("speed").cast("double"), F.lit(0.0)))


def by_day(points: DataFrame, zone: str = ZONE) -> DataFrame:
    """timed() points with `day`, their local date."""
    return timed(points).withColumn("day", local_date(F.col("packet_date"), zone))


def in_range(points: DataFrame, start: Column, end: Column) -> DataFrame:
    """The half-open range [start, end) of event time; the filter reaches the scan."""
    return points.filter((F.col("packet_date") >= start) & (F.col("packet_date") < end))


def place() -> Column:
    return F.struct(F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"), "t")


def paired(points: DataFrame, keys: tuple[str, ...] = ("imei",)) -> DataFrame:
    """timed points with pt, ps (time and speed of the point before) and jump (the guarded distance from it)."""
    w = window(keys)
    out = points.withColumns({"pt": F.lag("t").over(w), "ps": F.lag("speed").over(w), "prev": F.lag(place()).over(w)})
    out = out.withColumn("__raw", haversine_km(*coordinates(F.col("prev"), place())))  # computed once, whatever uses it
    return out.withColumn("jump", jump_guard(F.col("prev"), place(), F.col("__raw"))).drop("prev", "__raw")


def driven_km() -> Column:
    """A pair's distance where it is no jump and either end moves."""
    return F.when(~F.col("jump.is_jump") & ((F.col("ps") > 0) | (F.col("speed") > 0)), F.col("jump.distance_km")).otherwise(0.0)


def runs(points: DataFrame, holds: Column, keys: tuple[str, ...]) -> DataFrame:
    """Points with `x` (whether `holds` is true), and `run`, the number of runs of true begun so far."""
    out = points.withColumn("x", F.coalesce(holds, F.lit(False)))
    begins = F.col("x") & ~F.coalesce(F.lag("x").over(window(keys)), F.lit(False))
    return out.withColumn("run", F.sum(begins.cast("int")).over(so_far(keys)))


def folded(rows: DataFrame, order: tuple[str, ...], step: Callable, fields: list[T.StructField], last: bool = False) -> DataFrame:
    """imei and `fields` of what step(state, *values of order) gives besides the new state, or, with `last`, of the
    state after a device's last row. Sorted rows are streamed; of a device only the state is held (at first None)."""
    schema = T.StructType([rows.schema["imei"], *fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, state, begun = None, None, False
        packed = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k.type) for i, k in enumerate(kinds)], schema=kinds)
        for batch in batches:
            out = []
            for imei, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or imei != device:
                    if last and begun:
                        out.append((device, *state))
                    device, state, begun = imei, None, True
                state, given = step(state, *values)
                if given is not None:
                    out.append((device, *given))
            yield packed(out)
        if last and begun:
            yield packed([(device, *state)])

    return rows.select("imei", *order).repartition("imei").sortWithinPartitions("imei", *order).mapInArrow(run, schema)


def carried(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], uses: tuple[str, ...], step: Callable, fields: list[T.StructField]) -> DataFrame:
    """rows with `fields`, which step(state, *values of `uses`) gives, as a tuple, besides the new state; columns of these
    names are replaced. Each key's rows are streamed in `order`; of a key only the state is held (at first None)."""
    new = {f.name for f in fields}
    kept = [f for f in rows.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            pick = lambda names: zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True)  # noqa: E731, B023
            out = []
            for key, values in zip(pick(keys), pick(uses), strict=True):
                if key != at:
                    at, state = key, None
                state, given = step(state, *values)
                out.append(given)
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            cols += [pa.array([g[i] for g in out], kinds.field(len(kept) + i).type) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
