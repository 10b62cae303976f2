"""Intervals and edges of device series in event time: parking, trips, overspeed, ignition, fences, idling,
connectivity. Streaming forms of the same rules are in fleetlane.streaming."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlane.functions.geo import fence_coordinates, finite, in_circle, in_polygon, jump_guard
from fleetlane.functions.text import power_event

from .sequence import before, folded, paired, so_far, timed, window

#: Fixed values of the events.
PARK_KMH, RELEASE_KMH, TRIP_GAP_MIN, IDLE_MS, ACC_MS = 1.0, 5.0, 1.0, 300_000, 5_000
ENTER, EXIT, FENCE_OVERSPEED = 1000, 1001, 1002
IMEI = ("imei",)


def _ordered(*names: str) -> Column:
    return F.struct("t", "position_id", *names)


def parking_events(points: DataFrame, open_kmh: float = PARK_KMH, release_kmh: float = RELEASE_KMH) -> DataFrame:
    """Stops that open at a speed of open_kmh or less and that the first speed of release_kmh or more ends; that
    point gives the end values. Stops of 0 seconds go. Points without time or finite coordinates are skipped; a
    null coordinate counts as 0."""
    rows = timed(points).filter("t is not null").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("latitude", "longitude")})
    rows = rows.filter(finite(F.col("latitude"), F.col("longitude")))
    epoch = F.coalesce(F.count_if(F.col("speed") >= release_kmh).over(before(IMEI)), F.lit(0))
    rows = rows.withColumn("epoch", epoch)
    opened = F.max((F.col("speed") <= open_kmh).cast("int")).over(so_far(("imei", "epoch")))
    rows = rows.withColumn("inside", opened).filter("inside = 1")
    out = rows.groupBy("imei", "epoch").agg(F.min(_ordered("latitude", "longitude", "speed")).alias("a"), F.max(_ordered("latitude", "longitude", "speed")).alias("b"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"))
    out = out.withColumn("duration_seconds", F.floor((F.col("b.t") - F.col("a.t")) / 1000.0 + 0.5).cast("long")).filter("duration_seconds > 0")
    return out.select("imei", F.timestamp_millis("a.t").alias("start_at"), F.timestamp_millis("b.t").alias("end_at"), *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("a", "start"), ("b", "end")) for c in ("latitude", "longitude", "speed")], "min_speed", "max_speed", "duration_seconds")


def replace_range(old: DataFrame, new: DataFrame, keys: DataFrame, start: Column, end: Column, at: str = "start_at") -> DataFrame:
    """A rebuilt table: rows of old whose device is among keys and whose `at` is within [start, end] go, new ones come."""
    stale = F.col(at).between(start, end)
    kept = old.filter(~stale).unionByName(old.filter(stale).join(keys.select("imei").distinct(), "imei", "left_anti").select(*old.columns))
    return kept.unionByName(new.select(*old.columns))


def trips(points: DataFrame, gap_min: float = TRIP_GAP_MIN) -> DataFrame:
    """A trip begins at a moving point that is the first one, or that follows a standing point and is gap_min or
    more minutes after the last moving one; it ends at its last moving point. The last trip is open."""
    rows = paired(timed(points))
    moving = F.col("speed") > 0
    rows = rows.withColumn("moved", F.max(F.when(moving, F.col("t"))).over(before(IMEI)))
    new = moving & (F.col("moved").isNull() | ((F.col("ps") == 0) & (F.abs(F.col("t") - F.col("moved")) / 60000.0 >= gap_min)))
    rows = rows.withColumn("trip", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(so_far(IMEI))).filter(moving)
    out = rows.groupBy("imei", "trip").agg(F.min(_ordered("latitude", "longitude")).alias("a"), F.max(_ordered("latitude", "longitude")).alias("b"), F.sum("jump.distance_km").alias("distance_km"))
    next_start = F.lead("a.t").over(Window.partitionBy("imei").orderBy("trip"))
    out = out.withColumn("next", next_start)
    loc = lambda s: F.struct(F.col(f"{s}.latitude").alias("lat"), F.col(f"{s}.longitude").alias("lon"))
    return out.select("imei", "trip", F.timestamp_millis("a.t").alias("start_at"), F.timestamp_millis("b.t").alias("end_at"), loc("a").alias("start_loc"), loc("b").alias("end_loc"), "distance_km", ((F.col("b.t") - F.col("a.t")) / 60000.0).alias("duration_min"), (F.abs(F.col("next") - F.col("b.t")) / 60000.0).alias("gap_after_min"), F.col("next").isNull().alias("is_open"))


def overspeed_sessions(points: DataFrame, limits: DataFrame) -> DataFrame:
    """Closed sessions over a device's limit (imei, limit_kmh; none or not over 0: no limit).

    A lowspeed alarm is not over, an overspeed alarm is, with limit 0 where there is none; other points
    without a limit are ignored. A session ends at its last point that is over, once one comes that isn't.
    """
    own = limits.filter("limit_kmh > 0").select("imei", F.col("limit_kmh").cast("double").alias("limit_kmh"))
    alarm = F.lower(F.regexp_replace(F.coalesce("alarm", F.lit("")), r"\s+", ""))
    rows = timed(points).join(own, "imei", "left").withColumn("alarm", alarm)
    over = F.when(F.col("alarm") == "lowspeed", False).when(F.col("alarm") == "overspeed", True).when(F.col("limit_kmh").isNotNull(), F.col("speed") > F.col("limit_kmh"))
    rows = rows.withColumns({"over": over, "limit_kmh": F.coalesce("limit_kmh", F.lit(0.0))}).filter("over is not null")
    rows = rows.withColumn("session", F.count_if(~F.col("over")).over(so_far(IMEI)))
    ends = F.count_if(~F.col("over")).over(Window.partitionBy(*IMEI))
    rows = rows.withColumn("ends", ends).filter("over and session < ends")
    at = F.when(finite(F.col("latitude"), F.col("longitude")), F.struct("t", "position_id", "latitude", "longitude"))
    out = rows.groupBy("imei", "session").agg(F.min(_ordered("latitude", "longitude", "limit_kmh")).alias("a"), F.max(_ordered()).alias("b"), F.max(at).alias("at"), F.max("speed").alias("most"))
    spot = lambda s, t: F.struct(F.col(f"{s}.latitude").alias("lat"), F.col(f"{s}.longitude").alias("lon"), F.col(t).alias("t"))
    km = jump_guard(spot("a", "a.t"), spot("at", "b.t"))["distance_km"]
    return out.select("imei", F.timestamp_millis("a.t").alias("start_time"), F.timestamp_millis("b.t").alias("end_time"), F.round("most", 1).alias("speed_kmh"), F.col("a.limit_kmh").alias("speed_limit_kmh"), F.floor((F.col("b.t") - F.col("a.t")) / 1000.0 + 0.5).cast("long").alias("duration_sec"), F.round(km, 3).alias("distance_km"))


def acc_samples(points: DataFrame) -> DataFrame:
    """Points with acc: a power alarm beats ignition; off while moving is on; null says nothing."""
    power = power_event(F.col("alarm"))
    acc = F.coalesce(power, F.col("ignition"))
    acc = F.when(~acc & (F.coalesce("speed", F.lit(0.0)) > 0), True).otherwise(acc)
    return points.withColumns({"acc": acc, "triggered_by": F.when(power.isNotNull(), "power").otherwise("ignition")})


def acc_segments(samples: DataFrame, least_ms: int = ACC_MS) -> DataFrame:
    """Closed segments of one ignition state (imei, acc_status, start_time, end_time, duration_sec).

    A change less than least_ms after the segment began is ignored until a later sample repeats it. Samples
    that can't decide anything, being neither a change nor soon after one, go before a device's samples are
    folded in their order.
    """
    rows = timed(samples).filter("acc is not null")
    rows = rows.withColumn("edge", ~F.col("acc").eqNullSafe(F.lag("acc").over(window(IMEI))))
    rows = rows.withColumn("since", F.max(F.when(F.col("edge"), F.col("t"))).over(so_far(IMEI)))
    soon = F.coalesce(F.lag(F.col("t") - F.col("since")).over(window(IMEI)) < least_ms + 1000, F.lit(True))
    rows = rows.withColumn("soon", soon).filter("edge or soon")

    def step(s: tuple | None, t: int | None, position_id: int | None, acc: bool) -> tuple:
        if s is None:
            return (acc, t), None
        if acc == s[0] or t is None or s[1] is None or math.floor((t - s[1]) / 1000.0 + 0.5) * 1000 < least_ms:
            return s, None
        return (acc, t), (*s, t)

    out = folded(rows, ("t", "position_id", "acc"), step, [T.StructField("acc", T.BooleanType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    return out.select("imei", F.when(F.col("acc"), "on").otherwise("off").alias("acc_status"), F.timestamp_millis("begin").alias("start_time"), F.timestamp_millis("end").alias("end_time"), F.floor((F.col("end") - F.col("begin")) / 1000.0 + 0.5).cast("long").alias("duration_sec"))


def geofence_events(points: DataFrame, fences: DataFrame) -> DataFrame:
    """Enter (1000), exit (1001) and overspeed (1002) events of each device at its own fences.

    A fence's first observation only seeds its state. fences: imei, id, type (circle, polygon), latitude,
    longitude, radius (m), coordinates ([[lat, lon]]), notify_on_enter, notify_on_exit, speed_limit,
    speed_limit_enabled.
    """
    rows = timed(points).filter(fence_coordinates(F.col("latitude"), F.col("longitude")))
    fence = fences.select("imei", F.struct(*[c for c in fences.columns if c != "imei"]).alias("f")).filter("f.id is not null")
    rows = rows.select("imei", "t", "position_id", "latitude", "longitude", "speed").join(fence, "imei")
    lat, lon, kind = F.col("latitude"), F.col("longitude"), F.lower("f.type")
    inside = F.when(kind == "circle", in_circle(lat, lon, F.col("f.latitude"), F.col("f.longitude"), F.col("f.radius"))).when(kind == "polygon", in_polygon(lat, lon, F.col("f.coordinates"))).otherwise(False)
    keys = ("imei", "fence_id")
    rows = rows.withColumns({"fence_id": F.col("f.id"), "inside": inside})
    first = F.row_number().over(window(keys)) == 1
    over = F.col("inside") & F.coalesce(F.col("f.speed_limit") > 0, F.lit(False)) & F.coalesce(F.col("speed") > F.col("f.speed_limit"), F.lit(False))
    rows = rows.withColumn("over", ~first & over)
    rows = rows.withColumns({"was": F.lag("inside").over(window(keys)), "was_over": F.lag("over").over(window(keys))})
    enabled = F.coalesce(F.col("f.speed_limit_enabled"), F.col("f.speed_limit") != 0, F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    codes = F.array(
        F.when(~F.col("was") & F.col("inside") & yes("f.notify_on_enter"), ENTER),
        F.when(F.col("was") & ~F.col("inside") & yes("f.notify_on_exit"), EXIT),
        F.when(F.col("over") & ~F.col("was_over") & enabled, FENCE_OVERSPEED),
    )
    out = rows.select("imei", "fence_id", "t", "position_id", "speed", F.explode(F.array_compact(codes)).alias("alarm_type"))
    return out.select("imei", "fence_id", F.timestamp_millis("t").alias("at"), "position_id", "speed", "alarm_type")


def live_idle(points: DataFrame, idle_ms: int = IDLE_MS, speed_kmh: float = 0.0) -> DataFrame:
    """One row for each run of ignition on at speed_kmh or less: the first point idle_ms or more after its start."""
    rows = timed(points).withColumn("idle", F.col("ignition").eqNullSafe(True) & (F.col("speed") <= speed_kmh))
    rows = rows.withColumn("epoch", F.count_if(~F.col("idle")).over(so_far(IMEI))).filter("idle")
    rows = rows.withColumn("begin", F.min("t").over(so_far(("imei", "epoch"))))
    late = rows.filter(F.col("t") - F.col("begin") >= idle_ms)
    out = late.groupBy("imei", "epoch").agg(F.min(_ordered("begin")).alias("p"))
    return out.select("imei", F.timestamp_millis("p.begin").alias("idle_since"), F.timestamp_millis("p.t").alias("notified_at"), F.col("p.position_id").alias("position_id"))


def connectivity_intervals(changes: DataFrame) -> DataFrame:
    """Offline intervals of status changes (imei, packet_date, position_id, online; null says nothing). An interval opens at
    an online device's first offline row and the next online row closes it; the last may be open."""
    rows = timed(changes.withColumn("speed", F.lit(0.0))).filter("online is not null")
    rows = rows.withColumn("was", F.lag("online").over(window(IMEI))).filter("was is not null and was <> online")
    rows = rows.withColumn("end", F.lead("t").over(window(IMEI))).filter("not online")
    seconds = F.when(F.col("end").isNotNull(), F.greatest(F.floor((F.col("end") - F.col("t")) / 1000.0), F.lit(0)).cast("long"))
    return rows.select("imei", F.timestamp_millis("t").alias("start_at"), F.timestamp_millis("end").alias("end_at"), seconds.alias("duration_sec"), F.col("end").isNull().alias("is_open"))
