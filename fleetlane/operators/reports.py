"""Mileage, travel, idle and static reports. Each takes the point table once and exchanges it once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlane.functions.clock import ZONE
from fleetlane.functions.geo import km_to_miles

from .sequence import ORDER, before, by_day, driven_km, paired, runs, so_far, timed, window

#: Fixed values of the reports.
STOP_MS, OVERSPEED_KMH, STATIC_KM = 180_000, 120.0, 0.5
THRESHOLDS_MIN = (1, 3, 5, 10, 15, 30, 60)
DAY = ("imei", "day")


def mileage(points: DataFrame) -> DataFrame:
    """imei and km over the whole series."""
    return paired(timed(points)).groupBy("imei").agg(F.sum(driven_km()).alias("km"))


def prior_points(points: DataFrame, cursors: DataFrame) -> DataFrame:
    """The latest point at or before each device's cursor (imei, last_at), as of it."""
    near = timed(points).join(cursors.select("imei", "last_at"), "imei").filter("packet_date <= last_at")
    last = F.max_by(F.struct("t", "position_id", "packet_date", "latitude", "longitude", "speed"), F.struct("t", "position_id")).alias("last")
    return near.groupBy("imei").agg(last).select("imei", "last.*")


#: Columns of the status table with the last point that mileage has counted.
LAST_POINT = ("last_point_at", "last_latitude", "last_longitude", "last_speed")


def _since_last_points(points: DataFrame, status: DataFrame, since: Column | None) -> DataFrame:
    """timed points after the cursors of devices whose last point is known, and that point, with `new`."""
    known = status.filter("last_point_at is not null")
    rows = points if since is None else points.filter(F.col("packet_date") > since)
    cols = ["imei", "packet_date", "latitude", "longitude", "speed", "position_id", "t"]
    rows = timed(rows).join(known.select("imei", F.coalesce("last_mileage_at", F.lit(0).cast("timestamp")).alias("last_at")), "imei").filter("packet_date > last_at")
    last = known.select("imei", F.col("last_point_at").alias("packet_date"), *[F.col(f"last_{c}").alias(c) for c in ("latitude", "longitude", "speed")], F.lit(None).cast("long").alias("position_id"))
    return rows.select(*cols, F.lit(True).alias("new")).unionByName(timed(last).select(*cols, F.lit(False).alias("new")))


def _since_cursors(points: DataFrame, status: DataFrame) -> DataFrame:
    """timed points after each device's cursor, and the one before them, with `new`; without a cursor all are new."""
    cursors = status.select("imei", F.col("last_mileage_at").alias("last_at"))
    rows = timed(points).join(cursors, "imei", "left").withColumn("new", F.col("packet_date") > F.coalesce("last_at", F.lit(0).cast("timestamp")))
    rows = rows.filter(F.col("new") | F.coalesce(F.col("packet_date") <= F.col("last_at"), F.lit(False)))
    return rows.withColumn("keep", F.col("new") | F.coalesce(F.lead("new").over(window()), F.lit(False))).filter("keep").select("imei", "packet_date", "latitude", "longitude", "speed", "position_id", "t", "new")


def incremental_mileage(points: DataFrame, status: DataFrame, since: Column | None = None) -> DataFrame:
    """status (imei, last_mileage_at, km_total, miles_total) after the points that came after each cursor.

    The prior point is the boundary of the first pair. Totals and cursor move only if the distance is over
    0, so standing points are read again; devices without a status row begin with the epoch and 0.

    Where status also has LAST_POINT, that is a device's prior point and moves with the cursor, and of the points only
    those after the cursor are used. Then `since`, the earliest cursor of such devices, keeps older points from being
    read for them: the filter reaches the scan and its partitions. Devices without a status row, or without a last point
    in it, take the other path: their prior point is looked for among all points.
    """
    carries = set(LAST_POINT) <= set(status.columns)
    if carries:
        lacking = points.join(status.filter("last_point_at is not null").select("imei"), "imei", "left_anti")
        rows = _since_last_points(points, status, since).unionByName(_since_cursors(lacking, status))
    else:
        rows = _since_cursors(points, status)
    order = F.struct("t", "position_id")
    newest = F.max_by(F.when(F.col("new"), F.struct("packet_date", "latitude", "longitude", "speed")), F.when(F.col("new"), order))
    sums = paired(rows).groupBy("imei").agg(F.sum(F.when(F.col("new"), driven_km()).otherwise(0.0)).alias("added"), newest.alias("seen"))
    out = status.join(sums, "imei", "full")
    moved = F.coalesce(F.col("added"), F.lit(0.0)) > 0
    total = lambda c, add: F.coalesce(F.col(c), F.lit(0.0)) + F.when(moved, add).otherwise(0.0)
    newer = lambda c, new: F.when(moved, F.col(f"seen.{new}")).otherwise(F.col(c)).alias(c)
    last = [newer(c, new) for c, new in zip(LAST_POINT, ("packet_date", "latitude", "longitude", "speed"), strict=True)] if carries else []
    return out.select("imei", newer("last_mileage_at", "packet_date"), total("km_total", F.col("added")).alias("km_total"), total("miles_total", km_to_miles(F.col("added"))).alias("miles_total"), *last)


#: Parts of the devices into which a sliced table's days are divided.
PARTS = 64


def _part(imei: Column, parts: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64(imei), F.lit(parts)).cast("string"), 5, "0")


def sliced(points: DataFrame, parts: int = PARTS) -> DataFrame:
    """points with `slice`, a UTC day and a part of the devices, to partition a track table by."""
    return points.withColumn("slice", F.concat(F.date_format("packet_date", "yyyyMMdd"), F.lit("-"), _part(F.col("imei"), parts)))


def wanted_slices(devices: DataFrame, status: DataFrame, first: Column, until: Column, parts: int = PARTS) -> DataFrame:
    """The slices that incremental_mileage() needs for devices (imei): of each part of them, from the day of its earliest cursor
    to that of `until`; from the day of `first` where one of its devices has no cursor or no last point. At most as many
    rows as a table of these days has partitions."""
    known = status.filter("last_point_at is not null").select("imei", F.to_date("last_mileage_at").alias("day"))
    rows = devices.select("imei").filter(F.length("imei") > 0).join(known, "imei", "left")
    begins = rows.groupBy(_part(F.col("imei"), parts).alias("part")).agg(F.min(F.coalesce("day", F.to_date(first))).alias("day"))
    days = begins.filter(F.col("day") <= F.to_date(until)).select("part", F.explode(F.sequence("day", F.to_date(until))).alias("day"))
    return days.select(F.concat(F.date_format("day", "yyyyMMdd"), F.lit("-"), "part").alias("slice"))


def incremental_mileage_sliced(points: DataFrame, devices: DataFrame, status: DataFrame, first: Column, until: Column, parts: int = PARTS) -> DataFrame:
    """incremental_mileage() of a track table that is partitioned by sliced(): only the partitions that devices' cursors ask
    for are read, which Spark finds out as it runs. Devices that aren't listed in `devices` are read as far as their part is."""
    wanted = F.broadcast(wanted_slices(devices, status, first, until, parts))
    return incremental_mileage(points.join(wanted, "slice", "left_semi").drop("slice"), status)


def daily_points(points: DataFrame, zone: str = ZONE) -> DataFrame:
    """imei, day, km, fast_points, stop_minutes and stop_count of each local day with points.

    A stop is a run of speed 0 that a later point ends after 3 minutes or more; a run that the day's end
    leaves open counts whatever its length.
    """
    rows = paired(by_day(points, zone), DAY).withColumn("nt", F.lead("t").over(window(DAY)))
    rows = runs(rows, F.col("speed") == 0, DAY)
    by_run = rows.groupBy("imei", "day", "run").agg(
        F.sum(driven_km()).alias("km"),
        F.count_if(F.col("speed") > OVERSPEED_KMH).alias("fast"),
        F.sum(F.when(F.col("x"), F.greatest(F.coalesce(F.col("nt") - F.col("t"), F.lit(0)), F.lit(0)))).alias("still"),
        F.min(F.when(F.col("x"), F.col("t"))).alias("begin"),
        F.max(F.when(F.col("x"), F.col("nt"))).alias("end"),
        F.coalesce(F.bool_or(F.col("x") & F.col("nt").isNull()), F.lit(False)).alias("open"),
    )
    stops = F.count_if(F.col("open") | (F.col("end") - F.col("begin") >= STOP_MS))
    return by_run.groupBy("imei", "day").agg(F.sum("km").alias("km"), F.sum("fast").alias("fast_points"), (F.coalesce(F.sum("still"), F.lit(0)) / 60000.0).alias("stop_minutes"), stops.alias("stop_count"))


def daily_mileage(points: DataFrame, acc_events: DataFrame | None = None, alerts: DataFrame | None = None, overspeed_source: str = "alerts", zone: str = ZONE) -> DataFrame:
    """The daily report: km, miles, stops, and counts of ignition and overspeed events that start on the day.

    acc_events has imei, acc_status and start_time, alerts has imei and start_time. With overspeed_source
    `legacy_max`, the larger of alerts and points over 120 km/h counts.
    """
    out = daily_points(points, zone)
    local = F.to_date(F.from_utc_timestamp("start_time", zone)).alias("day")
    if acc_events is not None:
        acc = acc_events.select("imei", local, "acc_status").groupBy("imei", "day").agg(F.count_if(F.col("acc_status") == "on").alias("acc_on_count"), F.count_if(F.col("acc_status") == "off").alias("acc_off_count"))
        out = out.join(acc, ["imei", "day"], "left")
    else:
        out = out.withColumns({"acc_on_count": F.lit(0), "acc_off_count": F.lit(0)})
    if alerts is not None:
        out = out.join(alerts.select("imei", local).groupBy("imei", "day").agg(F.count("*").alias("alerts")), ["imei", "day"], "left")
    else:
        out = out.withColumn("alerts", F.lit(0))
    alerted = F.coalesce("alerts", F.lit(0)).cast("long")
    counted = F.greatest(F.col("fast_points"), alerted) if overspeed_source == "legacy_max" else alerted
    return out.select("imei", "day", "km", km_to_miles(F.col("km")).alias("miles"), counted.alias("overspeed_count"), "stop_minutes", "stop_count", F.coalesce("acc_on_count", F.lit(0)).cast("long").alias("acc_on_count"), F.coalesce("acc_off_count", F.lit(0)).cast("long").alias("acc_off_count"))


def _travel_rows(points: DataFrame, thresholds: tuple[float, ...], zone: str) -> DataFrame:
    """Points by day and threshold, with `segment`, `new` (whether it opens here), `closing` (whether it has no later point),
    `counted` (whether the pair before belongs to it), `km` of that pair, `stop` (whether a stop of 3 minutes or more ends
    here) and `moved` (the last moving point so far). All windows are by day, so points are sorted once and multiplied after it."""
    w, upto = window(DAY), so_far(DAY)
    moving = F.col("speed") > 0
    km = F.when(~F.col("jump.is_jump"), F.col("jump.distance_km")).otherwise(0.0).alias("km")
    rows = paired(by_day(points, zone), DAY).select(*DAY, *ORDER, "latitude", "longitude", "speed", "pt", "ps", km)
    rows = rows.withColumn("x", F.coalesce(~moving, F.lit(False)))
    begins = F.col("x") & ~F.coalesce(F.lag("x").over(w), F.lit(False))
    rows = rows.withColumn("start", F.when(begins, F.col("t"))).withColumn("start", F.max("start").over(upto))
    rows = rows.withColumn("stood", F.when(F.col("x"), F.col("t") - F.col("start")))
    ends = F.col("x") & ~F.coalesce(F.lead("x").over(w), F.lit(False))
    rows = rows.withColumns({
        "stop": ends & (F.coalesce(F.lead("t").over(w), F.col("t")) - F.col("start") >= STOP_MS),
        "stood_before": F.lag("stood").over(w),
        "moved_before": F.max(F.when(moving, F.lit(1))).over(before(DAY)).isNotNull(),
        "moved": F.last(F.when(moving, F.struct("t", "latitude", "longitude")), ignorenulls=True).over(upto),
    })
    long_stop = [F.coalesce(F.col("stood_before") >= float(m) * 60000, F.lit(False)) for m in thresholds]
    rows = rows.withColumns({f"new{i}": F.coalesce(moving & (~F.col("moved_before") | far), F.lit(False)) for i, far in enumerate(long_stop)})
    rows = rows.withColumns({f"segment{i}": F.sum(F.col(f"new{i}").cast("int")).over(upto) for i in range(len(thresholds))} | {f"closing{i}": F.coalesce(F.lead(f"new{i}").over(w), F.lit(True)) for i in range(len(thresholds))})

    def of(i: int, m: float) -> Column:
        counted = ~F.col(f"new{i}") & ((F.col("ps") > 0) | (moving & ~long_stop[i]))
        return F.struct(F.lit(float(m)).alias("threshold"), F.col(f"segment{i}").alias("segment"), F.col(f"new{i}").alias("new"), F.col(f"closing{i}").alias("closing"), F.coalesce(counted, F.lit(False)).alias("counted"))

    return rows.select(*DAY, "t", "pt", "latitude", "longitude", "km", "stop", "moved", F.inline(F.array(*[of(i, m) for i, m in enumerate(thresholds)])))


def _by_segment(points: DataFrame, thresholds: tuple[float, ...], zone: str) -> DataFrame:
    """One row for each segment, and one with number 0 for the points before the first; stops counts the standing
    runs of 3 minutes or more that end in it, up to the next moving point or the day's last one. Sums hold numbers
    alone, so that rows are hashed and not sorted again."""
    opened = lambda c: F.max(F.when(F.col("new"), F.col(c)))
    closed = lambda c: F.max(F.when(F.col("closing"), F.col(f"moved.{c}")))
    out = _travel_rows(points, thresholds, zone).groupBy("imei", "day", "threshold", "segment").agg(
        *[opened(c).alias(f"first_{c}") for c in ("t", "latitude", "longitude")],
        *[closed(c).alias(f"last_{c}") for c in ("t", "latitude", "longitude")],
        F.sum(F.when(F.col("counted"), F.col("km")).otherwise(0.0)).alias("distance_km"),
        F.sum(F.when(F.col("counted"), F.greatest(F.col("t") - F.col("pt"), F.lit(0)) / 60000.0).otherwise(0.0)).alias("driving_minutes"),
        F.count_if("stop").alias("stops"),
    )
    point = lambda at: F.struct(F.col(f"{at}_t").alias("t"), F.struct(F.col(f"{at}_latitude").alias("latitude"), F.col(f"{at}_longitude").alias("longitude")).alias("at"))
    return out.select("imei", "day", "threshold", "segment", point("first").alias("first"), point("last").alias("last"), "distance_km", "driving_minutes", "stops")


def travel_segments(points: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS_MIN, zone: str = ZONE) -> DataFrame:
    """One row for each segment: it opens at a moving point and closes at the first standing point that is
    `threshold` minutes or more after the stop began; its end is its last moving point."""
    out = _by_segment(points, thresholds, zone).filter("segment > 0")
    return out.select("imei", "day", "threshold", "segment", F.timestamp_millis("first.t").alias("start_at"), F.timestamp_millis("last.t").alias("end_at"), "distance_km", "driving_minutes", F.col("first.at").alias("start_loc"), F.col("last.at").alias("end_loc"))


def travel_stats(points: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS_MIN, zone: str = ZONE) -> DataFrame:
    """One row for each device, day and threshold, also without segments: totals and the segments themselves."""
    own = F.col("segment") > 0
    each = F.struct(F.timestamp_millis("first.t").alias("start_at"), F.timestamp_millis("last.t").alias("end_at"), "distance_km", "driving_minutes", F.col("first.at").alias("start_loc"), F.col("last.at").alias("end_loc"))
    zero = F.lit(0.0)
    return (
        _by_segment(points, thresholds, zone)
        .groupBy("imei", "day", F.col("threshold").alias("stop_threshold_min"))
        .agg(
            F.coalesce(F.sum(F.when(own, F.col("distance_km"))), zero).alias("total_distance_km"),
            F.coalesce(F.sum(F.when(own, F.col("driving_minutes"))), zero).alias("total_driving_minutes"),
            F.count_if(own).alias("total_segments"),
            F.sum("stops").alias("total_stop_count"),
            F.sort_array(F.collect_list(F.when(own, each))).alias("segments"),  # a device's day
        )
    )


def idle_intervals(points: DataFrame, speed_kmh: float = 0.0, minutes: float = 5.0, require_acc: bool = True, gap_seconds: float = 600.0, zone: str = ZONE) -> DataFrame:
    """imei, day, start_at, end_at and seconds of idle intervals of `minutes` or more.

    An interval ends at the point that isn't idle any more, or, before a gap of more than `gap_seconds` and
    at the day's end, at its last idle point. Unknown ignition isn't on.
    """
    rows = by_day(points, zone)
    on = F.coalesce(F.col("ignition"), F.lit(False)) if require_acc else F.lit(True)
    rows = rows.withColumn("x", on & (F.col("speed") <= speed_kmh))
    w = window(DAY)
    rows = rows.withColumns({"px": F.lag("x").over(w), "pt": F.lag("t").over(w), "nx": F.lead("x").over(w), "nt": F.lead("t").over(w)})
    new = F.col("x") & (~F.coalesce("px", F.lit(False)) | (F.col("t") - F.col("pt") > gap_seconds * 1000))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(so_far(DAY))).filter("x")
    until = F.when((F.col("nx") == F.lit(False)) & (F.col("nt") - F.col("t") <= gap_seconds * 1000), F.col("nt")).otherwise(F.col("t"))
    out = rows.groupBy("imei", "day", "run").agg(F.min("t").alias("begin"), F.max(until).alias("end"))
    out = out.filter(F.col("end") - F.col("begin") >= minutes * 60000)
    return out.select("imei", "day", F.timestamp_millis("begin").alias("start_at"), F.timestamp_millis("end").alias("end_at"), ((F.col("end") - F.col("begin")) / 1000.0).alias("seconds"))


def idle_stats(points: DataFrame, fuel_lph: float = 1.0, **options) -> DataFrame:
    """The idle report: one row for each device and day with an idle interval, none without."""
    out = idle_intervals(points, **options).groupBy("imei", "day").agg(F.sum("seconds").alias("idle_duration_seconds"), F.count("*").alias("idle_count"), F.min("start_at").alias("first_idle_start"), F.max("end_at").alias("last_idle_end"))
    return out.withColumn("fuel_waste_liters", F.col("idle_duration_seconds") / 3600 * fuel_lph if fuel_lph > 0 else F.lit(None).cast("double"))


def static_stats(points: DataFrame, daily: DataFrame, most_km: float = STATIC_KM, zone: str = ZONE) -> DataFrame:
    """imei, day, daily_mileage_km and is_static. A row of `daily` (imei, day, km) counts even with a null km
    (as 0); devices and days without one are computed from the points."""
    own = daily.select("imei", "day", F.coalesce("km", F.lit(0.0)).alias("daily_mileage_km"))
    missing = by_day(points, zone).join(daily.select("imei", "day"), ["imei", "day"], "left_anti")
    rest = paired(missing, DAY).groupBy("imei", "day").agg(F.sum(driven_km()).alias("daily_mileage_km"))
    return own.unionByName(rest).withColumn("is_static", F.col("daily_mileage_km") <= most_km)
