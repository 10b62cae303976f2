"""Dimension lookups and reconciliation, as equi-joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlane.functions.geo import km_to_miles
from fleetlane.functions.text import is_blank, stripped

from .sequence import carried


def resolve_devices(rows: DataFrame, details: DataFrame, key: str = "key") -> DataFrame:
    """rows ⟕ details (imei, serial_number, ...) where key is either; the imei match comes first.

    The dimension is exploded to one row for each of its two keys, so the OR is an equi-join.
    """
    rest = [c for c in details.columns if c not in ("imei", "serial_number")]
    keys = F.explode(F.array(F.struct(F.col("imei").alias("key"), F.lit(0).alias("kind")), F.struct(F.col("serial_number").alias("key"), F.lit(1).alias("kind"))))
    dim = details.select("imei", *rest, keys.alias("k")).select(F.col("k.key").alias(key), "k.kind", "imei", *rest).filter(F.col(key).isNotNull())
    ordered = [c for c, kind in dim.select(*rest).dtypes if not re.search("map<|variant", kind)]  # others have no order
    best = dim.groupBy(key).agg(F.min_by(F.struct("imei", *rest), F.struct("kind", "imei", *ordered)).alias("d"))
    return rows.join(best, key, "left").select(*rows.columns, F.col("d.imei").alias("resolved_imei"), *[F.col(f"d.{c}") for c in rest])


def tenant_rooms(devices: DataFrame, tenants: DataFrame) -> DataFrame:
    """imei and room: tenant_id, else device_owner_id, else the tenant with tenant_db_name; it must be over 0."""
    named = tenants.groupBy("tenant_db_name").agg(F.min("tenant_id").alias("by_name"))
    room = F.coalesce("tenant_id", "device_owner_id", "by_name")
    return devices.join(named, "tenant_db_name", "left").select("imei", F.when(room > 0, room).alias("room"))


def models(devices: DataFrame, details: DataFrame, default: str) -> DataFrame:
    """imei and model: of the details, else of the status, else the default; blanks are missing."""
    known = lambda c: F.nullif(stripped(c), F.lit(""))
    return devices.join(details.select("imei", "tr_model"), "imei", "left").select("imei", F.coalesce(known(F.col("tr_model")), known(F.col("model")), F.lit(default)).alias("model"))


def needs_sync(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """Devices whose observed model or runtime id (imei, model, runtime_id) isn't the desired one."""
    both = desired.alias("d").join(observed.alias("o"), "imei", "left")
    differs = ~F.col("d.model").eqNullSafe(F.col("o.model")) | ~F.col("d.runtime_id").eqNullSafe(F.col("o.runtime_id"))
    return both.filter(differs).select("imei", F.col("d.model").alias("model"), F.col("d.runtime_id").alias("runtime_id"))


def reconcile(online: DataFrame, snapshot: DataFrame) -> DataFrame:
    """imei and reason of online devices to be set offline: not in the snapshot, or there as offline or unknown.
    A null or empty status isn't offline."""
    last = snapshot.groupBy("imei").agg(F.max("status").alias("status"), F.lit(True).alias("there"))
    both = online.select("imei").join(last, "imei", "left")
    reason = F.when(F.col("there").isNull(), "missing").when(F.lower("status").isin("offline", "unknown"), F.lower("status"))
    return both.select("imei", reason.alias("reason")).filter("reason is not null")


def explicit_offline(online: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Online devices that the snapshot lists as offline or unknown; missing ones stay."""
    return online.select("imei").join(snapshot.filter(F.lower("status").isin("offline", "unknown")), "imei", "left_semi")


def empty_snapshot(online: int, started_ms: int, now_ms: int, empties: int, grace_ms: int = 120_000, needed: int = 2) -> tuple[bool, int]:
    """(whether an empty snapshot may set devices offline, how many empty ones there were in a row).

    Not while no device is online, nor in the grace time, which starts the count anew; then only as the needed one in a
    row. A snapshot that isn't empty starts the count anew, too, and always may.
    """
    if online <= 0:
        return False, empties
    if now_ms - started_ms < grace_ms:
        return False, 0
    return empties + 1 >= needed, empties + 1


#: Fixed values of the empty-snapshot gate: milliseconds of grace after the start, and how many empty ones it takes.
GRACE_MS, EMPTY_NEEDED = 120_000, 2


def snapshot_gate(refreshes: DataFrame, started_ms: int, grace_ms: int = GRACE_MS, needed: int = EMPTY_NEEDED) -> DataFrame:
    """refreshes (source, at in ms, devices: how many the snapshot lists, null if it failed; online: how many are online now)
    with `allowed`: whether what the snapshot lacks may be set offline. A failed one may not, and doesn't count."""

    def step(empties, at, devices, online):
        if devices is None:
            return empties, (False,)
        if devices > 0:
            return 0, (True,)
        allowed, empties = empty_snapshot(online or 0, started_ms, at, empties or 0, grace_ms, needed)
        return empties, (allowed,)

    return carried(refreshes, ("source",), ("at",), ("at", "devices", "online"), step, [T.StructField("allowed", T.BooleanType())])


def registry_intervals(refreshes: DataFrame, rows: DataFrame) -> DataFrame:
    """runtime_id, imei, since and until (ms; null: still): when the registry named a runtime id's device so.

    refreshes: at (ms) and ok of each poll; rows: at, unique_id, runtime_id and seq, what a poll listed. A failed refresh, and
    one that lists nothing, keep the registry as it was. Of rows with one unique id or one runtime id the last one counts.
    """
    listed = rows.filter("unique_id is not null and runtime_id is not null").withColumn("unique_id", stripped(F.col("unique_id"))).filter("unique_id <> ''")
    good = refreshes.filter("ok").join(listed.select("at").distinct(), "at", "left_semi")
    versions = good.select("at", F.lead("at").over(Window.orderBy("at")).alias("next"))  # a row for each refresh
    last = listed.groupBy("at", "unique_id").agg(F.max_by("runtime_id", "seq").alias("runtime_id"), F.max("seq").alias("seq"))
    named = last.groupBy("at", "runtime_id").agg(F.max_by("unique_id", "seq").alias("imei")).join(F.broadcast(versions), "at")
    w = Window.partitionBy("runtime_id").orderBy("at")
    begins = ~(F.lag("imei").over(w).eqNullSafe(F.col("imei")) & F.lag("next").over(w).eqNullSafe(F.col("at")))
    runs = named.withColumn("begins", begins).withColumn("run", F.count_if("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.max_by("next", "at")
    return runs.groupBy("runtime_id", "run").agg(F.first("imei").alias("imei"), F.min("at").alias("since"), ends.alias("until")).drop("run")


def registry_as_of(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """rows (runtime_device_id, at in ms) with imei as the registry had it then: the last interval that began at or before the
    row's time, unless it had ended. One exchange by runtime id; no pair of row and interval is made."""
    told = intervals.select(F.col("runtime_id").cast("double").alias("__id"), F.col("since").alias("at"), F.struct("imei", "until").alias("__told"))
    mine = rows.drop("imei").withColumn("__id", F.col("runtime_device_id").try_cast("double"))
    both = mine.withColumn("__row", F.lit(True)).unionByName(told, allowMissingColumns=True)
    w = Window.partitionBy("__id").orderBy(F.col("at"), F.col("__row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__told", F.last("__told", ignorenulls=True).over(w)).filter("__row")
    holds = F.col("__id").isNotNull() & (F.col("__told.until").isNull() | (F.col("at") < F.col("__told.until")))
    return both.withColumn("imei", F.when(holds, F.col("__told.imei"))).drop("__id", "__row", "__told")


def is_online(rows: DataFrame) -> Column:
    """Whether any of five flags says so: status, traccar_device_status and connection_state are `online`, connected or
    is_connected is true. Columns that are missing say nothing."""
    text = [F.col(c) == "online" for c in ("status", "traccar_device_status", "connection_state") if c in rows.columns]
    flag = [F.col(c).cast("boolean") for c in ("connected", "is_connected") if c in rows.columns]
    return F.exists(F.array(F.lit(False), *text, *flag), lambda x: F.coalesce(x, F.lit(False)))


def with_runtime_ids(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """rows (imei, runtime_device_id) whose missing imei is that of the device (imei, runtime_id) with this runtime id; it
    stays null where there is none. Of devices that share a runtime id the first by imei counts."""
    named = devices.filter("runtime_id is not null").groupBy(F.col("runtime_id").cast("double").alias("__id")).agg(F.min("imei").alias("__imei"))
    wanted = F.when(F.col("imei").isNull(), F.col("runtime_device_id").try_cast("double"))
    return rows.withColumn("__id", wanted).join(named, "__id", "left").withColumn("imei", F.coalesce("imei", "__imei")).select(*rows.columns)


def accumulator_overrides(requests: DataFrame) -> DataFrame:
    """requests (imei, hours, total_distance in metres, total_distance_km; texts or numbers) with error, and where there is
    none, what the status table takes: engine_hours, total_distance_m, km_total, miles_total. Columns of these names are
    replaced."""

    def number(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    metres, hours = F.coalesce(number("total_distance"), number("total_distance_km") * 1000), number("hours")
    error = F.when(is_blank(F.col("imei")), "imei_required").when(hours.isNull(), "invalid_or_missing_hours").when(metres.isNull(), "invalid_or_missing_totalDistance_or_totalDistanceKm")
    good = lambda c: F.when(F.col("error").isNull(), c)
    out = requests.withColumn("error", error).withColumns({"engine_hours": good(hours), "total_distance_m": good(metres)})
    return out.withColumns({"imei": stripped(F.col("imei")), "km_total": F.col("total_distance_m") / 1000, "miles_total": km_to_miles(F.col("total_distance_m") / 1000)})


def changed_runtime_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """unique_id, old and new runtime id of devices whose id differs; of duplicates the last listed (seq) counts."""
    last = lambda df, name: df.groupBy("unique_id").agg(F.max_by("runtime_id", "seq").alias(name))
    return last(before, "old_id").join(last(after, "new_id"), "unique_id").filter("old_id <> new_id")


def match_commands(commands: DataFrame, responses: DataFrame) -> DataFrame:
    """Each response with the newest pending command of its device and command id sent before it, else of its device.

    commands: imei, command_id, sent (ms), cmd_seq; responses: imei, command_id, responded (ms), seq. One pass over
    both tables, in order of time; a command that was matched is pending no more. A device's pending commands are held.
    """
    c = commands.select("imei", F.col("command_id").cast("string"), F.col("sent").alias("at"), F.lit(0).alias("kind"), F.col("cmd_seq").alias("id"))
    r = responses.select("imei", F.col("command_id").cast("string"), F.col("responded").alias("at"), F.lit(1).alias("kind"), F.col("seq").alias("id"))

    def newest(pending: list[int], answered: set[int]) -> int | None:
        while pending and pending[-1] in answered:
            pending.pop()
        return pending.pop() if pending else None

    def step(s, kind, command_id, number):
        every, by_id, answered = s or ([], {}, set())
        if not kind:
            every.append(number)
            by_id.setdefault(command_id, []).append(number)
            return (every, by_id, answered), (None,)
        found = newest(by_id.get(command_id, []), answered) if command_id is not None else None
        found = newest(every, answered) if found is None else found
        if found is not None:
            answered.add(found)
        if not every:  # all are answered
            by_id, answered = {}, set()
        return (every, by_id, answered), (found,)

    out = carried(c.unionByName(r), ("imei",), ("at", "kind", "id"), ("kind", "command_id", "id"), step, [T.StructField("cmd_seq", T.LongType())])
    return out.filter("kind = 1").select("imei", F.col("id").alias("seq"), "cmd_seq")


def subscriber_counts(memberships: DataFrame) -> DataFrame:
    """Memberships and distinct sockets over devices and rooms (socket, kind)."""
    return memberships.agg(F.count("*").alias("memberships"), F.countDistinct("socket").alias("sockets"), F.count_if(F.col("kind") == "device").alias("device_memberships"))


def by_user(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows ⋈ tokens on user_id, which may be a number on one side and text on the other."""
    return rows.withColumn("__u", F.col("user_id").cast("string")).join(tokens.select(F.col("user_id").cast("string").alias("__u"), "fcm_token"), "__u").drop("__u")
