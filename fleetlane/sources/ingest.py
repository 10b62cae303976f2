"""Raw JSON messages to positions, rejects and track points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlane.functions.clock import parsed_millis
from fleetlane.functions.geo import finite, knots_to_kmh, stored_coordinates
from fleetlane.functions.text import is_blank, stripped

#: Types that the track archive takes, and the attribute type (a heartbeat) that it doesn't.
TRACK_TYPES, HEARTBEAT = ("gps", "alarm"), 19


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON message in each line as `body`, read as text so that nothing is lost."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def stream_messages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path).withColumnRenamed("value", "body")


def is_json(body: Column) -> Column:
    return F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))


def positions(messages: DataFrame, body: str = "body", only_first: bool = False) -> DataFrame:
    """One row for each position of a message (or for its first): `item`, as JSON text, and both the position and the message
    as variants, which normalized() takes. A message is parsed once.

    The positions are, in this order of preference: the message itself if it is an array, `positions`,
    `position` (array or object), `data.position`, `data.positions`, or the message.
    """
    parsed = messages.withColumn("__body", F.try_parse_json(body))
    many = lambda path: F.try_variant_get("__body", path, "array<variant>")
    is_object = lambda path: F.try_variant_get("__body", path, "map<string,variant>").isNotNull()
    one = lambda path: F.when(is_object(path), F.array(F.try_variant_get("__body", path, "variant")))
    found = F.coalesce(many("$"), many("$.positions"), many("$.position"), one("$.position"), one("$.data.position"), many("$.data.positions"), F.array("__body"))
    out = parsed.withColumn("__root", F.when(many("$").isNull(), F.col("__body"))).withColumn("__item", F.get(found, 0) if only_first else F.explode(found))
    return out.withColumn("item", F.coalesce(F.to_json("__item"), body)).drop("__body")


def normalized(items: DataFrame) -> DataFrame:
    """positions() as columns: the first of several names that isn't missing or empty, numbers cast, times in
    milliseconds; valid is true if not given."""

    def first(*paths: str) -> Column:
        """Paths that begin with `/` are of the message, others of the position."""
        return F.coalesce(*[F.nullif(F.try_variant_get("__root" if p[0] == "/" else "__item", f"$.{p.lstrip('/')}", "string"), F.lit("")) for p in paths])

    device = lambda name: (f"device.{name}", f"/device.{name}")
    number = lambda c: c.try_cast("double")
    attribute = lambda name: first(f"attributes.{name}", f"/attributes.{name}")
    unique = first("uniqueId", "imei", "deviceUniqueId", "device.uniqueId", "device.imei", "/uniqueId", "/imei", "/deviceUniqueId", "/deviceImei", "/device.uniqueId", "/device.imei", "device.attributes.uniqueId", "/device.attributes.uniqueId", "device.attributes.imei", "/device.attributes.imei")
    return items.select(
        *[c for c in items.columns if c not in ("__root", "__item")],
        F.nullif(stripped(unique), F.lit("")).alias("imei"),
        first("deviceId", "device_id", "device.id", "/deviceId", "/device_id", "/device.id").alias("runtime_device_id"),
        first("id", "positionId", "/positionId", "/id").try_cast("long").alias("position_id"),
        first("protocol", "/protocol", *device("protocol")).alias("protocol"),
        *[parsed_millis(first(*names)).alias(alias) for alias, names in (("fix_time", ("fixTime", "time", "/fixTime", "/time")), ("device_time", ("deviceTime", "/deviceTime")), ("server_time", ("serverTime", "/serverTime")))],
        number(first("latitude", "lat", "gps.latitude", "/latitude", "/lat")).alias("latitude"),
        number(first("longitude", "lon", "lng", "gps.longitude", "/longitude", "/lon", "/lng")).alias("longitude"),
        number(first("altitude", "/altitude")).alias("altitude"),
        knots_to_kmh(number(first("speed", "/speed"))).alias("speed"),
        number(first("course", "direction", "/course", "/direction")).alias("course"),
        F.coalesce(first("valid", "/valid").try_cast("boolean"), F.lit(True)).alias("valid"),
        first("outdated", "/outdated").try_cast("boolean").alias("outdated"),
        first(*device("status")).alias("device_status"),
        first(*device("model")).alias("device_model"),
        attribute("ignition").try_cast("boolean").alias("ignition"),
        attribute("motion").try_cast("boolean").alias("motion"),
        attribute("alarm").alias("alarm"),
        attribute("type").alias("attr_type"),
        attribute("result").alias("result"),
    )


def checked(rows: DataFrame) -> DataFrame:
    """normalized() rows with reject_reason: null where a device and, but for command replies, coordinates are known."""
    known = F.col("imei").isNotNull() | F.col("runtime_device_id").try_cast("double").isNotNull()
    reply = ~is_blank(F.col("result"))
    reason = F.when(~known, "missing_uniqueId_or_deviceId").when(~reply & ~finite(F.col("latitude"), F.col("longitude")), "missing_position_coordinates")
    return rows.withColumn("reject_reason", reason)


def raw_archive(messages: DataFrame, received_at: Column, source: str = "forward") -> DataFrame:
    """The archive of raw messages: all of the body, and columns of its first position only."""
    first = normalized(positions(messages, only_first=True))
    return first.select(received_at.alias("received_at"), F.lit(source).alias("source"), "imei", "runtime_device_id", "protocol", "position_id", "fix_time", "device_time", "server_time", "latitude", "longitude", (~is_blank(F.col("result"))).alias("has_command_response"), F.col("body").alias("raw_payload"))


def track_points(rows: DataFrame) -> DataFrame:
    """The track table of rows (imei, type, latitude, longitude, speed, direction, packet_date, date, ignition,
    position_id, attr_type): positions and alarms with coordinates that aren't heartbeats."""
    keep = F.lower("type").isin(*TRACK_TYPES) & stored_coordinates(F.col("latitude"), F.col("longitude")) & ~F.coalesce(F.col("attr_type").try_cast("double") == HEARTBEAT, F.lit(False))
    number = lambda c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    out = rows.filter(keep & ~is_blank(F.col("imei")))
    return out.select(stripped(F.col("imei")).alias("imei"), F.col("latitude").cast("double"), F.col("longitude").cast("double"), number("speed"), number("direction"), "packet_date", F.col("ignition").cast("boolean"), F.when(F.col("position_id") > 0, F.col("position_id")).alias("position_id"))


def retained(rows: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """rows received within so many days; 0 or fewer keep all."""
    return rows if days <= 0 else rows.filter(F.col("received_at") >= now - F.make_interval(days=F.lit(days)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new instead of those with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_or_delete(old: DataFrame, new: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """upsert(), where a new row that doesn't hold `keep` deletes the old one and isn't stored."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.filter(F.coalesce(keep, F.lit(False))).select(*old.columns))


def write_days(report: DataFrame, path: str, day: str = "day") -> None:
    """Writes a report partitioned by day; the days that it has replace what was there, so that a run can be repeated
    and a row that is gone is deleted."""
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
