"""A track table derived from the `events` table, for want of real positions: integer arithmetic only, so that
SQL can derive the same one. `compress` divides the time between events by so much."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z, where the events begin


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def points(spark: SparkSession, sf_dir: str, compress: int = 60) -> DataFrame:
    """imei, packet_date, latitude, longitude, speed, direction, ignition, position_id, alarm, event_type."""
    e = events(spark, sf_dir)
    ms = F.expr(f"({BASE_US * compress} + unix_micros(ts) - {BASE_US}) div {compress * 1000}")
    u, n = F.col("user_id"), F.col("event_id")
    digit = n % 10
    speed = F.when(digit <= 3, 0.0).when(digit == 4, 1.0).when(digit == 5, 3.0).when(digit == 6, 5.0).when(digit == 7, 40.0).when(digit == 8, 60.0).otherwise(130.0)
    return e.select(
        F.lpad(u.cast("string"), 15, "0").alias("imei"),
        F.timestamp_millis(ms).alias("packet_date"),
        (F.lit(24.0) + (u % 100) / 100.0 + (n % 97) / 10000.0 + F.when(n % 50 == 0, 0.6).otherwise(0.0)).alias("latitude"),
        (F.lit(46.0) + (n % 89) / 10000.0).alias("longitude"),
        speed.alias("speed"),
        ((n * 7) % 360).cast("double").alias("direction"),
        F.when(F.col("event_type") == "signup", F.lit(None).cast("boolean")).otherwise(F.col("event_type") != "error").alias("ignition"),
        n.alias("position_id"),
        F.when(n % 31 == 0, "overspeed").when(n % 37 == 0, "lowspeed").alias("alarm"),
        "event_type",
    )


def speed_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """imei and limit_kmh; every seventh device has none."""
    u = F.col("user_id")
    return events(spark, sf_dir).select("user_id").distinct().select(F.lpad(u.cast("string"), 15, "0").alias("imei"), F.when(u % 7 != 0, 40.0 + (u % 5) * 20).alias("limit_kmh"))


def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circle and a polygon for each device."""
    u = F.col("user_id")
    lat = F.lit(24.0) + (u % 100) / 100.0
    ids = events(spark, sf_dir).select("user_id").distinct()
    vertex = lambda a, b: F.array(a, F.lit(b))
    kinds = F.array(
        F.struct(F.lit("c").alias("id"), F.lit("circle").alias("type"), (lat + 0.004).alias("latitude"), F.lit(46.004).alias("longitude"), F.lit(400.0).alias("radius"), F.lit(None).cast("array<array<double>>").alias("coordinates"), F.lit(True).alias("notify_on_enter"), (u % 2 == 0).alias("notify_on_exit"), F.lit(50.0).alias("speed_limit"), F.lit(None).cast("boolean").alias("speed_limit_enabled")),
        F.struct(F.lit("p").alias("id"), F.lit("polygon").alias("type"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.lit(None).cast("double").alias("radius"), F.array(vertex(lat, 46.0), vertex(lat, 46.005), vertex(lat + 0.006, 46.005), vertex(lat + 0.006, 46.0)).alias("coordinates"), (u % 3 == 0).alias("notify_on_enter"), F.lit(True).alias("notify_on_exit"), F.lit(100.0).alias("speed_limit"), (u % 4 != 0).alias("speed_limit_enabled")),
    )
    return ids.select(F.lpad(u.cast("string"), 15, "0").alias("imei"), F.explode(kinds).alias("fence")).select("imei", "fence.*")


def received(spark: SparkSession, sf_dir: str, compress: int = 60) -> DataFrame:
    """Messages with all their times: some late, some from the future, some without a fix, some that don't move."""
    n, t = F.col("position_id"), F.unix_millis("packet_date")
    fix = F.when(n % 23 != 0, t - F.when(n % 3 == 0, 400_000).when(n % 19 == 0, -130_000).otherwise((n % 5) * 50_000))
    device = F.when(n % 8 != 0, t - F.when(n % 7 == 0, 400_000).when(n % 37 == 0, -200_000).otherwise((n % 4) * 40_000))
    server = F.when(n % 13 != 0, t - F.when(n % 11 == 0, 290_000).otherwise(1000))
    lat = F.when(n % 2 == 0, 24.5).otherwise(F.lit(24.0) + n % 3)
    return points(spark, sf_dir, compress).select("imei", t.alias("arrived"), n.alias("seq"), fix.alias("fix"), device.alias("device"), server.alias("server"), lat.alias("latitude"), F.lit(46.5).alias("longitude"), F.when(n % 29 != 0, F.col("speed")).alias("speed"), (n % 17 == 0).alias("motion"), (n % 31 == 0).alias("outdated"))


#: Replies to commands that are hard to read: line ends and no-break spaces around them, fields on lines of their own,
#: names that begin like others, positions that are no positions before one that is.
ODD_REPLIES = (
    "RELAY=OK\r\n",
    "External power: 12.5V;\nGSM: strong; Relay: off\r\n",
    "External power: Vcc 12.5V; gprs : up ,ACC:ON",
    "Lat:N12,Lon:E3; Lat:S1.5.2,Lon:W46.25,Course:7,Speed:08,DateTime:2024-01-01 10:00",
    "\u00a0relay= ok!\u00a0now \t",
    "Lat:.5,Lon:4.,Course:1,Speed:2,DateTime:x,External power:3v,external power: 4.25V:5;SVS used in fix: 7",
    "A=B=C",
    "Lat:N..,Lon:E1,Course:0,Speed:0,DateTime:\ufeff",
    "power external power: 9v; External power: ; RELAY: a:b ; Relay: c",
    "no reply",
)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and reply: a position, a status, a result, or one of ODD_REPLIES."""
    n = F.col("event_id")
    s = lambda c: c.cast("string")
    position = F.concat(F.lit("Lat:"), F.when(n % 8 == 0, "S").otherwise("N"), s(n % 90), F.lit(".5,Lon:E46.25,Course:"), s(n % 360), F.lit(",Speed:"), s(n % 120), F.lit(",DateTime:2024-01-01"))
    status = F.concat(F.lit("External power: 12."), s(n % 10), F.lit("V; GSM: strong, ACC: ON; Relay: off"))
    odd = F.get(F.array(*[F.lit(r) for r in ODD_REPLIES]), (F.floor(n / 4) % len(ODD_REPLIES)).cast("int"))
    reply = F.when(n % 4 == 0, position).when(n % 4 == 1, status).when(n % 4 == 2, F.concat(F.lit("RELAY=OK "), s(n), F.lit("!"))).otherwise(odd)
    return events(spark, sf_dir).select("event_id", reply.alias("reply"))
