"""Named queries over the test tables and the SQL that checks them.

Times are given in milliseconds and distances rounded to 6 places, so that engines compare alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlane.functions import clock, geo, notices, text
from fleetlane.operators import events, live, lookups, reports, sequence
from fleetlane.sources import derived, ingest

from . import oracle as sql
from . import stateful  # noqa: F401  its queries register themselves
from .registry import QUERIES, SQL, km, ms, query

def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["daily_mileage"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages derived from the points: they arrive in the order of event_id, some of them late or from the future."""
    e = derived.points(spark, sf_dir)
    t, n = F.unix_millis("packet_date"), F.col("position_id")
    late = F.when(n % 6 == 0, 400_000).when(n % 9 == 0, -130_000).otherwise((n % 5) * 50_000)
    return e.select("imei", t.alias("arrived"), n.alias("seq"), F.when(n % 23 != 0, t - late).alias("fix"))


ARRIVALS = f"""{sql.points()}, arrivals AS (SELECT imei, t AS arrived, id AS seq,
    CASE WHEN id % 23 <> 0 THEN t - CASE WHEN id % 6 = 0 THEN 400000 WHEN id % 9 = 0 THEN -130000 ELSE (id % 5) * 50000 END END AS fix FROM points)"""
SINGLE = """alone AS (SELECT *, CASE WHEN fix IS NULL THEN 'missing_time' WHEN fix > arrived + 120000 THEN 'future_invalid' WHEN arrived - fix <= 300000 THEN 'fresh' ELSE 'historical' END AS d FROM arrivals),
    m AS (SELECT *, max(CASE WHEN d = 'fresh' THEN fix END) OVER (PARTITION BY imei ORDER BY arrived, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM alone),
    decided AS (SELECT *, CASE WHEN d = 'fresh' AND fix < newest THEN 'out_of_order' ELSE d END AS decision FROM m)"""


# --- filters, projections, functions


@query(f"WITH {sql.points()} SELECT id AS position_id, lat <> 0 OR lon <> 0 AS stored, lat <> 0 AND lon <> 0 AS live FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE lat END AS lat, CASE WHEN id % 6 = 0 THEN 0 ELSE lon END AS lon FROM points)")
def coord_filter(spark, sf_dir):
    n = F.col("position_id")
    rows = derived.points(spark, sf_dir).select(n, F.when(n % 4 == 0, 0.0).otherwise(F.col("latitude")).alias("lat"), F.when(n % 6 == 0, 0.0).otherwise(F.col("longitude")).alias("lon"))
    return rows.select(n, geo.stored_coordinates(F.col("lat"), F.col("lon")).alias("stored"), geo.live_coordinates(F.col("lat"), F.col("lon")).alias("live"))


@query(f"WITH {sql.points()} SELECT imei, t AS at, speed, direction, ignition, id AS position_id FROM points WHERE event_type IN ('click', 'error', 'signup') AND id % 19 <> 0")
def point_projection(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "signup"), "gps").when(F.col("event_type") == "error", "Alarm").otherwise("command")
    rows = derived.points(spark, sf_dir).withColumns({"type": kind, "imei": F.concat(F.lit(" "), "imei"), "attr_type": F.when(F.col("position_id") % 19 == 0, "19")})
    return ingest.track_points(rows).select("imei", ms("packet_date", "at"), "speed", "direction", "ignition", "position_id")


@query(f"WITH {sql.points(10)} SELECT imei, count(*) AS n, sum(speed) AS speeds FROM points WHERE t >= 1704153600000 AND t < 1704240000000 GROUP BY imei")
def time_range_filter(spark, sf_dir):
    rows = sequence.in_range(derived.points(spark, sf_dir, 10), F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-03").cast("timestamp"))
    return rows.groupBy("imei").agg(F.count("*").alias("n"), F.sum("speed").alias("speeds"))


@query(f"WITH {sql.paired()} SELECT imei, id AS position_id, round(raw, 6) AS raw_km FROM pairs WHERE pt IS NOT NULL")
def haversine_pairs(spark, sf_dir):
    pairs = sequence.paired(sequence.timed(derived.points(spark, sf_dir)))
    return pairs.filter("pt is not null").select("imei", "position_id", km("jump.raw_km", "raw_km"))


@query(f"WITH {sql.paired(k=1)} SELECT reason, count(*) AS n, round(sum(km), 4) AS km FROM pairs GROUP BY reason")
def jump_guard_reasons(spark, sf_dir):
    pairs = sequence.paired(sequence.timed(derived.points(spark, sf_dir, 1)))
    return pairs.groupBy("jump.reason").agg(F.count("*").alias("n"), F.round(F.sum("jump.distance_km"), 4).alias("km"))


@query(f"WITH {sql.points()}, {sql.FENCES} SELECT imei, id AS position_id FROM points JOIN u USING (imei) WHERE {sql.inside_square()}")
def point_in_polygon(spark, sf_dir):
    fences = derived.fences(spark, sf_dir).filter("type = 'polygon'").select("imei", "coordinates")
    rows = derived.points(spark, sf_dir).join(fences, "imei")
    return rows.filter(geo.in_polygon(F.col("latitude"), F.col("longitude"), F.col("coordinates"))).select("imei", "position_id")


@query(f"WITH {sql.points()}, {sql.FENCES} SELECT imei, id AS position_id FROM points JOIN u USING (imei) WHERE {sql.inside_circle()}")
def circle_fence(spark, sf_dir):
    fences = derived.fences(spark, sf_dir).filter("type = 'circle'").select("imei", F.col("latitude").alias("a"), F.col("longitude").alias("b"), "radius")
    rows = derived.points(spark, sf_dir).join(fences, "imei")
    return rows.filter(geo.in_circle(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b"), F.col("radius"))).select("imei", "position_id")


@query(f"""WITH d AS (SELECT DISTINCT CAST(timezone('{sql.CAIRO}', timezone('UTC', ts)) AS DATE) AS d FROM (SELECT ts FROM events UNION ALL SELECT ts + INTERVAL 115 DAY FROM events UNION ALL SELECT ts + INTERVAL 300 DAY FROM events))
    SELECT CAST(d AS VARCHAR) AS day, epoch_ms(timezone('{sql.CAIRO}', d::TIMESTAMP)) AS start_at, epoch_ms(timezone('{sql.CAIRO}', (d + 1)::TIMESTAMP)) AS end_at FROM d""")
def business_day_bounds(spark, sf_dir):
    ts = derived.events(spark, sf_dir).select(F.explode(F.array("ts", F.expr("ts + interval 115 days"), F.expr("ts + interval 300 days"))).alias("ts"))
    days = ts.select(clock.local_date(F.col("ts")).alias("d")).distinct()
    return days.select(F.col("d").cast("string").alias("day"), F.unix_millis(clock.day_start(F.col("d"))).alias("start_at"), F.unix_millis(clock.day_start(F.date_add("d", 1))).alias("end_at"))


def _codes(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    some = [(2, "Over Speed"), (3, "low_bat"), (5, "SOS"), (7, "tampering"), (11, "unheard-of"), (13, "sos")]
    codes = F.concat_ws(",", *[F.when(n % k == 0, c) for k, c in some])
    return derived.events(spark, sf_dir).select("event_id", text.alarm_tokens(codes).alias("tokens"))


@query(f"WITH {sql.TOKENS} SELECT event_id, array_to_string(tokens, ',') AS tokens FROM tokens")
def alarm_token_normalize(spark, sf_dir):
    return _codes(spark, sf_dir).select("event_id", F.array_join("tokens", ",").alias("tokens"))


@query(f"""WITH {sql.TOKENS} SELECT event_id, array_to_string(list_transform(tokens, lambda x: {sql.looked_up({k: v[0] for k, v in sql.MESSAGES.items()}, 'x')}), ' | ') AS en,
    CASE WHEN len(tokens) = 0 THEN 'تنبيه من الجهاز' ELSE array_to_string(list_transform(tokens, lambda x: {sql.looked_up({k: v[1] for k, v in sql.MESSAGES.items()}, "concat('تنبيه: ', x)")}), ' | ') END AS ar FROM tokens""")
def alarm_messages(spark, sf_dir):
    return _codes(spark, sf_dir).select("event_id", text.alarm_messages(F.col("tokens")).alias("en"), text.alarm_messages(F.col("tokens"), "ar").alias("ar"))


@query(f"WITH {sql.TOKENS} SELECT event_id, CAST(coalesce(list_filter(list_transform(tokens, lambda x: {sql.looked_up(sql.LEGACY, 'NULL')}), lambda y: y IS NOT NULL)[1], 0) AS INTEGER) AS code FROM tokens")
def legacy_alarm_code(spark, sf_dir):
    return _codes(spark, sf_dir).select("event_id", text.legacy_alarm_code(F.col("tokens")).alias("code"))


@query(f"""WITH {sql.TOKENS} SELECT event_id, array_to_string(list_filter(tokens, lambda x: x NOT IN {sql.MUTED}), ',') AS left_tokens,
    len(tokens) > 0 AND len(list_filter(tokens, lambda x: x NOT IN {sql.MUTED})) = 0 AS only_muted FROM tokens""")
def muted_alarms(spark, sf_dir):
    return _codes(spark, sf_dir).select("event_id", F.array_join(text.without_muted(F.col("tokens")), ",").alias("left_tokens"), text.only_muted(F.col("tokens")).alias("only_muted"))


@query("SELECT event_id, CAST(192 + event_id % 16 AS INTEGER) AS satellite FROM events")
def satellite_byte(spark, sf_dir):
    return derived.events(spark, sf_dir).select("event_id", text.satellite_byte(F.col("event_id")).alias("satellite"))


@query(sql.COMMAND_REPLIES)
def command_reply_parse(spark, sf_dir):
    out = derived.replies(spark, sf_dir).select("event_id", text.command_reply(F.col("reply")).alias("r"))
    return out.select("event_id", "r.position.lat", "r.position.lon", "r.position.speed", "r.position.datetime", "r.status.external_power", "r.status.voltage", "r.status.gsm", "r.status.relay", "r.command_result.command", "r.command_result.result")


@query(f"WITH {sql.points()} SELECT id AS position_id, concat(imei, '|gt06|', CAST(t AS VARCHAR), '|||', printf('%.6f', lat), '|', printf('%.6f', lon), '||', coalesce(alarm, ''), '|') AS fingerprint FROM points")
def fingerprint(spark, sf_dir):
    none = F.lit(None).cast("string")
    print_ = text.fingerprint(F.col("imei"), F.lit("gt06"), F.unix_millis("packet_date"), none, none, F.col("latitude"), F.col("longitude"), none, F.col("alarm"), none)
    return derived.points(spark, sf_dir).select("position_id", print_.alias("fingerprint"))


@query("""SELECT event_id, coalesce(event_type IN ('click', 'view'), false) AS by_motion, event_type <> 'signup' AND NOT event_type = 'error' AND value > 50 AS on_, event_type = 'error' OR value <= 1 AS parked
    FROM (SELECT event_id, event_type, coalesce(value, 0) AS value FROM events)""")
def state_flags(spark, sf_dir):
    e = derived.events(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0)))
    kind, v = F.col("event_type"), F.col("value")
    ignition = text.ignition_on(F.when(kind == "signup", False), F.when(kind == "error", False), v > 50)
    return e.select("event_id", kind.isin("click", "view").alias("by_motion"), ignition.alias("on_"), text.is_parked(F.when(kind == "error", False), F.lit(None).cast("boolean"), v).alias("parked"))


@query(f"""WITH {sql.TOKENS} SELECT event_id, CAST(192 + event_id % 16 AS INTEGER) AS satellite, CAST(coalesce(list_filter(list_transform(tokens, lambda x: {sql.looked_up(sql.LEGACY, 'NULL')}), lambda y: y IS NOT NULL)[1], 0) AS INTEGER) AS alarm_type,
    event_type = 'click' AS acc_on, event_id % 2 = 0 AS gps_positioned, value >= 50 AS north_latitude FROM tokens JOIN events USING (event_id)""")
def legacy_alarm_struct(spark, sf_dir):
    e = _codes(spark, sf_dir).join(derived.events(spark, sf_dir).select("event_id", "event_type", "value"), "event_id")
    n, unknown = F.col("event_id"), F.lit(None).cast("boolean")
    made = notices.legacy_alarm(F.col("tokens"), n % 16, F.col("value") - 50, F.lit(1.0), n % 2 == 0, F.when(F.col("event_type") == "click", True), unknown, unknown)
    return e.select("event_id", made.alias("a")).select("event_id", "a.satellite", "a.alarm_type", "a.status_decoded.acc_on", "a.status_decoded.gps_positioned", "a.north_latitude")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat(s_name, CASE WHEN s_suppkey % 3 = 0 THEN concat(' - ', CAST(s_nationkey AS VARCHAR)) ELSE '' END) WHEN s_suppkey % 3 = 0 THEN concat('- ', CAST(s_nationkey AS VARCHAR)) WHEN s_suppkey % 5 = 0 THEN 'Alert' WHEN s_suppkey % 7 = 0 THEN 'text' ELSE 'تنبيه' END AS title,
    concat('Command: ', s_name, chr(10), 'Response: ', CASE WHEN s_suppkey % 5 = 0 THEN 'ok' ELSE '—' END) AS en FROM supplier""")
def notification_texts(spark, sf_dir):
    k = F.col("s_suppkey")
    title = notices.device_title(F.when(k % 2 == 0, F.col("s_name")), F.when(k % 3 == 0, F.col("s_nationkey").cast("string")), F.when(k % 5 == 0, "Alert").otherwise("title"), F.when(k % 7 == 0, "text"))
    texts = notices.command_texts(F.concat(F.lit(" "), "s_name"), F.when(k % 5 == 0, " ok "), F.lit(""))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", title.alias("title"), texts["en"].alias("en"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE c_mktsegment END AS name, floor(c_acctbal * 10 + 0.5) / 10 AS speed, CASE WHEN c_custkey % 2 = 0 THEN 'alarm' ELSE 'gps' END AS type FROM customer")
def merged_payload(spark, sf_dir):
    k = F.col("c_custkey")
    legacy = {"name": F.when(k % 3 != 0, F.col("c_name")), "type": F.when(k % 2 == 0, "alarm")}
    both = notices.merged({"name": F.col("c_mktsegment"), "speed": notices.round1(F.col("c_acctbal")), "type": F.lit("gps")}, legacy)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", both.alias("p")).select("c_custkey", "p.name", "p.speed", "p.type")


@query(f"WITH {sql.points()} SELECT imei, max(t) AS at, arg_max(id, t) AS position_id FROM points GROUP BY imei")
def latest_per_device(spark, sf_dir):
    return live.latest(derived.points(spark, sf_dir)).select("imei", ms("packet_date", "at"), "position_id")


@query(f"WITH {sql.points()} SELECT CAST(sum(CASE WHEN event_type = 'view' THEN 0 WHEN alarm IS NOT NULL THEN 1 ELSE 2 END) AS BIGINT) AS priorities, count(*) FILTER (WHERE event_type = 'view') AS commands, count(*) FILTER (WHERE event_type <> 'view' AND alarm IS NOT NULL) AS alarms FROM points")
def ingress_priority(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "command").when(F.col("alarm").isNotNull(), "alarm").otherwise("gps")
    p = derived.points(spark, sf_dir).select(kind.alias("type")).withColumn("priority", live.priority(F.col("type")))
    return p.agg(F.sum("priority").alias("priorities"), F.count_if(F.col("type") == "command").alias("commands"), F.count_if(F.col("type") == "alarm").alias("alarms"))


@query(f"WITH {sql.points()}, b AS (SELECT t // 60000 AS m, count(*) AS n FROM points GROUP BY ALL) SELECT count(*) AS batches, max(n) AS most, round(avg(n), 6) AS mean FROM b")
def batch_sizes(spark, sf_dir):
    return live.batch_sizes(live.second_rates(derived.points(spark, sf_dir)).select("n")).select("batches", "most", km("mean"))


@query(f"""WITH {sql.points()}, x AS (SELECT imei, id, t, id % 3 = 0 AS seen, speed < 0 OR id % 11 = 0 AS bad FROM points) SELECT id AS position_id, CASE WHEN bad THEN 'invalid' WHEN seen THEN 'duplicate' ELSE 'acked' END AS outcome FROM x""")
def insert_outcomes(spark, sf_dir):
    p = derived.points(spark, sf_dir)
    n = F.col("position_id")
    return live.insert_outcomes(p.withColumn("latitude", F.when(n % 11 != 0, F.col("latitude"))), p.filter(n % 3 == 0)).select("position_id", "outcome")


# --- ingest


def _messages(spark, sf_dir) -> DataFrame:
    """JSON messages of three shapes, some of them not acceptable."""
    p = derived.points(spark, sf_dir)
    n = F.col("position_id")
    position = F.struct(n.alias("id"), F.when(n % 10 != 0, F.concat(F.when(n % 7 == 0, "\u00a0").otherwise(""), "imei", F.when(n % 3 == 0, "\r\n").otherwise(""))).alias("uniqueId"), F.when(n % 20 == 0, F.lit(7)).alias("deviceId"), F.col("latitude").cast("string").alias("lat"), F.when(n % 15 != 0, F.col("longitude")).alias("longitude"), (F.col("speed") / 1.852).alias("speed"), F.unix_millis("packet_date").alias("fixTime"), F.struct(F.col("alarm"), F.when(n % 30 == 0, "OK!").when(n % 15 == 0, "\r\n\t").alias("result")).alias("attributes"))
    bare = F.to_json(position)
    body = F.when(n % 3 == 0, bare).when(n % 3 == 1, F.concat(F.lit('{"positions":['), bare, F.lit("]}"))).otherwise(F.concat(F.lit('{"data":{"position":'), bare, F.lit("}}")))
    return p.select(n, body.alias("body"))


@query(f"""WITH {sql.points()} SELECT id AS position_id, CASE WHEN id % 10 <> 0 THEN imei END AS imei, round(lat, 6) AS latitude, CASE WHEN id % 15 <> 0 THEN round(lon, 6) END AS longitude, round(speed, 6) AS speed, t AS fix_time, alarm, true AS valid,
    CASE WHEN id % 10 = 0 AND id % 20 <> 0 THEN 'missing_uniqueId_or_deviceId' WHEN id % 30 <> 0 AND id % 15 = 0 THEN 'missing_position_coordinates' END AS reject_reason FROM points""")
def ingest_normalize(spark, sf_dir):
    rows = ingest.checked(ingest.normalized(ingest.positions(_messages(spark, sf_dir).select("body"))))
    return rows.select("position_id", "imei", km("latitude"), km("longitude"), km("speed"), "fix_time", "alarm", "valid", "reject_reason")


@query(f"WITH {sql.points()} SELECT id AS position_id, t AS fix_time, id % 30 = 0 AS has_command_response FROM points")
def raw_archive(spark, sf_dir):
    out = ingest.raw_archive(_messages(spark, sf_dir).select("body"), F.lit("2024-02-01").cast("timestamp"))
    return out.select("position_id", "fix_time", "has_command_response")


@query("SELECT count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def retention_filter(spark, sf_dir):
    rows = derived.events(spark, sf_dir).withColumnRenamed("ts", "received_at")
    return ingest.retained(rows, F.lit("2024-01-20").cast("timestamp"), 7).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"""WITH {sql.points()}, d AS (SELECT imei, t + 60000 * CASE WHEN id % 2 = 0 THEN 1 ELSE 4 END * g AS arrived, id * 3 + g AS seq, id FROM points, (SELECT unnest([0, 1, 2]) AS g))
    SELECT seq, coalesce(arrived - lag(arrived) OVER (PARTITION BY imei, id ORDER BY arrived, seq) <= 120000, false) AS suppressed FROM d""")
def retry_dedupe(spark, sf_dir):
    n, g = F.col("position_id"), F.col("g")
    p = derived.points(spark, sf_dir).withColumn("g", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    rows = p.select(F.concat_ws("|", "imei", n).alias("fingerprint"), (F.unix_millis("packet_date") + F.when(n % 2 == 0, 60000).otherwise(240000) * g).alias("arrived"), (n * 3 + g).alias("seq"))
    return live.retry_dedupe(rows).select("seq", "suppressed")


def _twice(spark, sf_dir) -> DataFrame:
    p = derived.points(spark, sf_dir)
    n = F.col("position_id")
    again = p.filter(n % 5 == 0).withColumn("packet_date", F.timestamp_millis(F.unix_millis("packet_date") + 1000))
    return p.unionByName(again).withColumn("position_id", F.when(n % 4 != 0, n))


TWICE = f"{sql.points()}, two AS (SELECT imei, t, CASE WHEN id % 4 <> 0 THEN id END AS id FROM points UNION ALL SELECT imei, t + 1000, CASE WHEN id % 4 <> 0 THEN id END FROM points WHERE id % 5 = 0)"


@query(f"WITH {TWICE} SELECT imei, id AS position_id, min(t) AS at FROM two WHERE id IS NOT NULL GROUP BY imei, id UNION ALL SELECT imei, id, t FROM two WHERE id IS NULL")
def position_id_dedupe(spark, sf_dir):
    return live.position_id_dedupe(_twice(spark, sf_dir)).select("imei", "position_id", ms("packet_date", "at"))


@query(f"""WITH {TWICE}, g AS (SELECT imei, id, count(*) AS n FROM two GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE id IS NOT NULL) AS BIGINT) AS with_id, CAST(sum(n) FILTER (WHERE id IS NULL) AS BIGINT) AS without_id,
    count(*) FILTER (WHERE id IS NOT NULL AND n > 1) AS duplicate_groups, CAST(sum(n) FILTER (WHERE id IS NOT NULL AND n > 1) AS BIGINT) AS duplicate_rows, CAST(sum(n - 1) FILTER (WHERE id IS NOT NULL AND n > 1) AS BIGINT) AS extra_rows,
    count(*) FILTER (WHERE id IS NOT NULL AND n > 1) = 0 AS can_create FROM g""")
def duplicate_diagnostic(spark, sf_dir):
    return live.duplicate_diagnostic(_twice(spark, sf_dir))


# --- reports


@query(f"WITH {sql.points(10)} SELECT DISTINCT imei FROM points WHERE t >= 1704153600000 AND t < 1704240000000")
def distinct_devices(spark, sf_dir):
    return sequence.in_range(derived.points(spark, sf_dir, 10), F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-03").cast("timestamp")).select("imei").distinct()


@query(f"WITH {sql.paired()} SELECT imei, round(sum(driven), 6) AS km FROM pairs GROUP BY imei")
def mileage(spark, sf_dir):
    return reports.mileage(derived.points(spark, sf_dir)).select("imei", km("km"))


@query(f"WITH {sql.points()}, c AS (SELECT DISTINCT imei, 1704067200000 + (user_id % 24) * 3600000 AS last_at FROM points) SELECT imei, t, id AS position_id, speed FROM points JOIN c USING (imei) WHERE t <= last_at QUALIFY row_number() OVER (PARTITION BY imei ORDER BY t DESC, id DESC) = 1")
def prior_point_asof(spark, sf_dir):
    return reports.prior_points(derived.points(spark, sf_dir), _cursors(spark, sf_dir)).select("imei", "t", "position_id", "speed")


def _cursors(spark, sf_dir) -> DataFrame:
    u = derived.events(spark, sf_dir).select("user_id").distinct()
    at = F.timestamp_millis(F.lit(1704067200000) + (F.col("user_id") % 24) * 3600000)
    return u.select(F.lpad(F.col("user_id").cast("string"), 15, "0").alias("imei"), at.alias("last_at"))


@query(f"""WITH {sql.paired()}, c AS (SELECT DISTINCT imei, CASE WHEN user_id % 5 <> 0 THEN 1704067200000 + (user_id % 24) * 3600000 END AS last_at FROM points),
    s AS (SELECT imei, any_value(last_at) AS last_at, sum(CASE WHEN t > coalesce(last_at, 0) THEN driven ELSE 0 END) AS added, max(CASE WHEN t > coalesce(last_at, 0) THEN t END) AS seen FROM pairs JOIN c USING (imei) GROUP BY imei)
    SELECT imei, CASE WHEN added > 0 THEN seen ELSE last_at END AS last_at, round(CASE WHEN last_at IS NULL THEN 0 ELSE 100 END + CASE WHEN added > 0 THEN added ELSE 0 END, 6) AS km_total FROM s""")
def incremental_mileage(spark, sf_dir):
    status = _cursors(spark, sf_dir).filter(F.col("imei").cast("long") % 5 != 0).select("imei", F.col("last_at").alias("last_mileage_at"), F.lit(100.0).alias("km_total"), F.lit(62.1371).alias("miles_total"))
    return reports.incremental_mileage(derived.points(spark, sf_dir), status).select("imei", ms("last_mileage_at", "last_at"), km("km_total"))


@query(f"""WITH {sql.paired()}, c AS (SELECT DISTINCT imei, user_id, CASE WHEN user_id % 7 <> 0 THEN 1704067200000 + 3600000 * (3 + user_id % 5) END AS last_at FROM points),
    first AS (SELECT imei, max(t) AS at FROM pairs JOIN c USING (imei) WHERE t <= last_at AND c.user_id % 11 <> 0 GROUP BY imei),
    s AS (SELECT imei, any_value(last_at) AS last_at, sum(CASE WHEN t > coalesce(last_at, 0) AND pt IS NOT NULL THEN driven ELSE 0 END) AS added, max(CASE WHEN t > coalesce(last_at, 0) THEN t END) AS seen FROM pairs JOIN c USING (imei) GROUP BY imei)
    SELECT imei, CASE WHEN added > 0 THEN seen ELSE last_at END AS last_at, CASE WHEN added > 0 THEN seen ELSE first.at END AS last_point, round(CASE WHEN added > 0 THEN added ELSE 0 END, 6) AS km_total FROM s LEFT JOIN first USING (imei)""")
def incremental_mileage_carried(spark, sf_dir):
    """The status table has each device's last point, but for some that have a cursor alone, and some that aren't in it; of
    the others points before the earliest cursor aren't read."""
    p, u = derived.points(spark, sf_dir), F.col("imei").cast("long")
    cursors = p.select("imei").distinct().filter(u % 7 != 0).withColumn("last_at", F.timestamp_millis(F.lit(1704067200000) + 3600000 * (3 + u % 5)))
    last = {"packet_date": "last_point_at", "latitude": "last_latitude", "longitude": "last_longitude", "speed": "last_speed"}
    prior = reports.prior_points(p, cursors.filter(u % 11 != 0)).select("imei", *[F.col(c).alias(name) for c, name in last.items()])
    status = cursors.join(prior, "imei", "left").select("imei", F.col("last_at").alias("last_mileage_at"), F.lit(0.0).alias("km_total"), F.lit(0.0).alias("miles_total"), *reports.LAST_POINT)
    out = reports.incremental_mileage(p, status, F.timestamp_millis(F.lit(1704067200000 + 3 * 3600000)))
    return out.select("imei", ms("last_mileage_at", "last_at"), ms("last_point_at", "last_point"), km("km_total"))


def _acc(spark, sf_dir) -> DataFrame:
    p = derived.points(spark, sf_dir, 20)
    return p.filter("event_type in ('click', 'error')").select("imei", F.when(F.col("event_type") == "click", "on").otherwise("off").alias("acc_status"), F.col("packet_date").alias("start_time"))


def _alerts(spark, sf_dir) -> DataFrame:
    return derived.points(spark, sf_dir, 20).filter("alarm = 'overspeed'").select("imei", F.col("packet_date").alias("start_time"))


@query(f"""WITH {sql.DAILY.replace(sql.points(), sql.points(20))}, a AS (SELECT imei, day, count(*) FILTER (WHERE event_type = 'click') AS on_, count(*) FILTER (WHERE event_type = 'error') AS off_, count(*) FILTER (WHERE alarm = 'overspeed') AS al FROM dayed GROUP BY ALL)
    SELECT imei, CAST(day AS VARCHAR) AS day, round(km, 6) AS km, al AS overspeed_count, round(stop_minutes, 6) AS stop_minutes, stop_count, on_ AS acc_on_count, off_ AS acc_off_count FROM daily JOIN a USING (imei, day)""")
def daily_mileage(spark, sf_dir):
    out = reports.daily_mileage(derived.points(spark, sf_dir, 20), _acc(spark, sf_dir), _alerts(spark, sf_dir))
    return out.select("imei", F.col("day").cast("string").alias("day"), km("km"), "overspeed_count", km("stop_minutes"), "stop_count", "acc_on_count", "acc_off_count")


@query(f"WITH {sql.DAILY} SELECT imei, CAST(day AS VARCHAR) AS day, round(stop_minutes, 6) AS stop_minutes, stop_count FROM daily")
def daily_stops(spark, sf_dir):
    return reports.daily_points(derived.points(spark, sf_dir)).select("imei", F.col("day").cast("string").alias("day"), km("stop_minutes"), "stop_count")


@query(f"WITH {sql.points(20)} SELECT imei, count(*) FILTER (WHERE event_type = 'click') AS acc_on_count, count(*) FILTER (WHERE event_type = 'error') AS acc_off_count FROM points WHERE event_type IN ('click', 'error') GROUP BY imei")
def acc_on_off_counts(spark, sf_dir):
    return _acc(spark, sf_dir).groupBy("imei").agg(F.count_if(F.col("acc_status") == "on").alias("acc_on_count"), F.count_if(F.col("acc_status") == "off").alias("acc_off_count"))


@query(f"WITH {sql.points(20)} SELECT imei, count(*) AS alerts FROM points WHERE alarm = 'overspeed' GROUP BY imei")
def alert_counts(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy("imei").agg(F.count("*").alias("alerts"))


@query(f"""WITH {sql.DAILY.replace(sql.points(), sql.points(20))}, a AS (SELECT imei, day, count(*) FILTER (WHERE alarm = 'overspeed') AS al FROM dayed GROUP BY ALL)
    SELECT imei, CAST(day AS VARCHAR) AS day, greatest(fast, al) AS overspeed_count FROM daily JOIN a USING (imei, day)""")
def legacy_overspeed_max(spark, sf_dir):
    out = reports.daily_mileage(derived.points(spark, sf_dir, 20), None, _alerts(spark, sf_dir), "legacy_max")
    return out.select("imei", F.col("day").cast("string").alias("day"), "overspeed_count")


@query(f"WITH {sql.TRAVEL} SELECT imei, CAST(day AS VARCHAR) AS day, theta AS threshold, b AS start_at, e AS end_at, round(km, 6) AS distance_km, round(mins, 6) AS driving_minutes FROM segs")
def travel_segments(spark, sf_dir):
    out = reports.travel_segments(derived.points(spark, sf_dir))
    return out.select("imei", F.col("day").cast("string").alias("day"), "threshold", ms("start_at", "start_at"), ms("end_at", "end_at"), km("distance_km"), km("driving_minutes"))


@query(f"""WITH {sql.TRAVEL}, r AS (SELECT imei, day, run, min(t) AS b, max(coalesce(nt, t)) AS e FROM zr WHERE z GROUP BY ALL), tc AS (SELECT imei, day, count(*) FILTER (WHERE e - b >= 180000) AS n FROM r GROUP BY ALL),
    ks AS (SELECT DISTINCT imei, day, theta FROM cs), sg AS (SELECT imei, day, theta, sum(km) AS km, sum(mins) AS mins, count(*) AS n FROM segs GROUP BY ALL)
    SELECT imei, CAST(day AS VARCHAR) AS day, theta AS stop_threshold_min, round(coalesce(sg.km, 0), 6) AS total_distance_km, round(coalesce(mins, 0), 6) AS total_driving_minutes, coalesce(sg.n, 0) AS total_segments, coalesce(tc.n, 0) AS total_stop_count
    FROM ks LEFT JOIN sg USING (imei, day, theta) LEFT JOIN tc USING (imei, day)""")
def travel_stats_by_threshold(spark, sf_dir):
    out = reports.travel_stats(derived.points(spark, sf_dir))
    return out.select("imei", F.col("day").cast("string").alias("day"), "stop_threshold_min", km("total_distance_km"), km("total_driving_minutes"), "total_segments", "total_stop_count")


@query(f"WITH {sql.IDLE} SELECT imei, CAST(day AS VARCHAR) AS day, b AS start_at, e AS end_at, (e - b) / 1000.0::DOUBLE AS seconds FROM i")
def idle_intervals(spark, sf_dir):
    out = reports.idle_intervals(derived.points(spark, sf_dir))
    return out.select("imei", F.col("day").cast("string").alias("day"), ms("start_at", "start_at"), ms("end_at", "end_at"), "seconds")


@query(f"WITH {sql.IDLE} SELECT imei, CAST(day AS VARCHAR) AS day, round(sum(e - b) / 1000.0::DOUBLE, 6) AS idle_duration_seconds, count(*) AS idle_count, min(b) AS first_idle_start, max(e) AS last_idle_end, round(sum(e - b) / 3600000.0::DOUBLE, 6) AS fuel_waste_liters FROM i GROUP BY imei, day")
def idle_stats(spark, sf_dir):
    out = reports.idle_stats(derived.points(spark, sf_dir))
    return out.select("imei", F.col("day").cast("string").alias("day"), km("idle_duration_seconds"), "idle_count", ms("first_idle_start", "first_idle_start"), ms("last_idle_end", "last_idle_end"), km("fuel_waste_liters"))


@query(f"WITH {sql.DAILY} SELECT imei, CAST(day AS VARCHAR) AS day, round(CASE WHEN CAST(imei AS BIGINT) % 4 = 0 THEN 0 ELSE km END, 6) AS daily_mileage_km, CASE WHEN CAST(imei AS BIGINT) % 4 = 0 THEN 0 ELSE km END <= 0.5 AS is_static FROM daily")
def static_flag(spark, sf_dir):
    p = derived.points(spark, sf_dir)
    n = F.col("imei").cast("long")
    # of some devices there is no daily report, of some one without mileage
    daily = reports.daily_points(p).filter((n % 3 != 0) | (n % 4 == 0)).select("imei", "day", F.when(n % 4 != 0, F.col("km")).alias("km"))
    out = reports.static_stats(p, daily)
    return out.select("imei", F.col("day").cast("string").alias("day"), km("daily_mileage_km"), "is_static")


# --- events


@query(f"""WITH {sql.points()}, e AS (SELECT *, count(*) FILTER (WHERE speed >= 5) OVER (PARTITION BY imei ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ep FROM points),
    o AS (SELECT *, max(CASE WHEN speed <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY imei, ep ORDER BY t, id) AS inside FROM e),
    g AS (SELECT imei, ep, min(t) AS b, max(t) AS x, min(speed) AS min_speed, max(speed) AS max_speed FROM o WHERE inside = 1 GROUP BY ALL)
    SELECT imei, b AS start_at, x AS end_at, min_speed, max_speed, CAST(floor((x - b) / 1000.0 + 0.5) AS BIGINT) AS duration_seconds FROM g WHERE floor((x - b) / 1000.0 + 0.5) > 0""")
def parking_events(spark, sf_dir):
    return events.parking_events(derived.points(spark, sf_dir)).select("imei", ms("start_at", "start_at"), ms("end_at", "end_at"), "min_speed", "max_speed", "duration_seconds")


TRIPS = f"""{sql.paired()}, m AS (SELECT *, max(CASE WHEN speed > 0 THEN t END) OVER (PARTITION BY imei ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lm FROM pairs),
    n AS (SELECT *, CASE WHEN speed > 0 AND (lm IS NULL OR (ps = 0 AND abs(t - lm) >= 60000)) THEN 1 ELSE 0 END AS nw FROM m),
    s AS (SELECT *, sum(nw) OVER (PARTITION BY imei ORDER BY t, id) AS trip FROM n), trips AS (SELECT imei, trip, min(t) AS b, max(t) AS e, sum(km) AS km FROM s WHERE speed > 0 GROUP BY ALL),
    gaps AS (SELECT *, lead(b) OVER (PARTITION BY imei ORDER BY trip) AS nx FROM trips)"""


@query(f"WITH {TRIPS} SELECT imei, b AS start_at, e AS end_at, round(km, 6) AS distance_km, round((e - b) / 60000.0::DOUBLE, 6) AS duration_min, nx IS NULL AS is_open FROM gaps")
def trips(spark, sf_dir):
    return events.trips(derived.points(spark, sf_dir)).select("imei", ms("start_at", "start_at"), ms("end_at", "end_at"), km("distance_km"), km("duration_min"), "is_open")


@query(f"WITH {TRIPS} SELECT imei, b AS start_at, round((nx - e) / 60000.0::DOUBLE, 6) AS gap_after_min FROM gaps")
def trip_gaps(spark, sf_dir):
    return events.trips(derived.points(spark, sf_dir)).select("imei", ms("start_at", "start_at"), km("gap_after_min"))


@query(f"""WITH {sql.points()}, q AS (SELECT *, CASE WHEN user_id % 7 <> 0 THEN 40 + (user_id % 5) * 20 END AS lim FROM points),
    o AS (SELECT *, CASE WHEN alarm = 'lowspeed' THEN false WHEN alarm = 'overspeed' THEN true WHEN lim IS NOT NULL THEN speed > lim END AS ov FROM q),
    s AS (SELECT *, count(*) FILTER (WHERE NOT ov) OVER w AS ses, count(*) FILTER (WHERE NOT ov) OVER (PARTITION BY imei ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM o WHERE ov IS NOT NULL WINDOW w AS (PARTITION BY imei ORDER BY t, id))
    SELECT imei, min(t) AS start_time, max(t) AS end_time, max(speed) AS speed_kmh, CAST(coalesce(any_value(lim), 0) AS DOUBLE) AS speed_limit_kmh, CAST(floor((max(t) - min(t)) / 1000.0 + 0.5) AS BIGINT) AS duration_sec FROM s WHERE ov AND later > 0 GROUP BY imei, ses""")
def overspeed_sessions(spark, sf_dir):
    out = events.overspeed_sessions(derived.points(spark, sf_dir), derived.speed_limits(spark, sf_dir))
    return out.select("imei", ms("start_time", "start_time"), ms("end_time", "end_time"), "speed_kmh", "speed_limit_kmh", "duration_sec")


CHANGES = "n.acc <> r.acc AND floor((n.t - r.b) / 1000.0 + 0.5) >= 5"


@query(f"""WITH RECURSIVE {sql.points()}, n AS (SELECT imei, t, CASE WHEN NOT ignition AND speed > 0 THEN true ELSE ignition END AS acc, row_number() OVER (PARTITION BY imei ORDER BY t, id) AS k FROM points WHERE ignition IS NOT NULL),
    r(imei, k, acc, b, was, ob, oe) AS (SELECT imei, k, acc, t, NULL::BOOLEAN, NULL::BIGINT, NULL::BIGINT FROM n WHERE k = 1 UNION ALL
        SELECT n.imei, n.k, CASE WHEN {CHANGES} THEN n.acc ELSE r.acc END, CASE WHEN {CHANGES} THEN n.t ELSE r.b END, CASE WHEN {CHANGES} THEN r.acc END, CASE WHEN {CHANGES} THEN r.b END, CASE WHEN {CHANGES} THEN n.t END FROM r JOIN n ON n.imei = r.imei AND n.k = r.k + 1)
    SELECT imei, CASE WHEN was THEN 'on' ELSE 'off' END AS acc_status, ob AS start_time, oe AS end_time, CAST(floor((oe - ob) / 1000.0 + 0.5) AS BIGINT) AS duration_sec FROM r WHERE ob IS NOT NULL""")
def acc_segments(spark, sf_dir):
    out = events.acc_segments(events.acc_samples(derived.points(spark, sf_dir)))
    return out.select("imei", "acc_status", ms("start_time", "start_time"), ms("end_time", "end_time"), "duration_sec")


def _fence_sql(fence: str, inside: str, limit: int, enter: str, exit_: str, over: str) -> str:
    return f"""SELECT imei, '{fence}' AS fence_id, t, id, speed, unnest(list_filter([CASE WHEN NOT was AND ins AND {enter} THEN 1000 END, CASE WHEN was AND NOT ins AND {exit_} THEN 1001 END, CASE WHEN ov AND NOT wov AND {over} THEN 1002 END], lambda x: x IS NOT NULL)) AS alarm_type
        FROM (SELECT *, lag(ins) OVER w AS was, lag(ov) OVER w AS wov FROM (SELECT *, rn > 1 AND ins AND speed > {limit} AS ov FROM (SELECT points.*, {inside} AS ins, row_number() OVER (PARTITION BY imei ORDER BY t, id) AS rn FROM points JOIN u USING (imei))) WINDOW w AS (PARTITION BY imei ORDER BY t, id))"""


@query(f"""WITH {sql.points()}, {sql.FENCES} SELECT imei, fence_id, t AS at, id AS position_id, CAST(alarm_type AS INTEGER) AS alarm_type FROM ({_fence_sql('c', sql.inside_circle(), 50, 'true', 'user_id % 2 = 0', 'true')}
    UNION ALL {_fence_sql('p', sql.inside_square(), 100, 'user_id % 3 = 0', 'true', 'user_id % 4 <> 0')})""")
def geofence_events(spark, sf_dir):
    out = events.geofence_events(derived.points(spark, sf_dir), derived.fences(spark, sf_dir))
    return out.select("imei", "fence_id", ms("at", "at"), "position_id", "alarm_type")


@query(f"""WITH {sql.points()}, i AS (SELECT *, coalesce(ignition, false) AND speed <= 0 AS idle FROM points), e AS (SELECT *, count(*) FILTER (WHERE NOT idle) OVER (PARTITION BY imei ORDER BY t, id) AS ep FROM i),
    b AS (SELECT *, min(t) OVER (PARTITION BY imei, ep) AS begin FROM e WHERE idle)
    SELECT imei, begin AS idle_since, t AS notified_at, id AS position_id FROM b WHERE t - begin >= 300000 QUALIFY row_number() OVER (PARTITION BY imei, ep ORDER BY t, id) = 1""")
def live_idle_notify(spark, sf_dir):
    return events.live_idle(derived.points(spark, sf_dir)).select("imei", ms("idle_since", "idle_since"), ms("notified_at", "notified_at"), "position_id")


@query(f"""WITH {sql.points()}, r AS (SELECT imei, t, id, event_type <> 'error' AS online FROM points WHERE event_type <> 'signup'), c AS (SELECT *, lag(online) OVER (PARTITION BY imei ORDER BY t, id) AS was FROM r),
    f AS (SELECT *, lead(t) OVER (PARTITION BY imei ORDER BY t, id) AS e FROM c WHERE was IS NOT NULL AND was <> online)
    SELECT imei, t AS start_at, e AS end_at, CAST(floor((e - t) / 1000.0) AS BIGINT) AS duration_sec, e IS NULL AS is_open FROM f WHERE NOT online""")
def connectivity_intervals(spark, sf_dir):
    rows = derived.points(spark, sf_dir).select("imei", "packet_date", "position_id", F.when(F.col("event_type") != "signup", F.col("event_type") != "error").alias("online"))
    return events.connectivity_intervals(rows).select("imei", ms("start_at", "start_at"), ms("end_at", "end_at"), "duration_sec", "is_open")


# --- live


@query(f"WITH {sql.points()} SELECT imei, id AS position_id, last_value(CASE WHEN id % 3 = 0 THEN speed END IGNORE NULLS) OVER (PARTITION BY imei ORDER BY t, id) AS power FROM points")
def sticky_telemetry(spark, sf_dir):
    rows = derived.points(spark, sf_dir).withColumn("power", F.when(F.col("position_id") % 3 == 0, F.col("speed")))
    return live.sticky(rows, ["power"]).select("imei", "position_id", "power")


@query(f"""WITH {sql.points()}, a AS (SELECT imei, id, speed, t + 5000 AS arrived, t + CASE WHEN id % 41 = 0 THEN 220000000000 WHEN id % 43 = 0 THEN 605000 WHEN id % 47 = 0 THEN 605001 ELSE 0 END AS fix FROM points)
    SELECT imei, max(fix) FILTER (WHERE fix <= arrived + 600000) AS last_fix_at, coalesce(arg_max(speed, fix) FILTER (WHERE fix <= arrived + 600000), arg_min(speed, (arrived, id))) AS speed,
        max(CASE WHEN speed > 1 THEN arrived END) AS last_position_at, count(*) AS points FROM a GROUP BY imei""")
def status_latest(spark, sf_dir):
    """Some fixes are years or a little over ten minutes ahead of their arrival."""
    n, t = F.col("position_id"), F.unix_millis("packet_date")
    ahead = F.when(n % 41 == 0, 220_000_000_000).when(n % 43 == 0, 605_000).when(n % 47 == 0, 605_001).otherwise(0)
    rows = derived.points(spark, sf_dir).withColumns({"arrived": F.timestamp_millis(t + 5000), "packet_date": F.timestamp_millis(t + ahead)})
    return live.status_latest(rows).select("imei", ms("last_fix_at", "last_fix_at"), "speed", ms("last_position_at", "last_position_at"), "points")


@query(f"WITH {ARRIVALS}, {SINGLE} SELECT seq, decision FROM decided")
def live_classification(spark, sf_dir):
    return live.live_classification(arrivals(spark, sf_dir)).select("seq", "decision")


@query(f"WITH RECURSIVE {sql.received()}, {sql.tracked('imei', 'received', 'arrived, seq', 'arrived')} SELECT seq, decision, effective FROM r WHERE n > 0")
def live_device_time(spark, sf_dir):
    return live.live_tracked(derived.received(spark, sf_dir)).select("seq", "decision", F.col("effective_ms").alias("effective"))


@query(f"""WITH RECURSIVE {sql.received()}, {sql.tracked('imei', 'received', 'arrived, seq', 'arrived')}, d AS (SELECT received.*, decision, coalesce(arrived - fix <= 300000, false) AS f, coalesce(arrived - device <= 300000, false) AS d FROM received JOIN r USING (seq))
    SELECT count(*) FILTER (WHERE decision = 'fresh') AS by_fix, count(*) FILTER (WHERE decision = 'fresh_device_time') AS by_device, count(*) FILTER (WHERE NOT f AND decision IN ('future_invalid', 'out_of_order', 'historical')) AS device_refused, count(*) FILTER (WHERE f) AS fix_fresh,
    count(*) FILTER (WHERE NOT f AND d) AS stale_device_fresh, count(*) FILTER (WHERE NOT f AND NOT d) AS stale_device_stale, count(*) FILTER (WHERE NOT f AND coalesce(arrived - server <= 300000, false)) AS stale_server_fresh,
    count(*) FILTER (WHERE NOT f AND coalesce(speed > 1, false)) AS stale_moving, count(*) FILTER (WHERE NOT f AND NOT coalesce(speed > 1, false)) AS stale_standing FROM d""")
def live_clock_split(spark, sf_dir):
    return live.clock_split(live.live_tracked(derived.received(spark, sf_dir)))


@query(f"""WITH RECURSIVE {sql.received(1200)}, b AS (SELECT *, arrived // 120000 AS burst FROM received), {sql.tracked('imei, burst', 'b', 'seq', '(k.burst + 1) * 120000')}
    SELECT seq, decision, accepted AND n = max(CASE WHEN accepted THEN n END) OVER (PARTITION BY imei, burst) AS is_live FROM r WHERE n > 0""")
def burst_live_pick(spark, sf_dir):
    rows = derived.received(spark, sf_dir, 1200).withColumn("burst", F.expr("arrived div 120000")).withColumn("now", (F.col("burst") + 1) * 120000)
    return live.burst_live_pick(rows).select("seq", "decision", "is_live")


@query(f"WITH {ARRIVALS} SELECT seq, coalesce(fix >= max(fix) OVER (PARTITION BY imei ORDER BY arrived, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS sent FROM arrivals")
def broadcast_order_guard(spark, sf_dir):
    return live.broadcast_guard(arrivals(spark, sf_dir)).select("seq", "sent")


@query(f"WITH {ARRIVALS}, {SINGLE} SELECT count(*) AS received, count(*) FILTER (WHERE decision = 'fresh') AS eligible, round(count(*) FILTER (WHERE decision = 'fresh') / count(*), 4) AS ratio FROM decided")
def eligibility_ratio(spark, sf_dir):
    return live.eligibility_ratio(live.live_classification(arrivals(spark, sf_dir)))


@query(f"WITH {ARRIVALS}, {SINGLE} SELECT decision, count(*) AS n FROM decided GROUP BY decision")
def decision_counts(spark, sf_dir):
    return live.decision_counts(live.live_classification(arrivals(spark, sf_dir)))


@query(f"""WITH {sql.points()}, l AS (SELECT imei, direction FROM points QUALIFY row_number() OVER (PARTITION BY imei ORDER BY t DESC, id DESC) <= 128), v AS (SELECT imei, list_sort(list(direction)) AS v FROM l GROUP BY imei)
    SELECT imei, {', '.join(f"v[CAST(floor((len(v) - 1) * {p}::DOUBLE) AS INTEGER) + 1] AS floor_p{k}, v[greatest(CAST(ceil(len(v) * {p}::DOUBLE) AS INTEGER) - 1, 0) + 1] AS ceil_p{k}" for k, p in ((50, 0.5), (95, 0.95), (99, 0.99)))} FROM v""")
def ring_percentiles(spark, sf_dir):
    return live.ring_percentiles(derived.points(spark, sf_dir), "direction")


@query(f"WITH {sql.points()} SELECT t // 60000 * 60000 AS window_start, count(*) AS n FROM points GROUP BY ALL")
def minute_rates(spark, sf_dir):
    return live.second_rates(derived.points(spark, sf_dir)).select(ms("window_start", "window_start"), "n")


@query(f"""WITH RECURSIVE {sql.points(4000)}, k AS (SELECT imei, id, t, concat(coalesce(CAST(ignition AS VARCHAR), '?'), CAST(speed > 0 AS VARCHAR)) AS k, row_number() OVER (PARTITION BY imei ORDER BY t, id) AS n FROM points),
    r(imei, n, id, persist, wrote, was) AS (SELECT imei, n, id, true, t, k FROM k WHERE n = 1 UNION ALL SELECT imei, n, id, due, CASE WHEN due THEN t ELSE wrote END, CASE WHEN due THEN k ELSE was END FROM (SELECT k.*, r.wrote, r.was, k.k <> r.was OR k.t - r.wrote >= 10000 AS due FROM r JOIN k ON k.imei = r.imei AND k.n = r.n + 1))
    SELECT imei, id AS position_id, persist FROM r""")
def status_coalesce(spark, sf_dir):
    rows = derived.points(spark, sf_dir, 4000).withColumn("moving", F.col("speed") > 0)
    return live.status_coalesce(rows, ["ignition", "moving"]).select("imei", "position_id", "persist")


@query(f"WITH {sql.points()}, s AS (SELECT DISTINCT imei, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 7 AS DOUBLE) END AS v FROM points) SELECT imei, id AS position_id, coalesce(last_value(CASE WHEN id % 4 = 0 THEN direction END IGNORE NULLS) OVER (PARTITION BY imei ORDER BY t, id), v) AS power FROM points JOIN s USING (imei)")
def sticky_seeded(spark, sf_dir):
    n, u = F.col("position_id"), F.col("imei").cast("long")
    p = derived.points(spark, sf_dir)
    rows = p.withColumn("power", F.when(n % 4 == 0, F.col("direction").cast("string")).when(n % 4 == 1, "none").when(n % 4 == 2, "NaN"))
    snapshot = p.select("imei").distinct().withColumn("power", F.when(u % 3 != 0, u % 7).cast("string"))
    return live.sticky(rows, ["power"], snapshot).select("imei", "position_id", "power")


NEWER = "n.fix <= n.arrived + 600000 AND (r.fix IS NULL OR n.fix > r.fix OR r.fix > n.arrived + 600000)"
POISONED = "CASE WHEN seq % 50 = 0 THEN fix + 550000 ELSE fix END"


@query(f"""WITH RECURSIVE {ARRIVALS}, n AS (SELECT imei, arrived - seq % 4 * 700000 AS arrived, seq, {POISONED} AS fix, row_number() OVER (PARTITION BY imei ORDER BY arrived - seq % 4 * 700000, seq) AS k FROM arrivals WHERE fix IS NOT NULL),
    r(imei, k, fix, seq) AS (SELECT imei, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM n WHERE k = 1 UNION ALL SELECT n.imei, n.k, CASE WHEN {NEWER} THEN n.fix ELSE r.fix END, CASE WHEN {NEWER} THEN n.seq ELSE r.seq END FROM r JOIN n ON n.imei = r.imei AND n.k = r.k + 1)
    SELECT imei, fix, seq FROM r WHERE fix IS NOT NULL QUALIFY row_number() OVER (PARTITION BY imei ORDER BY k DESC) = 1""")
def status_poison_heal(spark, sf_dir):
    rows = arrivals(spark, sf_dir).withColumns({"arrived": F.expr("arrived - seq % 4 * 700000"), "fix": F.expr(POISONED)})
    return live.status_with_healing(rows)


# --- lookups


@query("SELECT o_orderkey, c_custkey AS resolved, c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0")
def device_resolution(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    here = lambda x: F.when(F.col("c_acctbal") >= 0, x)  # noqa: E731  devices in debt aren't known by any key
    details = c.select(here(F.col("c_custkey").cast("string")).alias("imei"), here(F.concat(F.lit("S"), "c_custkey")).alias("serial_number"), F.col("c_mktsegment").alias("segment"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit("S"), "o_custkey")).alias("key"))
    return lookups.resolve_devices(rows, details).select("o_orderkey", F.col("resolved_imei").cast("long").alias("resolved"), "segment")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS imei, nullif(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 0 END, n_nationkey + 1), 0) AS room FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def tenant_room_resolution(spark, sf_dir):
    k = F.col("c_custkey")
    devices = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("string").alias("imei"), F.when(k % 2 == 0, k).alias("tenant_id"), F.when(k % 3 == 0, F.lit(0)).cast("long").alias("device_owner_id"), F.col("c_nationkey").cast("string").alias("tenant_db_name"))
    tenants = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("tenant_db_name"), (F.col("n_nationkey") + 1).cast("long").alias("tenant_id"))
    return lookups.tenant_rooms(devices, tenants)


@query("SELECT CAST(c_custkey AS VARCHAR) AS imei, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN s_suppkey % 3 = 0 THEN 'offline' ELSE 'unknown' END AS reason FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE s_suppkey IS NULL OR s_suppkey % 3 < 2")
def registry_reconcile(spark, sf_dir):
    s = F.col("s_suppkey")
    snapshot = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(s.cast("string").alias("imei"), F.when(s % 3 == 0, "offline").when(s % 3 == 1, "Unknown").when(s % 2 == 0, "").alias("status"))
    return lookups.reconcile(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("imei")), snapshot)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS imei, CASE WHEN s_suppkey % 2 = 0 THEN concat('m', CAST(s_nationkey AS VARCHAR)) WHEN s_suppkey % 3 = 0 THEN 'own' ELSE 'default' END AS model FROM supplier")
def model_resolution(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    devices = rows.select(s.cast("string").alias("imei"), F.when(s % 3 == 0, " own ").otherwise(" ").alias("model"))
    details = rows.filter(s % 2 == 0).select(s.cast("string").alias("imei"), F.concat(F.lit("m"), F.col("s_nationkey").cast("string")).alias("tr_model"))
    return lookups.models(devices, details, "default")


@query(f"""WITH RECURSIVE {sql.points()}, k AS (SELECT imei, id, kind, cid, row_number() OVER (PARTITION BY imei ORDER BY t, kind, id) AS n FROM (SELECT imei, id, t, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS kind, CASE WHEN event_type = 'view' OR id % 5 <> 0 THEN id % 3 END AS cid FROM points WHERE event_type IN ('view', 'purchase'))),
    r(imei, n, kind, seq, pending, cmd_seq) AS (SELECT imei, 0::BIGINT, 0, NULL::BIGINT, []::STRUCT(c BIGINT, id BIGINT)[], NULL::BIGINT FROM k WHERE n = 1 UNION ALL
        SELECT imei, n, kind, id, CASE WHEN kind = 0 THEN list_append(pending, {{'c': cid, 'id': id}}) ELSE list_filter(pending, lambda p: p.id IS DISTINCT FROM best) END, CASE WHEN kind = 1 THEN best END
        FROM (SELECT k.*, r.pending, coalesce(list_filter(r.pending, lambda p: p.c = k.cid)[-1].id, r.pending[-1].id) AS best FROM r JOIN k ON k.imei = r.imei AND k.n = r.n + 1))
    SELECT imei, seq, cmd_seq FROM r WHERE n > 0 AND kind = 1""")
def command_match(spark, sf_dir):
    p = derived.points(spark, sf_dir)
    n, t = F.col("position_id"), F.unix_millis("packet_date")
    commands = p.filter("event_type = 'view'").select("imei", (n % 3).alias("command_id"), t.alias("sent"), n.alias("cmd_seq"))
    responses = p.filter("event_type = 'purchase'").select("imei", F.when(n % 5 != 0, n % 3).alias("command_id"), t.alias("responded"), n.alias("seq"))
    return lookups.match_commands(commands, responses)


@query("SELECT count(*) AS memberships, count(DISTINCT o_custkey) AS sockets, count(*) FILTER (WHERE o_orderstatus = 'O') AS device_memberships FROM orders")
def subscriber_counts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return lookups.subscriber_counts(o.select(F.col("o_custkey").alias("socket"), F.when(F.col("o_orderstatus") == "O", "device").otherwise("room").alias("kind")))


@query("SELECT c_custkey AS imei, CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE c_acctbal END AS km FROM customer UNION ALL SELECT 1000000 + s_suppkey, 1.0 FROM supplier WHERE s_suppkey % 2 = 0")
def upsert_merge(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("imei"), F.col("c_acctbal").alias("km"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey % 2 = 0").select((F.lit(1000000) + F.col("s_suppkey")).alias("imei"), F.lit(1.0).alias("km"))
    return ingest.upsert(c, s.unionByName(c.filter("imei % 4 = 0").withColumn("km", F.lit(1.0))), ["imei"])


@query("SELECT c_custkey, c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0 AS online FROM customer")
def online_devices(spark, sf_dir):
    k = F.col("c_custkey")
    flags = {"status": F.when(k % 7 == 0, "online").when(k % 2 == 0, "Online"), "traccar_device_status": F.when(k % 3 == 0, "offline"), "connected": F.when(k % 11 == 0, True).when(k % 3 == 0, False), "is_connected": k % 13 == 0, "connection_state": F.when(k % 17 == 0, "online")}
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", *[c.alias(n) for n, c in flags.items()])
    return rows.select("c_custkey", lookups.is_online(rows).alias("online"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'own' WHEN c_acctbal >= 0 THEN CAST(c_custkey AS VARCHAR) END AS imei FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def runtime_id_resolution(spark, sf_dir):
    devices = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("imei"), F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("runtime_id"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "own").alias("imei"), F.col("o_custkey").cast("string").alias("runtime_device_id"))
    return lookups.with_runtime_ids(rows, devices).select("o_orderkey", "imei")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'imei_required' WHEN c_custkey % 7 = 0 THEN 'invalid_or_missing_hours' WHEN c_custkey % 6 = 0 THEN 'invalid_or_missing_totalDistance_or_totalDistanceKm' END AS error,
    CASE WHEN error IS NULL THEN round(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_nationkey * 1000 END / 1000, 6) END AS km_total, CASE WHEN error IS NULL THEN round(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_nationkey * 1000 END / 1000 * 0.621371, 6) END AS miles_total FROM customer""")
def accumulator_overrides(spark, sf_dir):
    k = F.col("c_custkey")
    requests = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, F.when(k % 10 != 0, F.concat(k, F.lit(" "))).alias("imei"), F.when(k % 7 != 0, "12.5").otherwise("x").alias("hours"), F.when((k % 2 == 0) & (k % 6 != 0), F.col("c_acctbal")).alias("total_distance"), F.when(k % 2 != 0, F.col("c_nationkey")).alias("total_distance_km"))
    return lookups.accumulator_overrides(requests).select("c_custkey", "error", km("km_total"), km("miles_total"))


@query(f"WITH {sql.paired()} SELECT imei, round(sum(driven) * 0.621371, 6) AS miles FROM pairs GROUP BY imei")
def mileage_miles(spark, sf_dir):
    return reports.mileage(derived.points(spark, sf_dir)).select("imei", km(geo.km_to_miles(F.col("km")), "miles"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 OR value > 0 WHEN event_type <> 'signup' THEN event_type <> 'error' OR value > 0 END AS acc, CASE WHEN event_id % 3 = 0 THEN 'power' ELSE 'ignition' END AS triggered_by FROM (SELECT event_id, event_type, coalesce(value, 0) AS value FROM events)")
def power_ignition(spark, sf_dir):
    n = F.col("event_id")
    power = F.when(n % 6 == 0, "Power On").when(n % 6 == 3, "powerCut")
    rows = derived.events(spark, sf_dir).select("event_id", power.alias("alarm"), F.when(F.col("event_type") != "signup", F.col("event_type") != "error").alias("ignition"), F.col("value").alias("speed"))
    return events.acc_samples(rows).select("event_id", "acc", "triggered_by")


@query("SELECT c.c_custkey AS unique_id, c.c_nationkey AS old_id, s.s_nationkey AS new_id FROM customer c JOIN supplier s ON s.s_suppkey = c.c_custkey WHERE c.c_nationkey <> s.s_nationkey")
def registry_changed_ids(spark, sf_dir):
    before = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("unique_id"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), (F.col("c_nationkey") + 1).alias("runtime_id")), F.struct(F.lit(2).alias("seq"), F.col("c_nationkey").alias("runtime_id")))).alias("x")).select("unique_id", "x.*")
    after = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("unique_id"), F.lit(1).alias("seq"), F.col("s_nationkey").alias("runtime_id"))
    return lookups.changed_runtime_ids(before, after)


@query("SELECT o_orderkey, c_name AS fcm_token FROM orders JOIN customer ON c_custkey = o_custkey")
def tokens_by_user(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    tokens = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("fcm_token"))
    return lookups.by_user(rows, tokens).select("o_orderkey", "fcm_token")


@query("SELECT CAST(c_custkey AS VARCHAR) AS imei FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE s_suppkey % 3 < 2")
def explicit_offline(spark, sf_dir):
    s = F.col("s_suppkey")
    snapshot = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(s.cast("string").alias("imei"), F.when(s % 3 == 0, "offline").when(s % 3 == 1, "Unknown").when(s % 2 == 0, "").alias("status"))
    return lookups.explicit_offline(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("imei")), snapshot)


@query(f"WITH {sql.points()} SELECT imei, t AS at, id AS position_id FROM points WHERE NOT (t BETWEEN 1704070800000 AND 1704078000000 AND user_id % 2 = 0) UNION ALL SELECT imei, t, -id FROM points WHERE t BETWEEN 1704070800000 AND 1704078000000 AND user_id % 2 = 0 AND speed > 0")
def range_replace(spark, sf_dir):
    """Rows of even devices between two instants (both included) give way to rebuilt ones."""
    old = derived.points(spark, sf_dir).select("imei", "packet_date", "position_id", "speed")
    start, end = F.timestamp_millis(F.lit(1704070800000)), F.timestamp_millis(F.lit(1704078000000))
    even = old.filter(F.col("imei").cast("long") % 2 == 0)
    new = even.filter(F.col("packet_date").between(start, end) & (F.col("speed") > 0)).withColumn("position_id", -F.col("position_id"))
    return events.replace_range(old, new, even, start, end, "packet_date").select("imei", ms("packet_date", "at"), "position_id")
