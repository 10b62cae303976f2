"""More named queries: rules with state, dated lookups, and fields of payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlane.functions import clock, geo, notices
from fleetlane.operators import live, lookups
from fleetlane.sources import derived, ingest

from . import oracle as sql
from .registry import km, ms, query

# --- status and live decisions

STATUS_MESSAGES = f"""{sql.points()}, m AS (SELECT imei, t + (id % 4) * 1000 AS arrived, id AS seq,
        CASE WHEN id % 23 = 0 THEN NULL WHEN id % 50 = 0 THEN t + 31536000000 WHEN id % 7 = 0 THEN t - 900000 ELSE t END AS fix,
        CASE WHEN id % 6 <> 0 THEN lat END AS lat, CASE WHEN id % 6 <> 0 THEN lon END AS lon, CASE WHEN id % 17 <> 0 THEN speed END AS speed,
        CASE WHEN id % 5 <> 0 THEN direction END AS direction, id % 13 = 0 AS beat, ignition, alarm FROM points),
    n AS (SELECT *, row_number() OVER (PARTITION BY imei ORDER BY arrived, seq) AS k FROM m)"""


@query(f"""WITH RECURSIVE {STATUS_MESSAGES},
    r(imei, k, fix, lat, lon, speed, direction, packet_at, position_at, gps_at, ignition, alarm) AS (
        SELECT imei, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN, NULL::VARCHAR FROM n WHERE k = 1
        UNION ALL SELECT imei, k, CASE WHEN nw THEN fix ELSE ofix END, CASE WHEN lat IS NOT NULL AND (nw OR olat IS NULL) THEN lat ELSE olat END, CASE WHEN lon IS NOT NULL AND (nw OR olon IS NULL) THEN lon ELSE olon END,
            CASE WHEN speed IS NOT NULL AND (nw OR ospeed IS NULL) THEN speed ELSE ospeed END, CASE WHEN direction IS NOT NULL AND (nw OR odirection IS NULL) THEN direction ELSE odirection END,
            arrived, CASE WHEN NOT beat AND speed > 1 THEN arrived ELSE position_at END, CASE WHEN nw AND lat IS NOT NULL AND NOT beat AND speed > 0 THEN fix ELSE gps_at END, ignition, alarm
        FROM (SELECT n.*, r.fix AS ofix, r.lat AS olat, r.lon AS olon, r.speed AS ospeed, r.direction AS odirection, r.position_at, r.gps_at,
            coalesce(n.fix <= n.arrived + 600000 AND (r.fix IS NULL OR n.fix > r.fix OR r.fix > n.arrived + 600000), false) AS nw FROM r JOIN n ON n.imei = r.imei AND n.k = r.k + 1))
    SELECT imei, fix, round(lat, 6) AS latitude, round(lon, 6) AS longitude, speed, direction, packet_at, position_at, gps_at, ignition, alarm FROM r QUALIFY row_number() OVER (PARTITION BY imei ORDER BY k DESC) = 1""")
def status_table(spark, sf_dir):
    """Messages with fixes a year ahead, late ones, without a fix, place, speed or course, and heartbeats."""
    n, t = F.col("position_id"), F.unix_millis("packet_date")
    place = lambda c: F.when(n % 6 != 0, F.col(c)).alias(c)
    fix = F.when(n % 23 == 0, None).when(n % 50 == 0, t + 31_536_000_000).when(n % 7 == 0, t - 900_000).otherwise(t)
    p = derived.points(spark, sf_dir)
    values = [place("latitude"), place("longitude"), F.when(n % 17 != 0, F.col("speed")).alias("speed"), F.when(n % 5 != 0, F.col("direction")).alias("direction")]
    rows = p.select("imei", (t + n % 4 * 1000).alias("arrived"), n.alias("seq"), fix.alias("fix"), F.when(n % 13 == 0, 19).alias("attr_type"), "ignition", "alarm", *values)
    return live.status_table(rows).select("imei", "fix", km("latitude"), km("longitude"), "speed", "direction", "packet_at", "position_at", "gps_at", "ignition", "alarm")


@query(f"""WITH RECURSIVE {sql.received(1200)}, b AS (SELECT *, arrived // 120000 AS burst FROM received), {sql.tracked('imei', 'b', 'burst, coalesce(fix, 0), seq', '(k.burst + 1) * 120000')}
    SELECT seq, decision, accepted AND n = max(CASE WHEN accepted THEN n END) OVER (PARTITION BY r.imei, burst) AS is_live FROM r JOIN b USING (seq) WHERE n > 0""")
def live_bursts(spark, sf_dir):
    rows = derived.received(spark, sf_dir, 1200).withColumn("burst", F.expr("arrived div 120000")).withColumn("now", (F.col("burst") + 1) * 120000)
    return live.live_bursts(rows).select("seq", "decision", "is_live")


@query(f"""WITH RECURSIVE {sql.points(40000)}, k AS (SELECT imei, t, row_number() OVER (PARTITION BY imei ORDER BY t, id) AS n FROM points),
    r(imei, n, start, c, s, e, m) AS (SELECT imei, n, t, 1::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM k WHERE n = 1 UNION ALL
        SELECT imei, n, CASE WHEN due THEN t ELSE start END, CASE WHEN due THEN 0 ELSE c + 1 END, CASE WHEN due THEN start END, CASE WHEN due THEN t END, CASE WHEN due THEN c + 1 END
        FROM (SELECT k.*, r.start, r.c, k.t - r.start >= 1000 AS due FROM r JOIN k ON k.imei = r.imei AND k.n = r.n + 1))
    SELECT imei, s AS start, e AS "end", m AS n FROM r WHERE m IS NOT NULL""")
def rate_windows(spark, sf_dir):
    return live.rate_windows(derived.points(spark, sf_dir, 40000).select("imei", F.unix_millis("packet_date").alias("at")))


# --- registry


POLLS = f"""{sql.points()}, polls AS (SELECT 1704067200000 + 3600000 * (h + 1) AS polled, h, h % 5 <> 3 AS ok FROM (SELECT unnest(range(0, 11)) AS h)),
    devices AS (SELECT DISTINCT user_id, imei FROM points),
    listed AS (SELECT polled, imei AS unique_id, user_id * 10 + CASE WHEN user_id % 3 = 0 AND h >= 5 THEN 1 ELSE 0 END AS runtime_id FROM polls, devices WHERE h % 5 <> 4 AND (user_id + h) % 7 <> 0),
    good AS (SELECT polled FROM polls WHERE ok AND h % 5 <> 4)"""


def _polls(spark, sf_dir):
    """Hourly polls of a registry, of which some fail and some list nothing; devices vanish and come back, some with another id."""
    u, h, start = F.col("user_id"), F.col("h"), F.lit(1704067200000)
    polls = spark.range(11).select(F.col("id").alias("h")).select((start + 3600000 * (h + 1)).alias("at"), (h % 5 != 3).alias("ok"), "h")
    devices = derived.events(spark, sf_dir).select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(11)])).alias("h"))
    runtime = u * 10 + F.when((u % 3 == 0) & (h >= 5), 1).otherwise(0)
    listed = devices.filter((h % 5 != 4) & ((u + h) % 7 != 0))
    rows = listed.select((start + 3600000 * (h + 1)).alias("at"), F.concat(F.lit(" "), F.lpad(u.cast("string"), 15, "0")).alias("unique_id"), runtime.alias("runtime_id"), u.alias("seq"))
    return polls.select("at", "ok"), rows


@query(f"""WITH {POLLS}, q AS (SELECT id, t, user_id * 10 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS rid FROM points), v AS (SELECT id, rid, max(polled) AS polled FROM q LEFT JOIN good ON polled <= t GROUP BY ALL)
    SELECT id AS position_id, unique_id AS imei FROM v LEFT JOIN listed ON listed.polled = v.polled AND listed.runtime_id = v.rid""")
def registry_as_of(spark, sf_dir):
    n = F.col("position_id")
    rows = derived.points(spark, sf_dir).select(n, F.unix_millis("packet_date").alias("at"), (F.col("imei").cast("long") * 10 + F.when(n % 2 == 0, 1).otherwise(0)).cast("string").alias("runtime_device_id"))
    return lookups.registry_as_of(rows, lookups.registry_intervals(*_polls(spark, sf_dir))).select("position_id", "imei")


@query(f"""WITH {POLLS}, v AS (SELECT polled, lead(polled) OVER (ORDER BY polled) AS nx FROM good),
    l AS (SELECT runtime_id, unique_id, polled, nx, lag(nx) OVER (PARTITION BY runtime_id ORDER BY polled) AS pn FROM listed JOIN v USING (polled)),
    g AS (SELECT *, sum(CASE WHEN pn = polled THEN 0 ELSE 1 END) OVER (PARTITION BY runtime_id ORDER BY polled) AS run FROM l)
    SELECT runtime_id, any_value(unique_id) AS imei, min(polled) AS since, CASE WHEN NOT bool_or(nx IS NULL) THEN max(nx) END AS until_, bool_or(nx IS NULL) AS still FROM g GROUP BY runtime_id, run""")
def registry_intervals(spark, sf_dir):
    out = lookups.registry_intervals(*_polls(spark, sf_dir))
    return out.select("runtime_id", "imei", "since", F.col("until").alias("until_"), F.col("until").isNull().alias("still"))


GATE = f"""{sql.points()}, f AS (SELECT imei AS source, t AS told, id, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 3 = 0 THEN 5 ELSE 0 END AS devices, CASE WHEN id % 4 <> 0 THEN 7 ELSE 0 END AS online FROM points),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY told, id) AS n FROM f)"""


@query(f"""WITH RECURSIVE {GATE}, r(source, n, id, empties, allowed) AS (SELECT source, 0::BIGINT, NULL::BIGINT, 0, false FROM k WHERE n = 1 UNION ALL
        SELECT source, n, id, CASE WHEN devices IS NULL THEN empties WHEN devices > 0 THEN 0 WHEN online <= 0 THEN empties WHEN grace THEN 0 ELSE empties + 1 END,
            CASE WHEN devices IS NULL THEN false WHEN devices > 0 THEN true WHEN online <= 0 OR grace THEN false ELSE empties + 1 >= 2 END
        FROM (SELECT k.*, r.empties, k.told - 1704067200000 < 7200000 AS grace FROM r JOIN k ON k.source = r.source AND k.n = r.n + 1))
    SELECT id AS position_id, allowed FROM r WHERE n > 0""")
def snapshot_gate(spark, sf_dir):
    n = F.col("position_id")
    devices = F.when(n % 9 == 0, None).when(n % 3 == 0, 5).otherwise(0)
    rows = derived.points(spark, sf_dir).select(F.col("imei").alias("source"), F.unix_millis("packet_date").alias("at"), n, devices.alias("devices"), F.when(n % 4 != 0, 7).otherwise(0).alias("online"))
    return lookups.snapshot_gate(rows, 1704067200000, 7_200_000).select("position_id", "allowed")


# --- sinks and sources


@query("SELECT c_custkey AS imei, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey ELSE c_acctbal END AS seconds FROM customer WHERE NOT (c_custkey % 4 = 0 AND c_nationkey <= 0)")
def upsert_or_delete(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = c.select(F.col("c_custkey").alias("imei"), F.col("c_acctbal").alias("seconds"))
    new = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("imei"), F.col("c_nationkey").cast("double").alias("seconds"))
    return ingest.upsert_or_delete(old, new, ["imei"], F.col("seconds") > 0)


@query("SELECT event_id, event_id % 9 <> 0 AND event_id % 14 <> 0 AS good FROM events")
def quarantined_lines(spark, sf_dir):
    n = F.col("event_id")
    whole = F.to_json(F.struct(n.alias("id"), F.col("event_type").alias("type")))
    body = F.when(n % 9 == 0, F.substring(whole, 1, 12)).when(n % 14 == 0, "").otherwise(whole)
    return derived.events(spark, sf_dir).select("event_id", ingest.is_json(body).alias("good"))


# --- functions


@query(f"WITH {sql.points()}, {sql.FENCES} SELECT imei, id AS position_id FROM points JOIN u USING (imei) WHERE points.user_id % 5 <> 4 AND {sql.inside_square()}")
def nested_rings(spark, sf_dir):
    """Polygons as JSON: plain ones, rings of which the first counts, and what is none."""
    u = F.col("imei").cast("long")
    fences = derived.fences(spark, sf_dir).filter("type = 'polygon'")
    plain = F.to_json("coordinates")
    hole = F.lit("[[24.0,46.0],[25.0,46.0],[25.0,47.0]]")
    text = F.when(u % 5 == 4, "[]").when(u % 2 == 0, F.concat(F.lit("["), plain, F.lit(","), hole, F.lit("]"))).otherwise(plain)
    rows = derived.points(spark, sf_dir).join(fences.select("imei", geo.ring(text).alias("ring")), "imei")
    return rows.filter(geo.in_polygon(F.col("latitude"), F.col("longitude"), F.col("ring"))).select("imei", "position_id")


@query(f"""WITH e AS (SELECT event_id, ts, CAST(timezone('{sql.CAIRO}', timezone('UTC', ts)) AS DATE) AS d FROM (SELECT event_id, ts + to_days(CAST(event_id % 366 AS INTEGER)) AS ts FROM events))
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'explicit' WHEN event_id % 5 = 1 THEN 'utc' ELSE 'cairo' END AS mode,
        CASE WHEN event_id % 5 = 0 THEN epoch_ms(date_trunc('hour', ts)) WHEN event_id % 5 = 1 THEN epoch_ms(date_trunc('day', ts)) ELSE epoch_ms(timezone('{sql.CAIRO}', d::TIMESTAMP)) END AS start_at,
        CASE WHEN event_id % 5 = 0 THEN epoch_ms(date_trunc('hour', ts)) + 86400000 WHEN event_id % 5 = 1 THEN epoch_ms(date_trunc('day', ts)) + 86400000 ELSE epoch_ms(timezone('{sql.CAIRO}', (d + 1)::TIMESTAMP)) END AS end_at FROM e""")
def business_day_resolve(spark, sf_dir):
    n = F.col("event_id")
    rows = derived.events(spark, sf_dir).select("event_id", F.timestamp_add("DAY", (n % 366).cast("int"), F.col("ts")).alias("ts"))
    explicit = F.when(n % 5 == 0, F.date_trunc("HOUR", "ts"))
    day = clock.resolved_day(F.col("ts"), explicit, F.when(n % 5 == 1, " UTC\n").when(n % 5 == 2, "Cairo").when(n % 5 == 3, ""))
    return rows.select("event_id", day.alias("d")).select("event_id", "d.mode", ms("d.start_at", "start_at"), ms("d.end_at", "end_at"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'alarm' END AS type, CASE WHEN event_id % 2 = 0 THEN 'a' WHEN event_id % 5 = 0 THEN 'b' END AS alarm_text,
        CASE WHEN event_id % 4 = 0 THEN 1.5::DOUBLE WHEN event_id % 4 <> 3 THEN 2.5::DOUBLE END AS latitude, CASE WHEN event_id % 7 < 2 THEN CAST(event_id AS DOUBLE) WHEN event_id % 7 < 5 THEN 3.0::DOUBLE END AS speed,
        CASE WHEN event_id % 6 = 0 THEN 'x,y' WHEN event_id % 6 = 1 THEN 'z' ELSE '' END AS codes FROM events""")
def notification_fields(spark, sf_dir):
    n, none = F.col("event_id"), F.lit(None).cast("string")
    s = n.cast("string")
    fields = {
        "type": F.when(n % 3 == 0, F.col("event_type")).when(n % 3 == 1, ""),
        "alarmText": F.when(n % 2 == 0, "a").otherwise(""),
        "alarm_text": F.when(n % 5 == 0, "b"),
        "latitude": F.when(n % 4 == 0, 1.5),
        "lat": F.when(n % 4 == 1, 2.5),
        "gps_latitude": F.when(n % 4 != 3, 2.5),
        "speed": F.when(n % 7 == 0, s).when(n % 7 == 1, F.concat(s, F.lit(".0"))).when(n % 7 == 2, "fast").when(n % 7 == 3, "NaN").when(n % 7 == 5, "-Infinity"),
        "gps_speed": F.when(n % 7 < 5, 3.0),
        "alarmCodes": F.when(n % 6 == 0, F.array(F.lit("x"), F.lit("y"))),
        "alarmCode": F.when(n % 6 == 1, "z").when(n % 6 == 0, "w").otherwise(none),
    }
    out = derived.events(spark, sf_dir).select("event_id", notices.picked(fields).alias("f"))
    return out.select("event_id", "f.type", "f.alarm_text", "f.latitude", "f.speed", F.array_join("f.alarm_codes", ",").alias("codes"))


@query(f"""WITH {sql.TOKENS}, t AS (SELECT event_id, coalesce(list_filter(list_transform(tokens, lambda x: {sql.looked_up(sql.LEGACY, 'NULL')}), lambda y: y IS NOT NULL)[1], 0) AS code FROM tokens)
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '19' END AS protocol, CAST(event_id AS VARCHAR) AS serial, CAST(192 + event_id % 20 % 16 AS INTEGER) AS satellite, CAST(event_id % 20 AS INTEGER) AS satellites, 12 AS gps_info_len,
        CASE WHEN event_id % 11 <> 0 THEN value END AS latitude, 0 AS course_status, 'cn' AS language, event_id % 2 = 0 AS gps_positioned, true AS real_time_gps, CASE WHEN event_id % 4 = 0 THEN 55.0::DOUBLE END AS voltage_level,
        CASE WHEN event_id % 5 = 0 THEN 4.0::DOUBLE END AS signal_strength, CAST(code AS INTEGER) AS alarm_type, coalesce(event_id % 11 <> 0 AND value >= 0, false) AS north_latitude, event_type = 'click' AS acc_on, event_id % 7 = 0 AS charging,
        event_id % 13 = 0 AS oil_cut, 0 AS alarm_code, false AS defense FROM t JOIN events USING (event_id)""")
def legacy_payload(spark, sf_dir):
    n, e = F.col("event_id"), derived.events(spark, sf_dir)
    some = [(2, "Over Speed"), (3, "low_bat"), (5, "SOS"), (7, "tampering"), (11, "unheard-of"), (13, "sos")]
    from fleetlane.functions import text

    tokens = text.alarm_tokens(F.concat_ws(",", *[F.when(n % k == 0, c) for k, c in some]))
    position = {
        "type": F.when(n % 3 == 0, 19),
        "id": n,
        "satellites": n % 20,
        "latitude": F.when(n % 11 != 0, F.col("value")),
        "longitude": F.lit(1.0),
        "valid": n % 2 == 0,
        "battery_level": F.when(n % 4 == 0, 55),
        "rssi": F.when(n % 5 == 0, 4),
        "ignition": F.when(F.col("event_type") == "click", True),
        "charge": F.when(n % 7 == 0, True),
        "blocked": n % 13 == 0,
    }
    names = ("protocol", "serial", "satellite", "satellites", "gps_info_len", "course_status", "language", "gps_positioned", "real_time_gps", "voltage_level", "signal_strength")
    more = ("alarm_type", "north_latitude", "acc_on", "charging", "oil_cut", "alarm_code", "defense")
    out = e.select("event_id", notices.legacy_payload(position, tokens).alias("p"))
    return out.select("event_id", *[f"p.{c}" for c in names], "p.gps.latitude", *[f"p.{c}" for c in more])
