"""SQL of the named queries, for DuckDB. The derived tables are made anew in each statement."""

from __future__ import annotations

from fleetlane.sources.derived import BASE_US, ODD_REPLIES

CAIRO = "Africa/Cairo"
#: Fixed values of the codes that the tests' data have, stated here anew: messages, legacy numbers, aliases, muted codes.
MESSAGES = {"overspeed": ("Over Speed Alarm", "تنبيه تجاوز السرعة"), "lowbattery": ("Low Battery Alarm", "تنبيه انخفاض البطارية"), "sos": ("SOS Alarm", "تنبيه استغاثة"), "tampering": ("Tampering Alarm", "تنبيه عبث بالجهاز")}
LEGACY = {"sos": 1, "overspeed": 6, "lowbattery": 14, "tampering": 19}
ALIASES = {"lowbat": "lowbattery"}
MUTED = ("tampering", "lowbattery")


def points(k: int = 60) -> str:
    return f"""points AS (SELECT lpad(CAST(user_id AS VARCHAR), 15, '0') AS imei, user_id, ({BASE_US * k} + epoch_us(ts) - {BASE_US}) // {k * 1000} AS t,
        24.0::DOUBLE + (user_id % 100) / 100.0::DOUBLE + (event_id % 97) / 10000.0::DOUBLE + CASE WHEN event_id % 50 = 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS lat,
        46.0::DOUBLE + (event_id % 89) / 10000.0::DOUBLE AS lon,
        CAST(CASE WHEN event_id % 10 <= 3 THEN 0 WHEN event_id % 10 = 4 THEN 1 WHEN event_id % 10 = 5 THEN 3 WHEN event_id % 10 = 6 THEN 5 WHEN event_id % 10 = 7 THEN 40 WHEN event_id % 10 = 8 THEN 60 ELSE 130 END AS DOUBLE) AS speed,
        CAST((event_id * 7) % 360 AS DOUBLE) AS direction, CASE WHEN event_type = 'signup' THEN NULL ELSE event_type <> 'error' END AS ignition,
        event_id AS id, CASE WHEN event_id % 31 = 0 THEN 'overspeed' WHEN event_id % 37 = 0 THEN 'lowspeed' END AS alarm, event_type FROM events)"""


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


DAY = f"CAST(timezone('{CAIRO}', timezone('UTC', make_timestamp(t * 1000))) AS DATE)"


def paired(keys: str = "imei", k: int = 60) -> str:
    """Common tables up to `pairs`: points with the point before them, reason and km of the guarded distance, and driven km."""
    w = f"OVER (PARTITION BY {keys} ORDER BY t, id)"
    return f"""{points(k)}, dayed AS (SELECT *, {DAY} AS day FROM points),
        lagged AS (SELECT *, lag(t) {w} AS pt, lag(speed) {w} AS ps, lag(lat) {w} AS plat, lag(lon) {w} AS plon, lead(t) {w} AS nt FROM dayed),
        raws AS (SELECT *, {hav('plat', 'plon', 'lat', 'lon')} AS raw, (t - pt) / 3600000.0::DOUBLE AS hours FROM lagged),
        reasons AS (SELECT *, CASE WHEN pt IS NULL THEN 'missing_point' WHEN t <= pt THEN 'bad_time' WHEN hours >= 6 AND raw >= 50 THEN 'offline_relocation'
            WHEN raw >= 2 AND raw / hours > 180 THEN 'implied_speed' ELSE 'ok' END AS reason FROM raws),
        pairs AS (SELECT *, CASE WHEN reason = 'ok' THEN raw ELSE 0.0 END AS km, CASE WHEN reason = 'ok' AND (ps > 0 OR speed > 0) THEN raw ELSE 0.0 END AS driven FROM reasons)"""


def zero_runs(keys: str = "imei, day") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY t, id)"
    return f"""zs AS (SELECT *, speed = 0 AS z, lag(speed) {w} = 0 AS pz FROM pairs),
        zr AS (SELECT *, sum(CASE WHEN z AND NOT coalesce(pz, false) THEN 1 ELSE 0 END) {w} AS run FROM zs)"""


DAILY = f"""{paired('imei, day')}, {zero_runs()},
    stops AS (SELECT imei, day, run, min(t) AS b, max(nt) AS e, bool_or(nt IS NULL) AS o FROM zr WHERE z GROUP BY ALL),
    sc AS (SELECT imei, day, count(*) FILTER (WHERE o OR e - b >= 180000) AS n FROM stops GROUP BY ALL),
    daily AS (SELECT imei, day, sum(driven) AS km, count(*) FILTER (WHERE speed > 120) AS fast, sum(CASE WHEN z THEN coalesce(nt - t, 0) ELSE 0 END) / 60000.0::DOUBLE AS stop_minutes,
        coalesce(any_value(n), 0) AS stop_count FROM zr LEFT JOIN sc USING (imei, day) GROUP BY ALL)"""

TRAVEL = f"""{paired('imei, day')}, {zero_runs()},
    sd AS (SELECT *, CASE WHEN z THEN t - min(CASE WHEN z THEN t END) OVER (PARTITION BY imei, day, run ORDER BY t, id) END AS stood FROM zr),
    th AS (SELECT *, lag(stood) OVER (PARTITION BY imei, day ORDER BY t, id) AS psd, max(CASE WHEN speed > 0 THEN 1 END) OVER (PARTITION BY imei, day ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mb FROM sd),
    xs AS (SELECT th.*, m AS theta, coalesce(psd >= m * 60000, false) AS ls FROM th, (SELECT unnest([1.0, 3.0, 5.0, 10.0, 15.0, 30.0, 60.0]::DOUBLE[]) AS m)),
    ns AS (SELECT *, speed > 0 AND (mb IS NULL OR ls) AS nw FROM xs),
    cs AS (SELECT *, sum(CASE WHEN nw THEN 1 ELSE 0 END) OVER (PARTITION BY imei, day, theta ORDER BY t, id) AS seg, coalesce(NOT nw AND (ps > 0 OR (speed > 0 AND NOT ls)), false) AS cnt FROM ns),
    segs AS (SELECT imei, day, theta, seg, min(t) FILTER (WHERE speed > 0) AS b, max(t) FILTER (WHERE speed > 0) AS e, sum(CASE WHEN cnt THEN km ELSE 0 END) AS km,
        sum(CASE WHEN cnt THEN t - pt ELSE 0 END) / 60000.0::DOUBLE AS mins FROM cs WHERE seg > 0 GROUP BY ALL)"""

IDLE = f"""{points()}, dayed AS (SELECT *, {DAY} AS day, coalesce(ignition, false) AND speed <= 0 AS x FROM points),
    l AS (SELECT *, lag(x) OVER w AS px, lag(t) OVER w AS pt, lead(x) OVER w AS nx, lead(t) OVER w AS nt FROM dayed WINDOW w AS (PARTITION BY imei, day ORDER BY t, id)),
    r AS (SELECT *, sum(CASE WHEN x AND (NOT coalesce(px, false) OR t - pt > 600000) THEN 1 ELSE 0 END) OVER (PARTITION BY imei, day ORDER BY t, id) AS run FROM l),
    i AS (SELECT imei, day, run, min(t) AS b, max(CASE WHEN nx = false AND nt - t <= 600000 THEN nt ELSE t END) AS e FROM r WHERE x GROUP BY ALL HAVING e - b >= 300000)"""

FENCES = """u AS (SELECT DISTINCT user_id, lpad(CAST(user_id AS VARCHAR), 15, '0') AS imei, 24.0::DOUBLE + (user_id % 100) / 100.0::DOUBLE AS la FROM events)"""


def inside_circle() -> str:
    return f"1000 * {hav('lat', 'lon', '(la + 0.004::DOUBLE)', '46.004::DOUBLE')} <= 400"


def inside_square() -> str:
    """Ray casting over the four vertices (la, 46), (la, 46.005), (la + 0.006, 46.005), (la + 0.006, 46)."""
    v = [("la", "46.0::DOUBLE"), ("la", "46.005::DOUBLE"), ("(la + 0.006::DOUBLE)", "46.005::DOUBLE"), ("(la + 0.006::DOUBLE)", "46.0::DOUBLE")]
    edges = []
    for k in range(4):
        (yi, xi), (yj, xj) = v[k], v[k - 1]
        edges.append(f"CASE WHEN ({yi} > lat) <> ({yj} > lat) THEN CAST(lon < ({xj} - {xi}) * (lat - {yi}) / nullif({yj} - {yi}, 0) + {xi} AS INTEGER) ELSE 0 END")
    return f"({' + '.join(edges)}) % 2 = 1"


TOKEN = "regexp_replace(lower(coalesce({0}, '')), '[\\s_\\-]+', '', 'g')"
ALIASED = "CASE " + " ".join(f"WHEN x = '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " ELSE x END"
#: A list of alarm codes made from an event.
CODES = "concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'Over Speed' END, CASE WHEN event_id % 3 = 0 THEN 'low_bat' END, CASE WHEN event_id % 5 = 0 THEN 'SOS' END, CASE WHEN event_id % 7 = 0 THEN 'tampering' END, CASE WHEN event_id % 11 = 0 THEN 'unheard-of' END, CASE WHEN event_id % 13 = 0 THEN 'sos' END)"
TOKENS = f"""c AS (SELECT event_id, {CODES} AS codes FROM events),
    k AS (SELECT event_id, list_filter(list_transform(list_transform(string_split(codes, ','), lambda y: {TOKEN.format('y')}), lambda x: {ALIASED}), lambda x: x <> '') AS raw FROM c),
    tokens AS (SELECT event_id, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS tokens FROM k)"""


def looked_up(values: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN x = '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {other} END"


def text(value: str) -> str:
    """A text as SQL; what isn't plain by its number."""
    parts = [f"'{c}'" if 32 <= ord(c) < 127 and c != "'" else f"chr({ord(c)})" for c in value]
    return f"concat({', '.join(parts)})"


REPLY = f"""CASE event_id % 4
    WHEN 0 THEN concat('Lat:', CASE WHEN event_id % 8 = 0 THEN 'S' ELSE 'N' END, CAST(event_id % 90 AS VARCHAR), '.5,Lon:E46.25,Course:', CAST(event_id % 360 AS VARCHAR), ',Speed:', CAST(event_id % 120 AS VARCHAR), ',DateTime:2024-01-01')
    WHEN 1 THEN concat('External power: 12.', CAST(event_id % 10 AS VARCHAR), 'V; GSM: strong, ACC: ON; Relay: off')
    WHEN 2 THEN concat('RELAY=OK ', CAST(event_id AS VARCHAR), '!') ELSE [{', '.join(map(text, ODD_REPLIES))}][1 + event_id // 4 % {len(ODD_REPLIES)}] END"""
BLANKS = r"[\s\v\p{Z}\x{FEFF}]"
NUMBER = "TRY_CAST(nullif(regexp_extract({0}, '^([0-9]+[.]?[0-9]*|[.][0-9]+)', 1), '') AS DOUBLE)"
FIELD = "list_filter(f, lambda x: x[1] = '{0}')[-1][2]"
COMMAND_REPLIES = rf"""WITH r AS (SELECT event_id, regexp_replace({REPLY}, '^{BLANKS}+|{BLANKS}+$', '', 'g') AS t FROM events),
    p AS (SELECT event_id, t, regexp_extract(t, 'Lat:([NS]?)([0-9.]+),Lon:([EW]?)([0-9.]+),Course:([0-9]+),Speed:([0-9]+),DateTime:([^\s\v\p{{Z}}\x{{FEFF}}]+)', ['ns', 'lat', 'ew', 'lon', 'course', 'speed', 'at']) AS m,
        regexp_extract(t, '^([A-Za-z]+)=([A-Za-z0-9_!\s\v\p{{Z}}\x{{FEFF}}]+)$', ['command', 'result']) AS c,
        list_transform(string_split_regex(t, '[;,]'), lambda x: list_transform(string_split(x, ':'), lambda y: regexp_replace(y, '^{BLANKS}+|{BLANKS}+$', '', 'g'))) AS parts FROM r),
    f AS (SELECT *, list_transform(list_filter(parts, lambda x: len(x) > 1 AND x[1] <> '' AND x[2] <> ''), lambda x: [regexp_replace(lower(x[1]), '{BLANKS}+', '_', 'g'), x[2]]) AS f FROM p),
    s AS (SELECT *, CASE WHEN contains(t, 'External power:') THEN f ELSE [] END AS g FROM f)
    SELECT event_id, CASE WHEN m.at <> '' THEN CASE WHEN m.ns = 'S' THEN -1 ELSE 1 END * {NUMBER.format('m.lat')} END AS lat, CASE WHEN m.at <> '' THEN CASE WHEN m.ew = 'W' THEN -1 ELSE 1 END * {NUMBER.format('m.lon')} END AS lon,
        TRY_CAST(nullif(m.speed, '') AS INTEGER) AS speed, nullif(m.at, '') AS datetime, {FIELD.format('external_power').replace('(f', '(g')} AS external_power,
        nullif(regexp_extract({FIELD.format('external_power').replace('(f', '(g')}, '([0-9]+([.][0-9]+)?)[vV]', 1), '') AS voltage, {FIELD.format('gsm').replace('(f', '(g')} AS gsm, {FIELD.format('relay').replace('(f', '(g')} AS relay,
        nullif(c.command, '') AS command, nullif(c.result, '') AS result FROM s"""


def received(k: int = 60) -> str:
    """Messages with all their times: some late, some from the future, some without a fix, some that don't move."""
    return f"""{points(k)}, received AS (SELECT imei, t AS arrived, id AS seq, CASE WHEN id % 23 <> 0 THEN t - CASE WHEN id % 3 = 0 THEN 400000 WHEN id % 19 = 0 THEN -130000 ELSE (id % 5) * 50000 END END AS fix,
        CASE WHEN id % 8 <> 0 THEN t - CASE WHEN id % 7 = 0 THEN 400000 WHEN id % 37 = 0 THEN -200000 ELSE (id % 4) * 40000 END END AS device, CASE WHEN id % 13 <> 0 THEN t - CASE WHEN id % 11 = 0 THEN 290000 ELSE 1000 END END AS server,
        CASE WHEN id % 2 = 0 THEN 24.5::DOUBLE ELSE 24.0::DOUBLE + id % 3 END AS lat, 46.5 AS lon, CASE WHEN id % 29 <> 0 THEN speed END AS speed, id % 17 = 0 AS motion, id % 31 = 0 AS outdated FROM points)"""


def tracked(keys: str, rows: str, order: str, now: str) -> str:
    """Recursive tables `k` (rows numbered by keys) and `r`: each row's decision, given what those before it left."""
    recent = lambda c: f"coalesce({now} - {c} <= 300000, false)"
    current = "(coalesce(speed > 1, false) OR coalesce(motion, false) OR coalesce(NOT (lat = 0 AND lon = 0) AND (lat <> plat OR lon <> plon), false))"
    behind = "coalesce(last_live > 0 AND device < last_live, false)"
    decision = f"""CASE WHEN fix IS NULL AND device IS NULL THEN 'missing_time' WHEN coalesce(fix, device) > {now} + 120000 OR coalesce(device > {now} + 120000, false) THEN 'future_invalid'
        WHEN {recent('fix')} THEN CASE WHEN last_fix > 0 AND fix < last_fix THEN 'out_of_order' ELSE 'fresh' END
        WHEN {recent('device')} AND NOT coalesce(outdated, false) AND NOT {behind} AND {recent('server')} AND coalesce(abs(device - server) <= 180000, false) AND {current} THEN 'fresh_device_time'
        WHEN {behind} AND {recent('device')} THEN 'out_of_order' ELSE 'historical' END"""
    on = " AND ".join(f"k.{c} = r.{c}" for c in keys.split(", "))
    names = ", ".join(f"k.{c}" for c in keys.split(", "))
    return f"""k AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {rows}),
        r({keys}, n, seq, decision, effective, last_fix, last_live, plat, plon, accepted) AS (SELECT {keys}, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, false FROM k WHERE n = 1 UNION ALL
            SELECT {keys}, n, seq, decision, effective, CASE WHEN decision = 'fresh' AND effective >= last_live THEN effective ELSE last_fix END, greatest(last_live, coalesce(effective, 0)), lat, lon, coalesce(effective >= last_live, false)
            FROM (SELECT *, CASE decision WHEN 'fresh' THEN fix WHEN 'fresh_device_time' THEN device END AS effective FROM (SELECT {names}, k.* EXCLUDE ({keys}), r.last_fix, r.last_live, r.plat, r.plon, {decision} AS decision FROM r JOIN k ON {on} AND k.n = r.n + 1)))"""
