import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetlane.functions import notices
from fleetlane.operators import live, lookups
from fleetlane.sources import ingest
from fleetlane.streaming import machines, pipeline

from .tracks import SCHEMA, T0, random_tracks, track

NOW = 1_000_000_000


@pytest.mark.parametrize(
    "fix, device, server, last_fix, last_live, current, outdated, decision",
    [
        (None, None, 0, None, None, True, False, "missing_time"),
        (-120_001, None, 0, None, None, True, False, "future_invalid"),
        (-120_000, None, 0, None, None, True, False, "fresh"),
        (300_000, None, 0, None, None, True, False, "fresh"),
        (10, None, 0, 5, None, True, False, "out_of_order"),
        (10, None, 0, 10, None, True, False, "fresh"),
        (300_001, 0, 0, None, None, True, False, "fresh_device_time"),
        (300_001, 0, 0, None, None, True, True, "historical"),
        (300_001, 0, 0, None, None, False, False, "historical"),
        (300_001, 0, 180_001, None, None, True, False, "historical"),
        (300_001, 400_000, 0, None, None, True, False, "historical"),
        (300_001, 10, 0, None, 5, True, False, "out_of_order"),
    ],
)
def test_classify(spark, fix, device, server, last_fix, last_live, current, outdated, decision):
    at = lambda ago: F.lit(None if ago is None else NOW - ago).cast("long")
    got = spark.range(1).select(live.classify_fix(at(fix), at(device), at(server), F.lit(NOW), at(last_fix), at(last_live), F.lit(current), F.lit(outdated)).alias("c")).first()["c"]
    assert got["decision"] == decision and got["live_eligible"] == decision.startswith("fresh")


def test_order_of_arrival(spark):
    rows = [("A", NOW, i, NOW - 60_000 + m * 1000) for i, m in enumerate((0, 5, 3, 6))]
    df = spark.createDataFrame(rows, "imei string, arrived long, seq long, fix long")
    assert [r["decision"] for r in live.live_classification(df).orderBy("seq").collect()] == ["fresh", "fresh", "out_of_order", "fresh"]


def test_newer_fix(spark):
    def newer(fix, stored):
        return spark.range(1).select(live.is_newer_fix(F.lit(fix), F.lit(stored).cast("long"), F.lit(NOW)).alias("x")).first()["x"]

    assert [newer(NOW - 1, NOW), newer(NOW + 600_000, NOW), newer(NOW + 600_001, NOW), newer(NOW, None), newer(NOW, NOW + 10**12)] == [False, True, False, True, True]


def test_healing_streams_a_hot_device(spark):
    rows = [("A", k * 1000, k, k * 1000 + (700_000 if k % 50 == 0 else 590_000 if k % 70 == 3 else k % 9)) for k in range(25_000)]
    rows += [("B", 5, 1, None), ("C", 5, 1, 10**9), ("D", 5, 1, 4), ("D", 6, 2, 4)]
    out = live.status_with_healing(spark.createDataFrame(rows, "imei string, arrived long, seq long, fix long").repartition(3))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    stands = {}
    for imei, arrived, seq, fix in rows:
        old = stands.get(imei)
        if fix is not None and fix <= arrived + 600_000 and (old is None or fix > old[0] or old[0] > arrived + 600_000):
            stands[imei] = (fix, seq)
    assert {r["imei"]: (r["fix"], r["seq"]) for r in out.collect()} == stands


def test_lookups(spark):
    online = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "imei string")
    snapshot = spark.createDataFrame([("b", "offline"), ("c", "Unknown"), ("d", None)], "imei string, status string")
    assert {r["imei"]: r["reason"] for r in lookups.reconcile(online, snapshot).collect()} == {"a": "missing", "b": "offline", "c": "unknown"}
    assert {r["imei"] for r in lookups.explicit_offline(online, snapshot).collect()} == {"b", "c"}
    before = spark.createDataFrame([("u", 1, 0), ("v", 2, 0)], "unique_id string, runtime_id long, seq int")
    after = spark.createDataFrame([("u", 1, 0), ("u", 9, 1), ("v", 2, 0)], before.schema)
    assert lookups.changed_runtime_ids(before, after).collect()[0].asDict() == {"unique_id": "u", "old_id": 1, "new_id": 9}
    users = lookups.by_user(spark.createDataFrame([(1,), (2,)], "user_id long"), spark.createDataFrame([("1", "t")], "user_id string, fcm_token string"))
    assert [r["user_id"] for r in users.collect()] == [1]
    wish = spark.createDataFrame([("a", "m", 1), ("b", "m", 2)], "imei string, model string, runtime_id long")
    seen = spark.createDataFrame([("a", "m", 1), ("b", "n", 2)], wish.schema)
    assert [r["imei"] for r in lookups.needs_sync(wish, seen).collect()] == ["b"]


MESSAGES = [
    {"data": {"positions": [{"imei": "1", "lat": "1.5", "lng": "2.5", "direction": "180", "attributes": {"alarm": "sos"}, "fixTime": "2026-09-07T10:00:00Z", "speed": 10}]}},
    {"deviceId": 7, "latitude": 1, "longitude": 2},
    {"uniqueId": "3", "attributes": {"result": "OK!"}},
    {"latitude": 1},
    {"uniqueId": "4", "latitude": 1},
    [{"uniqueId": "5", "latitude": 1, "longitude": 2}, {"uniqueId": " 6 ", "latitude": 1, "longitude": 2, "valid": False}],
    {"position": {"latitude": 0, "longitude": 0}, "device": {"uniqueId": "8", "status": "online"}},
]


def test_normalize(spark):
    df = spark.createDataFrame([(json.dumps(m),) for m in MESSAGES] + [("no json",), (None,)], "body string")
    rows = ingest.checked(ingest.normalized(ingest.positions(df))).collect()
    got = [(r["imei"], r["runtime_device_id"], r["reject_reason"]) for r in rows]
    missing = "missing_uniqueId_or_deviceId"
    assert got == [("1", None, None), (None, "7", None), ("3", None, None), (None, None, missing), ("4", None, "missing_position_coordinates"), ("5", None, None), ("6", None, None), ("8", None, None), (None, None, missing), (None, None, missing)]
    first = rows[0]
    assert (first["longitude"], first["course"], first["alarm"], first["fix_time"], round(first["speed"], 2)) == (2.5, 180.0, "sos", 1_788_775_200_000, 18.52)
    assert [r["valid"] for r in rows[5:7]] == [True, False] and rows[7]["device_status"] == "online"
    assert ingest.raw_archive(df, F.current_timestamp()).count() == 9


def test_files_to_tables(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text("\n".join([*(json.dumps(m) for m in MESSAGES), '{"uniqueId": "1", "lat']))
    for _ in range(2):  # the second run finds nothing new
        for q in pipeline.archive_and_track(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "ck")):
            q.awaitTermination()
    read = lambda n: spark.read.parquet(str(tmp_path / "out" / n))
    assert (read("raw").count(), read("rejects").count()) == (8, 3)
    assert [r["body"] for r in read("quarantine").collect()] == ['{"uniqueId": "1", "lat']
    rows = read("track").collect()
    assert sorted(r["imei"] for r in rows) == ["1", "5", "6"] and all(r["packet_date"] is not None for r in rows)
    assert [r["runtime_device_id"] for r in read("unresolved").collect()] == ["7"]
    devices = spark.createDataFrame([("77", 7)], "imei string, runtime_id long")
    for q in pipeline.archive_and_track(spark, str(landing), str(tmp_path / "known"), str(tmp_path / "ck2"), devices):
        q.awaitTermination()
    known = lambda n: spark.read.parquet(str(tmp_path / "known" / n))
    assert sorted(r["imei"] for r in known("track").collect()) == ["1", "5", "6", "77"] and known("unresolved").count() == 0


def test_upsert_and_days(spark, tmp_path):
    old = spark.createDataFrame([("a", "2024-01-01", 1.0), ("b", "2024-01-01", 2.0), ("a", "2024-01-02", 3.0)], "imei string, day string, km double")
    new = spark.createDataFrame([("a", "2024-01-01", 9.0)], old.schema)
    path = str(tmp_path / "t")
    ingest.write_days(old, path)
    ingest.write_days(new, path)
    assert sorted((r["imei"], str(r["day"]), r["km"]) for r in spark.read.parquet(path).collect()) == [("a", "2024-01-01", 9.0), ("a", "2024-01-02", 3.0)]
    assert sorted(r["km"] for r in ingest.upsert(old, new, ["imei", "day"]).collect()) == [2.0, 3.0, 9.0]


def streamed(spark, rows, machine, tmp_path, initial=None, by="imei", time_mode="None", **extra):
    """The machine's events over rows that come in three files."""
    rows = sorted(rows, key=lambda r: (r[1], r[6]))
    src = tmp_path / f"in-{type(machine).__name__}"
    schema = spark.createDataFrame([], SCHEMA).schema
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)).withColumns(extra)
    name = f"t_{type(machine).__name__}"
    q = machines.run(stream, machine, by, time_mode, initial).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}"))
    if time_mode == "None":
        q.trigger(availableNow=True).start().awaitTermination()
    else:  # with timers there is always another batch
        q = q.start()
        for _ in range(60):
            q.awaitTermination(1)
            if q.lastProgress and q.lastProgress["batchId"] >= 3:
                break
        q.stop()
    return spark.table(name)


def test_stream_is_batch(spark, tmp_path):
    from fleetlane.operators import events

    rows = random_tracks(5)
    t = spark.createDataFrame(rows, SCHEMA)
    pick = lambda df, *cols: sorted(tuple(r[c] for c in cols) for r in df.collect())
    cols = ("imei", "start_time", "end_time", "duration_sec")
    samples = events.acc_samples(t.withColumn("alarm", F.lit(None).cast("string")))
    acc = F.when(~F.col("ignition") & (F.col("speed") > 0), True).otherwise(F.col("ignition"))
    assert pick(streamed(spark, rows, machines.Ignition(), tmp_path, acc=acc), *cols) == pick(events.acc_segments(samples), *cols)
    trips = events.trips(t).filter("not is_open")
    assert pick(streamed(spark, rows, machines.Trips(), tmp_path), "imei", "start_at", "end_at") == pick(trips, "imei", "start_at", "end_at")
    limits = t.select("imei").distinct().withColumn("limit_kmh", F.lit(60.0))
    assert pick(streamed(spark, rows, machines.Overspeed(), tmp_path, limit_kmh=F.lit(60.0)), "imei", "start_time", "end_time", "speed_kmh") == pick(events.overspeed_sessions(t, limits), "imei", "start_time", "end_time", "speed_kmh")
    assert pick(streamed(spark, rows, machines.IdleNotice(), tmp_path), "imei", "idle_since", "notified_at") == pick(events.live_idle(t), "imei", "idle_since", "notified_at")


def test_parking_stream_keeps_zero_length_stops(spark, tmp_path):
    rows = [("A", T0 + timedelta(minutes=m), 30.0, 31.0, s, True, i, None) for i, (m, s) in enumerate(((0, 0.0), (1, 0.0), (3, 6.0), (4, 1.0), (4, 7.0)))]
    got = streamed(spark, rows, machines.Parking(), tmp_path).orderBy("start_at").collect()
    assert [(r["duration_seconds"], r["max_speed"]) for r in got] == [(180, 6.0), (0, 7.0)]


@pytest.mark.parametrize("last_speed, minutes, closed", [(45.0, 0.5, 0), (None, 0.5, 0), (None, 5, 1), (45.0, 5, 0)])
def test_trip_recovery(spark, tmp_path, last_speed, minutes, closed):
    trips = spark.createDataFrame([("A", T0 - timedelta(minutes=9), T0, True), ("A", T0 - timedelta(days=1), T0 - timedelta(days=1), False)], "imei string, start_at timestamp, end_at timestamp, is_open boolean")
    status = spark.createDataFrame([("A", last_speed)], "imei string, last_speed double").filter("last_speed is not null")
    rows = [("A", T0 + timedelta(minutes=minutes), 30.0, 31.0, 40.0, True, 1, None), ("A", T0 + timedelta(minutes=minutes + 0.1), 30.0, 31.0, 40.0, True, 2, None), ("B", T0, 30.0, 31.0, 0.0, True, 3, None)]
    got = streamed(spark, rows, machines.Trips(), tmp_path, machines.open_trips(trips, status)).collect()
    assert len(got) == closed and all(r["end_at"] == T0 and r["duration_min"] == 9 for r in got)


def test_retry_stream_is_batch(spark, tmp_path):
    rows = [("A", T0 + timedelta(seconds=s), 30.0, 31.0, float(v), True, i, None) for i, (s, v) in enumerate([(0, 1), (60, 1), (170, 1), (291, 1), (10, 2), (131, 2)])]
    got = streamed(spark, rows, machines.RetryDedupe(), tmp_path, by="fingerprint", time_mode="ProcessingTime", fingerprint=F.col("speed").cast("string"))
    batch = live.retry_dedupe(spark.createDataFrame(rows, SCHEMA).select(F.col("speed").cast("string").alias("fingerprint"), F.unix_millis("packet_date").alias("arrived"), F.col("position_id").alias("seq")))
    want = sorted(r["seq"] for r in batch.filter("not suppressed").collect())
    assert sorted(r["position_id"] for r in got.collect()) == want == [0, 3, 4, 5]


def test_outbox_and_payloads(spark):
    out = pipeline.outbox(spark.createDataFrame([("A", 1, None)], "imei string, code int, at string"), "t").first()
    assert out["title"] == "t" and out["data"] == {"imei": "A", "code": "1", "at": ""}
    none = F.lit(None).cast("string")
    n = spark.range(1).select(notices.notification(none, F.lit(""), F.lit("b"), none, none).alias("n")).first()["n"].asDict()
    assert n == {"type": "alarm", "title": "b", "body": "b", "alarm_text": "b", "alarm_text_ar": "b"}
    rows = spark.range(1).select(*[notices.round1(F.lit(v)) for v in ("1.25", "-1.25", "x", None)]).first()
    assert list(rows) == [1.3, -1.2, 0.0, 0.0]


def test_throttle_rules():
    def send(throttle, s, *points):
        return [[e[-1] for e in throttle.decide(s, t, lat, 31.0, speed)] for t, lat, speed in points]

    assert send(machines.RoomThrottle(), {}, (0, 24.7, 40.0), (0, 24.70001, 40.0)) == [["sent"], ["sent"]]
    assert send(machines.RoomThrottle(), {}, (1000, 24.7, 0.0), (2000, 24.70001, 0.0)) == [["sent"], []]
    # a standing point that was held back goes out once the interval is over
    assert send(machines.RoomThrottle(), {}, (0, 24.7, 0.0), (1000, 24.7, 0.0), (30_000, 24.7, 0.0)) == [["sent"], [], ["flushed"]]
    assert send(machines.RoomThrottle(), {}, (0, 24.7, 0.0), (1000, 24.7, 0.0), (31_000, 25.0, 0.0)) == [["sent"], [], ["flushed", "sent"]]
    # 0.5 km/h isn't standing; far from the last send, and of unknown speed, points go out whatever was sent
    two = machines.RoomThrottle(most=2)
    assert send(two, {}, (0, 24.7, 40.0), (1, 24.7, 0.5), (2, 24.7, 0.5)) == [["sent"], ["sent"], []]
    assert send(two, {}, (0, 24.7, 40.0), (1, 24.7, 40.0), (2, 25.0, 0.0)) == [["sent"]] * 3
    assert send(two, {}, (0, 24.7, 40.0), (1, 24.7, 40.0), (2, 24.7, None)) == [["sent"]] * 3
    assert send(two, {}, (0, 24.7, 40.0), (1, 24.7, 40.0), (2, 24.8, 40.0), (30_000, 24.9, 40.0)) == [["sent"], ["sent"], [], ["flushed", "sent"]]
    assert send(two, {}, (0, 24.7, 40.0), (40_000, 24.7, 40.0)) == [["sent"], ["sent"]]
    s = {}
    send(two, s, (0, 24.7, 40.0), (1, 24.7, 40.0), (2, 24.8, 40.0))
    assert [e[-1] for e in two.flushed(s)] == ["flushed"] and two.flushed(s) == []


NOW = 1_700_000_000_000


def test_fix_decisions(spark):
    """The column and the row form of the rules agree with literal cases."""
    cases = [
        ((NOW - 20_000, None, None), (NOW - 5_000, 0), False, "out_of_order"),
        ((None, None, None), (0, 0), False, "missing_time"),
        ((NOW + 600_000, None, None), (0, 0), False, "future_invalid"),
        ((NOW - 1000, NOW + 200_000, None), (0, 0), False, "future_invalid"),
        ((NOW - 600_000, NOW, NOW), (0, 0), True, "fresh_device_time"),
        ((NOW - 600_000, NOW, NOW), (0, 0), False, "historical"),
        ((NOW - 600_000, NOW, NOW - 200_000), (0, 0), True, "historical"),
        ((NOW - 600_000, NOW - 10, NOW), (0, NOW), True, "out_of_order"),
        ((None, NOW, NOW), (0, 0), True, "fresh_device_time"),
        ((NOW - 300_000, None, None), (0, 0), False, "fresh"),
    ]
    for times, last, current, want in cases:
        assert live.fix_decision(*times, NOW, *last, current, False)[0] == want
    rows = [(*times, *last, current) for times, last, current, _ in cases]
    df = spark.createDataFrame(rows, "fix long, device long, server long, last_fix long, last_live long, current boolean")
    got = df.select(live.classify_fix(*[F.col(c) for c in ("fix", "device", "server")], F.lit(NOW), F.col("last_fix"), F.col("last_live"), F.col("current"), F.lit(False))["decision"].alias("d")).collect()
    assert [r["d"] for r in got] == [w for *_, w in cases]


def test_burst_has_one_live_fix(spark):
    rows = [("A", 1, NOW, i, NOW - 20_000 + i * 100) for i in range(100)] + [("B", 1, NOW, 0, NOW - 1000), ("B", 1, NOW, 1, NOW + 3_600_000), ("B", 1, NOW, 2, NOW - 2000), ("C", 1, NOW, 0, NOW - 400_000)]
    df = spark.createDataFrame(rows, "imei string, burst long, now long, seq long, fix long").withColumns({c: F.lit("mine") for c in ("alone", "newest", "fresh", "key")})
    out = live.burst_live_pick(df.repartition(3))
    assert {(r["imei"], r["seq"]) for r in out.filter("is_live").collect()} == {("A", 99), ("B", 0)}
    assert [r["decision"] for r in out.filter("imei = 'B'").orderBy("seq").collect()] == ["fresh", "future_invalid", "out_of_order"]
    assert set(df.columns) < set(out.columns) and out.filter("fresh = 'mine' and key = 'mine'").count() == 104


def test_late_fixes_are_live_by_device_time(spark):
    at = lambda k: NOW + k * 10_000
    rows = [("A", at(0), 0, NOW - 900_000, at(0), at(0), 1.0, 1.0, 0.0), ("A", at(1), 1, NOW - 900_000, at(1), at(1), 1.0, 1.0, 0.0), ("A", at(2), 2, NOW - 900_000, at(2), at(2), 1.0, 1.1, 0.0), ("A", at(3), 3, at(2) - 5, at(3), at(3), 1.0, 1.1, 50.0), ("A", at(4), 4, NOW - 900_000, at(1), at(4), 1.0, 1.2, 50.0)]
    df = spark.createDataFrame(rows, "imei string, arrived long, seq long, fix long, device long, server long, latitude double, longitude double, speed double")
    out = live.live_tracked(df).orderBy("seq").collect()
    assert [r["decision"] for r in out] == ["historical", "historical", "fresh_device_time", "fresh", "out_of_order"]
    counts = live.clock_split(live.live_tracked(df)).first()
    assert (counts["by_fix"], counts["by_device"], counts["fix_fresh"], counts["device_refused"], counts["stale_moving"]) == (1, 1, 1, 3, 1)


def test_commands_answer_once(spark):
    commands = spark.createDataFrame([("A", "1", 100, 10), ("A", "1", 101, 11), ("A", "2", 102, 12)], "imei string, command_id string, sent long, cmd_seq long")
    responses = spark.createDataFrame([("A", "1", 200, 1), ("A", "1", 201, 2), ("A", "1", 202, 3), ("A", None, 203, 4), ("B", "1", 200, 5)], "imei string, command_id string, responded long, seq long")
    got = {r["seq"]: r["cmd_seq"] for r in lookups.match_commands(commands, responses).collect()}
    assert got == {1: 11, 2: 10, 3: 12, 4: None, 5: None}


def test_status_is_written_every_ten_seconds(spark):
    t = track(spark, [(k / 10, 1) for k in range(8)])  # minutes: a row each 6 s
    out = live.status_coalesce(t.withColumn("key", F.lit("mine")), ["speed"]).orderBy("position_id").collect()
    assert [r["persist"] for r in out] == [True, False] * 4 and {r["key"] for r in out} == {"mine"}


def test_runtime_ids_and_overrides(spark):
    devices = spark.createDataFrame([("A", 7), ("B", 7), ("C", 8)], "imei string, runtime_id long")
    rows = spark.createDataFrame([("X", "7"), (None, "7"), (None, "8.0"), (None, "9"), (None, "x")], "imei string, runtime_device_id string")
    assert [r["imei"] for r in lookups.with_runtime_ids(rows, devices).orderBy("runtime_device_id", "imei").collect()] == ["A", "X", "C", None, None]
    asked = spark.createDataFrame([(" 1 ", "5", "1500", None), ("2", "5", None, "2"), ("3", "x", "1", None), ("4", "1", "NaN", None), (" ", "1", "1", None)], "imei string, hours string, total_distance string, total_distance_km string")
    got = {(r["imei"], r["error"], r["km_total"]) for r in lookups.accumulator_overrides(asked).collect()}
    assert got == {("1", None, 1.5), ("2", None, 2.0), ("3", "invalid_or_missing_hours", None), ("4", "invalid_or_missing_totalDistance_or_totalDistanceKm", None), ("", "imei_required", None)}


def test_empty_snapshots_wait_for_the_grace_time():
    say = lambda now, empties, online=5: lookups.empty_snapshot(online, 0, now, empties)
    assert say(1000, 1) == (False, 0) and say(120_000, 0) == (False, 1) and say(130_000, 1) == (True, 2) and say(130_000, 1, 0) == (False, 1)
