"""Streams with typed state against the batch operators, with a restart in between, and timers."""

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fleetlane.operators import events, live, lookups
from fleetlane.streaming import machines, pipeline, trackers

NOW = 1_700_000_000_000


def streamed(spark, df, machine, path, at, time_mode="None", initial=None, watermark=None, by="imei"):
    """What the machine gives over df, in the order of `at`: two files, a restart, and a third file."""
    rows = df.orderBy(*at).collect()
    out = str(path / "out")
    for cut in ((0, len(rows) // 3, 2 * len(rows) // 3), (2 * len(rows) // 3, len(rows))):
        for lo, hi in zip(cut, cut[1:], strict=False):
            spark.createDataFrame(rows[lo:hi], df.schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
        if watermark:
            stream = stream.withColumn("__event", F.timestamp_millis(watermark)).withWatermark("__event", "0 seconds")
        made = machines.run(stream, machine, by, time_mode, initial)
        q = made.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", str(path / "ck"))
        if time_mode == "None":
            q.trigger(availableNow=True).start().awaitTermination(60)
            continue
        q = q.start()  # with timers there is always another batch
        for _ in range(40):
            q.awaitTermination(1)
            if sum(p["numInputRows"] for p in q.recentProgress) >= cut[-1] - cut[0]:
                break
        q.awaitTermination(2)
        q.stop()
    return spark.read.parquet(out)


def table(df, *cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in df.select(*cols).collect())


def messages(seed, devices=6, n=300):
    """Messages with late, missing and future times, in and out of order, some without a place."""
    rng, rows = random.Random(seed), []
    at = NOW
    for k in range(n):
        at += rng.choice([0, 1000, 20_000, 100_000, 400_000])
        some = lambda *values: rng.choice([None, *values])
        fix, device = some(at, at - 1000, at - 250_000, at - 400_000, at + 130_000, at + 590_000, at + 10**9), some(at, at - 50_000, at - 400_000, at + 200_000)
        rows.append((f"D{rng.randrange(devices)}", at, k, fix, device, some(at, at - 290_000, at - 400_000), some(24.5, 24.5, 24.6), 46.5, some(0.0, 0.5, 40.0), some(90.0, 180.0), some(True, False), some(True), some(0.0, 19.0), some("gps", "alarm"), some(True, False), some("sos"), at // 500_000))
    return rows


SCHEMA = "imei string, arrived long, seq long, fix long, device long, server long, latitude double, longitude double, speed double, direction double, motion boolean, outdated boolean, attr_type double, kind string, ignition boolean, alarm string, burst long"


def test_live_decisions_are_those_of_the_batch(spark, tmp_path):
    df = spark.createDataFrame(messages(0), SCHEMA)
    got = streamed(spark, df, trackers.LiveFixes(), tmp_path, ("arrived", "seq"))
    cols = ("imei", "seq", "decision", "effective_ms", "source")
    assert table(got, *cols) == table(live.live_tracked(df), *cols)
    assert {r["decision"] for r in got.collect()} == {"fresh", "fresh_device_time", "out_of_order", "historical", "future_invalid", "missing_time"}


def test_silent_devices_are_forgotten(spark, tmp_path):
    place = (24.5, 46.5)
    rows = [("A", NOW, 0, NOW), ("B", NOW + 100_000, 1, NOW), ("B", NOW + 200_000, 2, NOW + 200_000), ("A", NOW + 210_000, 3, NOW - 10_000), ("B", NOW + 220_000, 4, NOW)]
    df = spark.createDataFrame([(*r, None, None, *place, 0.0, False, None) for r in rows], "imei string, arrived long, seq long, fix long, device long, server long, latitude double, longitude double, speed double, motion boolean, outdated boolean")
    keep = table(streamed(spark, df, trackers.LiveFixes(), tmp_path / "a", ("arrived",)), "seq", "decision")
    forget = table(streamed(spark, df, trackers.LiveFixes(forget_ms=60_000), tmp_path / "b", ("arrived",), "EventTime", watermark="arrived"), "seq", "decision")
    assert keep == [("0", "fresh"), ("1", "fresh"), ("2", "fresh"), ("3", "out_of_order"), ("4", "out_of_order")]
    assert forget == [("0", "fresh"), ("1", "fresh"), ("2", "fresh"), ("3", "fresh"), ("4", "out_of_order")]


def test_bursts_on_the_stream(spark, tmp_path):
    df = spark.createDataFrame(messages(1), SCHEMA).withColumn("now", (F.col("burst") + 1) * 500_000)
    whole = df.withColumn("file", F.col("burst"))
    cuts = sorted({r["burst"] for r in df.collect()})
    rows = [r for r in whole.collect()]
    out, path = str(tmp_path / "out"), tmp_path / "in"
    for lo, hi in ((0, len(cuts) // 2), (len(cuts) // 2, len(cuts))):
        part = [r for r in rows if r["burst"] in cuts[lo:hi]]
        spark.createDataFrame(part, whole.schema).coalesce(1).write.mode("append").parquet(str(path))
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
        machines.run(stream, trackers.LiveBursts()).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    batch = live.live_bursts(df)
    cols = ("imei", "burst", "seq", "decision", "effective_ms", "is_live")
    assert table(spark.read.parquet(out), *cols) == table(batch, *cols)
    live_rows = batch.filter("is_live").groupBy("imei", "burst").count().collect()
    assert live_rows and all(r["count"] == 1 for r in live_rows)


def plain_status(rows):
    """The rules of the status table, message by message."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        imei, arrived, _, fix, _, _, lat, lon, speed, direction, motion, _, attr, kind, ignition, alarm, _ = r
        old = out.get(imei)
        d = dict(old) if old else {}
        limit = arrived + 600_000
        newer = fix is not None and fix <= limit and (d.get("fix") is None or fix > d["fix"] or d["fix"] > limit)
        d["packet_at"] = arrived
        if attr != 19 and speed is not None and speed > 1:
            d["position_at"] = arrived
        for name, v in [*([("latitude", lat), ("longitude", lon)] if lat is not None else []), ("speed", speed), ("direction", direction)]:
            if v is not None and (newer or d.get(name) is None):
                d[name] = v
        if newer:
            d["fix"] = fix
            if lat is not None and attr != 19 and speed is not None and speed > 0:
                d["gps_at"] = fix
        d |= {"kind": kind, "ignition": ignition, "motion": motion, "alarm": alarm}
        out[imei] = d
    return sorted((k, *(str(d.get(c)) for c in live.STATUS)) for k, d in out.items())


def test_status_is_kept_in_state(spark, tmp_path):
    rows = messages(2)
    df = spark.createDataFrame(rows, SCHEMA)
    batch = live.status_table(df.repartition(3))
    assert table(batch, "imei", *live.STATUS) == plain_status(rows)
    streamed(spark, df, trackers.StatusTable(), tmp_path, ("arrived", "seq"))
    assert table(trackers.status_rows(spark, str(tmp_path / "ck")), "imei", *live.STATUS) == plain_status(rows)


def test_a_fix_of_another_year_does_not_stand(spark, tmp_path):
    year = 7 * 365 * 86_400_000
    rows = [("A", NOW, 0, NOW), ("A", NOW + 1000, 1, NOW + year), ("A", NOW + 2000, 2, NOW + 2000), ("B", NOW, 3, NOW + year)]
    df = spark.createDataFrame([(*r, 1.0, 2.0, 5.0) for r in rows], "imei string, arrived long, seq long, fix long, latitude double, longitude double, speed double")
    assert {r["imei"]: r["fix"] for r in live.status_table(df).collect()} == {"A": NOW + 2000, "B": None}
    streamed(spark, df, trackers.StatusTable(), tmp_path, ("arrived",))
    assert {r["imei"]: r["fix"] for r in trackers.status_rows(spark, str(tmp_path / "ck")).collect()} == {"A": NOW + 2000, "B": None}
    ts = df.withColumns({"packet_date": F.timestamp_millis("fix"), "arrived": F.timestamp_millis("arrived"), "direction": F.lit(0.0), "position_id": F.col("seq")})
    latest = {r["imei"]: r for r in live.status_latest(ts).withColumn("at", F.unix_millis("last_fix_at")).collect()}
    assert latest["A"]["at"] == NOW + 2000 and latest["B"]["at"] is None and latest["B"]["latitude"] == 1.0
    now = spark.createDataFrame([("A", 0), ("A", 1)], "imei string, position_id long").selectExpr("*", "current_timestamp() + make_interval(position_id) AS packet_date", "1d AS latitude", "2d AS longitude", "0d AS speed", "0d AS direction")
    assert live.status_latest(now).filter("last_fix_at <= current_timestamp()").count() == 1


def test_a_poisoned_snapshot_heals(spark, tmp_path):
    """The stored fix of a snapshot lies in the future; the next good one replaces it."""
    snapshot = spark.createDataFrame([("A", NOW + 10**10, 50.0)], "imei string, fix long, latitude double")
    for c, kind in live.STATUS.items():
        if c not in snapshot.columns:
            snapshot = snapshot.withColumn(c, F.lit(None).cast(kind))
    df = spark.createDataFrame([("A", NOW + k, k, NOW + k, 1.0 + k, 2.0, 0.0) for k in range(3)], "imei string, arrived long, seq long, fix long, latitude double, longitude double, speed double")
    streamed(spark, df, trackers.StatusTable(), tmp_path, ("arrived",), initial=snapshot.select("imei", *live.STATUS))
    (r,) = trackers.status_rows(spark, str(tmp_path / "ck")).collect()
    assert (r["fix"], r["latitude"]) == (NOW + 2, 3.0)


class Handle:
    """Timers and states of one key."""

    def __init__(self):
        self.timers = set()

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getValueState(self, name, schema, **_):
        box = SimpleNamespace(value=None)
        box.exists, box.get = (lambda: box.value is not None), (lambda: box.value)
        box.update, box.clear = (lambda v: setattr(box, "value", v)), (lambda: setattr(box, "value", None))
        return box

    def getListState(self, name, schema, **_):
        box = self.getValueState(name, schema)
        box.put, box.get = (lambda v: setattr(box, "value", list(v))), (lambda: iter(box.value or []))
        return box


def clock(ms):
    return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)


def rows_of(frames):
    return [tuple(trackers.plain(x) for x in r) for f in frames for r in f.itertuples(index=False)]


def test_a_silent_device_keeps_its_last_state():
    import pandas as pd

    machine, handle = trackers.StatusWrites(), Handle()
    machine.init(handle)
    send = lambda at, key, now: rows_of(machine.handleInputRows(("A",), iter([pd.DataFrame({"at": [at], "seq": [at], "state_key": [key]})]), clock(now)))
    assert [r[-1] for r in send(0, "x", 0)] == ["first"] and send(4000, "x", 4000) == [] and send(6000, "x", 6000) == []
    assert handle.timers == {16_000}
    assert rows_of(machine.handleExpiredTimer(("A",), clock(16_000), None)) == [("A", 6000, 6000, "x", "flushed")]
    assert rows_of(machine.handleExpiredTimer(("A",), clock(17_000), None)) == []
    assert send(19_000, "x", 19_000) == [] and [r[-1] for r in send(20_000, "x", 20_000)] == ["due"] and [r[-1] for r in send(20_001, "y", 20_001)] == ["changed"]


def test_writes_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(7)
    rows, at = [], NOW
    for k in range(200):
        at += rng.choice([0, 1000, 4000, 9000])
        rows.append((f"D{rng.randrange(3)}", at, k, rng.choice("xy")))
    df = spark.createDataFrame(rows, "imei string, at long, seq long, state_key string")

    class NoTimers(trackers.StatusWrites):
        def arm(self, s, timer_values):
            pass

    got = streamed(spark, df, NoTimers(), tmp_path, ("at", "seq"))
    batch = live.status_coalesce(df.withColumns({"packet_date": F.timestamp_millis("at"), "position_id": F.col("seq")}), ["state_key"]).filter("persist")
    assert table(got, "imei", "seq") == table(batch, "imei", "seq")


def test_the_last_write_comes_by_timer(spark, tmp_path):
    df = spark.createDataFrame([("A", 0, 0, "x"), ("A", 1, 1, "x")], "imei string, at long, seq long, state_key string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = machines.run(stream, trackers.StatusWrites(every_ms=1000), time_mode="ProcessingTime").writeStream.format("memory").queryName("writes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    for _ in range(60):
        q.awaitTermination(1)
        if spark.table("writes").count() == 2:
            break
    q.stop()
    assert table(spark.table("writes"), "seq", "why") == [("0", "first"), ("1", "flushed")]


def fenced(rng, n):
    rows, at = [], NOW
    for k in range(n):
        at += rng.choice([0, 1000, 5000])
        rows.append((f"D{rng.randrange(3)}", at, k, rng.choice([24.0, 24.001, 24.004, 24.01, 99.0, None]), rng.choice([46.001, 46.004, 46.02]), rng.choice([None, 0.0, 60.0, 120.0])))
    return rows


FENCES = [("D0", "c", "circle", 24.004, 46.004, 400.0, None, True, False, 50.0, None), ("D0", "p", "Polygon", None, None, None, [[24.0, 46.0], [24.0, 46.005], [24.006, 46.005], [24.006, 46.0]], False, True, 100.0, True), ("D1", "c", "circle", 24.0, 46.001, 50.0, None, True, True, 0.0, True), ("D1", "z", "hexagon", 24.0, 46.0, 5.0, None, True, True, None, None), ("D2", "n", "polygon", None, None, None, [[24.0, 46.0]], True, True, None, None)]
FENCE_SCHEMA = "imei string, id string, type string, latitude double, longitude double, radius double, coordinates array<array<double>>, notify_on_enter boolean, notify_on_exit boolean, speed_limit double, speed_limit_enabled boolean"


def definitions(spark, fences, at, gone=False):
    df = spark.createDataFrame(fences, FENCE_SCHEMA).withColumnsRenamed({"latitude": "fence_latitude", "longitude": "fence_longitude"})
    return df.withColumns({"at": F.timestamp_millis(F.lit(at)), "gone": F.lit(gone)})


def test_fences_on_the_stream(spark, tmp_path):
    points = spark.createDataFrame(fenced(random.Random(3), 300), "imei string, at long, position_id long, latitude double, longitude double, speed double").withColumn("at", F.timestamp_millis("at"))
    both = trackers.merged(definitions(spark, FENCES, NOW - 1), points)
    got = streamed(spark, both, trackers.Fences(), tmp_path, ("at", "kind", "position_id"))
    batch = events.geofence_events(points.withColumnRenamed("at", "packet_date"), spark.createDataFrame(FENCES, FENCE_SCHEMA))
    cols = ("imei", "fence_id", "at", "position_id", "speed", "alarm_type")
    assert table(got, *cols) == table(batch, *cols) and {r["alarm_type"] for r in batch.collect()} == {1000, 1001, 1002}


def test_fences_change_while_the_stream_runs(spark, tmp_path):
    """A wider circle makes a standing device enter; a fence that is gone says nothing, and goes on when it is back."""
    circle = lambda radius: [("A", "c", "circle", 24.0, 46.0, radius, None, True, True, None, None)]
    places = [(0, 24.01), (10, 24.01), (20, 24.01), (30, 24.2), (40, 24.2), (50, 24.2)]
    points = spark.createDataFrame([("A", NOW + at, at, lat, 46.0, 0.0) for at, lat in places], "imei string, at long, position_id long, latitude double, longitude double, speed double").withColumn("at", F.timestamp_millis("at"))
    changes = definitions(spark, circle(100.0), NOW - 1).unionByName(definitions(spark, circle(5000.0), NOW + 15)).unionByName(definitions(spark, circle(5000.0), NOW + 25, True)).unionByName(definitions(spark, circle(5000.0), NOW + 45))
    got = streamed(spark, trackers.merged(changes, points), trackers.Fences(), tmp_path, ("at", "kind", "position_id"))
    assert table(got, "position_id", "alarm_type") == [("20", "1000"), ("50", "1001")]


@pytest.mark.parametrize("keep_ms", [None, 100])
def test_commands_on_the_stream(spark, tmp_path, keep_ms):
    rng, rows, at = random.Random(4), [], 0
    for k in range(200):
        at += rng.choice([0, 10, 40, 90])
        rows.append((f"D{rng.randrange(3)}", rng.randrange(2), at, rng.choice(["a", "b", None]), k))
    df = spark.createDataFrame(rows, "imei string, kind int, at long, command_id string, number long").filter("kind = 1 or command_id is not null")
    got = streamed(spark, df, trackers.Commands(keep_ms), tmp_path, ("at", "kind", "number"))
    if keep_ms is None:
        commands = df.filter("kind = 0").select("imei", "command_id", F.col("at").alias("sent"), F.col("number").alias("cmd_seq"))
        batch = lookups.match_commands(commands, df.filter("kind = 1").select("imei", "command_id", F.col("at").alias("responded"), F.col("number").alias("seq")))
        assert table(got, "imei", "seq", "cmd_seq") == table(batch, "imei", "seq", "cmd_seq")
    else:
        sent = {r[4]: r[2] for r in rows}
        found = [r for r in got.collect() if r["cmd_seq"] is not None]
        assert found and all(sent[r["seq"]] - sent[r["cmd_seq"]] <= keep_ms for r in found)


def test_connectivity_and_sticky_values_on_the_stream(spark, tmp_path):
    rng, rows, at = random.Random(5), [], NOW
    for k in range(200):
        at += rng.choice([0, 700, 1500])
        rows.append((f"D{rng.randrange(3)}", at, k, rng.choice([True, False, None]), rng.choice([None, 1.5, 2.5, float("nan")])))
    df = spark.createDataFrame(rows, "imei string, at long, seq long, online boolean, power double")
    ts = df.withColumns({"packet_date": F.timestamp_millis("at"), "position_id": F.col("seq"), "speed": F.lit(0.0)})
    batch = events.connectivity_intervals(ts).select("imei", F.unix_millis("start_at").alias("start_at"), F.unix_millis("end_at").alias("end_at"), "duration_sec", "is_open")
    got = streamed(spark, df, trackers.Connectivity(), tmp_path / "c", ("at", "seq"))
    closed = got.filter("not is_open")
    still = got.filter("is_open").join(closed.select("imei", "start_at", F.lit(True).alias("x")).distinct(), ["imei", "start_at"], "left").filter("x is null").drop("x")
    cols = ("imei", "start_at", "end_at", "duration_sec", "is_open")
    assert table(closed.unionByName(still), *cols) == table(batch, *cols)
    snapshot = spark.createDataFrame([("D0", 9.0), ("D1", None)], "imei string, power double")
    sticky = streamed(spark, df.select("imei", "at", "seq", "power"), trackers.Sticky(("power",)), tmp_path / "s", ("at", "seq"), initial=snapshot)
    assert table(sticky, "imei", "seq", "power") == table(live.sticky(ts, ["power"], snapshot).withColumnRenamed("position_id", "n"), "imei", "seq", "power")


def test_an_open_interval_goes_on_from_a_table(spark, tmp_path):
    df = spark.createDataFrame([("A", NOW, 0, False), ("A", NOW + 5999, 1, True), ("B", NOW, 2, True)], "imei string, at long, seq long, online boolean")
    started = spark.createDataFrame([("A", False, NOW - 4000)], "imei string, online boolean, start_at long")
    got = streamed(spark, df, trackers.Connectivity(), tmp_path, ("at",), initial=started)
    assert table(got, "imei", "start_at", "duration_sec") == [("A", str(NOW - 4000), "9")]


def plain_rates(times):
    out, start, n = [], None, 0
    for t in sorted(times):
        start = t if start is None else start
        n += 1
        if t - start >= 1000:
            out.append((start, t, n))
            start, n = t, 0
    return out


def test_rates_follow_the_events(spark, tmp_path):
    rng, rows, at = random.Random(6), [], NOW
    for _ in range(300):
        at += rng.choice([0, 0, 100, 400, 999, 1000, 2500])
        rows.append((f"D{rng.randrange(3)}", at))
    df = spark.createDataFrame(rows, "imei string, at long")
    want = sorted((d, *map(str, w)) for d in ("D0", "D1", "D2") for w in plain_rates([t for x, t in rows if x == d]))
    assert table(live.rate_windows(df.repartition(3)), "imei", "start", "end", "n") == want
    assert table(streamed(spark, df, trackers.RateWindows(), tmp_path, ("at",)), "imei", "start", "end", "n") == want


def test_waiting_positions_go_out_in_order(spark, tmp_path):
    rows = [("7", 1, 30, 3, "c", None), ("7", 1, 10, 1, "a", None), ("8", 1, 10, 9, "z", None), ("7", 0, 35, None, None, "A"), ("7", 1, 20, 2, "b", None), ("7", 1, 40, 4, "d", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n long, runtime_id string, kind int, at long, position_id long, item string, imei string")

    class NoTimers(trackers.Waiters):
        def _kept(self, waiting):
            self.waiting.put(waiting) if waiting else self.waiting.clear() if self.waiting.exists() else None

    got = streamed(spark, df, NoTimers(), tmp_path, ("n",), "ProcessingTime", by="runtime_id")
    assert table(got, "runtime_id", "imei", "item", "why") == [("7", "A", x, "resolved") for x in "abcd"]


def test_waiting_positions_expire():
    import pandas as pd

    machine, handle = trackers.Waiters(keep_ms=1000), Handle()
    machine.init(handle)
    row = lambda kind, at, item, imei=None: pd.DataFrame({"kind": [kind], "at": [at], "position_id": [at], "item": [item], "imei": [imei]})
    send = lambda r, now: rows_of(machine.handleInputRows(("7",), iter([r]), clock(now)))
    assert send(row(1, 1, "a"), 0) == [] and send(row(1, 2, "b"), 600) == [] and handle.timers == {1000}
    assert rows_of(machine.handleExpiredTimer(("7",), clock(1000), None)) == [("7", None, 1, 1, "a", "expired")] and handle.timers == {1600}
    assert send(row(0, None, None, "A"), 1200) == [("7", "A", 2, 2, "b", "resolved")] and send(row(1, 3, "c"), 1300) == [("7", "A", 3, 3, "c", "resolved")]


def test_streams_tell_their_progress(spark, tmp_path):
    listener = pipeline.Progress(str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    rows = [("A", NOW + k, k, NOW + k) for k in range(30)]
    df = spark.createDataFrame(rows, "imei string, arrived long, seq long, fix long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    try:
        q = pipeline.keep_status(stream, str(tmp_path / "ck"))
        q.awaitTermination()
        for _ in range(50):
            if (tmp_path / "progress").exists() and any(p.name.endswith("-end.json") for p in (tmp_path / "progress").iterdir()):
                break
            q.awaitTermination(1)
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    told = pipeline.progress(spark, str(tmp_path / "progress"))
    assert told.agg(F.sum("rows_in")).first()[0] == 30 and told.filter("error is null and batch is null").count() == 1
    assert pipeline.status(spark, str(tmp_path / "ck")).first()["packet_at"] == NOW + 29


def test_positions_wait_for_their_device(spark, tmp_path):
    positions = spark.createDataFrame([("7", 2, 2, "b"), ("7.0", 1, 1, "a"), ("x", 1, 9, "z")], "runtime_device_id string, fix_time long, position_id long, item string")
    devices = spark.createDataFrame([("A", 7), ("B", 8)], "imei string, runtime_id long")
    positions.write.parquet(str(tmp_path / "p"))
    devices.limit(0).write.parquet(str(tmp_path / "d"))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    q = pipeline.waiting(read("p", positions).filter("runtime_device_id <> 'x'"), read("d", devices), 600_000).writeStream.format("memory").queryName("waited").option("checkpointLocation", str(tmp_path / "ck")).start()
    for k in range(60):
        q.awaitTermination(1)
        if k == 3:
            devices.write.mode("append").parquet(str(tmp_path / "d"))
        if spark.table("waited").count():
            break
    q.stop()
    assert [(r["imei"], r["item"], r["why"]) for r in spark.table("waited").collect()] == [("A", "a", "resolved"), ("A", "b", "resolved")]


def test_the_room_throttle_flushes_by_timer():
    import pandas as pd

    machine, handle = machines.RoomThrottle(most=1), Handle()
    machine.init(handle)
    at = pd.to_datetime([NOW, NOW + 1000], unit="ms")
    points = pd.DataFrame({"packet_date": at, "position_id": [1, 2], "latitude": [24.0, 25.0], "longitude": [46.0, 46.0], "speed": [40.0, 40.0]})
    assert [r[-1] for r in rows_of(machine.handleInputRows(("A",), iter([points]), clock(0)))] == ["sent"] and handle.timers == {30_000}
    assert [r[-1] for r in rows_of(machine.handleExpiredTimer(key=("A",), timerValues=clock(30_000), expiredTimerInfo=None))] == ["flushed"]
