from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetlane.operators import events

from .tracks import SCHEMA, T0, by_device, guarded, random_tracks, track


def ms(ts):
    return round((ts - T0).total_seconds() * 1000)


def parked(own):
    out, cur = [], None
    for _, t, *_, speed in [(r[0], r[1], r[4]) for r in own]:
        if cur is None and speed <= 1:
            cur = [t, t, speed, speed]
        elif cur is not None:
            cur = [cur[0], t, min(cur[2], speed), max(cur[3], speed)]
            if speed >= 5:
                out.append(cur)
                cur = None
    out += [cur] if cur else []
    return [(ms(a), ms(b), low, high) for a, b, low, high in out if int((b - a).total_seconds() + 0.5) > 0]


def trips_of(own):
    out, moved, before, prev = [], None, None, None
    for r in own:
        if r[4] > 0:
            gap = None if moved is None else (r[1] - moved).total_seconds() / 60
            if moved is None or (before == 0 and gap >= 1):
                out.append([r[1], r[1], 0.0])
            out[-1][1] = r[1]
            out[-1][2] += guarded(prev, r)[0] if prev else 0.0
            moved = r[1]
        before, prev = r[4], r
    return [(ms(a), ms(b), round(d, 6)) for a, b, d in out]


def acc_of(own):
    out, state = [], None
    for r in own:
        if r[5] is None:
            continue
        acc = True if r[4] > 0 else r[5]
        if state is None:
            state = (acc, r[1])
        elif state[0] != acc and int((r[1] - state[1]).total_seconds() + 0.5) >= 5:
            out.append(("on" if state[0] else "off", ms(state[1]), ms(r[1])))
            state = (acc, r[1])
    return out


def over_of(own, limit):
    out, cur = [], None
    for r in own:
        over = False if r[7] == "lowspeed" else True if r[7] == "overspeed" else None if limit is None else r[4] > limit
        if over:
            cur = [cur[0] if cur else r[1], r[1], max(cur[2] if cur else 0.0, r[4])]
        elif over is False and cur:
            out.append((ms(cur[0]), ms(cur[1]), cur[2]))
            cur = None
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_machines_are_those_of_loops(spark, seed):
    rows = random_tracks(seed)
    t = spark.createDataFrame(rows, SCHEMA).cache()
    devices = by_device(rows)
    limits = {f"D{d}": None if d % 3 == 0 else 60.0 for d in range(12)}

    def got(df, *cols):
        out = {d: [] for d in devices}
        for r in df.collect():
            out[r["imei"]].append(tuple(ms(r[c]) if hasattr(r[c], "year") else round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols))
        return {d: sorted(v) for d, v in out.items()}

    want = lambda f: {d: sorted(f(own)) for d, own in devices.items()}
    assert got(events.parking_events(t), "start_at", "end_at", "min_speed", "max_speed") == want(parked)
    assert got(events.trips(t), "start_at", "end_at", "distance_km") == want(trips_of)
    assert got(events.acc_segments(events.acc_samples(t.withColumn("alarm", F.lit(None).cast("string")))), "acc_status", "start_time", "end_time") == want(acc_of)
    table = spark.createDataFrame(list(limits.items()), "imei string, limit_kmh double")
    assert got(events.overspeed_sessions(t, table), "start_time", "end_time", "speed_kmh") == {d: sorted(over_of(own, limits[d])) for d, own in devices.items()}


def test_parking_scenario(spark):
    got = events.parking_events(track(spark, [(0, 0), (1, 0), (2, 3), (3, 6)])).collect()
    assert [(r["duration_seconds"], r["max_speed"]) for r in got] == [(180, 6.0)]
    assert events.parking_events(track(spark, [(0, 3), (1, 6)])).count() == 0


def test_acc_change_within_five_seconds_waits(spark):
    rows = [("A", T0 + timedelta(seconds=s), 30.0, 31.0, 0.0, on, s, None) for s, on in ((0, True), (3, False), (6, False))]
    got = events.acc_segments(events.acc_samples(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r["acc_status"], r["duration_sec"]) for r in got] == [("on", 6)]


def test_hot_device_is_streamed(spark):
    flips = [(s, s // 7 % 2 == 0) for s in range(0, 75_000, 3)]
    rows = spark.createDataFrame([("A", s, on) for s, on in reversed(flips)] + [("B", 0, True), ("B", 9, False)], "imei string, s long, on boolean")
    rows = rows.select("imei", (F.lit(T0) + F.make_dt_interval(secs="s")).alias("packet_date"), F.lit(0.0).alias("speed"), F.col("s").alias("position_id"), F.col("on").alias("acc"))
    out = events.acc_segments(rows)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want, begin, state = [("B", 0, 9000, "on")], None, None
    for s, on in flips:
        if state is None:
            begin, state = s, on
        elif on != state and s - begin >= 5:
            want.append(("A", begin * 1000, s * 1000, "on" if state else "off"))
            begin, state = s, on
    assert sorted((r["imei"], ms(r["start_time"]), ms(r["end_time"]), r["acc_status"]) for r in out.collect()) == sorted(want)


def test_geofence_scenario(spark):
    t = track(spark, [(0, 40, True, 29.0, 31.0), (1, 40, True, 30.0, 31.0), (2, 90, True, 30.0, 31.0), (3, 90, True, 29.0, 31.0)])
    fence = spark.createDataFrame([("A", "f", "circle", 30.0, 31.0, 100.0, None, True, True, 80.0, None)], "imei string, id string, type string, latitude double, longitude double, radius double, coordinates array<array<double>>, notify_on_enter boolean, notify_on_exit boolean, speed_limit double, speed_limit_enabled boolean")
    assert [r["alarm_type"] for r in events.geofence_events(t, fence).orderBy("at").collect()] == [1000, 1002, 1001]
    assert events.geofence_events(t.limit(0), fence).count() == 0


def test_live_idle_tells_once(spark):
    got = events.live_idle(track(spark, [(0, 0), (6, 0), (7, 0), (8, 0, False), (9, 0), (13.9, 0)])).collect()
    assert [r["position_id"] for r in got] == [2]


def test_connectivity(spark):
    rows = [("A", T0 + timedelta(seconds=s), s, on) for s, on in ((0, True), (10, False), (20, False), (31, True), (40, None), (50, False))]
    got = events.connectivity_intervals(spark.createDataFrame(rows, "imei string, packet_date timestamp, position_id long, online boolean")).orderBy("start_at").collect()
    assert [(r["duration_sec"], r["is_open"]) for r in got] == [(21, False), (None, True)]


def test_rebuilding_a_range_can_be_repeated(spark):
    t = track(spark, [(0, 0), (1, 0), (3, 6)]).unionByName(track(spark, [(0, 0), (5, 9)], "B"))
    old = events.parking_events(t)
    lo, hi = F.lit(T0), F.lit(T0 + timedelta(days=1))
    new = events.replace_range(old, events.parking_events(t.filter("imei = 'A'")), spark.createDataFrame([("A",)], "imei string"), lo, hi)
    assert new.exceptAll(old).isEmpty() and new.count() == old.count()
