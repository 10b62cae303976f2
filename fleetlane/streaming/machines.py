"""Per-device state machines on streams: one stateful processor for each, with the rules of the batch operators.

A stream has the points' columns; a device's points are handled in the order of (packet_date, position_id)
within a micro-batch and in the order of micro-batches. State is kept in the checkpoint, so a restart goes
on where it stopped; a device's state is a few values, whatever its history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "value string"
ORDER = ["packet_date", "position_id"]


def _ms(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000


def _ts(ms: int | None):
    return None if ms is None else pd.Timestamp(ms, unit="ms")


def round_seconds(ms: int) -> int:
    return int(ms / 1000 + 0.5)


class Machine(StatefulProcessor):
    """Keeps one small JSON value for each device; step() takes it and a point and returns events."""

    schema: str
    names: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        points = pd.concat(list(rows)).sort_values(ORDER, kind="stable")
        out = []
        for p in points.itertuples(index=False):
            for event in self.step(state, p):
                out.append((key[0], *event))
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass

    def step(self, state: dict, p) -> Iterator[tuple]:
        raise NotImplementedError


class Parking(Machine):
    """Closed stops: open at 1 km/h or less, end at 5 km/h or more with that point's time."""

    schema = "imei string, start_at timestamp, end_at timestamp, min_speed double, max_speed double, duration_seconds long"
    names = ["imei", "start_at", "end_at", "min_speed", "max_speed", "duration_seconds"]

    def step(self, state, p):
        if pd.isna(p.latitude) or pd.isna(p.longitude) or pd.isna(p.packet_date):
            return
        t, speed = _ms(p.packet_date), 0.0 if pd.isna(p.speed) else float(p.speed)
        if not state:
            if speed <= 1:
                state.update(begin=t, end=t, low=speed, high=speed)
            return
        state.update(end=t, low=min(state["low"], speed), high=max(state["high"], speed))
        if speed >= 5:
            yield _ts(state["begin"]), _ts(state["end"]), state["low"], state["high"], round_seconds(state["end"] - state["begin"])
            state.clear()


class Trips(Machine):
    """Closed trips: a trip closes, at its last moving point, when a device moves again after gap_min minutes.

    A stream that begins anew takes up open trips from its initial state (see open_trips())."""

    schema = "imei string, start_at timestamp, end_at timestamp, duration_min double, gap_after_min double"
    names = ["imei", "start_at", "end_at", "duration_min", "gap_after_min"]

    def __init__(self, gap_min: float = 1.0):
        self.gap_min = gap_min

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for p in initialState.itertuples(index=False):
            self.state.update((json.dumps({"begin": _ms(p.start_at), "moved": _ms(p.end_at), "speed": 0.0 if pd.isna(p.last_speed) else float(p.last_speed)}),))

    def step(self, state, p):
        t, speed = _ms(p.packet_date), 0.0 if pd.isna(p.speed) else float(p.speed)
        if speed > 0:
            gap = None if state.get("moved") is None else abs(t - state["moved"]) / 60000
            if gap is None:
                state["begin"] = t
            elif state.get("speed") == 0 and gap >= self.gap_min:
                yield _ts(state["begin"]), _ts(state["moved"]), (state["moved"] - state["begin"]) / 60000, gap
                state["begin"] = t
            state["moved"] = t
        state["speed"] = speed


class Overspeed(Machine):
    """Closed sessions over limit_kmh (a column of the stream; null: none); alarms decide before speed does."""

    schema = "imei string, start_time timestamp, end_time timestamp, speed_kmh double, speed_limit_kmh double, duration_sec long"
    names = ["imei", "start_time", "end_time", "speed_kmh", "speed_limit_kmh", "duration_sec"]

    def step(self, state, p):
        t, speed = _ms(p.packet_date), 0.0 if pd.isna(p.speed) else float(p.speed)
        limit = None if pd.isna(p.limit_kmh) or p.limit_kmh <= 0 else float(p.limit_kmh)
        alarm = "" if pd.isna(p.alarm) else "".join(str(p.alarm).lower().split())
        if alarm == "lowspeed":
            over = False
        elif alarm == "overspeed":
            over, limit = True, limit or 0.0
        elif limit is None:
            return
        else:
            over = speed > limit
        if over:
            if not state:
                state.update(begin=t, limit=limit, high=speed)
            state.update(end=t, high=max(state["high"], speed))
        elif state:
            yield _ts(state["begin"]), _ts(state["end"]), round(state["high"] + 1e-9, 1), state["limit"], round_seconds(state["end"] - state["begin"])
            state.clear()


class Ignition(Machine):
    """Closed segments of one state of `acc`; changes within 5 seconds of the segment's start are ignored."""

    schema = "imei string, acc_status string, start_time timestamp, end_time timestamp, duration_sec long"
    names = ["imei", "acc_status", "start_time", "end_time", "duration_sec"]

    def step(self, state, p):
        if pd.isna(p.acc):
            return
        t, acc = _ms(p.packet_date), bool(p.acc)
        if not state:
            state.update(acc=acc, begin=t)
        elif state["acc"] != acc and round_seconds(max(0, t - state["begin"])) >= 5:
            yield "on" if state["acc"] else "off", _ts(state["begin"]), _ts(t), round_seconds(t - state["begin"])
            state.update(acc=acc, begin=t)


class IdleNotice(Machine):
    """One notice for each run of ignition on and no speed, once it is 5 minutes old."""

    schema = "imei string, idle_since timestamp, notified_at timestamp"
    names = ["imei", "idle_since", "notified_at"]

    def step(self, state, p):
        idle = p.ignition is True or (not pd.isna(p.ignition) and bool(p.ignition))
        if not idle or (not pd.isna(p.speed) and p.speed > 0):
            state.clear()
            return
        t = _ms(p.packet_date)
        state.setdefault("begin", t)
        if not state.get("told") and t - state["begin"] >= 300_000:
            state["told"] = True
            yield _ts(state["begin"]), _ts(t)


class RetryDedupe(StatefulProcessor):
    """Passes a message (imei, fingerprint, packet_date, position_id) unless the same one came ttl ms or less before, in event
    time; being seen again renews the time. State of a fingerprint expires by processing time."""

    schema = "fingerprint string, packet_date timestamp, position_id long"

    def __init__(self, ttl_ms: int = 120_000):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.seen = handle.getValueState("seen", "at long", ttlDurationMs=10 * self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        points = pd.concat(list(rows)).sort_values(ORDER, kind="stable")
        last = self.seen.get()[0] if self.seen.exists() else None
        keep = []
        for ts in points["packet_date"]:
            t = _ms(ts)
            keep.append(last is None or t - last > self.ttl_ms)
            last = t
        self.seen.update((last,))
        yield points.loc[keep, ["fingerprint", "packet_date", "position_id"]]

    def close(self):
        pass


class RoomThrottle(StatefulProcessor):
    """At most `most` sends of a device in a window of window_ms of event time; a further point waits, the latest
    instead of earlier ones, and goes out when the window is over: before the next point that comes later, or by timer.

    A device that stands (speed exactly 0) within dead_m of its last send waits likewise, until stand_ms after that
    send; one that stands elsewhere, and a point of unknown speed, go out at once. After silence_ms without a send
    any point does."""

    schema = "imei string, packet_date timestamp, latitude double, longitude double, speed double, why string"
    names = ["imei", "packet_date", "latitude", "longitude", "speed", "why"]

    def __init__(self, most: int = 10, window_ms: int = 30_000, dead_m: float = 15.0, silence_ms: int = 30_000, stand_ms: int = 30_000):
        self.most, self.window_ms, self.dead_m, self.silence_ms, self.stand_ms = most, window_ms, dead_m, silence_ms, stand_ms

    def init(self, handle):
        self.handle, self.state = handle, handle.getValueState("state", STATE)

    @staticmethod
    def _sent(s: dict, t: int, lat: float | None, lon: float | None) -> None:
        place = s["last"][1:] if s.get("last") else [None, None]
        known = all(x is not None and x == x for x in (lat, lon))
        s.update(last=[t, *([lat, lon] if known else place)], wait=None)

    def flushed(self, s: dict, t: int | None = None) -> list[tuple]:
        """The waiting point, if its time has come by t (None: now); it begins a window."""
        if not s.get("wait") or (t is not None and t < s["due"]):
            return []
        wait, due = s["wait"], s["due"]
        s.update(window=due, sent=1)
        self._sent(s, due, *wait[1:3])
        return [(*wait, "flushed")]

    def decide(self, s: dict, t: int, lat: float, lon: float, speed: float | None) -> list[tuple]:
        """The points (t, lat, lon, speed, why) that go out when a point comes; s is changed."""
        out = self.flushed(s, t)
        s.setdefault("window", t)
        s.setdefault("sent", 0)
        last = s.get("last")
        if speed == 0:
            near = last is not None and all(x is not None and x == x for x in (lat, lon, *last[1:])) and meters(last[1], last[2], lat, lon) <= self.dead_m
            if near and t - last[0] < self.stand_ms:
                s.update(wait=[t, lat, lon, speed], due=last[0] + self.stand_ms)
                return out
            s.update(window=t, sent=1)
        elif speed is not None and last is not None and t - last[0] >= self.silence_ms:
            s.update(window=t, sent=1)
        elif speed is not None:
            if t - s["window"] >= self.window_ms:
                s.update(window=t, sent=0)
            if s["sent"] >= self.most:
                s.update(wait=[t, lat, lon, speed], due=s["window"] + self.window_ms)
                return out
            s["sent"] += 1
        self._sent(s, t, lat, lon)
        return [*out, (t, lat, lon, speed, "sent")]

    def _rows(self, key, events: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], _ts(t), *rest) for t, *rest in events], columns=self.names)

    def handleInputRows(self, key, rows, timer_values):
        s = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out = []
        for p in pd.concat(list(rows)).sort_values(ORDER, kind="stable").itertuples(index=False):
            out += self.decide(s, _ms(p.packet_date), p.latitude, p.longitude, None if pd.isna(p.speed) else p.speed)
        if s.get("wait"):
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.window_ms)
        self.state.update((json.dumps(s),))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out = self.flushed(s)
        self.state.update((json.dumps(s),))
        yield self._rows(key, out)

    def close(self):
        pass


def meters(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    import math

    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(a))


def open_trips(trips: DataFrame, status: DataFrame) -> DataFrame:
    """Initial state for Trips: each device's open trip (imei, start_at, end_at, is_open) and its last speed (imei,
    last_speed); an unknown speed is taken as standing."""
    return trips.filter("is_open").select("imei", "start_at", "end_at").join(status.select("imei", "last_speed"), "imei", "left")


def run(stream: DataFrame, machine: StatefulProcessor, key: str = "imei", time_mode: str = "None", initial: DataFrame | None = None) -> DataFrame:
    """The machine's events over a stream. RocksDB state is needed: spark.sql.streaming.stateStore.providerClass.

    time_mode is ProcessingTime for machines with timers or expiring state; initial has the state to begin with.
    """
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=machine, outputStructType=machine.schema, outputMode="append", timeMode=time_mode, initialState=initial.groupBy(key) if initial is not None else None)
