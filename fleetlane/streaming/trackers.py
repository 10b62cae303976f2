"""State machines with typed state: live decisions, status, fences, commands, connectivity, sticky values, waiting positions.

They share their rules with the batch operators: both call the same step functions. Within a micro-batch a key's rows
are handled in the order that the machine names; state is kept in the checkpoint. Two inputs of one machine come as one
stream with `kind` (see merged()); at equal times the smaller kind comes first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlane.functions.geo import EARTH_KM
from fleetlane.operators import events, live


def plain(x):
    """A value of a pandas row as Python has it; what is missing is None."""
    if x is None or isinstance(x, (str, bool, list, tuple)):
        return x
    if hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return x.tolist()
    return None if pd.isna(x) else x.item() if hasattr(x, "item") else x


#: Columns that hold whole numbers; pandas has those with nulls as floats.
WHOLE = frozenset(("arrived", "fix", "device", "server", "now", "burst", "at", "seq", "kind", "position_id", "number", "start_at", "packet_at", "position_at", "gps_at"))


def sorted_rows(rows: Iterator[pd.DataFrame], order: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple]:
    """The values of `names` of all rows, in order; missing times come first."""
    points = pd.concat(list(rows)).sort_values(list(order), kind="stable", na_position="first")
    cols = [points[c].tolist() if c in points.columns else [None] * len(points) for c in names]
    whole = [c in WHOLE and points.get(c, pd.Series(dtype=float)).dtype.kind == "f" for c in names]
    for values in zip(*cols, strict=True):
        yield tuple(int(x) if w and x is not None else x for w, x in zip(whole, map(plain, values), strict=True))


class Tracker(StatefulProcessor):
    """One tuple of `state` for each key; step(state, *values of uses) returns it and a list of output rows without key."""

    state: dict[str, str]
    order: tuple[str, ...]
    uses: tuple[str, ...]
    columns: dict[str, str]
    key = "imei"

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} {kind}" for c, kind in ({self.key: "string"} | self.columns).items())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("state", ", ".join(f"{c} {kind}" for c, kind in self.state.items()))

    def held(self) -> tuple | None:
        return tuple(self.kept.get()) if self.kept.exists() else None

    def hold(self, state: tuple | None) -> None:
        if state is not None:
            self.kept.update(tuple(state))
        elif self.kept.exists():
            self.kept.clear()

    def frame(self, key, out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame([(key[0], *row) for row in out], columns=[self.key, *self.columns], dtype=object)
        for c, kind in self.columns.items():
            if kind in ("long", "int"):
                made[c] = made[c].astype("Int64")
            elif kind == "timestamp":
                made[c] = pd.to_datetime(made[c])
            elif kind == "double":
                made[c] = made[c].astype("float64")
        return made

    def handleInputRows(self, key, rows, timer_values):
        state, out = self.held(), []
        for values in sorted_rows(rows, self.order, self.uses):
            state, given = self.step(state, *values)
            out += given
        self.hold(state)
        self.arm(state, timer_values)
        yield self.frame(key, out)

    def arm(self, state: tuple | None, timer_values) -> None:
        pass

    def step(self, state: tuple | None, *values) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def alarm_at(handle: StatefulProcessorHandle, at: int) -> None:
    """The only timer of a key is at this time (ms)."""
    there = False
    for t in list(handle.listTimers()):
        if t == at:
            there = True
        else:
            handle.deleteTimer(t)
    if not there:
        handle.registerTimer(at)


# --- live decisions


class LiveFixes(Tracker):
    """live_tracked() on a stream: each message's decision, effective time and its source.

    A device from which nothing came for forget_ms of event time is forgotten, place too, and begins anew (time mode
    EventTime, with a watermark); without forget_ms all are kept, in a few values each."""

    state = {"last_fix": "long", "last_live": "long", "latitude": "double", "longitude": "double", "arrived": "long"}
    order = ("arrived", "seq")
    uses = ("arrived", "seq", "fix", *live.OF_MESSAGE)
    columns = {"seq": "long", "decision": "string", "effective_ms": "long", "source": "string"}

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def step(self, s, arrived, seq, *message):
        state, decided = live.track_step(s and (s[0], s[1], (s[2], s[3])), arrived, *message)
        return (state[0], state[1], *state[2], max(arrived, s[4]) if s else arrived), [(seq, *decided)]

    def arm(self, s, timer_values):
        if self.forget_ms and s:
            alarm_at(self.handle, s[4] + self.forget_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.hold(None)
        yield self.frame(key, [])


class LiveBursts(Tracker):
    """live_bursts() on a stream: a burst comes whole, in one micro-batch."""

    state = {"last_fix": "long", "last_live": "long", "latitude": "double", "longitude": "double"}
    order = ("now", "burst", "at", "seq")
    uses = ("now", "burst", "seq", "fix", *live.OF_MESSAGE)
    columns = {"burst": "long", "seq": "long", "decision": "string", "effective_ms": "long", "source": "string", "is_live": "boolean"}

    def handleInputRows(self, key, rows, timer_values):
        points = pd.concat(list(rows))
        points["at"] = points["fix"].fillna(0)
        s, out, live_row = self.held(), [], {}
        for now, burst, seq, *message in sorted_rows(iter([points]), self.order, self.uses):
            newest = s[1] if s else 0
            state, decided = live.track_step(s and (s[0], s[1], (s[2], s[3])), now, *message)
            s = (state[0], state[1], *state[2])
            if decided[1] is not None and decided[1] >= newest:
                live_row[burst] = len(out)
            out.append([burst, seq, *decided, False])
        for at in live_row.values():
            out[at][-1] = True
        self.hold(s)
        yield self.frame(key, out)


# --- status


class StatusTable(Tracker):
    """status_table() kept in state: the device's row of live.STATUS after each micro-batch. A snapshot with these columns is
    its initial state. status_rows() reads the table from the state, without a rewrite."""

    state = live.STATUS
    order = ("at", "seq")
    uses = tuple(live.STATUS_MESSAGE)
    columns = live.STATUS

    def handleInitialState(self, key, initialState, timerValues):
        for values in sorted_rows(iter([initialState]), ("imei",), tuple(live.STATUS)):
            self.hold(values)

    def handleInputRows(self, key, rows, timer_values):
        points = pd.concat(list(rows))
        points["at"] = points["arrived"].fillna(points["fix"])
        s = self.held()
        for values in sorted_rows(iter([points]), self.order, self.uses):
            s, _ = live.status_step(s, *values), None
        self.hold(s)
        yield self.frame(key, [s])


class StatusWrites(Tracker):
    """Which messages to write to the status table: `state_key` changed, or every_ms since the last write. A message that isn't
    written waits, and is written by timer (time mode ProcessingTime) if the device falls silent: its last state isn't lost.
    The time of such a write is when it was due."""

    state = {"at": "long", "state_key": "string", "wait_at": "long", "wait_key": "string", "wait_seq": "long"}
    order = ("at", "seq")
    uses = ("at", "seq", "state_key")
    columns = {"seq": "long", "at": "long", "state_key": "string", "why": "string"}

    def __init__(self, every_ms: int = live.PERSIST):
        self.every_ms = every_ms

    def step(self, s, at, seq, key):
        if s is None or s[1] != key or at - s[0] >= self.every_ms:
            return (at, key, None, None, None), [(seq, at, key, "changed" if s and s[1] != key else "due" if s else "first")]
        return (s[0], s[1], at, key, seq), []

    def arm(self, s, timer_values):
        if s and s[2] is not None:
            alarm_at(self.handle, timer_values.getCurrentProcessingTimeInMs() + self.every_ms)

    def flushed(self, s: tuple) -> tuple[tuple, list[tuple]]:
        if s[2] is None:
            return s, []
        return (s[0] + self.every_ms, s[3], None, None, None), [(s[4], s[2], s[3], "flushed")]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s, out = self.held(), []
        if s:
            s, out = self.flushed(s)
            self.hold(s)
        yield self.frame(key, out)


def status_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The status table as the last micro-batch of a StatusTable stream left it, read from its state."""
    rows = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    return rows.select("key.imei", "value.*")


# --- fences


def _meters(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    half = lambda a, b: math.sin(math.radians(b - a) / 2) ** 2
    a = half(lat1, lat2) + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half(lon1, lon2)
    return 2000 * EARTH_KM * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def _on_globe(lat, lon) -> bool:
    return lat is not None and lon is not None and math.isfinite(lat) and math.isfinite(lon) and abs(lat) <= 90 and abs(lon) <= 180


def is_inside(lat: float, lon: float, kind: str | None, center_lat, center_lon, radius, ring) -> bool:
    """Whether a place on the globe is in a circle or polygon, by the rules of geo.in_circle() and geo.in_polygon()."""
    if (kind or "").lower() == "circle":
        return bool(_on_globe(center_lat, center_lon) and radius is not None and radius > 0 and _meters(lat, lon, center_lat, center_lon) <= radius)
    if (kind or "").lower() != "polygon" or ring is None or len(ring) < 3:
        return False
    inside = False
    for (yi, xi), (yj, xj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if (yi > lat) != (yj > lat) and lon < (xj - xi) * (lat - yi) / (yj - yi) + xi:
            inside = not inside
    return inside


FENCE = {"id": "string", "type": "string", "fence_latitude": "double", "fence_longitude": "double", "radius": "double", "coordinates": "array<array<double>>", "notify_on_enter": "boolean", "notify_on_exit": "boolean", "speed_limit": "double", "speed_limit_enabled": "boolean"}


class Fences(StatefulProcessor):
    """geofence_events() on a stream whose fences change while it runs.

    Rows of kind 0 are a device's fences (FENCE; `gone`: no longer one), rows of kind 1 its points. A fence that is defined
    anew goes on with its state: whether the last point was inside, and too fast. So does one that went and came back.
    """

    columns = {"fence_id": "string", "at": "timestamp", "position_id": "long", "speed": "double", "alarm_type": "int"}
    schema = "imei string, " + ", ".join(f"{c} {kind}" for c, kind in columns.items())
    uses = ("kind", "at", "position_id", "latitude", "longitude", "speed", "gone", *FENCE)

    def init(self, handle):
        self.fences = handle.getMapState("fences", "id string", ", ".join(f"{c} {kind}" for c, kind in FENCE.items() if c != "id") + ", gone boolean, inside boolean, over boolean")

    def handleInputRows(self, key, rows, timer_values):
        fences = {k[0]: list(v) for k, v in self.fences.iterator()}
        was, out = {k: tuple(v) for k, v in fences.items()}, []
        for kind, at, number, lat, lon, speed, gone, fence_id, *fence in sorted_rows(rows, ("at", "kind", "position_id"), self.uses):
            if kind == 0:
                if fence_id is not None:
                    fence[4] = None if fence[4] is None else [list(map(float, v)) for v in fence[4]]
                    fences[fence_id] = [*fence, gone is True, *(fences[fence_id][-2:] if fence_id in fences else (None, None))]
            elif _on_globe(lat, lon):
                for name in sorted(fences):
                    out += [(name, at, number, speed or 0.0, code) for code in self.observed(fences[name], lat, lon, speed or 0.0)]
        for name, values in fences.items():
            if was.get(name) != tuple(values):
                self.fences.updateValue((name,), tuple(values))
        made = pd.DataFrame([(key[0], *r) for r in out], columns=["imei", *self.columns])
        made["at"] = pd.to_datetime(made["at"])
        yield made

    @staticmethod
    def observed(fence: list, lat: float, lon: float, speed: float) -> list[int]:
        """The alarms of a point at a fence, whose state is changed."""
        kind, center_lat, center_lon, radius, ring, on_enter, on_exit, limit, enabled, gone, was, was_over = fence
        if gone:
            return []
        inside = is_inside(lat, lon, kind, center_lat, center_lon, radius, ring)
        over = was is not None and inside and limit is not None and limit > 0 and speed > limit
        fence[-2:] = [inside, over]
        if was is None:
            return []
        codes = [events.ENTER] if inside and not was and on_enter else [events.EXIT] if was and not inside and on_exit else []
        notify = enabled if enabled is not None else bool(limit)
        return codes + ([events.FENCE_OVERSPEED] if over and not was_over and notify else [])

    def close(self):
        pass


# --- commands


class Commands(StatefulProcessor):
    """match_commands() on a stream: rows of kind 0 are commands (command_id, number), rows of kind 1 responses. A response gets
    the newest pending command of its id, else of its device, and none twice. Commands go after keep_ms without answer."""

    schema = "imei string, seq long, cmd_seq long"

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle):
        self.pending = handle.getListState("pending", "command_id string, number long, at long")

    def handleInputRows(self, key, rows, timer_values):
        pending = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        out = []
        for kind, at, command_id, number in sorted_rows(rows, ("at", "kind", "number"), ("kind", "at", "command_id", "number")):
            if self.keep_ms is not None:
                pending = [p for p in pending if at - p[2] <= self.keep_ms]
            if kind == 0:
                pending.append((command_id, number, at))
                continue
            mine = [p for p in pending if command_id is not None and p[0] == command_id] or pending
            found = mine[-1] if mine else None
            if found:
                pending.remove(found)
            out.append((key[0], number, found and found[1]))
        if pending:
            self.pending.put(pending)
        else:
            self.pending.clear()
        yield pd.DataFrame(out, columns=["imei", "seq", "cmd_seq"]).astype({"seq": "Int64", "cmd_seq": "Int64"})

    def close(self):
        pass


# --- connectivity and sticky values


class Connectivity(Tracker):
    """connectivity_intervals() on a stream: an interval is told when it opens (no end) and when it closes. Initial state: the
    devices' last state (imei, online, start_at in ms of the interval that is open)."""

    state = {"online": "boolean", "start_at": "long"}
    order = ("at", "seq")
    uses = ("at", "online")
    columns = {"start_at": "long", "end_at": "long", "duration_sec": "long", "is_open": "boolean"}

    def handleInitialState(self, key, initialState, timerValues):
        for online, start in sorted_rows(iter([initialState]), ("imei",), ("online", "start_at")):
            self.hold((online, start))

    def step(self, s, at, online):
        if online is None:
            return s, []
        if s is None or s[0] == online:
            return (online, s[1] if s else None), []
        if not online:
            return (False, at), [(at, None, None, True)]
        closed = [(s[1], at, max((at - s[1]) // 1000, 0), False)] if s[1] is not None else []
        return (True, None), closed


class Sticky(Tracker):
    """sticky() on a stream, for numbers and flags: a row's values, or the last known ones. Initial state: a status snapshot."""

    order = ("at", "seq")

    def __init__(self, numbers: tuple[str, ...] = (), flags: tuple[str, ...] = ()):
        self.numbers, self.flags = numbers, flags
        kinds = dict.fromkeys(numbers, "double") | dict.fromkeys(flags, "boolean")
        self.state, self.columns, self.uses = kinds, {"seq": "long"} | kinds, ("seq", *kinds)

    def known(self, values) -> list:
        n = len(self.numbers)
        return [self.number(x) for x in values[:n]] + [x if isinstance(x, bool) else None for x in values[n:]]

    @staticmethod
    def number(x) -> float | None:
        try:
            x = float(x) if x is not None and not isinstance(x, bool) else None
        except ValueError:
            return None
        return x if x is not None and math.isfinite(x) else None

    def handleInitialState(self, key, initialState, timerValues):
        for values in sorted_rows(iter([initialState]), (self.key,), tuple(self.state)):
            self.hold(tuple(self.known(values)))

    def step(self, s, seq, *values):
        s = tuple(new if new is not None else old for new, old in zip(self.known(values), s or [None] * len(values), strict=True))
        return s, [(seq, *s)]


class RateWindows(Tracker):
    """rate_windows() on a stream."""

    state = {"start": "long", "n": "long"}
    order = uses = ("at",)
    columns = {"start": "long", "end": "long", "n": "long"}

    def step(self, s, at):
        s, closed = live.rate_step(s, at, 1)
        return s, [closed] if closed else []


# --- waiting positions


class Waiters(StatefulProcessor):
    """Positions of devices known by a runtime id alone, keyed by it: rows of kind 0 tell an id's imei, rows of kind 1 are positions.

    Once the imei is known, those that wait go out, in the order of at and position_id, before later ones; one that has
    waited keep_ms of processing time goes out without an imei (time mode ProcessingTime)."""

    schema = "runtime_id string, imei string, at long, position_id long, item string, why string"
    names = ["runtime_id", "imei", "at", "position_id", "item", "why"]

    def __init__(self, keep_ms: int = 600_000):
        self.keep_ms = keep_ms

    def init(self, handle):
        self.handle = handle
        self.imei = handle.getValueState("imei", "imei string")
        self.waiting = handle.getListState("waiting", "at long, position_id long, item string, since long")

    def _kept(self, waiting: list[tuple]) -> None:
        if waiting:
            self.waiting.put(waiting)
            alarm_at(self.handle, min(w[3] for w in waiting) + self.keep_ms)
        elif self.waiting.exists():
            self.waiting.clear()

    def _out(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.names).astype({"at": "Int64", "position_id": "Int64"})

    def handleInputRows(self, key, rows, timer_values):
        now = timer_values.getCurrentProcessingTimeInMs()
        imei = self.imei.get()[0] if self.imei.exists() else None
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        told = imei
        for kind, at, number, item, name in sorted_rows(rows, ("kind", "at", "position_id"), ("kind", "at", "position_id", "item", "imei")):
            if kind == 0:
                told = name if name is not None else told
            else:
                waiting.append((at, number, item, now))
        out = []
        if told is not None:
            if told != imei:
                self.imei.update((told,))
            first = (-math.inf, -math.inf)
            waiting.sort(key=lambda w: tuple(f if x is None else x for x, f in zip(w[:2], first, strict=True)))
            out, waiting = [(told, *w[:3], "resolved") for w in waiting], []
        self._kept(waiting)
        yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentProcessingTimeInMs()
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        late = [w for w in waiting if now - w[3] >= self.keep_ms]
        self._kept([w for w in waiting if now - w[3] < self.keep_ms])
        yield self._out(key, [(None, *w[:3], "expired") for w in late])

    def close(self):
        pass


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two inputs as one stream, with kind 0 and 1; columns that one hasn't are null."""
    return first.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)), allowMissingColumns=True)
