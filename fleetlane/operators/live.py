"""What is live: classification of fixes, order guards, duplicate deliveries, status of devices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequence import carried, folded, so_far, timed

#: Fixed values, in milliseconds.
LIVE_AGE, FUTURE, SKEW, RETRY_TTL, FUTURE_FIX, PERSIST = 300_000, 120_000, 180_000, 120_000, 600_000, 10_000
IMEI = ("imei",)


def _fresh(age: Column, most: int) -> Column:
    return F.coalesce(age <= most, F.lit(False))


def classify_fix(fix: Column, device: Column, server: Column, now: Column, last_fix: Column, last_live: Column, current: Column, outdated: Column) -> Column:
    """struct(decision, live_eligible, effective_ms, source) of a fix; all times in milliseconds.

    last_fix and last_live are the newest live fix time and effective live time before it (null: none),
    current tells whether the message is a current update (moving, in motion or at a new place).
    """
    fix_fresh, device_fresh, server_fresh = (_fresh(now - c, LIVE_AGE) for c in (fix, device, server))
    behind = F.coalesce((last_live > 0) & (device < last_live), F.lit(False))
    fallback = device.isNotNull() & ~F.coalesce(outdated, F.lit(False)) & device_fresh & ~behind & server_fresh & F.coalesce(F.abs(device - server) <= SKEW, F.lit(False)) & F.coalesce(current, F.lit(False))
    decision = (
        F.when(fix.isNull() & device.isNull(), "missing_time")
        .when((F.coalesce(fix, device) > now + FUTURE) | F.coalesce(device > now + FUTURE, F.lit(False)), "future_invalid")
        .when(fix_fresh & F.coalesce((last_fix > 0) & (fix < last_fix), F.lit(False)), "out_of_order")
        .when(fix_fresh, "fresh")
        .when(fallback, "fresh_device_time")
        .when(behind & device_fresh, "out_of_order")
        .otherwise("historical")
    )
    live = decision.isin("fresh", "fresh_device_time")
    return F.struct(decision.alias("decision"), live.alias("live_eligible"), F.when(decision == "fresh", fix).when(decision == "fresh_device_time", device).alias("effective_ms"), F.when(decision == "fresh", "fixTime").when(decision == "fresh_device_time", "deviceTime").alias("source"))


def fix_decision(fix: int | None, device: int | None, server: int | None, now: int, last_fix: int, last_live: int, current: bool, outdated: bool) -> tuple[str, int | None, str | None]:
    """(decision, effective_ms, source): classify_fix() for one row; 0 means that there was no live fix yet."""
    recent = lambda t: t is not None and now - t <= LIVE_AGE
    if fix is None and device is None:
        return "missing_time", None, None
    if (device if fix is None else fix) > now + FUTURE or (device is not None and device > now + FUTURE):
        return "future_invalid", None, None
    if recent(fix):
        return ("out_of_order", None, None) if last_fix > 0 and fix < last_fix else ("fresh", fix, "fixTime")
    behind = device is not None and last_live > 0 and device < last_live
    if recent(device) and not outdated and not behind and recent(server) and abs(device - server) <= SKEW and current:
        return "fresh_device_time", device, "deviceTime"
    return ("out_of_order" if behind and recent(device) else "historical"), None, None


def is_current(lat: float | None, lon: float | None, speed: float | None, motion: bool | None, before: tuple | None) -> bool:
    """Whether a message is a current update: over 1 km/h, in motion, or at another place than the message before it."""
    if (speed is not None and math.isfinite(speed) and speed > 1) or motion is True:
        return True
    known = before is not None and all(x is not None and math.isfinite(x) for x in (lat, lon, *before))
    return known and (lat, lon) != (0, 0) and (lat, lon) != before


#: What fix_decision() reads of a message besides its fix and arrival; columns that are missing count as unknown.
OF_MESSAGE = {"device": "long", "server": "long", "latitude": "double", "longitude": "double", "speed": "double", "motion": "boolean", "outdated": "boolean"}
DECIDED = [T.StructField("decision", T.StringType()), T.StructField("effective_ms", T.LongType()), T.StructField("source", T.StringType())]


def _messages(arrivals: DataFrame, more: dict[str, str]) -> tuple[DataFrame, tuple[str, ...]]:
    """arrivals with typed copies of what a decision reads, and the names of the copies."""
    wanted = {"fix": "long"} | OF_MESSAGE | more
    value = lambda c, kind: (F.col(c) if c in arrivals.columns else F.lit(None)).cast(kind)
    return arrivals.withColumns({f"__{c}": value(c, kind) for c, kind in wanted.items()}), tuple(f"__{c}" for c in wanted)


def track_step(s: tuple | None, now: int, fix: int | None, device: int | None, server: int | None, lat: float | None, lon: float | None, speed: float | None, motion: bool | None, outdated: bool | None) -> tuple:
    """(state, (decision, effective_ms, source)) of a device's next message. The state is its newest live fix time, its
    newest effective live time (0: none), and the place of its last message."""
    last_fix, last_live, before = s or (0, 0, None)
    decided = _, effective, source = fix_decision(fix, device, server, now, last_fix, last_live, is_current(lat, lon, speed, motion, before), outdated is True)
    if effective is not None and effective >= last_live:
        last_live = effective
        if source == "fixTime":
            last_fix = fix
    return (last_fix, last_live, (lat, lon)), decided


def live_tracked(arrivals: DataFrame) -> DataFrame:
    """arrivals (imei, arrived, seq, fix; device, server, latitude, longitude, speed, motion and outdated where there
    are such; times in ms) with decision, effective_ms and source, in arrival order.

    A device's state is its newest live fix time, its newest effective live time (of fix or device), and the place
    of its last message. An effective time older than the newest one changes none of them."""
    rows, names = _messages(arrivals, {})
    return carried(rows, IMEI, ("arrived", "seq"), ("arrived", *names), track_step, DECIDED).drop(*names)


def live_bursts(arrivals: DataFrame) -> DataFrame:
    """live_tracked() of messages that come in bursts (burst; all of one at its `now`), with `is_live`: of each burst, in
    the order of fix times, the last message whose effective time isn't older than the newest one. A missing fix
    time is the oldest. Devices go on from burst to burst."""
    rows, names = _messages(arrivals, {})
    rows = rows.withColumns({"__at": F.coalesce("__fix", F.lit(0).cast("long")), "__seq": F.col("seq").cast("long")})

    def step(s, now, *message):
        newest = s[0][1] if s else 0
        state, decided = track_step(s[0] if s else None, now, *message)
        number = (s[1] if s else 0) + 1
        return (state, number), (*decided, number if decided[1] is not None and decided[1] >= newest else None)

    out = carried(rows, IMEI, ("now", "burst", "__at", "__seq"), ("now", *names), step, [*DECIDED, T.StructField("__accepted", T.LongType())])
    last = F.max("__accepted").over(Window.partitionBy("imei", "burst"))
    return out.withColumn("is_live", F.coalesce(F.col("__accepted") == last, F.lit(False))).drop("__accepted", "__at", "__seq", *names)


def live_classification(arrivals: DataFrame) -> DataFrame:
    """arrivals (imei, arrived, seq, fix, ... in ms) with decision, in arrival order, where fixes have fix times:
    a fresh fix that is older than an earlier fresh one is out of order. live_tracked() without device times, in
    windows alone."""
    w = Window.partitionBy("imei").orderBy("arrived", "seq").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(None).cast("long")
    alone = classify_fix(F.col("fix"), none, none, F.col("arrived"), none, none, F.lit(False), F.lit(False))
    rows = arrivals.withColumn("__alone", alone["decision"])
    rows = rows.withColumn("__newest", F.max(F.when(F.col("__alone") == "fresh", F.col("fix"))).over(w))
    decision = F.when((F.col("__alone") == "fresh") & (F.col("fix") < F.col("__newest")), "out_of_order").otherwise(F.col("__alone"))
    return rows.withColumn("decision", decision).drop("__alone", "__newest")


def burst_live_pick(arrivals: DataFrame) -> DataFrame:
    """arrivals (imei, burst, now, seq, fix and what live_tracked() takes) with decision, effective_ms, source and
    `is_live`: of each burst, whose messages come together at `now`, at most one.

    A burst's messages are classified in the order of seq, each by what those before it left (at first last_fix
    and last_live, where there are such columns); the last one accepted is live, others are superseded."""

    def step(s, now, seq, fix, device, server, lat, lon, speed, motion, outdated, first_fix, first_live):
        last_fix, last_live, before = s or (first_fix or 0, first_live or 0, None)
        decision, effective, source = fix_decision(fix, device, server, now, last_fix, last_live, is_current(lat, lon, speed, motion, before), outdated is True)
        accepted = effective is not None and effective >= last_live
        if accepted:
            last_live = effective
            if source == "fixTime":
                last_fix = fix
        return (last_fix, last_live, (lat, lon)), (decision, effective, source, seq if accepted else None)

    rows, names = _messages(arrivals, {"last_fix": "long", "last_live": "long"})
    rows = rows.withColumn("__seq", F.col("seq").cast("long"))
    keys = ("imei", "burst")
    out = carried(rows, keys, ("seq",), ("now", "__seq", *names), step, [*DECIDED, T.StructField("__accepted", T.LongType())])
    live = F.max("__accepted").over(Window.partitionBy(*keys))
    return out.withColumn("is_live", F.coalesce(F.col("__accepted") == live, F.lit(False))).drop("__accepted", "__seq", *names)


def clock_split(decided: DataFrame) -> DataFrame:
    """One row of counts over live_tracked() rows: live by fix or by device time, device times refused, fixes that are
    fresh, and of the others those whose device and server times are fresh or not, and that move or don't."""
    recent = lambda c: F.coalesce(F.col("arrived") - F.col(c) <= LIVE_AGE, F.lit(False))
    fresh, moving = recent("fix"), F.coalesce((F.col("speed") > 1) & ~F.isnan("speed") & (F.abs("speed") != float("inf")), F.lit(False))
    counts = {
        "by_fix": F.col("source") == "fixTime",
        "by_device": F.col("source") == "deviceTime",
        "device_refused": ~fresh & F.col("decision").isin("future_invalid", "out_of_order", "historical"),
        "fix_fresh": fresh,
        "stale_device_fresh": ~fresh & recent("device"),
        "stale_device_stale": ~fresh & ~recent("device"),
        "stale_server_fresh": ~fresh & recent("server"),
        "stale_moving": ~fresh & moving,
        "stale_standing": ~fresh & ~moving,
    }
    return decided.agg(*[F.count_if(c).alias(name) for name, c in counts.items()])


def broadcast_guard(arrivals: DataFrame) -> DataFrame:
    """arrivals with `sent`: not older than any packet of the device before it; an equal one passes."""
    w = Window.partitionBy("imei").orderBy("arrived", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return arrivals.withColumn("sent", F.coalesce(F.col("fix") >= F.max("fix").over(w), F.lit(True)))


def retry_dedupe(deliveries: DataFrame, ttl_ms: int = RETRY_TTL) -> DataFrame:
    """deliveries (fingerprint, arrived in ms, seq) with `suppressed`: the same message came ttl_ms or less before;
    being seen again renews the time."""
    w = Window.partitionBy("fingerprint").orderBy("arrived", "seq")
    return deliveries.withColumn("suppressed", F.coalesce(F.col("arrived") - F.lag("arrived").over(w) <= ttl_ms, F.lit(False)))


def position_id_dedupe(points: DataFrame) -> DataFrame:
    """The first point of each (imei, position_id > 0); points without such an id all stay."""
    known = points.filter("position_id > 0")
    w = Window.partitionBy("imei", "position_id").orderBy("packet_date", "latitude", "longitude", "speed")
    first = known.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first.unionByName(points.filter("position_id is null or position_id <= 0"))


def duplicate_groups(points: DataFrame) -> DataFrame:
    return points.filter("position_id > 0").groupBy("imei", "position_id").agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_diagnostic(points: DataFrame) -> DataFrame:
    """One row: points in all, with and without id, groups of duplicates, rows in them, rows too many, and whether
    a unique index can be made."""
    ids = points.groupBy("imei", F.when(F.col("position_id") > 0, F.col("position_id")).alias("id")).agg(F.count("*").alias("n"))
    has = F.col("id").isNotNull()
    many = has & (F.col("n") > 1)
    zero = F.lit(0)
    out = ids.agg(*[F.coalesce(F.sum(F.when(c, v)), zero).cast("long").alias(a) for c, v, a in ((F.lit(True), F.col("n"), "total"), (has, F.col("n"), "with_id"), (~has, F.col("n"), "without_id"), (many, F.lit(1), "duplicate_groups"), (many, F.col("n"), "duplicate_rows"), (many, F.col("n") - 1, "extra_rows"))])
    return out.withColumn("can_create", F.col("duplicate_groups") == 0)


def sticky(rows: DataFrame, columns: list[str], snapshot: DataFrame | None = None) -> DataFrame:
    """rows with each column's last known value of the device where it is null; before the first one, that of the
    device's row in a status snapshot (imei and the columns). Texts count as numbers if they are such, else as null;
    so do numbers that aren't finite."""
    kinds = dict(rows.dtypes)

    def known(c: str, source: DataFrame) -> Column:
        if kinds[c] == "boolean":
            return F.col(c) if dict(source.dtypes)[c] == "boolean" else F.lit(None).cast("boolean")
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    w = so_far(IMEI)
    out = timed(rows).withColumns({c: F.last(known(c, rows), ignorenulls=True).over(w) for c in columns})
    if snapshot is None:
        return out
    seed = snapshot.groupBy("imei").agg(F.struct(*[F.max(known(c, snapshot)).alias(c) for c in columns]).alias("__seed"))
    return out.join(seed, "imei", "left").withColumns({c: F.coalesce(c, F.col("__seed")[c]) for c in columns}).drop("__seed")


def status_latest(points: DataFrame) -> DataFrame:
    """Each device's newest fix, its last arrival, and its last place where it moved at over 1 km/h.

    A fix more than 10 minutes ahead of its arrival (`arrived`, a timestamp; without such a column, of now) is no fix:
    where a device has no other, its time stays unknown, and place, speed and direction are those that came first. Of
    equal fixes the first that arrived stands. Points come in the order of arrival, then position_id."""
    known = "arrived" in points.columns
    arrived = F.col("arrived") if known else F.current_timestamp()
    rows = timed(points).withColumn("__ok", F.col("packet_date") <= F.timestamp_add("MILLISECOND", F.lit(FUTURE_FIX), arrived))
    rows = rows.withColumn("__at", F.unix_millis("arrived") if known else F.lit(0).cast("long"))
    values = F.struct("packet_date", "latitude", "longitude", "speed", "direction")
    newest = F.max_by(F.when(F.col("__ok"), values), F.when(F.col("__ok"), F.struct("t", -F.col("__at"), -F.col("position_id"))))
    seen = F.max("arrived") if known else F.max(F.when(F.col("__ok"), F.col("packet_date")))
    moved = F.max(F.when((F.col("speed") > 1) & (F.lit(True) if known else F.col("__ok")), F.col("arrived" if known else "packet_date")))
    out = rows.groupBy("imei").agg(newest.alias("fix"), F.min_by(values, F.struct("__at", "position_id")).alias("first"), seen.alias("last_seen_at"), moved.alias("last_position_at"), F.count("*").alias("points"))
    either = [F.coalesce(F.col(f"fix.{c}"), F.col(f"first.{c}")).alias(c) for c in ("latitude", "longitude", "speed", "direction")]
    return out.select("imei", F.col("fix.packet_date").alias("last_fix_at"), *either, "last_seen_at", "last_position_at", "points")


#: The columns of a device's status, in groups: those of the newest fix, times, and those of the last message.
OF_FIX = {"latitude": "double", "longitude": "double", "speed": "double", "direction": "double"}
STATUS_TIMES = {"fix": "long", "packet_at": "long", "position_at": "long", "gps_at": "long"}
OF_LAST = {"kind": "string", "ignition": "boolean", "motion": "boolean", "alarm": "string"}
STATUS = STATUS_TIMES | OF_FIX | OF_LAST
#: What status_step() takes of a message; times in ms, unknown values null.
STATUS_MESSAGE = {"arrived": "long", "fix": "long", "attr_type": "double"} | OF_FIX | OF_LAST
HEARTBEAT = 19


def status_step(s: tuple | None, arrived: int | None, fix: int | None, attr_type: float | None, lat: float | None, lon: float | None, speed: float | None, direction: float | None, *last) -> tuple:
    """A device's status (the values of STATUS) after a message, each group by its rule.

    A fix is newer if it isn't over 10 minutes ahead of the arrival (without one, of itself), and none is stored, or an
    older one, or one that lies in that future. Place, speed and direction follow a newer fix; until there is one, the
    first that come stay. The time of arrival counts for all messages, for a position only over 1 km/h and not from a
    heartbeat; gps_at is the newest fix in motion with coordinates. The last group is that of the last message.
    """
    now = dict(zip(STATUS, s or [None] * len(STATUS), strict=True))
    reference = fix if arrived is None else arrived
    latest = None if reference is None else reference + FUTURE_FIX
    newer = fix is not None and fix <= latest and (now["fix"] is None or fix > now["fix"] or now["fix"] > latest)
    moving = speed is not None and speed > 0 and attr_type != HEARTBEAT
    if reference is not None:
        now["packet_at"] = reference
        if moving and speed > 1:
            now["position_at"] = reference
    placed = lat is not None and lon is not None
    for name, value in (("latitude", lat if placed else None), ("longitude", lon if placed else None), ("speed", speed), ("direction", direction)):
        if value is not None and (newer or now[name] is None):
            now[name] = value
    if newer:
        now["fix"] = fix
        if placed and moving:
            now["gps_at"] = fix
    now.update(zip(OF_LAST, last, strict=True))
    return tuple(now.values())


def status_message(rows: DataFrame, prefix: str = "") -> DataFrame:
    """rows with typed columns of STATUS_MESSAGE; those that are missing, and NaN, are null."""
    value = lambda c, kind: F.nullif((F.col(c) if c in rows.columns else F.lit(None)).cast(kind), F.lit("NaN").cast(kind)) if kind == "double" else (F.col(c) if c in rows.columns else F.lit(None)).cast(kind)
    return rows.withColumns({prefix + c: value(c, kind) for c, kind in STATUS_MESSAGE.items()})


def status_table(messages: DataFrame) -> DataFrame:
    """imei and STATUS after all messages (imei, seq and what STATUS_MESSAGE names, as far as there is), in the order of
    arrival (without one, of the fix) and seq: folds status_step() over each device's messages."""
    rows = status_message(messages).withColumns({"__at": F.coalesce("arrived", "fix"), "__seq": F.col("seq").cast("long")})
    rows = rows.select("imei", "__at", "__seq", *STATUS_MESSAGE)

    def step(s: tuple | None, _at: int, _seq: int, *message) -> tuple:
        return status_step(s, *message), None

    return folded(rows, ("__at", "__seq", *STATUS_MESSAGE), step, T.StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in STATUS.items())).fields, last=True)


def is_newer_fix(fix: Column, stored: Column, reference: Column, future_ms: int = FUTURE_FIX) -> Column:
    """Whether a fix replaces the stored one (ms): it isn't in the reference's future, and the stored one is
    missing, older, or in that future itself."""
    latest = reference + future_ms
    return F.coalesce((fix <= latest) & (stored.isNull() | (fix > stored) | (stored > latest)), F.lit(False))


def status_with_healing(arrivals: DataFrame) -> DataFrame:
    """imei, fix and seq of the fix that stands after all arrivals (imei, arrived, seq, fix) in their order: folds
    is_newer_fix over them, row by row."""
    rows = arrivals.filter("fix is not null and fix <= arrived + %d" % FUTURE_FIX).select("imei", *[F.col(c).cast("long").alias(c) for c in ("arrived", "seq", "fix")])

    def step(s: tuple | None, arrived: int, seq: int, fix: int) -> tuple:
        latest = arrived + FUTURE_FIX
        return ((fix, seq) if fix <= latest and (s is None or fix > s[0] or s[0] > latest) else s), None

    return folded(rows, ("arrived", "seq", "fix"), step, [T.StructField("fix", T.LongType()), T.StructField("seq", T.LongType())], last=True)


def status_coalesce(rows: DataFrame, key: list[str], every_ms: int = PERSIST) -> DataFrame:
    """rows with `persist`: the first of a device, or its key differs from what was last written, or every_ms passed
    since then."""

    def step(s, t, key):
        due = s is None or key != s[1] or t is None or s[0] is None or t - s[0] >= every_ms
        return ((t, key) if due else s), (due,)

    timed_rows = rows.withColumns({"__t": F.unix_millis("packet_date"), "__key": F.to_json(F.struct(*key))})
    return carried(timed_rows, IMEI, ("__t", "position_id"), ("__t", "__key"), step, [T.StructField("persist", T.BooleanType())]).drop("__t", "__key")


def ring_percentiles(rows: DataFrame, value: str, size: int = 128) -> DataFrame:
    """p50, p95 and p99 of each device's last `size` values, by both index rules: floor((n - 1) p) and ceil(n p) - 1."""
    w = Window.partitionBy("imei").orderBy(F.col("t").desc(), F.col("position_id").desc())
    last = timed(rows).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= size)
    kept = last.groupBy("imei").agg(F.sort_array(F.collect_list(value)).alias("v"))  # size values at most
    n = F.size("v")
    at = lambda i: F.element_at("v", i.cast("int") + 1)
    cols = [at(F.floor((n - 1) * F.lit(p))).alias(f"floor_p{k}") for k, p in ((50, 0.5), (95, 0.95), (99, 0.99))]
    cols += [at(F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0))).alias(f"ceil_p{k}") for k, p in ((50, 0.5), (95, 0.95), (99, 0.99))]
    return kept.select("imei", *cols)


def eligibility_ratio(decisions: DataFrame) -> DataFrame:
    n, live = F.count("*"), F.count_if(F.col("decision").isin("fresh", "fresh_device_time"))
    return decisions.agg(n.alias("received"), live.alias("eligible"), F.when(n > 0, F.round(live / n, 4)).otherwise(0.0).alias("ratio"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("n"))


def second_rates(points: DataFrame, seconds: int = 60) -> DataFrame:
    """Points by tumbling window of so many seconds."""
    return points.groupBy(F.window("packet_date", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


#: Milliseconds after which the next event closes a rate window.
RATE_MS = 1000


def rate_step(s: tuple | None, t: int, n: int) -> tuple:
    """((start, count), closed): a window begins with its first event; the first one RATE_MS or more after its start is its
    last, and begins the next window, in which it doesn't count."""
    start, count = s or (t, 0)
    if t - start >= RATE_MS:
        return (t, 0), (start, t, count + n)
    return (start, count + n), None


def rate_windows(events: DataFrame) -> DataFrame:
    """imei, start, end (ms) and n of the closed rate windows of events (imei, at in ms); windows follow the events, not
    the clock. Events of one instant are counted before they are brought together."""
    rows = events.filter("at is not null").groupBy("imei", F.col("at").cast("long").alias("at")).agg(F.count("*").alias("n"))

    def step(s: tuple | None, t: int, n: int) -> tuple:
        # events of one instant come one after the other: the first one closes the window, the others are in the next
        s, closed = rate_step(s, t, 1)
        return (s[0], s[1] + n - 1), closed

    return folded(rows, ("at", "n"), step, [T.StructField(c, T.LongType()) for c in ("start", "end", "n")])


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each device, whole."""
    names = rows.columns
    last = F.max_by(F.struct(*names), F.struct("packet_date", "position_id")).alias("row")
    return rows.groupBy("imei").agg(last).select(*[F.col(f"row.{c}") for c in names])


def priority(kind: Column) -> Column:
    """Order of handling: commands, then alarms, then the rest."""
    return F.when(kind == "command", 0).when(kind == "alarm", 1).otherwise(2)


def batch_sizes(batches: DataFrame) -> DataFrame:
    """How many batches (rows with n) there were, the largest and their mean."""
    return batches.agg(F.count("*").alias("batches"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def insert_outcomes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new with outcome: invalid (no device, time or coordinates), duplicate (its (imei, position_id) is stored, or an
    earlier new row has it) or acked. Rows without an id are never duplicates."""
    known = stored.filter("position_id > 0").select("imei", "position_id").distinct().withColumn("__there", F.lit(True))
    w = Window.partitionBy("imei", "position_id").orderBy("packet_date", "latitude", "longitude")
    rows = new.join(known, ["imei", "position_id"], "left").withColumn("__again", (F.col("position_id") > 0) & (F.row_number().over(w) > 1))
    bad = F.col("imei").isNull() | F.col("packet_date").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull()
    outcome = F.when(bad, "invalid").when(F.col("__there") | F.col("__again"), "duplicate").otherwise("acked")
    return rows.withColumn("outcome", outcome).select(*[c for c in new.columns if c != "outcome"], "outcome")
