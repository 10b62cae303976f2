"""Small tracks for tests, and sequential versions of the device rules to hold the operators against."""

import math
import random
from datetime import datetime, timedelta

T0 = datetime(2026, 9, 7, 10, 0)
SCHEMA = "imei string, packet_date timestamp, latitude double, longitude double, speed double, ignition boolean, position_id long, alarm string"


def track(spark, rows, imei="A"):
    """rows: (minutes after T0, speed) or (minutes, speed, ignition) or (minutes, speed, ignition, lat, lon)."""
    data = []
    for i, r in enumerate(rows):
        minute, speed, ignition, lat, lon = (*r, *(True, 30.0 + i / 1000, 31.0)[len(r) - 2 :])
        data.append((imei, T0 + timedelta(minutes=minute), float(lat), float(lon), None if speed is None else float(speed), ignition, i + 1, None))
    return spark.createDataFrame(data, SCHEMA)


def random_tracks(seed, devices=12):
    """Rows of SCHEMA in a random order, with equal instants, gaps, nulls and alarms."""
    rng = random.Random(seed)
    rows, n = [], 0
    for d in range(devices):
        t = T0
        lat = 30.0
        for _ in range(rng.randint(1, 40)):
            t += timedelta(seconds=rng.choice([0, 1, 3, 20, 59, 60, 61, 170, 180, 300, 601, 700]))
            lat += rng.choice([0, 0.001, 0.01, 0.3])
            n += 1
            rows.append((f"D{d}", t, lat, 31.0, float(rng.choice([0, 0, 0, 1, 3, 5, 40, 90, 130])), rng.choice([True, True, False, None]), n, rng.choice([None] * 8 + ["overspeed", "lowspeed"])))
    rng.shuffle(rows)
    return rows


def by_device(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[6])):
        out.setdefault(r[0], []).append(r)
    return out


def km(a, b):
    la, lo, lb, lp = map(math.radians, (a[2], a[3], b[2], b[3]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def guarded(a, b):
    """(km that count, whether it is a jump) between two rows."""
    seconds = (b[1] - a[1]).total_seconds()
    if seconds <= 0:
        return 0.0, True
    d, hours = km(a, b), seconds / 3600
    if (hours >= 6 and d >= 50) or (d >= 2 and d / hours > 180):
        return 0.0, True
    return d, False
