from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fleetlane.functions import clock, geo, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def spot(lat, lon, t):
    return F.struct(F.lit(lat).cast("double").alias("lat"), F.lit(lon).cast("double").alias("lon"), F.lit(t).cast("long").alias("t"))


HOUR = 3_600_000


@pytest.mark.parametrize(
    "a, b, reason",
    [
        ((30, 31, 0), (30, 31.6, 6 * HOUR), "offline_relocation"),
        ((30, 31, 0), (30, 31.4, 6 * HOUR), "ok"),
        ((30, 31, 0), (30, 31.6, 6 * HOUR - 1), "ok"),
        ((30, 31, 0), (30, 31.3, 60_000), "implied_speed"),
        ((30, 31, 0), (30, 31.01, 1_000), "ok"),
        ((30, 31, 5), (30, 31, 5), "bad_time"),
        ((30, 31, None), (30, 31, 5), "bad_time"),
        ((float("nan"), 31, 0), (30, 31, 5), "invalid_coords"),
        ((None, None, 0), (None, 0, 5), "ok"),
    ],
)
def test_jump_guard(spark, a, b, reason):
    got = one(spark, geo.jump_guard(spot(*a), spot(*b)))
    assert got["reason"] == reason and got["is_jump"] == (reason != "ok")


def test_jump_guard_without_a_point(spark):
    none = F.lit(None).cast("struct<lat:double,lon:double,t:bigint>")
    assert one(spark, geo.jump_guard(none, spot(1, 1, 1)))["reason"] == "missing_point"


@pytest.mark.parametrize("lat, lon, inside", [(0.5, 0.5, True), (1.5, 0.5, False), (0.5, -0.1, False), (None, 0.5, False), (91.0, 0.5, False)])
def test_polygon(spark, lat, lon, inside):
    ring = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))])
    lat, lon = F.lit(lat).cast("double"), F.lit(lon).cast("double")
    assert one(spark, geo.in_polygon(lat, lon, ring)) is inside
    assert one(spark, geo.in_polygon(lat, lon, F.slice(ring, 1, 2))) is False


def test_business_day(spark):
    def bounds(text_):
        b = one(spark, clock.day_bounds(F.lit(text_).cast("timestamp")))
        return str(b["date"]), b["start_at"], (b["end_at"] - b["start_at"]).total_seconds() / 3600

    assert bounds("2026-09-07 12:00:00") == ("2026-09-07", datetime(2026, 9, 6, 21), 24)
    assert bounds("2026-04-24 12:00:00")[2] == 23 and bounds("2026-10-29 12:00:00")[2] == 25


def test_resolve_day():
    now = datetime(2026, 9, 7, 12, tzinfo=timezone.utc)
    assert clock.resolve_day(now)[0] == datetime(2026, 9, 6, 21, tzinfo=timezone.utc)
    assert clock.resolve_day(now, mode="utc")[0] == datetime(2026, 9, 7, tzinfo=timezone.utc)
    start, end = clock.resolve_day(day_utc=now)
    assert start == now and (end - start).total_seconds() == 86400


@pytest.mark.parametrize("value, want", [("1700000000", 1_700_000_000_000), ("1700000000123", 1_700_000_000_123), ("2026-09-07T10:00:00Z", 1_788_775_200_000), ("soon", None), (None, None), ("", None)])
def test_times(spark, value, want):
    assert one(spark, clock.parsed_millis(F.lit(value).cast("string"))) == want


def test_alarms(spark):
    tokens = text.alarm_tokens(F.lit(" Low_Bat, over-speed ,,OVERSPEED,what"))
    assert one(spark, tokens) == ["lowbattery", "overspeed", "what"]
    assert one(spark, text.alarm_messages(tokens)) == "Low Battery Alarm | Over Speed Alarm | what"
    assert one(spark, text.legacy_alarm_code(tokens)) == 14
    assert one(spark, text.without_muted(tokens)) == ["overspeed", "what"]
    assert one(spark, text.only_muted(text.alarm_tokens(F.lit("tampering")))) is True
    assert one(spark, text.only_muted(text.alarm_tokens(F.lit(None).cast("string")))) is False


def test_command_reply(spark):
    at = one(spark, text.command_reply(F.lit("Lat:S30.5,Lon:W31.25,Course:90,Speed:60,DateTime:2024-01-01 x")))["position"]
    assert at.asDict() == {"lat": -30.5, "lon": -31.25, "speed": 60, "course": 90, "datetime": "2024-01-01"}
    status = one(spark, text.command_reply(F.lit("External power: 12.5V; SVS Used in fix:7, ACC: ON")))["status"]
    assert (status["voltage"], status["svs_used"], status["acc"], status["gprs"]) == ("12.5", "7", "ON", None)
    assert one(spark, text.command_reply(F.lit("RELAY=OK!")))["command_result"].asDict() == {"command": "RELAY", "result": "OK!"}
    assert one(spark, text.command_reply(F.lit(None).cast("string"))).asDict() == {"position": None, "status": None, "command_result": None}


def test_fingerprint_keeps_empty_parts(spark):
    none = F.lit(None).cast("string")
    args = [F.lit("A"), none, F.lit("t"), none, none, F.lit(1.0), F.lit(None).cast("double"), none, none, F.lit(" x ")]
    assert one(spark, text.fingerprint(*args)) == "A||t|||1.000000||||x"


def test_alarm_texts(spark):
    say = lambda codes, language: one(spark, text.alarm_messages(text.alarm_tokens(F.lit(codes)), language))
    assert say("SOS,unheard-of", "en") == "SOS Alarm | unheardof" and say("SOS,unheard-of", "ar") == "تنبيه استغاثة | تنبيه: unheardof"
    assert say("", "en") == "" and say(None, "ar") == "تنبيه من الجهاز"


def test_command_replies(spark):
    say = lambda reply: one(spark, text.command_reply(F.lit(reply)))
    got = say("Current position!Lat:S24.5,Lon:W46.25,Course:10,Speed:7,DateTime:2024-01-01 10:00 more, or less")["position"]
    assert tuple(got) == (-24.5, -46.25, 7, 10, "2024-01-01")
    assert tuple(say("Lat:1,Lon:2.5,Course:0,Speed:0,DateTime:x:y")["position"]) == (1.0, 2.5, 0, 0, "x:y")
    for bad in ("Lat:N1,Lon:E2,Course:1.5,Speed:0,DateTime:x", "Lat:N1,Course:1,Lon:E2,Speed:0,DateTime:x", "Lat:,Lon:E2,Course:1,Speed:0,DateTime:x", "Lat:N1,Lon:E2,Course:1,Speed:0", "", None):
        assert say(bad)["position"] is None
    status = say("External power: 12.3V; GSM: weak, GSM: strong; ACC: ON")["status"]
    assert (status["voltage"], status["gsm"], status["acc"], status["relay"]) == ("12.3", "strong", "ON", None)
    assert say("External power: none")["status"]["voltage"] is None and say("GSM: strong")["status"] is None
    assert tuple(say("RELAY=OK 12!")["command_result"]) == ("RELAY", "OK 12!")
    assert [say(x)["command_result"] for x in ("R1=OK", "A=B=C", "A=", "=B", "A=b.c")] == [None] * 5


@pytest.mark.parametrize(
    "reply, want",
    [
        ("RELAY=OK\r\n", (None, None, "OK")),
        ("  RELAY=OK!﻿", (None, None, "OK!")),
        ("External power: 12.5V;\nGSM: strong; Relay: off\r\n", (None, ("12.5", "strong", "off"), None)),
        ("External power: Vcc 12.5V", (None, ("12.5", None, None), None)),
        ("External power: 3 v, External power: 4V", (None, ("4", None, None), None)),
        ("Lat:N1,Lon:E2 Lat:S30.5,Lon:W31.25,Course:9,Speed:10,DateTime:2024-01-01 10:00", ((-30.5, -31.25, 10, "2024-01-01"), None, None)),
        ("Lat:1.2.3,Lon:4,Course:0,Speed:0,DateTime:x", ((1.2, 4.0, 0, "x"), None, None)),
        ("A=B=C", (None, None, None)),
        ("relay=a\nb", (None, None, "a\nb")),
        (None, (None, None, None)),
    ],
)
def test_command_replies(spark, reply, want):
    r = spark.range(1).select(text.command_reply(F.lit(reply).cast("string")).alias("r")).first()["r"]
    position = r["position"] and tuple(r["position"][c] for c in ("lat", "lon", "speed", "datetime"))
    status = r["status"] and tuple(r["status"][c] for c in ("voltage", "gsm", "relay"))
    assert (position, status, r["command_result"] and r["command_result"]["result"]) == want


def test_blanks_of_all_kinds(spark):
    rows = spark.createDataFrame([("123\n",), (" 123 ﻿",), ("\r\n\t",), (None,), ("1 2",)], "s string")
    assert [tuple(r) for r in rows.select(text.stripped(F.col("s")), text.is_blank(F.col("s"))).collect()] == [("123", False), ("123", False), ("", True), (None, True), ("1 2", False)]


def test_rings_written_as_json(spark):
    rows = spark.createDataFrame([("[[1,2],[3,4.5],[5,6]]",), ("[[[1,2],[3,4],[5,6]],[[9,9]]]",), ("[]",), ("x",), (None,)], "s string")
    got = [r[0] for r in rows.select(geo.ring(F.col("s"))).collect()]
    assert got[:2] == [[[1.0, 2.0], [3.0, 4.5], [5.0, 6.0]], [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]] and not got[2] and got[3:] == [None, None]
