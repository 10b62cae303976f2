"""Payloads for subscribers and notifications, as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alarm_messages, legacy_alarm_code, satellite_byte, stripped

#: Placeholders that don't count as a title or body, and the title where there is neither.
PLACEHOLDERS, NO_TITLE = ("title", "body"), "تنبيه"


def known(c: Column) -> Column:
    """A text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def round1(c: Column) -> Column:
    """One decimal, halves upwards; what is no number is 0."""
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(F.floor(n * 10 + 0.5) / 10)


def legacy_alarm(tokens: Column, satellites: Column, lat: Column, lon: Column, valid: Column, ignition: Column, charge: Column, blocked: Column) -> Column:
    """The legacy alarm struct: satellite byte, alarm number, messages, hemispheres and decoded flags (unknown is false)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = F.struct(yes(blocked).alias("oil_cut"), yes(valid).alias("gps_positioned"), F.lit(0).alias("alarm_code"), yes(charge).alias("charging"), yes(ignition).alias("acc_on"), F.lit(False).alias("defense"))
    text = lambda language: known(alarm_messages(tokens, language))
    return F.struct(
        satellite_byte(satellites).alias("satellite"),
        F.coalesce(satellites, F.lit(0)).cast("int").alias("satellites"),
        legacy_alarm_code(tokens).alias("alarm_type"),
        text("en").alias("alarm_text"),
        text("ar").alias("alarm_text_ar"),
        F.coalesce(lon >= 0, F.lit(False)).alias("east_longitude"),
        F.coalesce(lat >= 0, F.lit(False)).alias("north_latitude"),
        flags.alias("status_decoded"),
    )


#: Fixed values of the legacy payload.
GPS_INFO_LENGTH, COURSE_STATUS, LANGUAGE = 12, 0, "cn"


def legacy_payload(position: dict[str, Column], tokens: Column) -> Column:
    """The whole legacy payload of a position: legacy_alarm(), the fields that old parsers had beside it, and its flags once
    more on the upper level. position: type, id, satellites, latitude, longitude, direction, valid, battery_level, rssi,
    ignition, charge, blocked; what is missing is null."""
    of = lambda name, kind: (position[name] if name in position else F.lit(None)).cast(kind)
    lat, lon, valid = of("latitude", "double"), of("longitude", "double"), F.coalesce(of("valid", "boolean"), F.lit(False))
    alarm = legacy_alarm(tokens, F.coalesce(of("satellites", "int"), F.lit(0)), lat, lon, valid, of("ignition", "boolean"), of("charge", "boolean"), of("blocked", "boolean"))
    flags = alarm["status_decoded"]
    own = {
        "protocol": of("type", "string"),
        "serial": of("id", "string"),
        "gps_info_len": F.lit(GPS_INFO_LENGTH),
        "gps": F.struct(lat.alias("latitude"), lon.alias("longitude")),
        "course_status": F.lit(COURSE_STATUS),
        "language": F.lit(LANGUAGE),
        "direction": of("direction", "double"),
        "gps_positioned": valid,
        "real_time_gps": F.lit(True),
        "voltage_level": of("battery_level", "double"),
        "signal_strength": of("rssi", "double"),
    }
    same = ("satellite", "satellites", "alarm_type", "alarm_text", "alarm_text_ar", "east_longitude", "north_latitude", "status_decoded")
    flat = ("oil_cut", "alarm_code", "charging", "acc_on", "defense")
    return F.struct(*[c.alias(n) for n, c in own.items()], *[alarm[n].alias(n) for n in same], *[flags[n].alias(n) for n in flat])


def picked(fields: dict[str, Column]) -> Column:
    """struct of a notification's fields, each the first of its names that there is: texts that aren't empty, numbers that are
    finite; alarm_codes are an array, a single code one of one. The type is `alarm` if there is none."""
    of = lambda name, kind="string": (fields[name] if name in fields else F.lit(None)).cast(kind)
    text = lambda *names: F.coalesce(*[known(of(n)) for n in names])

    def number(*names: str) -> Column:
        finite = [F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for x in (of(n).try_cast("double") for n in names)]
        return F.coalesce(*finite)

    one = F.when(known(of("alarmCode")).isNotNull(), F.array(of("alarmCode"))).otherwise(F.array().cast("array<string>"))
    codes = F.coalesce(of("alarmCodes", "array<string>"), one)
    return F.struct(
        F.coalesce(text("type"), F.lit("alarm")).alias("type"),
        text("subType", "sub_type").alias("sub_type"),
        F.coalesce(of("alarmType"), of("alarm_type")).alias("alarm_type"),
        text("alarmText", "alarm_text").alias("alarm_text"),
        text("alarmTextAr", "alarm_text_ar").alias("alarm_text_ar"),
        F.coalesce(of("latitude", "double"), of("lat", "double"), of("gps_latitude", "double")).alias("latitude"),
        F.coalesce(of("longitude", "double"), of("lon", "double"), of("gps_longitude", "double")).alias("longitude"),
        number("speed", "gps_speed").alias("speed"),
        text("fence_name", "fenceName").alias("fence_name"),
        codes.alias("alarm_codes"),
        text("acc_status").alias("acc_status"),
    )


def device_title(name: Column, carnum: Column, title: Column, body: Column) -> Column:
    """'name - carnum', else the title, else the body, else a general one; placeholders don't count."""
    plain = lambda c, p: F.when(c != p, known(c))
    fallback = F.coalesce(plain(title, PLACEHOLDERS[0]), known(body), F.lit(NO_TITLE))
    own = stripped(F.concat(F.coalesce(name, F.lit("")), F.coalesce(F.concat(F.lit(" - "), known(carnum)), F.lit(""))))
    return F.coalesce(known(own), fallback)


def command_texts(command: Column, response: Column, body: Column) -> Column:
    """struct(en, ar) of a command and its response; what is missing is a dash."""
    part = lambda *cs: F.coalesce(*[known(stripped(c)) for c in cs], F.lit("—"))
    c, r = part(command), part(response, body)
    return F.struct(F.concat(F.lit("Command: "), c, F.lit("\nResponse: "), r).alias("en"), F.concat(F.lit("الأمر: "), c, F.lit("\nالرد: "), r).alias("ar"))


def notification(kind: Column, title: Column, body: Column, text_en: Column, text_ar: Column) -> Column:
    """struct(type, title, body, alarm_text, alarm_text_ar): each the first of the others that is known."""
    body, title = known(body), known(title)
    ar = F.coalesce(known(text_ar), body, title, F.lit(""))
    return F.struct(F.coalesce(known(kind), F.lit("alarm")).alias("type"), F.coalesce(title, ar).alias("title"), F.coalesce(body, ar).alias("body"), F.coalesce(known(text_en), body, title, F.lit("")).alias("alarm_text"), ar.alias("alarm_text_ar"))


def merged(base: dict[str, Column], over: dict[str, Column]) -> Column:
    """A struct of both: `over` wins where it isn't null."""
    names = list(dict.fromkeys([*base, *over]))
    return F.struct(*[F.coalesce(*[d[n] for d in (over, base) if n in d]).alias(n) for n in names])
