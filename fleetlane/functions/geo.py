"""Distances, containment and the jump guard as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: What the jump guard takes for a relocation while offline, and for an impossible speed.
OFFLINE_HOURS, OFFLINE_KM, LEAST_KM, MOST_KMH = 6.0, 50.0, 2.0, 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    a = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000.0


def finite(*columns: Column) -> Column:
    """True where all are numbers, neither null nor NaN nor infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))
    return out


def stored_coordinates(lat: Column, lon: Column) -> Column:
    """The archive's rule: finite and not (0, 0)."""
    return finite(lat, lon) & ~((lat == 0) & (lon == 0))


def live_coordinates(lat: Column, lon: Column) -> Column:
    """The live path's rule: finite and neither is 0."""
    return finite(lat, lon) & (lat != 0) & (lon != 0)


def fence_coordinates(lat: Column, lon: Column) -> Column:
    """The fences' rule: finite and within the globe's range."""
    return finite(lat, lon) & lat.between(-90, 90) & lon.between(-180, 180)


def coordinates(*places: Column) -> list[Column]:
    """Latitudes and longitudes of structs (lat, lon); a null one counts as 0."""
    return [F.coalesce(s[k], F.lit(0.0)) for s in places for k in ("lat", "lon")]


def jump_guard(prev: Column, cur: Column, raw: Column | None = None, most_kmh: float = MOST_KMH, offline_hours: float = OFFLINE_HOURS, offline_km: float = OFFLINE_KM) -> Column:
    """struct(distance_km, is_jump, reason, raw_km, dt_min, implied_kmh) between two structs (lat, lon, t in ms).

    A null coordinate counts as 0; NaN and infinite ones are invalid. The rules apply in this order. raw is a column
    with haversine_km(*coordinates(prev, cur)), where there is one: the rules use it several times.
    """
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    lat1, lon1, lat2, lon2 = coordinates(prev, cur)
    raw = haversine_km(lat1, lon1, lat2, lon2) if raw is None else raw
    minutes = (cur["t"] - prev["t"]) / 60000.0
    hours = minutes / 60.0
    kmh = raw / hours

    def result(distance: Column, jump: bool, reason: str, raw_km: Column, dt: Column, speed: Column) -> Column:
        return F.struct(distance.alias("distance_km"), F.lit(jump).alias("is_jump"), F.lit(reason).alias("reason"), raw_km.alias("raw_km"), dt.alias("dt_min"), speed.alias("implied_kmh"))

    return (
        F.when(prev.isNull() | cur.isNull(), result(zero, False, "missing_point", zero, none, none))
        .when(~finite(lat1, lon1, lat2, lon2), result(zero, True, "invalid_coords", zero, none, none))
        .when(prev["t"].isNull() | cur["t"].isNull() | (cur["t"] <= prev["t"]), result(zero, True, "bad_time", raw, none, none))
        .when((hours >= offline_hours) & (raw >= offline_km), result(zero, True, "offline_relocation", raw, minutes, kmh))
        .when((raw >= LEAST_KM) & (kmh > most_kmh), result(zero, True, "implied_speed", raw, minutes, kmh))
        .otherwise(result(raw, False, "ok", raw, minutes, kmh))
    )


def in_circle(lat: Column, lon: Column, center_lat: Column, center_lon: Column, radius_m: Column) -> Column:
    near = (radius_m > 0) & (haversine_m(lat, lon, center_lat, center_lon) <= radius_m)
    return F.coalesce(fence_coordinates(lat, lon) & fence_coordinates(center_lat, center_lon) & near, F.lit(False))


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting over an array of [lat, lon] vertices; fewer than three contain nothing."""
    edge = F.zip_with(ring, F.concat(F.slice(ring, F.size(ring), F.lit(1)), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))), lambda i, j: F.struct(i.alias("i"), j.alias("j")))

    def crosses(e: Column) -> Column:
        yi, xi, yj, xj = e["i"][0], e["i"][1], e["j"][0], e["j"][1]
        return ((yi > lat) != (yj > lat)) & (lon < (xj - xi) * (lat - yi) / (yj - yi) + xi)

    inside = F.size(F.filter(edge, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return F.coalesce(fence_coordinates(lat, lon) & (F.size(ring) >= 3) & inside, F.lit(False))


def ring(text: Column) -> Column:
    """The vertices of a polygon written as JSON: an array of [lat, lon], or of rings of them, of which the first counts;
    null where it is neither."""
    parsed = F.try_parse_json(text)
    nested = F.try_variant_get(parsed, "$[0][0][0]", "double").isNotNull()
    at = lambda path: F.try_variant_get(parsed, path, "array<array<double>>")
    return F.when(nested, at("$[0]")).otherwise(at("$"))


def knots_to_kmh(knots: Column) -> Column:
    return knots * 1.852


def km_to_miles(km: Column) -> Column:
    return km * 0.621371
