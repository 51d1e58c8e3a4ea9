"""Column functions over scores and statuses (inventory 2.J, 2.L, 2.R)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses that count as a match, and as none.
MATCHES = ["MATCH", "AUTO_ACCEPT", "COORDS_VALIDATED", "ANALYZED", "ACCEPT"]
MISMATCHES = ["MISMATCH", "ADDRESS_MISMATCH", "MISMATCH_WARN", "REJECT", "FAILED", "ERROR", "NO_COORDS", "NO_COORDINATES"]


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def percent_score(c: Column) -> Column:
    """J-3: a share or a percentage as a whole number from 0 to 100, halves to even; null where it isn't a finite number."""
    v = c.cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite, clamp(F.bround(F.when((v > 0) & (v <= 1), v * 100).otherwise(v)).cast("int"), 0, 100))


def as_percent(c: Column) -> Column:
    """J-4: as above, but all values up to 1 are shares, and what isn't a number is 0."""
    v = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.bround(clamp(F.when(v <= 1, v * 100).otherwise(v), 0.0, 100.0)).cast("int")


def status_token(c: Column) -> Column:
    """I-62."""
    return F.upper(F.replace(F.replace(F.trim(c), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_")))


def is_match(c: Column) -> Column:
    """J-9."""
    return F.coalesce(status_token(c).isin(MATCHES), F.lit(False))


def is_mismatch(c: Column) -> Column:
    """J-10."""
    t = status_token(c)
    return F.coalesce(t.isin(MISMATCHES) | t.contains("MISMATCH"), F.lit(False))


def meets(c: Column, threshold: int | None, default: int = 70) -> Column:
    """J-8: truncated score against the threshold."""
    return F.coalesce(c.cast("int") >= (default if threshold is None else threshold), F.lit(False))


def location_confidence(location_type: Column, source: Column) -> Column:
    """J-23."""
    t = F.upper(location_type)
    named = F.when(t == "ROOFTOP", 95.0).when(t == "RANGE_INTERPOLATED", 75.0).when(t == "GEOMETRIC_CENTER", 60.0).when(t == "APPROXIMATE", 40.0)
    return F.coalesce(named, F.when(source == "osm", 82.0).when(source == "interpolated", 76.0).otherwise(50.0))


def osm_location(rank: Column) -> Column:
    """J-28: rank bands of forward results (low ranks are precise there)."""
    return F.when(rank <= 10, "ROOFTOP").when(rank <= 16, "RANGE_INTERPOLATED").when(rank <= 22, "GEOMETRIC_CENTER").otherwise("APPROXIMATE")


def reverse_location(rank: Column) -> Column:
    """J-33: rank bands of reverse results (high ranks are precise there)."""
    return F.when(rank >= 28, "ROOFTOP").when(rank >= 24, "RANGE_INTERPOLATED").when(rank >= 16, "GEOMETRIC_CENTER").otherwise("APPROXIMATE")


def status_from_score(c: Column) -> Column:
    """J-36."""
    return F.when(c >= 90, "AUTO_ACCEPT").when(c >= 60, "MANUAL_REVIEW").otherwise("REJECT")


def reverse_confidence(found: Column, number: Column, road: Column, postcode: Column, location: Column, distance_m: Column, status: Column, match_percent: Column) -> Column:
    """J-32: 50 and what the result's parts, place, distance and status add, 0 to 99; at most 35 unless the text matches."""
    s = F.lit(50) + F.when(number.isNotNull(), 20).otherwise(0) + F.when(road.isNotNull(), 15).otherwise(0) + F.when(postcode.isNotNull(), 10).otherwise(0)
    s = s + F.when(location == "ROOFTOP", 25).when(location == "RANGE_INTERPOLATED", 10).when(location == "APPROXIMATE", -15).otherwise(0)
    s = s + F.when(distance_m.isNull(), 0).when(distance_m < 50, 10).when(distance_m < 100, 5).when(distance_m < 500, -10).otherwise(-25)
    s = s + F.when(status == "MATCH", 5).when(status == "MISMATCH_WARN", -10).when(status == "MISMATCH", -25).when(status == "ADDRESS_MISMATCH", -30).when(status == "UNVERIFIED", -20).otherwise(0)
    s = clamp(s, 0, 99)
    s = F.when(F.coalesce(match_percent, F.lit(100)) < 100, F.least(s, F.lit(35))).otherwise(s)
    return F.when(found, s).otherwise(0).cast("int")


def footprint_band(area_m2: Column) -> tuple[Column, Column]:
    """L-29: structure and confidence by area."""
    kind = F.when(area_m2 <= 500, "SFU").when(area_m2 <= 1200, "MDU_SMALL").when(area_m2 <= 2500, "MDU_LARGE")
    return kind, F.when(area_m2 <= 0, 72).when(area_m2 <= 500, 80).when(area_m2 <= 1200, 76).when(area_m2 <= 2500, 72)


def unit_count(kind: Column, area_m2: Column) -> Column:
    """J-37."""
    small = F.when(area_m2 < 450, 2).when(area_m2 < 550, 3).otherwise(4)
    return F.when(kind == "SFU", 1).when(kind == "MDU_SMALL", small).when(kind == "MDU_LARGE", F.greatest(F.lit(5), (area_m2 / 120).cast("int")))
