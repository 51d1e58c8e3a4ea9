"""Column functions over coordinates (inventory 2.J, 2.R)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """J-11: great-circle metres."""
    dphi, dlam = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam / 2), 2)
    return 2 * F.lit(EARTH_M) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def valid_pair(lat: Column, lon: Column) -> Column:
    """J-7: in range, and zero on neither axis."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & (lat != 0) & (lon != 0), F.lit(False))


def mapper_pair(lat: Column, lon: Column) -> Column:
    """C-5: in range, and not zero on both axes."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """J-17: initial bearing, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))), F.lit(360.0))


def nudge(lat: Column, lon: Column, heading: Column, forward_m: Column, lateral_m: Column) -> tuple[Column, Column]:
    """J-19: a point moved along the heading and to its right."""
    h = F.radians(heading)
    north = forward_m * F.cos(h) - lateral_m * F.sin(h)
    east = forward_m * F.sin(h) + lateral_m * F.cos(h)
    scale = F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    return lat + north / METRES_PER_DEGREE, lon + east / (METRES_PER_DEGREE * scale)


def interpolate(number: Column, low: Column, high: Column, south: Column, west: Column, north: Column, east: Column) -> tuple[Column, Column]:
    """J-20: a house number's place along a box's diagonal."""
    f = F.when(high == low, F.lit(0.5)).otherwise(F.least(F.greatest((number - low) / (high - low), F.lit(0.0)), F.lit(1.0)))
    return F.round(south + f * (north - south), 7), F.round(west + f * (east - west), 7)


def parse_coordinate(c: Column) -> tuple[Column, Column]:
    """J-2: (lat, lon) of the first ``lon,lat[,alt]`` of a text."""
    parts = F.split(F.regexp_extract(F.trim(c), r"^(\S+)", 1), ",")
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    lon, lat = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(lat.rlike(number) & lon.rlike(number), lat.cast("double")), F.when(lat.rlike(number) & lon.rlike(number), lon.cast("double"))


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]], boundary: bool = True) -> Column:
    """R-e: whether a point is in a ring of (lat, lon); its boundary counts as inside, or as outside for strict containment."""
    inside, on = F.lit(False), F.lit(False)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        on = on | ((F.abs(cross) < 1e-12) & lat.between(min(y1, y2), max(y1, y2)) & lon.between(min(x1, x2), max(x1, x2)))
        if y1 != y2:
            crosses = ((lat < y1) != (lat < y2)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            inside = inside != crosses
    return (inside | on) if boundary else (inside & ~on)


def edges(ring: Column) -> Column:
    """The edges of an array of structs ``lat``, ``lon`` with three corners or more, open or closed."""
    n = F.size(ring)
    corner = lambda i: F.get(ring, i)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(corner(i)["lat"].alias("y1"), corner(i)["lon"].alias("x1"), corner(F.pmod(i + 1, n))["lat"].alias("y2"), corner(F.pmod(i + 1, n))["lon"].alias("x2")))


def in_edges(lat: Column, lon: Column, edges: Column, boundary: bool = True) -> Column:
    """R-e over edges: whether a point is in their ring; the boundary counts as inside, or as outside for strict containment."""
    def crosses(e: Column) -> Column:
        x = (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return ((lat < e["y1"]) != (lat < e["y2"])) & F.coalesce(lon < x, F.lit(False))

    def touches(e: Column) -> Column:
        cross = (lon - e["x1"]) * (e["y2"] - e["y1"]) - (lat - e["y1"]) * (e["x2"] - e["x1"])
        box = lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])) & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        return (F.abs(cross) < 1e-12) & box

    inside = F.aggregate(edges, F.lit(False), lambda odd, e: odd != crosses(e))
    on = F.exists(edges, touches)
    return (inside | on) if boundary else (inside & ~on)


def degrees_to_edges(lat: Column, lon: Column, edges: Column) -> Column:
    """Least distance in degrees, as on a plane, of a point to the edges."""
    def away(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = ((lon - e["x1"]) * dx + (lat - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.sqrt(F.pow(lon - e["x1"] - t * dx, 2) + F.pow(lat - e["y1"] - t * dy, 2))

    return F.array_min(F.transform(edges, away))


def ring_area_m2(ring: Column) -> Column:
    """Q-n: spherical area of an array of structs ``lat``, ``lon``, open or closed."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, F.pmod(i + 1, n)).alias("q")))
    total = F.aggregate(edges, F.lit(0.0), lambda s, e: s + F.radians(e["q"]["lon"] - e["p"]["lon"]) * (2 + F.sin(F.radians(e["p"]["lat"])) + F.sin(F.radians(e["q"]["lat"]))))
    return F.abs(total * 6378137.0 * 6378137.0 / 2)


def cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    """Row and column of a grid of ``degrees``."""
    return F.floor(lat / degrees).cast("long"), F.floor(lon / degrees).cast("long")


def tile(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    """Column and row of the tile in web Mercator; rows count from the north."""
    n = float(1 << level)
    s = F.sin(F.radians(F.least(F.greatest(lat, F.lit(-85.05112878)), F.lit(85.05112878))))
    clip = lambda v: F.least(F.greatest(F.floor(v * n).cast("int"), F.lit(0)), F.lit((1 << level) - 1))
    return clip((lon + 180) / 360), clip(0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi()))


def quadkey(lat: Column, lon: Column, level: int) -> Column:
    """D-15: the tile's quadkey in web Mercator."""
    x, y = tile(lat, lon, level)
    digits = [(F.shiftright(x, i).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, i).bitwiseAND(F.lit(1))).cast("string") for i in range(level - 1, -1, -1)]
    return F.concat(*digits)


def quadkey_at(x: Column, y: Column, level: Column) -> Column:
    """The quadkey, as long as ``level`` (1 or more), of the tile in that column and row."""
    bit = lambda v, i: F.call_function("shiftright", v, i).bitwiseAND(F.lit(1))
    return F.array_join(F.transform(F.sequence(level - 1, F.lit(0), F.lit(-1)), lambda i: (bit(x, i) + 2 * bit(y, i)).cast("string")), "")
