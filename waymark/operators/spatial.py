"""Spatial joins, generators and the greedy distance distinct (inventory 2.D, 2.E, 2.M)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from math import pi, radians, sin

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

Ring = list[tuple[float, float]]


def in_polygons(points: DataFrame, polygons: list[tuple[int, Ring]], boundary: bool = True) -> DataFrame:
    """D spatial containment: ``polygon_id`` of the first polygon, by id, that holds each point; null where none does."""
    found = F.lit(None).cast("int")
    for polygon_id, ring in sorted(polygons, reverse=True):
        found = F.when(geo.in_ring(F.col("lat"), F.col("lon"), ring, boundary), F.lit(polygon_id)).otherwise(found)
    return points.withColumn("polygon_id", found)


def outside_filter(points: DataFrame, ring: Ring) -> DataFrame:
    """R-f: drops what is known to be outside; rows without coordinates stay."""
    return points.filter(F.coalesce(geo.in_ring(F.col("lat"), F.col("lon"), ring), F.lit(True)))


def _corner_range(axis: str) -> tuple[Column, Column]:
    values = F.transform("ring", lambda q: q[axis])
    return F.array_min(values), F.array_max(values)


def _around_polygons(points: DataFrame, polygons: DataFrame, margin: float) -> DataFrame:
    """Points with the edges of each polygon whose box, widened by ``margin`` degrees, may hold them.

    A polygon is filed in cells as wide as its widened box or up to twice that, of which it meets four at most; points are
    looked up in their cell of each width in use (a few dozen at most, whatever the table).
    """
    c = F.col
    (south, north), (west, east) = _corner_range("lat"), _corner_range("lon")
    wide = margin * (1 + 1e-9) + 1e-9
    filed = polygons.filter("size(ring) >= 3 and forall(ring, q -> abs(q.lat) < double('inf') and abs(q.lon) < double('inf'))")
    filed = filed.select("polygon_id", geo.edges(c("ring")).alias("edges"), (south - wide).alias("s"), (north + wide).alias("n"), (west - wide).alias("w"), (east + wide).alias("e"))
    filed = filed.withColumn("level", F.ceil(F.log2(F.greatest(c("n") - c("s"), c("e") - c("w")))).cast("int"))
    levels = [r.level for r in filed.select("level").distinct().collect()]
    size = F.pow(F.lit(2.0), c("level"))
    cell = lambda v: F.floor(v / size).cast("long")
    filed = filed.withColumn("cy", F.explode(F.sequence(cell(c("s")), cell(c("n"))))).withColumn("cx", F.explode(F.sequence(cell(c("w")), cell(c("e")))))
    places = points.filter("abs(lat) < double('inf') and abs(lon) < double('inf')")
    places = places.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumns({"cy": cell(c("lat")), "cx": cell(c("lon"))})
    return places.join(filed, ["level", "cy", "cx"]).select(*points.columns, "polygon_id", "edges")


def _places(points: DataFrame) -> DataFrame:
    """The distinct places of points, with finite coordinates."""
    return points.filter("abs(lat) < double('inf') and abs(lon) < double('inf')").select("lat", "lon").distinct()


def _rings(polygons: DataFrame) -> DataFrame:
    """Equal rings once, with their smallest ``polygon_id``."""
    return polygons.groupBy("ring").agg(F.min("polygon_id").alias("polygon_id"))


def containing(points: DataFrame, polygons: DataFrame, boundary: bool = True) -> DataFrame:
    """Spatial containment in a table of polygons (``polygon_id``, ``ring`` of structs ``lat``, ``lon``): the smallest ``polygon_id`` that holds each point (``id``), else null.

    Rings of fewer than three corners or with infinite ones hold nothing; rings across the 180th meridian are taken as they are.
    Equal places and equal rings are compared once, whatever number of rows has them.
    """
    hits = _around_polygons(_places(points), _rings(polygons), 0.0).filter(geo.in_edges(F.col("lat"), F.col("lon"), F.col("edges"), boundary))
    first = hits.groupBy("lat", "lon").agg(F.min("polygon_id").alias("polygon_id"))
    return points.join(first, ["lat", "lon"], "left").select("id", *(x for x in points.columns if x != "id"), "polygon_id")


def nearest_polygon(points: DataFrame, polygons: DataFrame, near_deg: float = 0.00015) -> DataFrame:
    """D-10: ``polygon_id``, ``match_type`` and ``confidence`` of each point: within (85), else nearer than ``near_deg`` (80), else nearest (75).

    The smaller id decides ties. The search widens sixteenfold each round and takes on only points that have none yet.
    Points without finite coordinates, and all where there are no polygons, have no row. A point much further from all
    polygons than they are from each other is measured against most of them. Equal places and rings are searched once.
    """
    _checkpoints(points.sparkSession)
    c = F.col
    places, rings, at = _places(points).checkpoint(), _rings(polygons).checkpoint(), ["lat", "lon"]
    held = _around_polygons(places, rings, 0.0).filter(geo.in_edges(c("lat"), c("lon"), c("edges"), boundary=False))
    found = held.groupBy(*at).agg(F.min("polygon_id").alias("polygon_id")).select(*at, "polygon_id", F.lit("ST_WITHIN").alias("match_type"), F.lit(85).alias("confidence")).checkpoint()
    left = places.join(found, at, "left_anti").checkpoint()
    radius = near_deg
    while not left.isEmpty():
        pairs = _around_polygons(left, rings, radius).withColumn("d", geo.degrees_to_edges(c("lat"), c("lon"), c("edges"))).filter(c("d") <= radius)
        best = pairs.groupBy(*at).agg(F.min(F.struct("d", "polygon_id")).alias("b"))
        near = c("b.d") < near_deg
        best = best.select(*at, "b.polygon_id", F.when(near, "ST_DWITHIN").otherwise("NEAREST").alias("match_type"), F.when(near, 80).otherwise(75).alias("confidence")).checkpoint()
        if radius > 1e4 and best.isEmpty():
            break
        found, left = found.unionByName(best), left.join(best, at, "left_anti").checkpoint()
        radius *= 16
    return points.select("id", *at).join(found, at).select("id", "polygon_id", "match_type", "confidence")


def _bands(lat: Column, dlat: float) -> Column:
    return F.floor(lat / dlat).cast("long")


def _cells_of_band(band: Column, dlat: float, radius_m: float) -> Column:
    """How many cells a band of latitude has around the globe, each as wide as two points of it in reach can be apart; one near a pole."""
    reach = radius_m / geo.EARTH_M * (1 + 1e-6)
    tilt = lambda v: 90 - F.abs(90 - F.abs(v))
    top = F.radians(F.greatest(tilt(band * dlat), tilt((band + 1) * dlat)))
    share = F.lit(sin(min(reach, pi / 2))) / F.greatest(F.cos(top), F.lit(1e-12))
    n = F.floor(F.lit(2 * pi) / F.asin(F.least(share, F.lit(1.0)))).cast("long")
    return F.when((top + reach + radians(dlat) >= pi / 2) | (n < 3), F.lit(1)).otherwise(n)


def pairs_within(left: DataFrame, right: DataFrame, radius_m: float, by: str | None = None) -> DataFrame:
    """D-17: pairs (``left_id``, ``right_id``, ``distance_m``) at most ``radius_m`` apart, of equal ``by`` where it is given: an equi-join on grid cells, then the distance.

    Bands of latitude are as high as the radius; each has cells of its own width, numbered around the globe, so pairs near
    the poles and across the 180th meridian are found. Rows without coordinates have no pairs.
    """
    c, dlat = F.col, radius_m / 111_000.0
    own = [c(by).alias("own")] if by else []
    keys = ["cy", "cx", *(["own"] if by else [])]
    place = lambda: F.floor(F.pmod(c("lon") + 180, F.lit(360.0)) / 360 * c("n")).cast("long")
    some = "lat is not null and lon is not null"
    a = left.filter(some).select(c("id").alias("left_id"), "lat", "lon", *own).withColumn("cy", _bands(c("lat"), dlat)).withColumn("n", _cells_of_band(c("cy"), dlat, radius_m))
    a = a.withColumn("cx", F.pmod(place(), c("n"))).drop("n")
    b = right.filter(some).select(c("id").alias("right_id"), "lat", "lon", *own).withColumn("band", _bands(c("lat"), dlat))
    b = b.withColumn("cy", F.explode(F.sequence(c("band") - 1, c("band") + 1))).withColumn("n", _cells_of_band(c("cy"), dlat, radius_m))
    b = b.withColumn("cx", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda step: F.pmod(place() + step, c("n"))))))
    b = b.drop("band", "n").withColumnsRenamed({"lat": "lat2", "lon": "lon2"})
    d = geo.haversine_m(c("lat"), c("lon"), c("lat2"), c("lon2"))
    return a.join(b, keys).withColumn("distance_m", d).filter(c("distance_m") <= radius_m).select("left_id", "right_id", "distance_m")


def near_any(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """D-17, D-18: rows of ``left`` with ``near``: whether any row of ``right`` is at most ``radius_m`` away."""
    hit = pairs_within(left, right, radius_m).select("left_id").distinct()
    return left.join(hit, F.col("id") == F.col("left_id"), "left").withColumn("near", F.col("left_id").isNotNull()).drop("left_id")


def nearest(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """D-11: the nearest row of ``right`` within the radius, ties to the smaller id."""
    best = pairs_within(left, right, radius_m).groupBy("left_id").agg(F.min(F.struct(F.round("distance_m", 3).alias("distance_m"), "right_id")).alias("b"))
    return best.select(F.col("left_id").alias("id"), F.col("b.right_id").alias("nearest_id"), F.col("b.distance_m").alias("distance_m"))


def grid_points(polygons: DataFrame, step: float) -> DataFrame:
    """M-1: candidate points strictly inside each polygon (``polygon_id``, ``ring``): every cell of ``step`` degrees of its box at nine offsets. Boxes without height or width have none."""
    c = F.col
    (south, north), (west, east) = _corner_range("lat"), _corner_range("lon")
    offsets = F.array(*[F.lit(o) for o in (0.5, 0.25, 0.75)])
    out = polygons.filter("size(ring) >= 3").select("polygon_id", geo.edges(c("ring")).alias("edges"), south.alias("s"), north.alias("n"), west.alias("w"), east.alias("e")).filter("s < n and w < e")
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((c("n") - c("s")) / step)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((c("e") - c("w")) / step))))
    out = out.withColumn("oy", F.explode(offsets)).withColumn("ox", F.explode(offsets))
    out = out.withColumns({"lat": c("s") + (c("i") + c("oy")) * step, "lon": c("w") + (c("j") + c("ox")) * step})
    return out.filter(geo.in_edges(c("lat"), c("lon"), c("edges"), boundary=False)).select("polygon_id", "i", "j", "oy", "ox", "lat", "lon")


#: Directions as (north, east).
DIRECTIONS = [("N", 1.0, 0.0), ("S", -1.0, 0.0), ("E", 0.0, 1.0), ("W", 0.0, -1.0), ("NE", 0.7071, 0.7071), ("NW", 0.7071, -0.7071), ("SE", -0.7071, 0.7071), ("SW", -0.7071, -0.7071)]


def neighbourhood_candidates(seeds: DataFrame, polygons: DataFrame, distance_m: float = 60.0, samples: int = 4) -> DataFrame:
    """M-2: points around each seed (``id``, ``polygon_id``) strictly inside its polygon, in the first ``samples`` directions at one and one and a half times the distance; of points equal to six places the first stays."""
    table = F.array(*[F.struct(F.lit(i).alias("d"), F.lit(n).alias("n"), F.lit(e).alias("e"), F.lit(r).alias("r")) for i, (_, n, e) in enumerate(DIRECTIONS[:samples]) for r in (1.0, 1.5)])
    c = F.col
    out = seeds.withColumn("s", F.explode(table))
    lat = c("lat") + c("s.n") * distance_m * c("s.r") / 111_320.0
    lon = c("lon") + c("s.e") * distance_m * c("s.r") / (111_320.0 * F.greatest(F.lit(0.1), F.cos(F.radians(c("lat")))))
    out = out.join(polygons.filter("size(ring) >= 3").select("polygon_id", geo.edges(c("ring")).alias("edges")), "polygon_id").withColumns({"y": lat, "x": lon})
    out = out.filter(geo.in_edges(c("y"), c("x"), c("edges"), boundary=False))
    out = out.select(c("id").alias("seed_id"), c("s.d").alias("direction"), c("s.r").alias("radius"), F.round("y", 6).alias("lat"), F.round("x", 6).alias("lon"))
    first = out.groupBy("lat", "lon").agg(F.min(F.struct("direction", "radius", "seed_id")).alias("f"))
    return first.select("f.seed_id", "f.direction", "f.radius", "lat", "lon")


def multi_unit_rows(rows: DataFrame, cap: int) -> DataFrame:
    """M-3: one row per unit, two at least and ``cap`` at most."""
    n = F.least(F.greatest(F.col("units"), F.lit(2)), F.lit(cap))
    return rows.withColumn("unit", F.explode(F.sequence(F.lit(1), n)))


def _checkpoints(spark: SparkSession) -> None:
    """Sees to it that the session has a checkpoint folder that its executors share."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="waymark-"))


def greedy_distinct(points: DataFrame, group: str, threshold_m: float = 20.0) -> DataFrame:
    """E-4: in order of ``ord``, keeps a point of its group unless a kept one is nearer than ``threshold_m``.

    The choice depends on order, so it can't be a window; and a group is never gathered in one task. Of points at one
    place only the first can stay. Then, in rounds, a point is kept once no earlier point near it is undecided or kept,
    and goes once one near it is kept; each round is two joins over the pairs of near points.
    """
    _checkpoints(points.sparkSession)
    firsts = points.filter("lat is not null and lon is not null").groupBy(group, "lat", "lon").agg(F.min(F.struct("ord", "id")).alias("f")).select(group, "lat", "lon", "f.ord", "f.id")
    firsts = firsts.checkpoint()
    near = pairs_within(firsts, firsts, threshold_m, by=group).filter(F.col("distance_m") < threshold_m)
    side = lambda n: firsts.select(F.col("id").alias(f"{n}_id"), F.struct("ord", "id").alias(f"{n}_ord"))
    pairs = near.join(side("left"), "left_id").join(side("right"), "right_id").filter("left_ord < right_ord")
    pairs = pairs.select(F.col("left_id").alias("before"), F.col("right_id").alias("after")).checkpoint()
    kept, left = firsts.select("id").limit(0), firsts.select("id")
    while not pairs.isEmpty():
        free = left.join(pairs.select(F.col("after").alias("id")).distinct(), "id", "left_anti")
        gone = pairs.join(free.withColumnRenamed("id", "before"), "before", "left_semi").select(F.col("after").alias("id")).distinct()
        kept = kept.unionByName(free).checkpoint()
        left = left.join(free, "id", "left_anti").join(gone, "id", "left_anti").checkpoint()
        still = left.select(F.col("id").alias("x"))
        pairs = pairs.join(still, F.col("before") == F.col("x"), "left_semi").join(still, F.col("after") == F.col("x"), "left_semi").checkpoint()
    return points.join(kept.unionByName(left), "id", "left_semi")


def first_of_key_or_place(rows: DataFrame, near_m: float) -> DataFrame:
    """E-5: in order of ``ord``, the ``id`` of each row (``id``, ``ord``, ``key``, ``lat``, ``lon``) whose key no kept row has and that no kept row is within ``near_m`` of.

    Decided in rounds as in ``greedy_distinct``. Rows wait for the earliest undecided row of their key and of each place in
    reach, so only pairs of places are joined, never pairs of rows of one key or place. Null keys equal none.
    """
    _checkpoints(rows.sparkSession)
    c = F.col
    left = rows.filter("lat is not null and lon is not null").select("id", "key", F.struct("ord", "id").alias("turn"), F.concat_ws(",", "lat", "lon").alias("place"), "lat", "lon").checkpoint()
    places = left.groupBy("place").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon")).withColumnRenamed("place", "id")
    reach = pairs_within(places, places, near_m).select(c("left_id").alias("place"), c("right_id").alias("other")).checkpoint()
    kept = left.select("id").limit(0)
    while not left.isEmpty():
        here = left.groupBy("place").agg(F.min("turn").alias("turn"))
        by_place = reach.join(here.withColumnRenamed("place", "other"), "other").groupBy("place").agg(F.min("turn").alias("place_turn"))
        by_key = left.filter("key is not null").groupBy("key").agg(F.min("turn").alias("key_turn"))
        free = left.join(by_place, "place").join(by_key, "key", "left").filter((c("turn") == c("place_turn")) & (c("key_turn").isNull() | (c("turn") == c("key_turn"))))
        free = free.select("id", "key", "place").checkpoint()
        kept = kept.unionByName(free.select("id"))
        gone = reach.join(free.select("place"), "place", "left_semi").select(c("other").alias("place")).distinct()
        left = left.join(gone, "place", "left_anti").join(free.filter("key is not null").select("key").distinct(), "key", "left_anti").checkpoint()
    return kept


def hulls(points: DataFrame, group: str) -> DataFrame:
    """Q-a: the convex hull of each group, against the clock from its least longitude, as the hull of its parts' hulls, so that no group is gathered whole. Null is a group too."""

    def turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def hull(p: np.ndarray) -> np.ndarray:
        p = np.unique(p, axis=0)
        if len(p) < 3:
            return p
        out: list = []
        for side in (p, p[::-1]):
            start = len(out)
            for q in side:
                while len(out) >= start + 2 and turn(out[-2], out[-1], q) <= 0:
                    out.pop()
                out.append(q)
            out.pop()
        return np.array(out)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, own in b.groupby(group, dropna=False):
                h = hull(own[["lon", "lat"]].to_numpy(float))
                yield pd.DataFrame({group: pd.Series([None if pd.isna(g) else g] * len(h), dtype="object"), "lon": h[:, 0], "lat": h[:, 1]})

    def whole(own: pd.DataFrame) -> pd.DataFrame:
        h = hull(own[["lon", "lat"]].to_numpy(float))
        return pd.DataFrame({group: own[group].iloc[0], "place": np.arange(len(h)), "lat": h[:, 1], "lon": h[:, 0]})

    kind = points.schema[group].dataType.simpleString()
    clean = points.filter("lat is not null and lon is not null").select(group, "lon", "lat")
    return clean.mapInPandas(part, f"{group} {kind}, lon double, lat double").groupBy(group).applyInPandas(whole, f"{group} {kind}, place long, lat double, lon double")
