"""Building footprints in tiles (inventory A-21 to A-23, D-14, D-16).

Footprints come as gzipped lines of GeoJSON. They are written once, partitioned by the quadkey of the smallest tile of
which a footprint's box meets four at most, so keys have mixed lengths. Points look their own tiles up on each length; the
distinct keys of the points prune the partitions when the query runs, so only tiles with points in them are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial

LEVEL = 9
RING = "array<struct<lat:double,lon:double>>"
TILES = f"polygon_id bigint, region string, ring {RING}, tile string"
#: Regions whose border tiles share quadkeys.
SIBLINGS = {"Canada": "UnitedStates", "UnitedStates": "Canada"}


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A-21: (``properties``, ``part``, ``ring``) of lines of GeoJSON features, gzipped or not; ``part`` counts a multipolygon's polygons.

    Lines that aren't JSON objects, features without geometry and other geometries than polygons give nothing. Of each
    polygon the outer ring is kept, as its holes are no footprint of another building.
    """
    feature = F.from_json("value", "geometry struct<type:string,coordinates:string>, properties map<string,string>")
    rows = spark.read.text(path).select(feature.alias("f")).filter("f.geometry.type in ('Polygon', 'MultiPolygon')").select("f.properties", "f.geometry.*")
    one, many = F.from_json("coordinates", "array<array<array<double>>>"), F.from_json("coordinates", "array<array<array<array<double>>>>")
    outer = F.when(F.col("type") == "Polygon", F.array(F.get(one, F.lit(0)))).otherwise(F.transform(many, lambda p: F.get(p, F.lit(0))))
    rings = rows.select("properties", F.posexplode(outer).alias("part", "outer")).filter("size(outer) >= 3")
    corner = lambda c: F.struct(F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon"))
    return rings.select("properties", "part", F.transform("outer", corner).alias("ring"))


def _box_tiles(south: Column, west: Column, north: Column, east: Column, level: int) -> list[Column]:
    """First and last column, first and last row of the tiles of a box."""
    (x0, y1), (x1, y0) = geo.tile(south, west, level), geo.tile(north, east, level)
    return [x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")]


def tiles_of_box(boxes: DataFrame, level: int = LEVEL) -> DataFrame:
    """D-16: ``boxes`` (``south``, ``west``, ``north``, ``east``) with a row for each ``quadkey`` of ``level`` that they meet.

    Exact, by the ranges of columns and rows. Boxes across the 180th meridian are given as two.
    """
    own = boxes.select("*", *_box_tiles(*map(F.col, ("south", "west", "north", "east")), level))
    own = own.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return own.withColumn("quadkey", geo.quadkey_at(F.col("x"), F.col("y"), F.lit(level))).drop("x0", "x1", "y0", "y1", "x", "y")


def tile_cover(boxes: DataFrame, level: int = LEVEL) -> DataFrame:
    """``boxes`` with a row for each ``quadkey`` of their cover by whole tiles of mixed size, ``level`` the smallest.

    From the four largest tiles down, what lies in the box stays and what meets its border is split in four, so a box has
    about as many tiles as its border is long. One narrow step a level, no shuffle.
    """
    own = boxes.select("*", *_box_tiles(*map(F.col, ("south", "west", "north", "east")), level))
    whole = lambda t, s: (F.col("x0") <= F.shiftleft(t["x"], s)) & (F.shiftleft(t["x"] + 1, s) - 1 <= F.col("x1")) & (F.col("y0") <= F.shiftleft(t["y"], s)) & (F.shiftleft(t["y"] + 1, s) - 1 <= F.col("y1"))
    met = lambda t, s: (F.shiftleft(t["x"], s) <= F.col("x1")) & (F.shiftleft(t["x"] + 1, s) > F.col("x0")) & (F.shiftleft(t["y"], s) <= F.col("y1")) & (F.shiftleft(t["y"] + 1, s) > F.col("y0"))
    seed = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("l"), F.lit(False).alias("done"))
    own = own.withColumn("t", seed)
    for at in range(1, level + 1):
        left = level - at
        parts = F.array(*(F.struct((F.col("t.x") * 2 + dx).alias("x"), (F.col("t.y") * 2 + dy).alias("y"), F.lit(at).alias("l"), F.lit(False).alias("done")) for dy in (0, 1) for dx in (0, 1)))
        parts = F.filter(parts, lambda t: met(t, left))
        parts = F.transform(parts, lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["l"].alias("l"), whole(t, left).alias("done")))
        own = own.withColumn("t", F.explode(F.when(F.col("t.done"), F.array("t")).otherwise(parts)))
    return own.withColumn("quadkey", geo.quadkey_at(F.col("t.x"), F.col("t.y"), F.col("t.l"))).drop("x0", "x1", "y0", "y1", "t")


def _up(name: str) -> Column:
    """A tile's column or row, ``up`` levels higher."""
    return F.call_function("shiftright", F.col(name), F.col("up"))


def _filed(boxes: DataFrame, level: int) -> DataFrame:
    """Boxes (``x0``, ``x1``, ``y0``, ``y1`` of ``level``) with a row for each tile ``fx``, ``fy`` that they meet ``up`` levels higher: the smallest tiles of which they meet two columns and two rows at most."""
    span = lambda s: F.greatest(F.shiftright("x1", s) - F.shiftright("x0", s), F.shiftright("y1", s) - F.shiftright("y0", s))
    up = F.lit(level - 1)
    for s in range(level - 2, -1, -1):
        up = F.when(span(s) <= 1, F.lit(s)).otherwise(up)
    boxes = boxes.withColumn("up", up)
    return boxes.withColumn("fx", F.explode(F.sequence(_up("x0"), _up("x1")))).withColumn("fy", F.explode(F.sequence(_up("y0"), _up("y1"))))


def write_tiles(footprints: DataFrame, path: str, level: int = LEVEL) -> None:
    """Footprints (``polygon_id``, ``region``, ``ring``) as Parquet partitioned by ``tile``, ``q`` and a quadkey.

    The key is as long as can be, up to ``level``, with the box meeting two columns and two rows at most. Spark splits
    large tiles into several files.
    """
    corner = lambda f, axis: f(F.transform("ring", lambda q: q[axis]))
    filed = footprints.filter("size(ring) >= 3 and forall(ring, q -> abs(q.lat) <= 90 and abs(q.lon) <= 180)")
    filed = filed.select("polygon_id", "region", "ring", *_box_tiles(corner(F.array_min, "lat"), corner(F.array_min, "lon"), corner(F.array_max, "lat"), corner(F.array_max, "lon"), level))
    filed = _filed(filed, level)
    key = F.concat(F.lit("q"), geo.quadkey_at(F.col("fx"), F.col("fy"), level - F.col("up")))
    filed.select("polygon_id", "region", "ring", key.alias("tile")).hint("rebalance", F.col("tile")).write.partitionBy("tile").parquet(path)


def point_tiles(points: DataFrame, level: int = LEVEL) -> DataFrame:
    """The distinct ``tile`` names, of all lengths, that the points are in: 4^level * 4 / 3 at most, whatever the points."""
    placed = points.filter("lat between -90 and 90 and lon between -180 and 180").select(geo.quadkey(F.col("lat"), F.col("lon"), level).alias("k")).distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.lit(level)), lambda n: F.concat(F.lit("q"), F.substring(F.col("k"), F.lit(1), n)))
    return placed.select(F.explode(prefixes).alias("tile")).distinct()


def tiles_with(points: DataFrame, path: str, level: int = LEVEL) -> DataFrame:
    """D-14: the footprints of the tiles that hold points, each once. Spark prunes the other partitions at run time.

    The keys that are broadcast for that are bounded by the number of tiles, 350,000 for level 9.
    """
    tiles = points.sparkSession.read.schema(TILES).parquet(path)
    keys = point_tiles(points, level).filter("tile >= 'q'")
    return tiles.join(F.broadcast(keys), "tile", "left_semi").select("polygon_id", "region", "ring").dropDuplicates(["polygon_id"])


def footprints_at(points: DataFrame, path: str, level: int = LEVEL) -> DataFrame:
    """``points`` (``id``, ``lat``, ``lon``) with the ``polygon_id`` of the first footprint, by id, that holds each; null where none does."""
    return spatial.containing(points, tiles_with(points, path, level))


def normal_quadkey(c: Column, level: int = LEVEL) -> Column:
    """A quadkey's digits, with the zeros in front that are lost where it was read as a number."""
    return F.lpad(F.regexp_replace(c.cast("string"), "[^0-3]", ""), level, "0")


def normal_region(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z]", "")


def tile_sources(wanted: DataFrame, index: DataFrame, level: int = LEVEL) -> DataFrame:
    """A-23: (``quadkey``, ``choice``, ``region``, ``url``) in the order to try them for each row (``quadkey``, ``preferred``) of ``wanted``.

    ``index`` has ``quadkey``, ``location``, ``url`` and its order ``ord``. An address that is listed twice counts once,
    where it comes first; blank ones don't count. The preferred region comes first, then its sibling across the border,
    then the rest in the index's order; without a preference all are in that order. Several wanted rows of one quadkey
    must agree.
    """
    rows = index.select(normal_quadkey(F.col("quadkey"), level).alias("quadkey"), normal_region(F.col("location")).alias("region"), F.trim("url").alias("url"), "ord").filter("url <> ''")
    rows = rows.groupBy("quadkey", "url").agg(F.min(F.struct("ord", "region")).alias("f")).select("quadkey", "url", "f.*")
    asked = wanted.select(normal_quadkey(F.col("quadkey"), level).alias("quadkey"), normal_region(F.coalesce("preferred", F.lit(""))).alias("preferred")).distinct()
    sibling = F.element_at(F.create_map(*(F.lit(x) for pair in SIBLINGS.items() for x in pair)), F.col("preferred"))
    place = F.when(F.col("preferred") == "", 0).when(F.col("region") == F.col("preferred"), 0).when(F.col("region") == sibling, 1).otherwise(2)
    order = Window.partitionBy("quadkey").orderBy(place, "ord", "url")
    return asked.join(rows, "quadkey").withColumn("choice", F.row_number().over(order)).select("quadkey", "choice", "region", "url")


def chosen_regions(points: DataFrame, footprints: DataFrame, sources: DataFrame, level: int = LEVEL) -> DataFrame:
    """A-22: (``quadkey``, ``region``) of the first choice of ``sources`` that has a footprint in the box of the tile's points.

    ``footprints`` has ``region`` and ``ring``. A region without any there is passed over for the next one. Equal boxes of a
    region count once; a box is filed in four tiles of its own size at most, and the points' tiles look up those they are in.
    """
    c = F.col
    x, y = geo.tile(c("lat"), c("lon"), level)
    boxes = points.filter("lat between -90 and 90 and lon between -180 and 180").groupBy(x.alias("x"), y.alias("y"))
    boxes = boxes.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    corner = lambda f, axis: f(F.transform("ring", lambda q: q[axis]))
    placed = footprints.select(normal_region(c("region")).alias("region"), corner(F.array_min, "lat").alias("south"), corner(F.array_min, "lon").alias("west"), corner(F.array_max, "lat").alias("north"), corner(F.array_max, "lon").alias("east"))
    placed = _filed(placed.distinct().select("*", *_box_tiles(*map(c, ("south", "west", "north", "east")), level)), level)
    met = boxes.select("*", F.explode(F.sequence(F.lit(0), F.lit(level - 1))).alias("up")).select("*", _up("x").alias("fx"), _up("y").alias("fy"))
    there = placed.join(met, ["up", "fx", "fy"]).filter("x between x0 and x1 and y between y0 and y1 and south <= n and north >= s and west <= e and east >= w")
    there = there.select("x", "y", "region").distinct().select(geo.quadkey_at(c("x"), c("y"), F.lit(level)).alias("quadkey"), "region")
    first = sources.join(there, ["quadkey", "region"]).groupBy("quadkey").agg(F.min(F.struct("choice", "region")).alias("f"))
    return first.select("quadkey", "f.region")
