"""Queries over footprint tiles, property records and address lines, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines
from ..operators import linkage
from ..sources import footprints
from ..sources.shared import new_folder
from .queries import query
from .views import ADDRESSES, STREETS, addresses, haversine_sql, table

# footprint tiles

#: Half the side of a footprint in degrees; every 40th is a county, 2.5 degrees wide.
_HALF = "CASE WHEN id % 40 = 7 THEN 1.25::DOUBLE ELSE 0.0004::DOUBLE END"


def _footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square around each address that has a place, every 40th a large one; ids and regions from the address."""
    half = F.when(F.col("id") % 40 == 7, 1.25).otherwise(0.0004)
    rows = addresses(spark, sf_dir).filter("lat <= 85").select(F.col("id").alias("polygon_id"), "lat", "lon", half.alias("h"), F.when(F.col("id") % 3 == 0, "Canada").otherwise("United States").alias("region"))
    corner = lambda dy, dx: F.struct((F.col("lat") + dy * F.col("h")).alias("lat"), (F.col("lon") + dx * F.col("h")).alias("lon"))
    return rows.select("polygon_id", "region", F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1)).alias("ring"))


def _write_lines(rows: DataFrame, path: str) -> None:
    """Footprints as gzipped lines of GeoJSON, every fifth a multipolygon, with bad lines and lines without geometry among them."""
    ring = F.transform("ring", lambda q: F.array(q["lon"], q["lat"]))
    rings = F.to_json(F.struct(F.array(ring).alias("r")))
    one = F.regexp_extract(rings, r'^\{"r":(.*)\}$', 1)
    geometry = F.when(F.col("polygon_id") % 5 == 0, F.concat(F.lit('{"type": "MultiPolygon", "coordinates": ['), one, F.lit("]}"))).otherwise(F.concat(F.lit('{"type": "Polygon", "coordinates": '), one, F.lit("}")))
    line = F.concat(F.lit('{"type": "Feature", "properties": {"id": '), F.col("polygon_id").cast("string"), F.lit(', "region": "'), F.col("region"), F.lit('"}, "geometry": '), geometry, F.lit("}"))
    bad = F.when(F.col("polygon_id") % 11 == 0, F.array(F.lit("{not json"), F.lit(""))).when(F.col("polygon_id") % 11 == 1, F.array(F.lit('{"type": "Feature", "geometry": null}'))).otherwise(F.array())
    rows.select(F.explode(F.concat(F.array(line), bad)).alias("value")).write.option("compression", "gzip").text(path)


@query(f"""WITH {ADDRESSES}, f AS (SELECT id, lat, lon, {_HALF} AS h FROM addr WHERE lat <= 85)
SELECT id AS polygon_id, CASE WHEN id % 3 = 0 THEN 'Canada' ELSE 'United States' END AS region, 0 AS part, 4 AS corners, lat - h AS south, lon - h AS west, lat + h AS north, lon + h AS east FROM f""")
def footprint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21: gzipped GeoJSON lines, read back."""
    _write_lines(_footprints(spark, sf_dir), path := new_folder(spark, "lines"))
    corner = lambda f, axis: f(F.transform("ring", lambda q: q[axis]))
    read = footprints.read_features(spark, path)
    return read.select(F.col("properties")["id"].cast("long").alias("polygon_id"), F.col("properties")["region"].alias("region"), "part", F.size("ring").alias("corners"), corner(F.array_min, "lat").alias("south"), corner(F.array_min, "lon").alias("west"), corner(F.array_max, "lat").alias("north"), corner(F.array_max, "lon").alias("east"))


#: Places asked for: those of tabular addresses, moved a little, some of them outside of all footprints.
_ASKED = "SELECT id, lat + (id % 7 - 3) * 0.0002::DOUBLE AS lat, lon - CASE WHEN id % 13 = 0 THEN 3 ELSE 0 END AS lon FROM addr WHERE file_role = 'tabular'"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return addresses(spark, sf_dir).filter("file_role = 'tabular'").select(k, (F.col("lat") + (k % 7 - 3) * 0.0002).alias("lat"), (F.col("lon") - F.when(k % 13 == 0, 3).otherwise(0)).alias("lon"))


@query(f"""WITH {ADDRESSES}, f AS (SELECT id AS polygon_id, lat AS y, lon AS x, {_HALF} AS h FROM addr WHERE lat <= 85), p AS ({_ASKED})
SELECT id, min(polygon_id) AS polygon_id FROM p LEFT JOIN f ON p.lat BETWEEN y - h AND y + h AND p.lon BETWEEN x - h AND x + h GROUP BY id""")
def footprint_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21, D-14: lines to tiles on disk, and the first footprint that holds each point, from the tiles that have points."""
    _write_lines(_footprints(spark, sf_dir), lines := new_folder(spark, "lines"))
    read = footprints.read_features(spark, lines).select(F.col("properties")["id"].cast("long").alias("polygon_id"), F.col("properties")["region"].alias("region"), "ring")
    footprints.write_tiles(read, path := new_folder(spark, "tiles"))
    return footprints.footprints_at(_asked(spark, sf_dir), path).select("id", "polygon_id")


_AT = "least(greatest(floor({v} * {n}.0::DOUBLE)::INTEGER, 0), {n} - 1)"
_MERCATOR = "(0.5 - ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) / (4 * pi()))"
_KEY = "list_aggregate(list_transform(range({l} - 1, -1, -1), lambda i: ((({x} >> i) & 1) + 2 * (({y} >> i) & 1))::VARCHAR), 'string_agg', '')"


def _box_sql(n: int) -> str:
    x = lambda c: _AT.format(v=f"(({c} + 180) / 360)", n=n)
    y = lambda c: _AT.format(v=_MERCATOR.format(lat=c), n=n)
    return f"{x('west')} AS x0, {x('east')} AS x1, {y('north')} AS y0, {y('south')} AS y1"


_BOXES = "boxes AS (SELECT city, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM addr WHERE lat <= 85 GROUP BY city)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).filter("lat <= 85").groupBy("city").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


@query(f"""WITH {ADDRESSES}, {_BOXES}, t AS (SELECT *, {_box_sql(1 << 14)} FROM boxes), x AS (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM t), y AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM x)
SELECT city, {_KEY.format(l=14, x='x', y='y')} AS quadkey FROM y""")
def box_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprints.tiles_of_box(_boxes(spark, sf_dir), 14).select("city", "quadkey")


@query(f"""WITH RECURSIVE {ADDRESSES}, {_BOXES}, t AS (SELECT city, {_box_sql(1 << 16)} FROM boxes),
r AS (
  SELECT city, x0, x1, y0, y1, 0 AS x, 0 AS y, 0 AS l, false AS done FROM t
  UNION ALL
  SELECT * EXCLUDE (s), (x << s) >= x0 AND ((x + 1) << s) - 1 <= x1 AND (y << s) >= y0 AND ((y + 1) << s) - 1 <= y1 AS done
  FROM (SELECT city, x0, x1, y0, y1, x * 2 + dx AS x, y * 2 + dy AS y, l + 1 AS l, 16 - l - 1 AS s FROM r, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy) WHERE NOT done AND l < 16)
  WHERE (x << s) <= x1 AND ((x + 1) << s) > x0 AND (y << s) <= y1 AND ((y + 1) << s) > y0)
SELECT city, {_KEY.format(l='l', x='x', y='y')} AS quadkey FROM r WHERE done""")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover of the cities' boxes by tiles of mixed size."""
    return footprints.tile_cover(_boxes(spark, sf_dir), 16).select("city", "quadkey")


#: An index of tile files: several regions a tile, files listed twice, blank ones, keys that lost their leading zeros.
_INDEX = """idx AS (
  SELECT c_custkey AS ord, c_custkey % 60 AS k, (['Canada', 'United States', 'Greenland', 'Mexico'])[(c_custkey * 7) % 4 + 1] AS location,
    CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE 'tiles/' || (c_custkey % 97)::VARCHAR || '.csv.gz' END AS url FROM customer)"""


@query(f"""WITH {_INDEX}, i AS (SELECT ord, lpad(k::VARCHAR, 9, '0') AS quadkey, replace(location, ' ', '') AS region, trim(url) AS url FROM idx WHERE regexp_full_match(k::VARCHAR, '[0-3]+') AND trim(url) <> ''),
f AS (SELECT quadkey, url, min(ord) AS ord, arg_min(region, ord) AS region FROM i GROUP BY quadkey, url),
w AS (SELECT DISTINCT lpad(k::VARCHAR, 9, '0') AS quadkey, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'Canada' ELSE 'Mexico' END AS preferred FROM (SELECT c_custkey % 40 AS k FROM customer) WHERE regexp_full_match(k::VARCHAR, '[0-3]+'))
SELECT quadkey, row_number() OVER (PARTITION BY quadkey ORDER BY CASE WHEN preferred = '' OR region = preferred THEN 0 WHEN preferred = 'Canada' AND region = 'UnitedStates' THEN 1 ELSE 2 END, ord, url) AS choice, region, url
FROM w JOIN f USING (quadkey)""")
def tile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    location = F.element_at(F.array(*map(F.lit, ("Canada", "United States", "Greenland", "Mexico"))), (k * 7 % 4 + 1).cast("int"))
    index = rows.select(k.alias("ord"), (k % 60).alias("quadkey"), location.alias("location"), F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("tiles/"), (k % 97).cast("string"), F.lit(".csv.gz"))).alias("url")).filter(F.col("quadkey").cast("string").rlike("^[0-3]+$"))
    asked = rows.select((k % 40).alias("quadkey")).filter(F.col("quadkey").cast("string").rlike("^[0-3]+$"))
    asked = asked.withColumn("preferred", F.when(F.col("quadkey") % 3 == 0, None).when(F.col("quadkey") % 3 == 1, "Canada").otherwise("Mexico"))
    return footprints.tile_sources(asked, index)


@query(f"""WITH {ADDRESSES}, f AS (SELECT id AS polygon_id, lat AS y, lon AS x, {_HALF} AS h, CASE WHEN id % 3 = 0 THEN 'Canada' ELSE 'UnitedStates' END AS region FROM addr WHERE lat <= 85),
p AS (SELECT *, {_AT.format(v='((lon + 180) / 360)', n=1 << 14)} AS tx, {_AT.format(v=_MERCATOR.format(lat='lat'), n=1 << 14)} AS ty FROM ({_ASKED}) WHERE lat <= 85),
b AS (SELECT tx, ty, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM p GROUP BY tx, ty),
g AS (SELECT *, {_AT.format(v='((x - h + 180) / 360)', n=1 << 14)} AS x0, {_AT.format(v='((x + h + 180) / 360)', n=1 << 14)} AS x1, {_AT.format(v=_MERCATOR.format(lat='(y + h)'), n=1 << 14)} AS y0, {_AT.format(v=_MERCATOR.format(lat='(y - h)'), n=1 << 14)} AS y1 FROM f),
r AS (SELECT DISTINCT tx, ty, region FROM b JOIN g ON tx BETWEEN x0 AND x1 AND ty BETWEEN y0 AND y1 AND y - h <= n AND y + h >= s AND x - h <= e AND x + h >= w)
SELECT {_KEY.format(l=14, x='tx', y='ty')} AS quadkey, min(region) AS region FROM r GROUP BY tx, ty""")
def tile_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-22: Canada is the first choice everywhere, then the United States."""
    points = _asked(spark, sf_dir).filter("lat <= 85")
    keys = points.select(footprints.geo.quadkey(F.col("lat"), F.col("lon"), 14).alias("quadkey")).distinct()
    index = keys.select("quadkey", F.explode(F.array(F.lit("United States"), F.lit("Canada"))).alias("location"), F.lit(1).alias("ord")).withColumn("url", F.concat("quadkey", F.lit("/"), "location"))
    sources = footprints.tile_sources(keys.withColumn("preferred", F.lit("Canada")), index, 14)
    return footprints.chosen_regions(points, _footprints(spark, sf_dir), sources, 14)


# property records

_STREETS = "(['OAK', 'MAIN', 'HILL', 'LAKE', 'PARK'])"
_LINES = f"""props AS (
  SELECT p_partkey AS property_id, CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN (p_partkey % 23 + 1)::VARCHAR || ' ST, ' || (30000 + p_partkey % 25 * 7)::VARCHAR
      ELSE (p_partkey % 23 + 1)::VARCHAR || CASE WHEN p_partkey % 4 = 0 THEN ' NW ' ELSE ' ' END || {_STREETS}[p_partkey * 3 % 5 + 1] || ' Rd' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ', ' || (30000 + p_partkey % 25 * 7)::VARCHAR END END AS p_line,
    CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE 32.0::DOUBLE + (p_partkey % 1000) / 10000.0::DOUBLE END AS p_lat, -84.0::DOUBLE - ((p_partkey * 13) % 1000) / 10000.0::DOUBLE AS p_lon FROM part),
targets AS (
  SELECT id, CASE WHEN id % 9 = 0 THEN (id % 23 + 1)::VARCHAR || ' road, ' || zip_code || '-0001' ELSE raw_address || ', ' || city || ' ' || zip_code END AS line, lat, lon FROM addr)"""
_STOP = "['REDDICK', 'FL', 'FLORIDA', 'USA', 'US', 'MARION', 'GA', 'GEORGIA', 'ST', 'STREET', 'RD', 'ROAD', 'DR', 'DRIVE', 'AVE', 'AVENUE', 'TER', 'TERRACE', 'LN', 'LANE', 'CT', 'COURT', 'BLVD', 'BOULEVARD', 'HWY', 'HIGHWAY', 'NW', 'NE', 'SW', 'SE', 'N', 'S', 'E', 'W']"


def _line_sql(table_name: str, line: str) -> str:
    tokens = f"list_distinct(regexp_extract_all(upper({line}), '[A-Z0-9]+'))"
    return rf"SELECT *, nullif(regexp_extract({line}, '^\s*(\d+)', 1), '') AS num, nullif(regexp_extract({line}, '^\s*\d+\b.*\b(\d{{5}})(-\d{{4}})?\b', 1), '') AS zip, {tokens} AS tok, list_filter({tokens}, lambda t: NOT list_contains({_STOP}, t) AND NOT regexp_full_match(t, '[0-9]+')) AS street FROM {table_name}"


_MILES = f"coalesce(round({haversine_sql('t.lat', 't.lon', 'p.p_lat', 'p.p_lon')} / 1609.344, 6), 0.0)"
_SCORE = "100 + least(len(list_intersect(t.tok, p.tok)) * 5, 40) + CASE WHEN contains(upper(t.line), upper(p.p_line)) OR contains(upper(p.p_line), upper(t.line)) THEN 20 ELSE 0 END"
_WORDS = "list_has_any(t.street, p.street)"
_MEETS = f"t.num = p.num AND ({_WORDS} OR (t.zip = p.zip AND (len(t.street) = 0 OR len(p.street) = 0)))"


@query(f"""WITH {ADDRESSES}, {_LINES}, t AS ({_line_sql('targets', 'line')}), p AS ({_line_sql('props', 'p_line')}),
m AS (SELECT id, property_id, ({_SCORE})::INTEGER AS score, {_MILES} AS miles FROM t, p WHERE {_MEETS})
SELECT id, property_id, score, miles FROM m WHERE miles <= 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, miles, property_id) = 1""")
def property_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-12, I-52: against all pairs in SQL."""
    return linkage.pick_properties(_targets(spark, sf_dir), _properties(spark, sf_dir), max_miles=3.0)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    bare = F.concat((k % 23 + 1).cast("string"), F.lit(" road, "), "zip_code", F.lit("-0001"))
    line = F.when(k % 9 == 0, bare).otherwise(F.concat("raw_address", F.lit(", "), "city", F.lit(" "), "zip_code"))
    return addresses(spark, sf_dir).select("id", line.alias("line"), "lat", "lon")


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    number, zip_code = (k % 23 + 1).cast("string"), (30000 + k % 25 * 7).cast("string")
    street = F.element_at(F.array(*map(F.lit, STREETS)), (k * 3 % 5 + 1).cast("int"))
    named = F.concat(number, F.when(k % 4 == 0, " NW ").otherwise(" "), street, F.lit(" Rd"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(", "), zip_code)))
    line = F.when(k % 19 == 0, None).when(k % 7 == 0, F.concat(number, F.lit(" ST, "), zip_code)).otherwise(named)
    return table(spark, sf_dir, "part").select(k.alias("property_id"), line.alias("line"), F.when(k % 37 != 0, 32.0 + (k % 1000) / 10000.0).alias("lat"), (-84.0 - ((k * 13) % 1000) / 10000.0).alias("lon"))


@query(f"""WITH {ADDRESSES}, {_LINES}, own AS (SELECT id, CASE WHEN id % 4 = 1 THEN '99' || substr(line, 1, 1) || ' NOWHERE' ELSE line END AS line, lat, lon, line AS other FROM targets),
cand AS (SELECT id, 0 AS k, line, lat, lon FROM own WHERE line <> '' UNION ALL SELECT id, 1, other, lat, lon FROM own WHERE id % 2 = 1 AND other <> ''),
c AS ({_line_sql('cand', 'line')}), t AS ({_line_sql('own', 'line')}), p AS ({_line_sql('props', 'p_line')}),
l AS (SELECT id, k AS via, property_id, ({_SCORE})::INTEGER AS score, {_MILES} AS miles FROM c AS t, p WHERE {_MEETS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, score DESC, miles, property_id) = 1),
n AS (
  SELECT id, NULL::INTEGER AS via, property_id, CASE WHEN coalesce(t.line, '') = '' OR coalesce(p.p_line, '') = '' THEN 0 WHEN t.num <> p.num THEN -1 ELSE ({_SCORE}) - CASE WHEN t.num = p.num THEN 0 ELSE 100 END END::INTEGER AS score, {_MILES} AS miles
  FROM t, p WHERE NOT EXISTS (FROM l WHERE l.id = t.id) AND t.lat IS NOT NULL AND p.p_lat IS NOT NULL AND {haversine_sql('t.lat', 't.lon', 'p.p_lat', 'p.p_lon')} <= 2.0 * 1609.344
    AND (coalesce(t.line, '') = '' OR coalesce(p.p_line, '') = '' OR (coalesce(t.num = p.num, true) AND (len(t.street) = 0 OR len(p.street) = 0 OR {_WORDS})))),
m AS (SELECT * FROM n WHERE score >= 0 AND miles <= 1.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, miles, property_id) = 1)
SELECT id, property_id, score, miles, via FROM l UNION ALL SELECT id, property_id, score, miles, via FROM m""")
def property_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-13: some targets' own line leads nowhere; half of these have a second one, the others are left to their place."""
    k = F.col("id")
    rows = _targets(spark, sf_dir).withColumn("other", F.col("line"))
    rows = rows.withColumn("line", F.when(k % 4 == 1, F.concat(F.lit("99"), F.substring("line", 1, 1), F.lit(" NOWHERE"))).otherwise(F.col("line")))
    lines_of = F.posexplode(F.when(k % 2 == 1, F.array("line", "other")).otherwise(F.array("line"))).alias("k", "line")
    candidates = rows.select("id", lines_of).filter("line is not null")
    return linkage.lookup_properties(rows.select("id", "line", "lat", "lon"), candidates, _properties(spark, sf_dir), 2.0, 1.5)


# address lines

#: Lines in several forms: with country, without zip, state names, zip in a part of its own, blanks and doubled commas.
_LINE_OF = r"""CASE id % 8 WHEN 0 THEN raw_address || ', ' || city || ', ' || state || ' ' || zip_code || ', USA' WHEN 1 THEN '  ' || raw_address || ' , ' || city || ', GEORGIA  ' || zip_code || '-1234'
  WHEN 2 THEN raw_address || ',, ' || city || ' ,New York' WHEN 3 THEN raw_address || ', ' || city || ', north carolina, ga ' || zip_code WHEN 4 THEN raw_address WHEN 5 THEN raw_address || ', united states'
  WHEN 6 THEN raw_address || ', ' || city || ', tx, x, TX ' || zip_code ELSE ' , ' END"""
_STATE_LIST = ", ".join(f"'{k}': '{v}'" for k, v in lines.STATES.items())


def _code_sql(s: str) -> str:
    return f"coalesce(map {{{_STATE_LIST}}}[upper({s})], upper({s}))"


@query(rf"""WITH {ADDRESSES}, l AS (SELECT id, coalesce({_LINE_OF}, '') AS line, CASE WHEN id % 3 = 0 THEN ' ' || city || ' , texas ' WHEN id % 3 = 1 THEN city ELSE city || ',Ga, x' END AS cs FROM addr),
p AS (SELECT *, list_filter(list_transform(string_split(line, ','), lambda x: trim(x)), lambda x: x <> '') AS q FROM l),
t AS (SELECT *, CASE WHEN len(q) > 1 AND upper(q[-1]) IN ('USA', 'US', 'UNITED STATES') THEN q[:-2] ELSE q END AS r FROM p),
z AS (SELECT *, '^([A-Za-z]{{2,}})\s+(\d{{5}}(?:-\d{{4}})?)$' AS pat FROM t),
o AS (SELECT *, CASE WHEN len(r) >= 3 THEN regexp_extract(r[3], pat, 2) ELSE '' END AS z3, CASE WHEN len(r) >= 4 THEN regexp_extract(r[4], pat, 2) ELSE '' END AS z4 FROM z)
SELECT id, coalesce(r[1], '') AS street, coalesce(r[2], '') AS city,
  CASE WHEN z3 <> '' THEN {_code_sql("regexp_extract(r[3], pat, 1)")} WHEN z4 <> '' THEN {_code_sql("regexp_extract(r[4], pat, 1)")} WHEN len(r) >= 3 THEN {_code_sql('r[3]')} ELSE '' END AS state,
  substr(CASE WHEN z3 <> '' THEN z3 ELSE z4 END, 1, 5) AS zip_code,
  trim(string_split(trim(cs), ',')[1]) AS own_city, CASE WHEN contains(cs, ',') THEN trim(substr(trim(cs), instr(trim(cs), ',') + 1)) ELSE '' END AS own_state, {_code_sql("CASE WHEN contains(cs, ',') THEN trim(substr(trim(cs), instr(trim(cs), ',') + 1)) ELSE '' END")} AS own_code
FROM o""")
def address_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-40, I-41, T-91, T-131."""
    k, c = F.col("id") % 8, F.concat
    forms = [
        c("raw_address", F.lit(", "), "city", F.lit(", "), "state", F.lit(" "), "zip_code", F.lit(", USA")),
        c(F.lit("  "), "raw_address", F.lit(" , "), "city", F.lit(", GEORGIA  "), "zip_code", F.lit("-1234")),
        c("raw_address", F.lit(",, "), "city", F.lit(" ,New York")),
        c("raw_address", F.lit(", "), "city", F.lit(", north carolina, ga "), "zip_code"),
        F.col("raw_address"),
        c("raw_address", F.lit(", united states")),
        c("raw_address", F.lit(", "), "city", F.lit(", tx, x, TX "), "zip_code"),
    ]
    line = F.lit(" , ")
    for i, form in enumerate(forms):
        line = F.when(k == i, form).otherwise(line)
    own = F.when(F.col("id") % 3 == 0, c(F.lit(" "), "city", F.lit(" , texas "))).when(F.col("id") % 3 == 1, F.col("city")).otherwise(c("city", F.lit(",Ga, x")))
    parts = lines.address_parts(line)
    plain, coded = lines.city_and_state(own), lines.city_and_state_code(own)
    return addresses(spark, sf_dir).select("id", *(parts[x].alias(x) for x in ("street", "city", "state", "zip_code")), plain["city"].alias("own_city"), plain["state"].alias("own_state"), coded["state"].alias("own_code"))
