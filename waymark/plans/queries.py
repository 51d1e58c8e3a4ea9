"""Queries over the reference operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..functions import geo, text
from ..operators import mapping, metrics, providers, records, rules, spatial, stages
from .views import ADDRESSES, LATEST, SCORES, addresses, haversine_sql, key_sql, scores, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return records.upsert(rows.limit(0), rows, ["address_id", "stage"], F.col("version"))


# strings and addresses


@query("""SELECT c_custkey, CASE WHEN lower(trim(v)) IN ('', 'none', 'null', 'nan', 'nat', 'n/a', 'na', '<na>') THEN NULL ELSE trim(v) END AS value
FROM (SELECT c_custkey, (['', ' N/A ', 'None', '  ' || c_name || ' ', 'null', c_mktsegment, '<NA>'])[c_custkey % 7 + 1] AS v FROM customer)""")
def clean_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit(""), F.lit(" N/A "), F.lit("None"), F.concat(F.lit("  "), "c_name", F.lit(" ")), F.lit("null"), F.col("c_mktsegment"), F.lit("<NA>")), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.clean_value(raw).alias("value"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('ns' || (p_partkey % 3)::VARCHAR || ':' || p_type || '_' || p_brand), '^ns\d+:', ''), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')) AS header FROM part""")
def normalize_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("ns"), (F.col("p_partkey") % 3).cast("string"), F.lit(":"), "p_type", F.lit("_"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_header(raw).alias("header"))


@query(f"WITH {ADDRESSES} SELECT id, {key_sql('raw_address')} AS key, CASE WHEN contains({key_sql('raw_address')}, substr(zip_code, 1, 5)) THEN {key_sql('raw_address')} ELSE {key_sql('raw_address')} || '|' || substr(zip_code, 1, 5) END AS stored_key FROM addr")
def normalize_address_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).select("id", text.address_key(F.col("raw_address")).alias("key"), text.stored_key(F.col("raw_address"), F.col("zip_code")).alias("stored_key"))


@query(r"""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'x,' || c_custkey::VARCHAR ELSE (-(c_custkey % 180))::VARCHAR || ',' || (c_custkey % 90)::VARCHAR || '.5,0 1,2,3' END AS t FROM customer),
s AS (SELECT c_custkey, string_split(regexp_extract(trim(t), '^(\S+)', 1), ',') AS p FROM p)
SELECT c_custkey, CASE WHEN regexp_full_match(p[1], '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN p[2]::DOUBLE END AS lat, CASE WHEN regexp_full_match(p[1], '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN try_cast(p[1] AS DOUBLE) END AS lon FROM s""")
def parse_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("x,"), k.cast("string"))).otherwise(F.concat((-(k % 180)).cast("string"), F.lit(","), (k % 90).cast("string"), F.lit(".5,0 1,2,3")))
    lat, lon = geo.parse_coordinate(raw)
    return table(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))


def _search_sql(c: str) -> str:
    out = f"lower({c})"
    for word, short in text.SEARCH_WORDS:
        out = rf"regexp_replace({out}, '\b{word}\b', '{short}', 'g')"
    return rf"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH {ADDRESSES} SELECT id, {_search_sql(chr(39).join(['raw_address || ', ', ', ' || city || ', ', USA', '']))} AS search_key FROM addr")
def search_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("raw_address", F.lit(", "), "city", F.lit(", USA"))
    return addresses(spark, sf_dir).select("id", text.search_key(line).alias("search_key"))


#: Behind a number: fractions, letters, ranges, directions and none at all.
LINE_ENDS = [" 1/2 OAK ST", "½ Oak St", "-3/4 Hill Rd", "B MAIN ST", " b Main St", " N Main St", "-5 Oak", " HILL", ", Park", " 3rd St"]
_LINE = f"CASE WHEN c_custkey % 11 = 10 THEN 'LOT ' || (c_custkey % 90)::VARCHAR ELSE (c_custkey % 90 + 1)::VARCHAR || ({LINE_ENDS!r})[c_custkey % 11 + 1] END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ends = F.element_at(F.array(*map(F.lit, LINE_ENDS)), (F.least(k % 11, F.lit(9)) + 1).cast("int"))
    line = F.when(k % 11 == 10, F.concat(F.lit("LOT "), (k % 90).cast("string"))).otherwise(F.concat((k % 90 + 1).cast("string"), ends))
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("t"))


def _number_sql(t: str) -> str:
    """SQL of the house number."""
    n = text
    fraction = f"upper(regexp_extract({t}, '{n.NUMBER_FRACTION}', 1))"
    for sign, digits in n.FRACTIONS:
        fraction = f"replace({fraction}, '{sign}', ' {digits}')"
    fraction = rf"trim(regexp_replace({fraction}, '\s+', ' ', 'g'))"
    unit = f"regexp_extract({t}, '{n.NUMBER_UNIT}', 1) || regexp_extract({t}, '{n.NUMBER_UNIT}', 2)"
    others = [f"regexp_extract({t}, '{p}', 1)" for p in (n.NUMBER_LETTER, n.NUMBER_PLAIN, n.NUMBER_ANYWHERE)]
    return f"coalesce({', '.join(f'nullif(upper({x}), {chr(39) * 2})' for x in (fraction, others[0], unit, *others[1:]))})"


def _bare_sql(t: str) -> str:
    """SQL of the house number in one spelling."""
    out = f"upper({t})"
    for sign, digits in text.FRACTIONS:
        out = f"replace({out}, '{sign}', '{digits}')"
    return rf"coalesce(replace(replace(regexp_replace({out}, '\s+', '', 'g'), '-1/', '1/'), '-3/', '3/'), '')"


_REST = "t"
for _form in (text.NUMBER_PLAIN, text.NUMBER_UNIT, text.NUMBER_LETTER, text.NUMBER_FRACTION):
    _REST = f"CASE WHEN regexp_matches(t, '{_form}') THEN regexp_replace(regexp_replace(t, '{_form}', ''), '^[ ,]+', '') ELSE {_REST} END"


@query(f"WITH l AS (SELECT c_custkey, {_LINE} AS t FROM customer) SELECT c_custkey, {_number_sql('t')} AS house_number, {_bare_sql(_number_sql('t'))} AS bare, {_REST} AS rest FROM l")
def house_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _lines(spark, sf_dir).select("c_custkey", text.house_number(t).alias("house_number"), text.normalize_house_number(text.house_number(t)).alias("bare"), text.strip_house_number(t).alias("rest"))


@query(f"""WITH l AS (SELECT c_custkey, {_LINE} AS t, CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 90 + 2)::VARCHAR || ' ' ELSE '' END || {_LINE} || ', Springfield, OR' END AS f FROM customer),
n AS (SELECT *, {_bare_sql(_number_sql('t'))} AS x, {_bare_sql(_number_sql('f'))} AS y FROM l),
p AS (SELECT c_custkey, x, y, f, CASE WHEN trim(f) = '' THEN 0 WHEN x <> '' AND y <> '' AND x <> y THEN 40 ELSE 100 END AS percent FROM n)
SELECT c_custkey, percent, percent >= 100 AS exact, CASE WHEN c_custkey % 5 = 0 AND x <> '' AND x <> '7' THEN least(percent, 40) WHEN c_custkey % 5 <> 0 AND x <> '' AND y <> '' AND x <> y THEN least(percent, 40) ELSE percent END AS with_number FROM p""")
def match_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("c_custkey"), F.col("t")
    other = F.when(k % 3 == 0, F.concat((k % 90 + 2).cast("string"), F.lit(" "))).otherwise("")
    f = F.when(k % 13 == 0, " ").otherwise(F.concat(other, t, F.lit(", Springfield, OR")))
    rows = _lines(spark, sf_dir).withColumn("f", f).withColumn("geo", F.when(k % 5 == 0, "7"))
    rows = rows.withColumns({"x": text.house_number(t), "y": text.house_number(F.col("f"))})
    rows = rows.withColumn("percent", text.match_percent(t, F.col("f"), F.col("x"), F.col("y")))
    with_number = text.match_percent_for_geo(F.col("percent"), t, F.col("x"), F.coalesce("geo", "y"))
    return rows.select("c_custkey", "percent", text.matches_exactly(F.col("percent")).alias("exact"), with_number.alias("with_number"))


@query(f"WITH {ADDRESSES} SELECT id, CASE WHEN id % 3 = 0 AND raw_address IS NOT NULL THEN raw_address WHEN id % 3 = 1 THEN '' ELSE coalesce(raw_address, '') END AS line FROM addr")
def category_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, raw, own = F.col("id"), F.col("raw_address"), F.col("category")
    line = F.when(k % 3 == 0, F.concat(F.lower(own), F.lit(": "), raw)).when(k % 3 == 1, F.lower(own)).otherwise(raw)
    return addresses(spark, sf_dir).select("id", text.without_category(line, own, raw).alias("line"))


@query(rf"""WITH {ADDRESSES} SELECT id, CASE WHEN regexp_matches(lower(coalesce(raw_address, '')), '\bapt\b|apartment|unit #|ste |suite| #') THEN 'Multi-Family' WHEN regexp_matches(lower(coalesce(raw_address, '')), 'hwy|highway|industrial|warehouse|park') THEN 'Commercial'
  WHEN regexp_matches(lower(coalesce(raw_address, '')), '\b(st|street|ave|avenue|rd|road|dr|drive|ln|lane|ct|court|blvd|boulevard)\b') THEN 'Single-Family' ELSE 'Unknown' END AS land_use FROM addr""")
def land_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).select("id", text.land_use(F.lit(None).cast("string"), F.col("raw_address")).alias("land_use"))


@query()
def token_set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = addresses(spark, sf_dir)
    return a.select("id", text.token_set_ratio(F.col("raw_address"), F.concat_ws(" ", F.lit("OAK STREET"), "city")).alias("ratio"))


# numbers and coordinates


@query(f"WITH {ADDRESSES} SELECT id, round({haversine_sql('lat', 'lon', '32.05', '-84.05')}, 4) AS metres, round(((degrees(atan2(sin(radians(-84.05 - lon)) * cos(radians(32.05)), cos(radians(lat)) * sin(radians(32.05)) - sin(radians(lat)) * cos(radians(32.05)) * cos(radians(-84.05 - lon)))) % 360) + 360) % 360, 4) AS bearing FROM addr WHERE lat <= 90")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, y, x = addresses(spark, sf_dir).filter("lat <= 90"), F.lit(32.05), F.lit(-84.05)
    return a.select("id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), y, x), 4).alias("metres"), F.round(geo.bearing(F.col("lat"), F.col("lon"), y, x), 4).alias("bearing"))


@query(f"""WITH {ADDRESSES} SELECT id, round(lat + (10 * cos(radians(id % 360)) - 5 * sin(radians(id % 360))) / 111320.0, 7) AS lat2, round(lon + (10 * sin(radians(id % 360)) + 5 * cos(radians(id % 360))) / (111320.0 * greatest(cos(radians(lat)), 1e-6)), 7) AS lon2,
  round(32.0 + least(greatest((id % 100 - 10) / 60.0, 0.0), 1.0) * 0.1, 7) AS mid_lat FROM addr WHERE lat <= 90""")
def nudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = addresses(spark, sf_dir).filter("lat <= 90")
    y, x = geo.nudge(F.col("lat"), F.col("lon"), (F.col("id") % 360).cast("double"), F.lit(10.0), F.lit(5.0))
    mid, _ = geo.interpolate((F.col("id") % 100).cast("double"), F.lit(10.0), F.lit(70.0), F.lit(32.0), F.lit(-84.1), F.lit(32.1), F.lit(-84.0))
    return a.select("id", F.round(y, 7).alias("lat2"), F.round(x, 7).alias("lon2"), mid.alias("mid_lat"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 101) / 100.0::DOUBLE ELSE (o_orderkey % 140)::DOUBLE END AS v FROM orders)
SELECT o_orderkey, least(greatest(round_even(CASE WHEN v > 0 AND v <= 1 THEN v * 100 ELSE v END, 0)::INTEGER, 0), 100) AS percent, round_even(least(greatest(CASE WHEN v <= 1 THEN v * 100 ELSE v END, 0.0), 100.0), 0)::INTEGER AS as_percent,
  CASE WHEN v >= 90 THEN 'AUTO_ACCEPT' WHEN v >= 60 THEN 'MANUAL_REVIEW' ELSE 'REJECT' END AS status FROM v""")
def percent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(k % 3 == 0, (k % 101) / 100.0).otherwise((k % 140).cast("double"))
    return table(spark, sf_dir, "orders").select(k, conf.percent_score(v).alias("percent"), conf.as_percent(v).alias("as_percent"), conf.status_from_score(v).alias("status"))


@query("""SELECT o_orderkey, CASE (['ROOFTOP','RANGE_INTERPOLATED','GEOMETRIC_CENTER','APPROXIMATE','X'])[o_orderkey % 5 + 1] WHEN 'ROOFTOP' THEN 95.0 WHEN 'RANGE_INTERPOLATED' THEN 75.0 WHEN 'GEOMETRIC_CENTER' THEN 60.0 WHEN 'APPROXIMATE' THEN 40.0
    ELSE CASE (['osm','interpolated','google'])[o_custkey % 3 + 1] WHEN 'osm' THEN 82.0 WHEN 'interpolated' THEN 76.0 ELSE 50.0 END END::DOUBLE AS base,
  CASE WHEN o_orderkey % 31 <= 10 THEN 'ROOFTOP' WHEN o_orderkey % 31 <= 16 THEN 'RANGE_INTERPOLATED' WHEN o_orderkey % 31 <= 22 THEN 'GEOMETRIC_CENTER' ELSE 'APPROXIMATE' END AS forward_type,
  CASE WHEN o_orderkey % 31 >= 28 THEN 'ROOFTOP' WHEN o_orderkey % 31 >= 24 THEN 'RANGE_INTERPOLATED' WHEN o_orderkey % 31 >= 16 THEN 'GEOMETRIC_CENTER' ELSE 'APPROXIMATE' END AS reverse_type FROM orders""")
def location_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    kind, source, rank = pick(["ROOFTOP", "RANGE_INTERPOLATED", "GEOMETRIC_CENTER", "APPROXIMATE", "X"], F.col("o_orderkey")), pick(["osm", "interpolated", "google"], F.col("o_custkey")), F.col("o_orderkey") % 31
    return table(spark, sf_dir, "orders").select("o_orderkey", conf.location_confidence(kind, source).alias("base"), conf.osm_location(rank).alias("forward_type"), conf.reverse_location(rank).alias("reverse_type"))


@query("""WITH v AS (SELECT o_orderkey AS k, o_orderkey % 800 AS d, o_orderkey % 5 AS s FROM orders),
w AS (SELECT k, 50 + CASE WHEN k % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 10 ELSE 0 END
  + CASE k % 4 WHEN 0 THEN 25 WHEN 1 THEN 10 WHEN 3 THEN -15 ELSE 0 END + CASE WHEN d < 50 THEN 10 WHEN d < 100 THEN 5 WHEN d < 500 THEN -10 ELSE -25 END
  + CASE s WHEN 0 THEN 5 WHEN 1 THEN -10 WHEN 2 THEN -25 WHEN 3 THEN -30 ELSE -20 END AS s FROM v)
SELECT k AS o_orderkey, CASE WHEN k % 11 = 0 THEN 0 WHEN k % 6 = 0 THEN least(least(greatest(s, 0), 99), 35) ELSE least(greatest(s, 0), 99) END::INTEGER AS confidence FROM w""")
def reverse_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    has = lambda n: F.when(k % n == 0, "x")
    kind = F.when(k % 4 == 0, "ROOFTOP").when(k % 4 == 1, "RANGE_INTERPOLATED").when(k % 4 == 3, "APPROXIMATE").otherwise("GEOMETRIC_CENTER")
    status = F.element_at(F.array(*map(F.lit, ["MATCH", "MISMATCH_WARN", "MISMATCH", "ADDRESS_MISMATCH", "UNVERIFIED"])), (k % 5 + 1).cast("int"))
    c = conf.reverse_confidence(k % 11 != 0, has(2), has(3), has(7), kind, k % 800, status, F.when(k % 6 == 0, 80).otherwise(100))
    return table(spark, sf_dir, "orders").select("o_orderkey", c.alias("confidence"))


@query("""WITH v AS (SELECT p_partkey, (p_partkey * 37 % 2600)::DOUBLE AS a FROM part), k AS (SELECT *, CASE WHEN a <= 500 THEN 'SFU' WHEN a <= 1200 THEN 'MDU_SMALL' WHEN a <= 2500 THEN 'MDU_LARGE' END AS kind FROM v)
SELECT p_partkey, kind, CASE WHEN a <= 0 THEN 72 WHEN a <= 500 THEN 80 WHEN a <= 1200 THEN 76 WHEN a <= 2500 THEN 72 END AS confidence,
  CASE kind WHEN 'SFU' THEN 1 WHEN 'MDU_SMALL' THEN CASE WHEN a < 450 THEN 2 WHEN a < 550 THEN 3 ELSE 4 END WHEN 'MDU_LARGE' THEN greatest(5, trunc(a / 120)::INTEGER) END AS units FROM k""")
def footprint_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (F.col("p_partkey") * 37 % 2600).cast("double")
    kind, score = conf.footprint_band(area)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), score.alias("confidence"), conf.unit_count(kind, area).alias("units"))


# records


_CHECKED = f"""checked AS (
  SELECT *, {key_sql('raw_address')} AS dedupe_key, raw_address IS NULL OR lat > 90 AS bad FROM addr),
classed AS (
  SELECT *, CASE WHEN bad THEN 'invalid' WHEN row_number() OVER (PARTITION BY dedupe_key, bad ORDER BY ord) > 1 THEN 'duplicate' ELSE 'valid' END AS row_class,
    first_value(id) OVER (PARTITION BY dedupe_key, bad ORDER BY ord) AS first_id FROM checked)"""


@query(f"WITH {ADDRESSES} SELECT id, concat_ws(',', CASE WHEN raw_address IS NULL THEN 'missing_raw_address' END, CASE WHEN lat > 90 THEN 'invalid_latitude' END) AS errors, '' AS warnings FROM addr")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.validate(addresses(spark, sf_dir)).select("id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {ADDRESSES}, {_CHECKED} SELECT id, row_class, CASE WHEN row_class = 'duplicate' THEN first_id END AS canonical_id FROM classed")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.deduplicate(addresses(spark, sf_dir)).select("id", "row_class", "canonical_id")


@query(f"WITH {ADDRESSES}, {_CHECKED} SELECT d.id, f.id AS canonical_id, d.dedupe_key, round({haversine_sql('f.lat', 'f.lon', 'd.lat', 'd.lon')}, 3) AS distance_m FROM classed d JOIN classed f ON f.id = d.first_id WHERE d.row_class = 'duplicate'")
def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.duplicate_links(addresses(spark, sf_dir))


@query(f"WITH {ADDRESSES}, {_CHECKED} SELECT id, row_class, ord, CASE row_class WHEN 'valid' THEN 0 WHEN 'invalid' THEN 1 ELSE 2 END::INTEGER AS class_rank FROM classed")
def stored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stored_order(addresses(spark, sf_dir))


_MERGE = f"""k AS (SELECT id, ord, file_role, {key_sql('raw_address')} AS merge_key FROM addr),
n AS (SELECT *, row_number() OVER (PARTITION BY merge_key, file_role ORDER BY ord) AS k FROM k),
m AS (
  SELECT a.id AS csv_id, b.id AS kmz_id, coalesce(a.merge_key, b.merge_key) AS merge_key
  FROM (SELECT * FROM n WHERE file_role = 'tabular') a FULL JOIN (SELECT * FROM n WHERE file_role = 'geospatial') b ON a.merge_key = b.merge_key AND a.k = b.k)"""
_MERGED = "CASE WHEN csv_id IS NULL OR kmz_id IS NOT NULL THEN 'verified' ELSE 'unmatched' END"


@query(f"WITH {ADDRESSES}, {_MERGE} SELECT csv_id, kmz_id, merge_key, {_MERGED} AS merge_status, csv_id IS NOT NULL AND kmz_id IS NOT NULL AS absorbed FROM m")
def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.greedy_merge(addresses(spark, sf_dir))


@query(f"WITH {ADDRESSES}, {_MERGE} SELECT {_MERGED} AS merge_status, count(*) AS n, count(csv_id) AS n_csv, count(kmz_id) AS n_kmz FROM m GROUP BY 1")
def merge_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.greedy_merge(addresses(spark, sf_dir)).groupBy("merge_status").agg(F.count(F.lit(1)).alias("n"), F.count("csv_id").alias("n_csv"), F.count("kmz_id").alias("n_kmz"))


@query(f"WITH {SCORES}, {LATEST} SELECT * FROM latest")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    early = F.col("version") % 2 == 0
    return records.upsert(rows.filter(early), rows.filter(~early), ["address_id", "stage"], F.col("version")).select(*rows.columns)


@query("""WITH f AS (SELECT p_partkey AS ord, 'data/' || p_brand || '.csv' AS source_file FROM part), n AS (SELECT *, 'src_' || regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(source_file, '^.*/', ''), '\\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS base FROM f)
SELECT ord, source_file, base, CASE WHEN r > 1 THEN base || '_' || r::VARCHAR ELSE base END AS table_name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS r FROM n)""".replace("\\\\", "\\"))
def unique_table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("data/"), "p_brand", F.lit(".csv")).alias("source_file"))
    return records.unique_table_names(files)


@query("""WITH r AS (SELECT l_orderkey AS placemark, l_linenumber AS row_number, l_returnflag || l_linestatus AS field, l_shipdate::DATE::VARCHAR AS value, CASE WHEN l_linenumber > 1 THEN l_suppkey::VARCHAR END AS coordinates FROM lineitem),
f AS (SELECT placemark, field, max_by(value, struct_pack(a := row_number, b := value)) AS value FROM r GROUP BY ALL), g AS (SELECT placemark, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM f GROUP BY ALL)
SELECT placemark, min(row_number) AS row_number, min_by(coordinates, struct_pack(a := row_number, b := coordinates)) FILTER (coordinates IS NOT NULL) AS coordinates, any_value(fields) AS fields FROM r JOIN g USING (placemark) GROUP BY placemark""")
def flatten_kml_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("placemark"), c("l_linenumber").alias("row_number"), F.concat("l_returnflag", "l_linestatus").alias("field"), c("l_shipdate").cast("date").cast("string").alias("value"), F.when(c("l_linenumber") > 1, c("l_suppkey").cast("string")).alias("coordinates"))
    out = records.flattened_placemarks(rows)
    return out.select("placemark", "row_number", "coordinates", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


# stages and rules

_PICK = ", ".join(f"max({c}) FILTER (stage = '{s}') AS {s}_{c}" for s in (f"agent{i}" for i in range(6)) for c in ("score", "status", "structure"))
_WIDE = f"found AS (SELECT address_id, {_PICK} FROM latest GROUP BY address_id), wide AS (SELECT c_custkey AS address_id, found.* EXCLUDE (address_id) FROM customer LEFT JOIN found ON address_id = c_custkey)"
STAGE_NAMES = [f"agent{i}" for i in range(6)]


@query(f"WITH {SCORES}, {LATEST}, {_WIDE} SELECT * FROM wide")
def stage_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.wide_stages(latest(spark, sf_dir), STAGE_NAMES, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address_id")))


_VOTE = """votes AS (SELECT address_id, list_filter([agent4_structure, agent5_structure, agent3_structure], lambda v: v IS NOT NULL AND v <> 'Unknown') AS v FROM wide),
kinds AS (SELECT address_id, v, CASE WHEN len(v) = 0 THEN 'Unknown' WHEN len(v) = 3 AND v[2] = v[3] THEN v[2] ELSE v[1] END AS kind FROM votes)"""


@query(f"WITH {SCORES}, {LATEST}, {_WIDE}, {_VOTE} SELECT address_id, kind FROM kinds")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = stage_left_joins(spark, sf_dir)
    return wide.select("address_id", rules.majority(F.array("agent4_structure", "agent5_structure", "agent3_structure")).alias("kind"))


_KIND = lambda c: f"CASE replace(replace(lower(coalesce({c}, '')), '-', '_'), ' ', '_') WHEN 'sfh' THEN 'SFH' WHEN 'apartment_building' THEN 'MDU' WHEN 'mixed_use' THEN 'Commercial' WHEN 'vacant_lot' THEN 'Vacant' ELSE 'Unknown' END"


@query(f"""WITH {SCORES}, {LATEST}, {_WIDE},
a AS (SELECT w.*, w.address_id % 17 = 0 AS vacant, w.address_id % 7 = 0 AS sure, CASE w.address_id % 6 WHEN 0 THEN 'Vacant land' WHEN 1 THEN 'Multi-Family' WHEN 2 THEN 'single family' WHEN 3 THEN 'COMMERCIAL' END AS land,
  {_KIND('agent4_structure')} AS k4, {_KIND('agent5_structure')} AS k5, (w.address_id % 4)::INTEGER AS lo, (w.address_id % 12)::INTEGER AS hi FROM wide w),
v AS (SELECT *, list_filter([k4, k5, CASE WHEN lower(land) LIKE '%vacant%' THEN CASE WHEN k4 NOT IN ('SFH', 'MDU', 'Commercial') AND k5 NOT IN ('SFH', 'MDU', 'Commercial') THEN 'Vacant' END WHEN lower(land) LIKE '%multi%' THEN 'MDU' WHEN lower(land) LIKE '%single%' THEN 'SFH' WHEN lower(land) LIKE '%commercial%' THEN 'Commercial' END], lambda x: x IS NOT NULL AND x <> 'Unknown') AS p FROM a),
k AS (SELECT *, CASE WHEN len(p) = 0 THEN 'Unknown' WHEN len(p) = 3 AND p[2] = p[3] THEN p[2] ELSE p[1] END AS kind FROM v),
u AS (SELECT *, CASE WHEN kind = 'Vacant' THEN 0 ELSE greatest(coalesce(nullif(lo, 0), 1), coalesce(nullif(hi, 0), 1)) END AS units FROM k),
f AS (SELECT *, CASE WHEN kind <> 'MDU' THEN kind WHEN units >= 8 THEN 'MDU_LARGE' ELSE 'MDU_SMALL' END AS final,
  least(100, trunc(coalesce(agent1_score, 0) * 0.4::DOUBLE + greatest(coalesce(agent4_score, 0), coalesce(agent5_score, 0), CASE WHEN sure THEN 90 ELSE 0 END) * 0.4::DOUBLE + CASE WHEN len(p) = 0 THEN 0 WHEN len(list_distinct(p)) = 1 THEN 100 ELSE 50 END * 0.2::DOUBLE)::INTEGER) AS score FROM u)
SELECT address_id, CASE WHEN agent1_status = 'REJECT' THEN 'rejected' ELSE 'classified' END AS status,
  CASE WHEN agent1_status = 'REJECT' THEN 'Unknown' WHEN vacant THEN 'Vacant' ELSE final END AS final_structure_type,
  CASE WHEN agent1_status = 'REJECT' THEN NULL WHEN vacant THEN FALSE ELSE kind = 'MDU' END AS final_is_mdu,
  CASE WHEN agent1_status = 'REJECT' THEN NULL WHEN vacant THEN 0 WHEN kind IN ('MDU', 'Vacant') THEN units ELSE 1 END::INTEGER AS final_unit_count,
  CASE WHEN agent1_status = 'REJECT' THEN 0 WHEN vacant THEN greatest(80, coalesce(agent1_score, 0)) WHEN sure AND final <> 'Unknown' THEN greatest(90, score) ELSE score END::INTEGER AS final_confidence,
  CASE WHEN agent1_status = 'REJECT' OR vacant OR final = 'Vacant' THEN 'SKIP' WHEN final = 'MDU_LARGE' THEN 'HIGH' WHEN final = 'MDU_SMALL' OR final = 'SFH' AND agent1_status = 'AUTO_ACCEPT' THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM f""")
def final_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("address_id")
    land = F.when(k % 6 == 0, "Vacant land").when(k % 6 == 1, "Multi-Family").when(k % 6 == 2, "single family").when(k % 6 == 3, "COMMERCIAL")
    more = {"vacant": k % 17 == 0, "house_number_sure": k % 7 == 0, "agent3_land_use": land, "units_min": (k % 4).cast("int"), "units_max": (k % 12).cast("int")}
    return rules.synthesize(stage_left_joins(spark, sf_dir).withColumns(more))


@query(f"WITH {SCORES}, {LATEST} SELECT address_id, stage, score, status, CASE WHEN score >= 60 AND status IN ('MATCH', 'AUTO_ACCEPT') THEN 'accepted' ELSE 'continued' END AS decision FROM latest WHERE stage = 'agent1'")
def resolution_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resolution_gate(latest(spark, sf_dir), "agent1", 60, True)


@query(f"WITH {SCORES}, {LATEST} SELECT address_id, min(score) AS least FROM latest WHERE stage IN ('agent1', 'agent2', 'agent3') GROUP BY address_id HAVING min(score) < 90")
def low_confidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.low_confidence(latest(spark, sf_dir))


def _rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = records.deduplicate(addresses(spark, sf_dir))
    tabular = rows.filter("file_role = 'tabular' and dedupe_key is not null").select(F.col("dedupe_key").alias("tab_key")).distinct()
    own = rows.join(tabular, F.col("dedupe_key") == F.col("tab_key"), "left")
    flag = lambda n, r: k % n == r
    return own.select(
        "id", flag(41, 0).alias("sticky_duplicate"), (F.col("row_class") == "duplicate").alias("seen_before"), F.col("raw_address").isNull().alias("missing_address"), flag(37, 1).alias("interpolated_conflict"), (F.col("lat") > 90).alias("coord_mismatch"),
        (F.col("file_role") == "geospatial").alias("is_geospatial"), F.col("tab_key").isNotNull().alias("key_in_tabular"), flag(2, 0).alias("is_discovered"), flag(5, 0).alias("exact_found"), flag(7, 0).alias("exact_warning"), flag(11, 0).alias("not_found"), flag(13, 0).alias("failed_validation"), flag(3, 1).alias("has_final"),
        F.when(flag(2, 0), "verified").alias("flow_status"),
    )


_RULES = f"""{_CHECKED}, tab AS (SELECT DISTINCT dedupe_key FROM checked WHERE file_role = 'tabular' AND dedupe_key IS NOT NULL),
ruled AS (SELECT id, CASE WHEN id % 41 = 0 OR row_class = 'duplicate' THEN 'duplicate' WHEN raw_address IS NULL THEN 'excluded' WHEN id % 37 = 1 OR lat > 90 THEN 'invalid'
  WHEN file_role = 'geospatial' AND tab.dedupe_key IS NULL AND id % 2 = 0 THEN 'new' WHEN (file_role = 'geospatial' AND tab.dedupe_key IS NULL) OR id % 5 = 0 OR id % 7 = 0 THEN 'verified' WHEN id % 11 = 0 OR id % 13 = 0 THEN 'invalid'
  WHEN id % 3 = 1 AND id % 2 = 0 THEN 'verified' ELSE 'invalid' END AS rule_status FROM classed c LEFT JOIN tab ON c.dedupe_key = tab.dedupe_key)"""
_COLOR = "CASE rule_status WHEN 'verified' THEN 'green' WHEN 'duplicate' THEN 'white' WHEN 'new' THEN 'blue' WHEN 'excluded' THEN 'gray' ELSE 'red' END"


@query(f"WITH {ADDRESSES}, {_RULES} SELECT id, rule_status, {_COLOR} AS color FROM ruled")
def rule_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_status(_rule_flags(spark, sf_dir)).select("id", "rule_status", "color")


@query(f"WITH {ADDRESSES} SELECT id, CASE WHEN lat > 90 THEN 'NO_COORDS' WHEN raw_address IS NULL THEN 'COORDS_VALIDATED' WHEN id % 4 = 0 AND id % 700 <= 100 THEN 'MATCH' WHEN id % 4 = 0 AND id % 700 <= 500 THEN 'MISMATCH_WARN' WHEN id % 4 = 0 THEN 'MISMATCH' WHEN id % 3 = 0 THEN 'COORDS_VALIDATED' ELSE 'UNVERIFIED' END AS coord_status FROM addr")
def coordinate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = addresses(spark, sf_dir).select("id", (F.col("lat") <= 90).alias("has_coords"), F.col("raw_address").isNotNull().alias("has_address"), F.when(k % 4 == 0, k % 700).alias("forward_m"), (k % 3 == 0).alias("has_reverse"))
    return rules.coordinate_status(rows).select("id", "coord_status")


@query("""WITH s AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT % 101 AS s0 FROM orders), a AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN least(s0, 89) ELSE s0 END AS s1 FROM s), b AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 400 > 150 THEN least(s1, 79) ELSE s1 END AS s2 FROM a),
c AS (SELECT *, (CASE WHEN o_orderkey % 17 = 0 THEN least(s2, 30) ELSE s2 END)::INTEGER AS g FROM b) SELECT o_orderkey, g AS gated_score, CASE WHEN g >= 90 THEN 'AUTO_ACCEPT' WHEN g >= 60 THEN 'MANUAL_REVIEW' ELSE 'REJECT' END AS gated_status FROM c""")
def validator_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.pmod(F.floor("o_totalprice"), F.lit(101)).alias("score"), (k % 2 != 0).alias("deliverable"), (k % 3 == 0).alias("number_mismatch"), (k % 400).alias("distance_m"), (k % 17 == 0).alias("hard_mismatch"))
    return rules.quality_gates(rows).select("o_orderkey", "gated_score", "gated_status")


_M = "('MATCH', 'AUTO_ACCEPT')"


@query(f"""WITH {SCORES}, {LATEST}, {_WIDE}, f AS (SELECT address_id, CASE WHEN address_id % 41 = 0 THEN 'duplicate' WHEN agent1_status IN {_M} AND coalesce(agent1_score, 0) >= CASE WHEN address_id % 3 = 0 THEN 60 ELSE 70 END THEN 'verified'
  WHEN agent5_status = 'REJECT' THEN 'invalid' WHEN agent5_status IS NOT NULL AND agent5_score >= CASE WHEN address_id % 5 = 0 THEN 40 ELSE 70 END THEN 'verified' ELSE 'invalid' END AS flow_status FROM wide)
SELECT address_id, flow_status, CASE flow_status WHEN 'verified' THEN 'valid' ELSE flow_status END AS rule_status FROM f""")
def flow_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("address_id")
    of = {"first_status": "agent1_status", "first_score": "agent1_score", "final_status": "agent5_status", "final_score": "agent5_score"}
    rows = stage_left_joins(spark, sf_dir).withColumnsRenamed({v: n for n, v in of.items()})
    rows = rows.withColumns({"sticky_duplicate": k % 41 == 0, "first_threshold": F.when(k % 3 == 0, 60), "final_threshold": F.when(k % 5 == 0, 40), "default_score": F.lit(0)})
    return rules.flow_status(rows).select("address_id", "flow_status", "rule_status")


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AND greatest(o_orderkey % 101, o_orderkey % 7 * 20, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 90 END, 0)) >= 100 AS exact_warning FROM orders""")
def exact_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 3 == 0, " mismatch_warn ").when(k % 3 == 1, "MATCH")
    return table(spark, sf_dir, "orders").select(k, rules.exact_with_warning(status, k % 101, k % 7 * 20, F.when(k % 2 == 0, 90)).alias("exact_warning"))


@query(f"WITH {SCORES}, {LATEST} SELECT c_custkey AS address_id FROM customer WHERE c_custkey NOT IN (SELECT address_id FROM latest WHERE stage = 'agent5' AND status = 'REJECT')")
def executed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = latest(spark, sf_dir).withColumn("status", F.when(F.col("status") == "REJECT", "skipped").otherwise(F.col("status")))
    return rules.executed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address_id")), results, "agent5")


@query(f"""WITH {ADDRESSES}, t AS (SELECT id, [CASE WHEN id % 2 = 0 AND id % 3 <> 0 AND (id % 101 >= 90 OR id % 101 = 1) THEN {{'o': 'agent2', 'y': lat, 'x': lon}} END, CASE WHEN id % 97 >= 90 OR id % 97 = 1 THEN {{'o': 'final_result', 'y': 0.0::DOUBLE, 'x': lon}} END, CASE WHEN id % 97 >= 90 OR id % 97 = 1 THEN {{'o': 'final_meta', 'y': lat + 1, 'x': lon}} END,
  CASE WHEN id % 89 >= 85 OR id % 89 = 6 OR id % 5 = 0 THEN {{'o': 'validator', 'y': CASE WHEN id % 7 <> 0 THEN lat + 2 END, 'x': lon}} END, CASE WHEN id % 4 = 0 THEN {{'o': 'parcel', 'y': lat + 3, 'x': lon}} END, {{'o': 'validated', 'y': CASE WHEN id % 11 = 0 THEN lat + 4 END, 'x': lon}}, {{'o': 'stored', 'y': lat, 'x': lon}}, {{'o': 'final_meta', 'y': lat + 1, 'x': lon}}, {{'o': 'source', 'y': 1.0::DOUBLE, 'x': 1.0::DOUBLE}}] AS t FROM addr),
b AS (SELECT id, list_filter(t, lambda s: s IS NOT NULL AND s.y BETWEEN -90 AND 90 AND s.y <> 0)[1] AS b FROM t) SELECT id, b.y AS lat, b.x AS lon, b.o AS origin FROM b""")
def best_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y, x = F.col("id"), F.col("lat"), F.col("lon")
    at = lambda lat, **more: F.struct(lat.alias("lat"), x.alias("lon"), *[v.alias(n) for n, v in more.items()])
    rows = addresses(spark, sf_dir).select(
        "id",
        F.when(k % 2 == 0, at(y, status=F.when(k % 3 == 0, "Failed").otherwise("ok"), score=k % 101)).alias("agent2"),
        at(F.lit(0.0)).alias("final_result"), at(y + 1).alias("final_meta"), (k % 97).alias("final_score"),
        at(F.when(k % 7 != 0, y + 2), score=k % 89 + F.when(k % 89 >= 85, 5).otherwise(-5)).alias("validator"), F.when(k % 5 == 0, 95).alias("validator_score"),
        at(y + 3, source=F.when(k % 4 == 0, "Regrid").otherwise("county"), status=F.lit(None).cast("string"), score=F.lit(0.92)).alias("parcel"),
        at(F.when(k % 11 == 0, y + 4)).alias("validated"), at(y).alias("stored"), F.struct(F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon")).alias("source"),
    )
    return rules.best_coordinates(rows).select("id", "lat", "lon", "origin")


@query("""WITH g AS (SELECT c_custkey, c_custkey % 3 AS h, c_custkey % 13 AS m, c_custkey % 4 AS a, c_custkey % 5 AS b FROM customer),
r AS (SELECT *, [(h = 0)::INT, (50 + a)::INT, [100, 45, 15, 0][a + 1], (a <> 1)::INT, [100, 80, 30, 0, 55][b + 1]] AS rev, [(h <> 2)::INT, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 51 END, [95, 90, 0, 45, 20][b + 1], 1, [100, 80, 30, 0][a + 1]] AS fwd FROM g)
SELECT c_custkey, CASE WHEN m = 0 AND b = 0 THEN NULL WHEN m = 0 THEN 'forward' WHEN b = 0 AND m < 4 THEN 'reverse' WHEN c_custkey % 17 = 0 THEN 'reverse' WHEN rev > fwd THEN 'reverse' ELSE 'forward' END AS direction FROM r""")
def chosen_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    number = lambda same: F.when(same, "12").otherwise("14")
    found = lambda house, road, kind, place: F.struct(house.alias("house"), road.alias("road"), F.array(F.lit("other"), kind).alias("types"), place.alias("location_type"))
    reverse = found(number(k % 3 == 0), F.when(k % 4 != 1, "OAK ST"), pick(4, "street_address", " Route ", "locality", "nothing"), pick(5, "rooftop", "RANGE_INTERPOLATED", "APPROXIMATE", "X", "GEOMETRIC_CENTER"))
    forward = found(number(k % 3 != 2), F.lit("OAK ST"), pick(5, "premise", "house", "x", "road", "neighborhood"), pick(4, "ROOFTOP", "RANGE_INTERPOLATED", "APPROXIMATE", "X"))
    rows = table(spark, sf_dir, "customer").select(
        k, F.lit("12 Oak St").alias("line"), F.when(k % 13 != 0, reverse).alias("reverse"), F.when(~((k % 5 == 0) & (k % 13 < 4)), forward).alias("forward"),
        (50 + k % 4).alias("reverse_percent"), F.when(k % 7 != 0, 51).alias("forward_percent"), (k % 17 == 0).alias("coordinate_driven"),
    )
    return rules.choose_geocode(rows).select("c_custkey", "direction")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN (o_orderkey % 100)::DOUBLE ELSE least((o_orderkey % 100)::DOUBLE, 35.0::DOUBLE) END AS score FROM orders")
def geocoder_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    place = F.when(k % 3 == 0, " rooftop ").when(k % 3 == 1, "APPROXIMATE")
    percent = F.when(k % 2 == 0, 100).when(k % 5 == 0, 99)
    return table(spark, sf_dir, "orders").select(k, rules.final_geocoder_score(k % 100, place, percent).alias("score"))


@query(r"""WITH h AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'x-amrc-1' WHEN 1 THEN 'FL1234ABC ABCDTX' WHEN 2 THEN 'abcdtx ' || c_custkey::VARCHAR WHEN 3 THEN 'n/a' ELSE c_mktsegment END || ' ' || c_name AS h FROM customer),
u AS (SELECT c_custkey, upper(h) AS h FROM h)
SELECT c_custkey, CASE WHEN contains(h, 'AMRC') THEN 'Americus' END AS city, CASE WHEN contains(h, 'AMRC') THEN 'GA' ELSE coalesce(nullif(regexp_extract(h, '\b([A-Z]{2})\d{3,}[A-Z]{3,}\b', 1), ''), nullif(regexp_extract(h, '\b[A-Z]{4}([A-Z]{2})\b', 1), '')) END AS state FROM u""")
def place_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    first = F.when(k % 5 == 0, "x-amrc-1").when(k % 5 == 1, "FL1234ABC ABCDTX").when(k % 5 == 2, F.concat(F.lit("abcdtx "), k.cast("string"))).when(k % 5 == 3, "n/a").otherwise(F.col("c_mktsegment"))
    city, state = mapping.place_hint(first, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(k, city.alias("city"), state.alias("state"))


# metrics and exports


@query(f"""WITH {ADDRESSES}, {_RULES}, m AS (SELECT count(*) FILTER (file_role = 'tabular' AND rule_status <> 'duplicate') AS demand, count(*) FILTER (rule_status = 'verified') AS served, count(*) FILTER (rule_status = 'invalid') AS not_served, count(*) FILTER (rule_status = 'new') AS additional FROM ruled JOIN addr USING (id))
SELECT *, served + additional AS engineered, round(not_served / nullif(demand, 0)::DOUBLE, 6) AS discrepancy FROM m""")
def summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = rules.rule_status(_rule_flags(spark, sf_dir)).select("id", "rule_status")
    return metrics.summary(ruled.join(addresses(spark, sf_dir).select("id", "file_role"), "id"))


@query(f"WITH {SCORES}, {LATEST}, b AS (SELECT CASE WHEN score <= 0 THEN 'invalid' WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS bucket FROM latest) SELECT bucket, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM b), 4) AS share FROM b GROUP BY bucket")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confidence_histogram(latest(spark, sf_dir), "score")


@query(f"WITH {ADDRESSES}, {_RULES} SELECT rule_status AS bucket, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ruled), 4) AS share FROM ruled GROUP BY rule_status")
def rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(rules.rule_status(_rule_flags(spark, sf_dir)).withColumnRenamed("rule_status", "bucket"))


@query(f"WITH {SCORES}, {LATEST} SELECT address_id, max(score) AS score, min(stage) FILTER (score = best) AS stage FROM (SELECT *, max(score) OVER (PARTITION BY address_id) AS best FROM latest) GROUP BY address_id")
def overlay_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overlay(latest(spark, sf_dir), chained=False)


@query(f"WITH {SCORES}, {LATEST} SELECT address_id, coalesce(max(score) FILTER (stage = 'agent5'), max(score)) AS score FROM latest GROUP BY address_id")
def overlay_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overlay(latest(spark, sf_dir), chained=True, final="agent5").select("address_id", "score")


@query(f"WITH {ADDRESSES} SELECT category, count(*) AS n, count(*) FILTER (raw_address IS NULL) AS missing_address, row_number() OVER (ORDER BY count(*) DESC, category) % 6 AS color_index FROM addr GROUP BY category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.categories(addresses(spark, sf_dir), "category")


@query(f"WITH {ADDRESSES} SELECT id, raw_address, city FROM addr WHERE contains(lower(raw_address), 'oak') ORDER BY id LIMIT 20 OFFSET 20")
def paged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.page(addresses(spark, sf_dir), "raw_address", "oak", 2, 20).select("id", "raw_address", "city")


@query(f"WITH {ADDRESSES}, {_RULES} SELECT {_search_sql('raw_address')} AS search_key, max(struct_pack(r := CASE rule_status WHEN 'verified' THEN 3 WHEN 'new' THEN 2 ELSE 1 END, o := -id))['r']::INTEGER AS rank, -max(struct_pack(r := CASE rule_status WHEN 'verified' THEN 3 WHEN 'new' THEN 2 ELSE 1 END, o := -id))['o'] AS id FROM ruled JOIN addr USING (id) WHERE raw_address IS NOT NULL GROUP BY 1")
def search_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = rules.rule_status(_rule_flags(spark, sf_dir)).select("id", "rule_status")
    return metrics.search_results(ruled.join(addresses(spark, sf_dir).select("id", "raw_address"), "id"))


@query("SELECT o_orderstatus AS status, count(*) AS n, sum(o_orderkey % 7)::BIGINT AS row_count, min(o_orderdate) AS first_start, max(o_orderdate) AS last_end, date_diff('second', min(o_orderdate), max(o_orderdate)) AS seconds FROM orders GROUP BY o_orderstatus")
def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 7).alias("row_count"), F.col("o_orderdate").alias("started"), F.col("o_orderdate").alias("ended"))
    return metrics.job_totals(jobs)


@query(f"WITH {ADDRESSES}, s AS (SELECT category, {haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM addr WHERE lat <= 90 WINDOW w AS (PARTITION BY category ORDER BY ord)) SELECT category, round(sum(d), 2) AS metres FROM s GROUP BY category")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.polyline_lengths(addresses(spark, sf_dir).filter("lat <= 90"), "category")


@query("SELECT conv_id, max_by(role, turn) AS role, max_by(text, turn) AS text, max(turn) AS turn, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def latest_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"), F.count(F.lit(1)).alias("n_turns"))


# spatial

RINGS = [(1, [(32.0, -84.06), (32.06, -84.06), (32.06, -84.0), (32.0, -84.0)]), (2, [(32.02, -84.1), (32.1, -84.08), (32.09, -84.03), (32.04, -84.04)])]


def _ring_sql(ring: list[tuple[float, float]]) -> str:
    crossings = []
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            crossings.append(f"CASE WHEN (lat < {y1}::DOUBLE) <> (lat < {y2}::DOUBLE) AND lon < ({x2}::DOUBLE - {x1}::DOUBLE) * (lat - {y1}::DOUBLE) / ({y2}::DOUBLE - {y1}::DOUBLE) + {x1}::DOUBLE THEN 1 ELSE 0 END")
    edges = [f"(abs((lon - {x1}::DOUBLE) * ({y2}::DOUBLE - {y1}::DOUBLE) - (lat - {y1}::DOUBLE) * ({x2}::DOUBLE - {x1}::DOUBLE)) < 1e-12 AND lat BETWEEN {min(y1, y2)} AND {max(y1, y2)} AND lon BETWEEN {min(x1, x2)} AND {max(x1, x2)})" for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1])]
    return f"(({' + '.join(crossings)}) % 2 = 1 OR {' OR '.join(edges)})"


@query(f"WITH {ADDRESSES} SELECT id, CASE WHEN {_ring_sql(RINGS[0][1])} THEN 1 WHEN {_ring_sql(RINGS[1][1])} THEN 2 END AS polygon_id FROM addr")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_polygons(addresses(spark, sf_dir), RINGS).select("id", "polygon_id")


@query(f"WITH {ADDRESSES} SELECT id FROM addr WHERE {_ring_sql(RINGS[1][1])}")
def outside_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.outside_filter(addresses(spark, sf_dir), RINGS[1][1]).select("id")


_PAIR = f"FROM addr a JOIN addr b ON a.file_role = 'tabular' AND b.file_role = 'geospatial' AND abs(a.lat - b.lat) < 0.001 AND {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 60.0"


@query(f"WITH {ADDRESSES} SELECT id, EXISTS (SELECT 1 FROM addr b WHERE b.file_role = 'geospatial' AND abs(a.lat - b.lat) < 0.001 AND {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 60.0) AS near FROM addr a WHERE file_role = 'tabular'")
def radius_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = addresses(spark, sf_dir)
    return spatial.near_any(a.filter("file_role = 'tabular'"), a.filter("file_role = 'geospatial'"), 60.0).select("id", "near")


@query(f"WITH {ADDRESSES}, p AS (SELECT a.id, b.id AS nearest_id, round({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS distance_m {_PAIR}) SELECT id, nearest_id, distance_m FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance_m, nearest_id) = 1")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = addresses(spark, sf_dir)
    return spatial.nearest(a.filter("file_role = 'tabular'"), a.filter("file_role = 'geospatial'"), 60.0)


_TILE = "least(greatest(floor({v} * 512.0::DOUBLE)::INTEGER, 0), 511)"
_X, _Y = _TILE.format(v="((lon + 180) / 360)"), _TILE.format(v="(0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi()))")


@query(f"WITH {ADDRESSES}, t AS (SELECT id, {_X} AS x, {_Y} AS y FROM addr WHERE lat <= 85) SELECT id, list_aggregate(list_transform(range(8, -1, -1), lambda i: (((x >> i) & 1) + 2 * ((y >> i) & 1))::VARCHAR), 'string_agg', '') AS quadkey FROM t")
def quadkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).filter("lat <= 85").select("id", geo.quadkey(F.col("lat"), F.col("lon"), 9).alias("quadkey"))


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slanted square for each nation; some overlap."""
    k = F.col("n_nationkey")
    y, x = 32.0 + k * 0.004, -84.1 + k * 7 % 25 * 0.0035
    corner = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    ring = F.array(corner(y, x), corner(y + 0.006, x + 0.001), corner(y + 0.005, x + 0.006), corner(y + 0.001, x + 0.005))
    return table(spark, sf_dir, "nation").select(k.alias("polygon_id"), ring.alias("ring"))


_CORNERS = ["y", "x"], ["y + 0.006::DOUBLE", "x + 0.001::DOUBLE"], ["y + 0.005::DOUBLE", "x + 0.006::DOUBLE"], ["y + 0.001::DOUBLE", "x + 0.005::DOUBLE"]
_EDGES = ", ".join(f"{{'y1': {p[0]}, 'x1': {p[1]}, 'y2': {q[0]}, 'x2': {q[1]}}}" for p, q in zip(_CORNERS, [*_CORNERS[1:], _CORNERS[0]]))
_POLYGONS = f"""polys AS (SELECT n_nationkey AS polygon_id, 32.0::DOUBLE + n_nationkey * 0.004::DOUBLE AS y, -84.1::DOUBLE + n_nationkey * 7 % 25 * 0.0035::DOUBLE AS x FROM nation),
edges AS (SELECT polygon_id, e.y1, e.x1, e.y2, e.x2 FROM (SELECT polygon_id, unnest([{_EDGES}]) AS e FROM polys))"""
_HELD = "(sum(CASE WHEN (lat < y1) <> (lat < y2) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)"
_TOUCHED = "bool_or(abs((lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)) < 1e-12 AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2))"
_ALONG = "least(greatest(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)), 0.0), 1.0)"
_AWAY = f"sqrt(power(lon - x1 - {_ALONG} * (x2 - x1), 2) + power(lat - y1 - {_ALONG} * (y2 - y1), 2))"


@query(f"WITH {ADDRESSES}, {_POLYGONS}, h AS (SELECT id, polygon_id, {_HELD} OR {_TOUCHED} AS held FROM addr, edges GROUP BY id, polygon_id) SELECT id, min(polygon_id) FILTER (held) AS polygon_id FROM h GROUP BY id")
def polygon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.containing(addresses(spark, sf_dir), _polygons(spark, sf_dir)).select("id", "polygon_id")


@query(f"""WITH {ADDRESSES}, {_POLYGONS}, h AS (SELECT id, polygon_id, {_HELD} AND NOT {_TOUCHED} AS held, min({_AWAY}) AS d FROM addr, edges GROUP BY id, polygon_id),
b AS (SELECT id, min(polygon_id) FILTER (held) AS held_by, min(d) AS d, min_by(polygon_id, struct_pack(d := d, p := polygon_id)) AS nearest FROM h GROUP BY id)
SELECT id, coalesce(held_by, nearest) AS polygon_id, CASE WHEN held_by IS NOT NULL THEN 'ST_WITHIN' WHEN d < 0.00015 THEN 'ST_DWITHIN' ELSE 'NEAREST' END AS match_type, CASE WHEN held_by IS NOT NULL THEN 85 WHEN d < 0.00015 THEN 80 ELSE 75 END AS confidence FROM b""")
def polygon_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_polygon(addresses(spark, sf_dir), _polygons(spark, sf_dir))


@query(f"""WITH {_POLYGONS}, b AS (SELECT polygon_id, min(y1) AS s, min(x1) AS w FROM edges GROUP BY polygon_id),
p AS (SELECT polygon_id, s + (i + oy) * 0.0005::DOUBLE AS lat, w + (j + ox) * 0.0005::DOUBLE AS lon FROM b, (SELECT unnest(range(14)) AS i), (SELECT unnest(range(14)) AS j), (SELECT unnest([0.5, 0.25, 0.75]::DOUBLE[]) AS oy), (SELECT unnest([0.5, 0.25, 0.75]::DOUBLE[]) AS ox))
SELECT polygon_id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM p JOIN edges USING (polygon_id) GROUP BY polygon_id, p.lat, p.lon HAVING {_HELD} AND NOT {_TOUCHED}""")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.grid_points(_polygons(spark, sf_dir), 0.0005).select("polygon_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(f"""WITH {ADDRESSES}, {_POLYGONS}, h AS (SELECT id, polygon_id, {_HELD} OR {_TOUCHED} AS held FROM addr, edges WHERE file_role = 'geospatial' AND lat <= 90 GROUP BY id, polygon_id),
seeds AS (SELECT id, lat AS y, lon AS x, own AS polygon_id FROM (SELECT id, min(polygon_id) FILTER (held) AS own FROM h GROUP BY id) JOIN addr USING (id) WHERE own IS NOT NULL),
d AS (SELECT unnest([{{'d': 0, 'n': 1.0::DOUBLE, 'e': 0.0::DOUBLE}}, {{'d': 1, 'n': -1.0::DOUBLE, 'e': 0.0::DOUBLE}}, {{'d': 2, 'n': 0.0::DOUBLE, 'e': 1.0::DOUBLE}}, {{'d': 3, 'n': 0.0::DOUBLE, 'e': -1.0::DOUBLE}}]) AS s), r AS (SELECT unnest([1.0, 1.5]::DOUBLE[]) AS radius),
p AS (SELECT id AS seed_id, polygon_id, s.d AS direction, radius, y + s.n * 60.0::DOUBLE * radius / 111320.0::DOUBLE AS lat, x + s.e * 60.0::DOUBLE * radius / (111320.0::DOUBLE * greatest(0.1, cos(radians(y)))) AS lon FROM seeds, d, r),
i AS (SELECT seed_id, direction, radius, round(p.lat, 6) AS lat, round(p.lon, 6) AS lon FROM p JOIN edges USING (polygon_id) GROUP BY seed_id, direction, radius, p.lat, p.lon HAVING {_HELD} AND NOT {_TOUCHED})
SELECT seed_id, direction::INTEGER AS direction, radius, lat, lon FROM i QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY direction, radius, seed_id) = 1""")
def neighborhood_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = _polygons(spark, sf_dir)
    seeds = spatial.containing(addresses(spark, sf_dir).filter("file_role = 'geospatial' and lat <= 90"), polygons)
    return spatial.neighbourhood_candidates(seeds.filter("polygon_id is not null"), polygons)


@query(f"WITH {ADDRESSES}, u AS (SELECT id, raw_address, unnest(range(1, least(greatest(id % 6, 2), 4) + 1)) AS unit FROM addr WHERE raw_address IS NOT NULL) SELECT id, unit::INTEGER AS unit, regexp_replace(raw_address, '^(\\d+)', '\\1-' || unit::VARCHAR) AS address FROM u".replace("\\\\", "\\"))
def multi_unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = addresses(spark, sf_dir).filter("raw_address is not null").withColumn("units", (F.col("id") % 6).cast("int"))
    return spatial.multi_unit_rows(rows, 4).select("id", "unit", text.suffix_address(F.col("raw_address"), F.col("unit")).alias("address"))


@query("""WITH n AS (SELECT n_nationkey AS k, 0.01::DOUBLE * (n_nationkey + 1) AS s, 30.0::DOUBLE AS y, 10.0::DOUBLE AS x FROM nation)
SELECT k AS n_nationkey, round(abs((radians(0.0) * (2 + sin(radians(y)) + sin(radians(y + s))) + radians(s) * (2 + sin(radians(y + s)) + sin(radians(y + s))) + radians(0.0) * (2 + sin(radians(y + s)) + sin(radians(y))) + radians(-s) * (2 + sin(radians(y)) + sin(radians(y)))) * 6378137.0 * 6378137.0 / 2), 1) AS area_m2 FROM n""")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, y, x = 0.01 * (F.col("n_nationkey") + 1), F.lit(30.0), F.lit(10.0)
    corner = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    ring = F.array(corner(y, x), corner(y + s, x), corner(y + s, x + s), corner(y, x + s))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(geo.ring_area_m2(ring), 1).alias("area_m2"))


@query()
def greedy_distance_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = addresses(spark, sf_dir).filter("lat <= 90").select("id", "ord", "file_role", "lat", "lon")
    return spatial.greedy_distinct(points, "file_role", 20.0)


@query()
def convex_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.hulls(addresses(spark, sf_dir).filter("lat <= 90"), "category")


# nested data, texts and events


@query("SELECT event_id, event_type, try_cast(json_extract_string(props, '$.' || k) AS VARCHAR) AS first_value FROM events, (SELECT json_keys(props)[1] AS k FROM events ORDER BY event_id LIMIT 1)")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    key = rows.orderBy("event_id").select(F.get(F.json_object_keys("props"), F.lit(0)).alias("k")).first()
    value = F.get_json_object("props", f"$.{key.k}") if key and key.k else F.lit(None).cast("string")
    return rows.select("event_id", "event_type", value.alias("first_value"))


@query("SELECT md5(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query()
def sliding_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import limiter

    return limiter.limited(table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("key"), "ts"), 3, 60.0)


# provider results


@query("""WITH d AS (SELECT l_orderkey AS id, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS position, (l_partkey % 40 * 53 + 5)::VARCHAR AS number, (l_quantity / 50.0)::DOUBLE AS confidence, CASE WHEN l_orderkey % 3 = 0 THEN (l_orderkey % 40 * 53 + 5)::VARCHAR END AS expected FROM lineitem),
v AS (SELECT * FROM d WHERE length(number) BETWEEN 2 AND 5 AND number::INTEGER NOT BETWEEN 1900 AND 2100),
e AS (SELECT * FROM v QUALIFY NOT coalesce(bool_or(number = expected) OVER (PARTITION BY id), FALSE) OR number = expected),
w AS (SELECT *, confidence + 0.8::DOUBLE * row_number() OVER (PARTITION BY id, number ORDER BY position) + CASE length(number) WHEN 3 THEN 1.0::DOUBLE WHEN 4 THEN 1.5::DOUBLE WHEN 5 THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM e),
s AS (SELECT id, number, sum(weight) AS weight, min(position) AS place FROM w GROUP BY ALL)
SELECT id, max_by(number, struct_pack(w := round(weight, 9), p := -place)) AS number, round(max_by(weight, struct_pack(w := round(weight, 9), p := -place)), 4) AS weight FROM s GROUP BY id""")
def ocr_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    expected = F.when(c("l_orderkey") % 3 == 0, (c("l_orderkey") % 40 * 53 + 5).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), (c("l_linenumber").cast("long") * 1000000000 + c("l_partkey") * 1000 + c("l_suppkey")).alias("position"), (c("l_partkey") % 40 * 53 + 5).cast("string").alias("number"), (c("l_quantity") / 50.0).alias("confidence"), expected.alias("expected"))
    return providers.ocr_consensus(rows)


@query(r"""WITH r AS (SELECT o_custkey AS id, o_orderkey AS position, (['street_address', 'point_of_interest', 'locality', 'route'])[o_orderkey % 4 + 1] AS t, (['ROOFTOP', 'RANGE_INTERPOLATED', 'APPROXIMATE'])[o_orderkey % 3 + 1] AS l, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey::VARCHAR || ' OAK' ELSE 'OAK' END AS a FROM orders),
s AS (SELECT *, CASE t WHEN 'street_address' THEN 100 WHEN 'point_of_interest' THEN 25 WHEN 'locality' THEN -75 ELSE 0 END + CASE l WHEN 'ROOFTOP' THEN 40 WHEN 'RANGE_INTERPOLATED' THEN 30 ELSE 0 END + CASE WHEN regexp_matches(a, '^\d') THEN 25 ELSE 0 END AS score FROM r)
SELECT id, max_by(a, struct_pack(s := score, p := -position)) AS formatted_address, max(score) AS score FROM s WHERE score > 0 GROUP BY id""")
def best_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    line = F.when(k % 5 < 3, F.concat(k.cast("string"), F.lit(" OAK"))).otherwise("OAK")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), k.alias("position"), F.array(pick("street_address", "point_of_interest", "locality", "route")).alias("types"), pick("ROOFTOP", "RANGE_INTERPOLATED", "APPROXIMATE").alias("location_type"), line.alias("formatted_address"))
    return providers.best_result(rows).select("id", "formatted_address", "score")


@query(f"""WITH {ADDRESSES} SELECT id, CASE WHEN raw_address IS NOT NULL AND lat <= 90 THEN 'both' WHEN raw_address IS NOT NULL THEN 'geocode' WHEN lat <= 90 THEN 'validator' ELSE 'skipped' END AS route FROM addr""")
def classify_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.routes(addresses(spark, sf_dir)).select("id", "route")


@query(f"""WITH {ADDRESSES}, r AS (SELECT format('{{:.3f}},{{:.3f}}', lat, lon) AS place, min(round(lat, 3) + CASE WHEN id % 2 = 0 THEN 0.0 ELSE 1.0 END) AS y, min(round(lon, 3)) AS x FROM addr WHERE lat <= 90 GROUP BY 1)
SELECT a.id, CASE WHEN {haversine_sql('a.lat', 'a.lon', 'r.y', 'r.x')} <= 2000.0 THEN round(r.y, 6) END AS result_lat FROM addr a LEFT JOIN r ON format('{{:.3f}},{{:.3f}}', a.lat, a.lon) = r.place WHERE a.lat <= 90""")
def cached_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = addresses(spark, sf_dir).filter("lat <= 90").select("id", "lat", "lon")
    y = F.round("lat", 3) + F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0)
    results = a.groupBy(providers.place_key(F.col("lat"), F.col("lon"), 3).alias("place")).agg(F.min(y).alias("result_lat"), F.min(F.round("lon", 3)).alias("result_lon"))
    return providers.looked_up(a, results, 3).select("id", F.round("result_lat", 6).alias("result_lat"))


@query(rf"""WITH {ADDRESSES} SELECT id, CASE WHEN id % 4 = 0 THEN 'Retail' WHEN regexp_matches(lower(coalesce(raw_address, '')), 'park') THEN 'Commercial' WHEN regexp_matches(lower(coalesce(raw_address, '')), '\b(st|street)\b') THEN 'Single-Family' ELSE 'Unknown' END AS land_use,
  CASE WHEN id % 4 = 0 THEN 95 WHEN id % 5 = 0 THEN 85 WHEN id % 5 = 1 THEN 75 WHEN id % 5 = 2 THEN 30 ELSE 0 END AS confidence FROM addr""")
def parcel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = addresses(spark, sf_dir)
    parcel = a.filter("id % 4 = 0").select("id", F.lit("Retail").alias("land_use"))
    kind = F.when(F.col("id") % 5 == 0, "within").when(F.col("id") % 5 == 1, "nearest")
    county = a.filter("id % 5 < 3").select("id", F.col("city").alias("county"), kind.alias("match_type"))
    return providers.parcels(a, parcel, county)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN least(80.0 + CASE WHEN o_orderkey % 700 <= 20 THEN 15 WHEN o_orderkey % 700 <= 50 THEN 12 WHEN o_orderkey % 700 <= 100 THEN 8 WHEN o_orderkey % 700 <= 200 THEN 4 WHEN o_orderkey % 700 > 500 THEN -12 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 8 ELSE -15 END, 99.0) ELSE 35.0 END::DOUBLE AS confidence FROM orders""")
def forward_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = providers.forward_confidence(F.lit(80.0), k % 3 == 0, k % 700, F.when(k % 2 == 0, "MATCH").otherwise("MISMATCH"))
    return table(spark, sf_dir, "orders").select("o_orderkey", c.cast("double").alias("confidence"))


@query(f"""WITH {SCORES}, {LATEST} SELECT address_id, string_agg(stage || ':' || score::VARCHAR, ',' ORDER BY stage) AS history, max(score) FILTER (stage IN ('agent1', 'agent2')) AS tag FROM latest GROUP BY address_id""")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(spark, sf_dir).groupBy("address_id").agg(F.sort_array(F.collect_list(F.struct("stage", "score"))).alias("h"))
    empty = F.expr("cast(array() as array<struct<stage:string,score:int,accepted:boolean>>)")
    history = F.aggregate("h", empty, lambda acc, x: providers.history_append(acc, x["stage"], x["score"], F.lit(True)))
    tags = F.transform("h", lambda x: F.struct(x["stage"].alias("name"), x["score"].cast("double").alias("confidence")))
    some = F.exists("h", lambda x: x["stage"].isin("agent1", "agent2"))
    return rows.select("address_id", F.array_join(F.transform(history, lambda x: F.concat(x["stage"], F.lit(":"), x["score"].cast("string"))), ",").alias("history"), F.when(some, providers.tag_confidence(tags, ["agent1", "agent2"]).cast("int")).alias("tag"))


# building, imagery, validation and discovery


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 60)::INTEGER AS d, (p_partkey * 7 % 500)::INTEGER AS a FROM part) SELECT p_partkey, d > 30 AS rejected, d > 30 AND (d > 45 OR a >= 300) AS vacant_signal,
  greatest(72, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 20 <= 5 THEN 92 WHEN p_partkey % 20 <= 15 THEN 88 ELSE 85 END ELSE 0 END, CASE WHEN p_partkey % 101 >= 99 THEN 90 WHEN p_partkey % 101 >= 90 THEN 85 ELSE 0 END, CASE WHEN d <= 10 THEN 90 WHEN d <= 20 THEN 85 WHEN d <= 35 THEN 80 WHEN d <= 50 THEN 75 ELSE 0 END)::INTEGER AS confidence FROM p""")
def building_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, (k % 60).cast("int").alias("distance_m"), (k * 7 % 500).cast("int").alias("area_m2"), F.lit(72).alias("band"), F.when(k % 2 == 0, "MATCH").otherwise("MISMATCH").alias("coord_status"), (k % 20).alias("coord_m"), (k % 101).alias("validation"))
    return stages.building_confidence(stages.footprint_match(rows)).select("p_partkey", "rejected", "vacant_signal", "confidence")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(least((l_quantity / 50.0)::DOUBLE * 50 + least(l_partkey % 14, 10) + CASE WHEN l_partkey % 2 = 0 THEN 20 ELSE 0 END + least(l_suppkey % 7 * 3, 15) + least(l_linenumber % 4 * 5, 10) + CASE WHEN l_partkey % 9 = 0 THEN 10 WHEN l_partkey % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN l_suppkey % 2 = 0 THEN 10 ELSE 5 END, 100.0), 0)::INTEGER AS score FROM lineitem""")
def imagery_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    score = stages.imagery_score(F.col("l_quantity") / 50.0, p % 14, p % 2 == 0, s % 7, F.col("l_linenumber") % 4, p % 3 == 0, p % 9 == 0, s % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"))


@query(f"""WITH {ADDRESSES}, v AS (SELECT id, raw_address IS NOT NULL AND id % 3 <> 0 AS equal, id % 7 = 0 AS hard FROM addr)
SELECT id, CASE WHEN hard AND equal THEN 30 WHEN equal THEN 100 WHEN hard THEN 30 ELSE 35 END AS confidence, CASE WHEN hard THEN 'REJECT' WHEN equal THEN 'AUTO_ACCEPT' ELSE 'MANUAL_REVIEW' END AS validation_status FROM v""")
def validator_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = addresses(spark, sf_dir).select("id", "raw_address", F.when(k % 3 == 0, F.concat(F.lit("999 "), "raw_address")).otherwise(F.col("raw_address")).alias("standardized"), F.when(k % 7 == 0, "MISMATCH").otherwise("MATCH").alias("coord_status"))
    return stages.validator_result(rows).select("id", "confidence", "validation_status")


@query(f"WITH {SCORES} SELECT stage, count(*) AS total, count(*) FILTER (status IN ('MATCH', 'AUTO_ACCEPT')) AS matched, count(*) FILTER (status = 'REJECT') AS mismatched, count(*) FILTER (status NOT IN ('MATCH', 'AUTO_ACCEPT', 'REJECT')) AS other FROM scores GROUP BY stage")
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.status_counters(scores(spark, sf_dir), "stage")


@query(f"WITH {ADDRESSES}, {SCORES}, {LATEST} SELECT id, raw_address FROM addr WHERE id % 4 <> 0 OR id IN (SELECT address_id FROM latest WHERE score >= 90)")
def unconfirmed_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = addresses(spark, sf_dir).withColumn("discovered", F.col("id") % 4 == 0)
    return stages.without_unconfirmed(rows, latest(spark, sf_dir))[0].select("id", "raw_address")


_FOUND = "CASE WHEN id % 2 = 0 AND file_role = 'geospatial' THEN 'LOT ' || city ELSE raw_address END"


@query(f"""WITH RECURSIVE {ADDRESSES}, a AS (SELECT id, {_FOUND} AS address, lat, lon, {key_sql(_FOUND)} AS key, file_role FROM addr), k AS (SELECT * FROM a WHERE file_role = 'tabular'),
f AS (SELECT *, CASE WHEN {_ring_sql(RINGS[0][1])} THEN 1 WHEN {_ring_sql(RINGS[1][1])} THEN 2 END AS polygon_id FROM a WHERE file_role = 'geospatial'),
o AS (SELECT f.*, CASE WHEN coalesce(trim(address), '') = '' THEN 'failed' WHEN polygon_id IS NULL THEN 'outside'
  WHEN EXISTS (SELECT 1 FROM k WHERE k.key = f.key) OR EXISTS (SELECT 1 FROM k WHERE abs(k.lat - f.lat) < 0.001 AND {haversine_sql('f.lat', 'f.lon', 'k.lat', 'k.lon')} <= 25.0) THEN 'known' END AS early FROM f),
c AS (SELECT *, row_number() OVER (ORDER BY id) AS turn FROM o WHERE early IS NULL),
g AS (SELECT 0::BIGINT AS turn, [{{'id': 0::BIGINT, 'key': NULL::VARCHAR, 'lat': 0.0::DOUBLE, 'lon': 0.0::DOUBLE}}] AS kept UNION ALL
  SELECT c.turn, CASE WHEN len(list_filter(kept, lambda x: coalesce(x.key = c.key, FALSE) OR {haversine_sql('x.lat', 'x.lon', 'c.lat', 'c.lon')} <= 25.0)) > 0 THEN kept ELSE list_append(kept, {{'id': c.id, 'key': c.key, 'lat': c.lat, 'lon': c.lon}}) END FROM g JOIN c ON c.turn = g.turn + 1),
n AS (SELECT unnest(list_transform(kept, lambda x: x.id)) AS id FROM g WHERE turn = (SELECT max(turn) FROM g))
SELECT id, key, coalesce(early, CASE WHEN id IN (SELECT id FROM n) THEN 'new' ELSE 'repeated' END) AS outcome FROM o""")
def discovery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lot = F.when((F.col("id") % 2 == 0) & (F.col("file_role") == "geospatial"), F.concat(F.lit("LOT "), "city")).otherwise(F.col("raw_address"))
    a = addresses(spark, sf_dir).withColumn("address", lot)
    found = spatial.in_polygons(a.filter("file_role = 'geospatial'"), RINGS)
    return stages.new_geocodes(found, a.filter("file_role = 'tabular'"))


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h ' || (s % 3600 // 60)::VARCHAR || 'm' WHEN s >= 60 THEN (s // 60)::VARCHAR || 'm ' || (s % 60)::VARCHAR || 's' ELSE s::VARCHAR || 's' END AS duration FROM (SELECT o_orderkey, o_orderkey * 13 % 9000 AS s FROM orders)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", stages.duration(F.col("o_orderkey") * 13 % 9000).alias("duration"))


@query("""WITH v AS (SELECT p_partkey, (p_partkey % 32)::INTEGER AS c, CASE WHEN p_partkey % 3 = 0 THEN 15 WHEN p_partkey % 3 = 1 THEN 22 END AS r FROM part)
SELECT p_partkey, CASE WHEN c <= 15 THEN '' ELSE array_to_string(list_concat(CASE WHEN r < c THEN [r] ELSE [] END, list_filter([25, 22, 20, 18, 15], lambda x: x < c AND (r IS NULL OR x <> r)))[1:5], ',') END AS views FROM v""")
def tighter_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    views = stages.tighter_views((k % 32).cast("int"), F.when(k % 3 == 0, 15).when(k % 3 == 1, 22))
    return table(spark, sf_dir, "part").select(k, F.array_join(views.cast("array<string>"), ",").alias("views"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_name END AS name, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 'true' END AS ok FROM nation")
def loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, k = F.col("n_name"), F.col("n_nationkey")
    plain = F.concat(F.lit('{"name": "'), name, F.lit('", "ok": true}'))
    loose = F.concat(F.lit('Here:\n```json\n{"name": "'), name, F.lit('", // the name\n "ok": True,}\n```'))
    quoted = F.concat(F.lit("{“name”: “"), name, F.lit("”, “ok”: True}"))
    comment = F.concat(F.lit('// a comment\n{"name": "'), name, F.lit('", "ok": true,}'))
    text_of = F.when(k % 5 == 0, plain).when(k % 5 == 1, F.regexp_replace(loose, " // the name", "")).when(k % 5 == 2, quoted).when(k % 5 == 3, comment).otherwise("no object")
    parsed = stages.parsed_json(text_of)
    return table(spark, sf_dir, "nation").select(k, parsed["name"].alias("name"), parsed["ok"].alias("ok"))
