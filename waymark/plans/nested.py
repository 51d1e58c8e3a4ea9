"""Queries over nested metadata, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata
from ..operators import inputs
from .queries import query
from .views import ADDRESSES, addresses, spread, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.try_parse_json("props").alias("props"))


@query("""WITH m AS (SELECT event_id, event_type, json_merge_patch(json_merge_patch(props::JSON, json_object('k', CASE WHEN event_id % 4 = 0 THEN json_object('deep', event_id % 5) ELSE to_json(event_id % 7) END, 'type', event_type, 'o', json_object('x', event_id, 'y', 1))),
    json_object('o', json_object('y', json_object('z', event_id % 3), 'w', 't'))) AS m FROM events)
SELECT event_id, m->>'$.k.deep' AS deep, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (m->>'$.k')::BIGINT END AS k, m->>'$.type' AS kind, (m->>'$.o.x')::BIGINT AS x, (m->>'$.o.y.z')::BIGINT AS z, m->>'$.o.w' AS w, len(json_keys(m)) AS n FROM m""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep merges of events' properties with further objects."""
    k, js = F.col("event_id"), lambda *parts: F.parse_json(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))
    first = js('{"k": ', F.when(k % 4 == 0, F.concat(F.lit('{"deep": '), (k % 5).cast("string"), F.lit("}"))).otherwise((k % 7).cast("string")), ', "type": "', F.col("event_type"), '", "o": {"x": ', k, ', "y": 1}}')
    second = js('{"o": {"y": {"z": ', k % 3, '}, "w": "t"}}')
    rows = _events(spark, sf_dir).withColumn("a", metadata.merged(F.col("props"), first)).withColumn("m", metadata.merged(F.col("a"), second))
    at = lambda p, kind: metadata.path(F.col("m"), [p], kind)
    return rows.select("event_id", at("$.k.deep", "string").alias("deep"), at("$.k", "bigint").alias("k"), at("$.type", "string").alias("kind"), at("$.o.x", "bigint").alias("x"), at("$.o.y.z", "bigint").alias("z"), at("$.o.w", "string").alias("w"), F.size(metadata.fields(F.col("m"))).alias("n"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE event_id % 101 WHEN 1 THEN 100 ELSE event_id % 101 END WHEN 1 THEN 77 WHEN 2 THEN event_id % 50 ELSE NULL END::INTEGER AS confidence,
  CASE event_id % 3 WHEN 0 THEN event_type || '|r' WHEN 1 THEN 'v' ELSE '' END AS texts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 33.5 + event_id % 10 END::DOUBLE AS lat, CASE WHEN event_id % 6 = 0 THEN NULL ELSE -84.25 END::DOUBLE AS lon FROM events""")
def metadata_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-7, K-8, K-16: confidences, texts and coordinates under one of several names."""
    k = F.col("event_id")
    score = F.when(k % 4 == 0, F.concat(F.lit('"confidence": '), (k % 101).cast("string"))).when(k % 4 == 1, '"confidence": "high", "confidence_score": "77"').when(k % 4 == 2, F.concat(F.lit('"confidence": null, "score": '), (k % 50).cast("string"))).otherwise('"score": {"a": 1}')
    texts = F.when(k % 3 == 0, F.concat(F.lit('"reason": "r", "remark": " ", "comment": "'), "event_type", F.lit('"'))).when(k % 3 == 1, '"reason": 7, "final_resolution": {"a": "v", "b": 1, "c": {"d": "x"}}').otherwise('"final_resolution": "none"')
    lat = F.when(k % 5 == 0, '"lat": 0, "flat": 12.5').otherwise(F.concat(F.lit('"Node Latitude": "'), (33.5 + k % 10).cast("string"), F.lit('", "plat lat": 95')))
    lon = F.when(k % 6 == 0, '"lng": true, "lon": [1]').otherwise('"lng": -84.25')
    rows = spread(_events(spark, sf_dir), "event_id").withColumn("m", F.parse_json(F.concat(F.lit("{"), F.concat_ws(", ", score, texts, lat, lon), F.lit("}"))))
    rows, place = rows.withColumn("place", metadata.coordinates_in(F.col("m"))), F.col("place")
    return rows.select(k, metadata.payload_confidence(F.col("m")).cast("int").alias("confidence"), F.array_join(metadata.meta_texts(F.col("m")), "|").alias("texts"), place["lat"].alias("lat"), place["lon"].alias("lon"))


@query(f"""WITH {ADDRESSES} SELECT id, city AS display_name, (id % 90)::VARCHAR AS house_number, CASE WHEN id % 3 = 0 THEN 'Oak St' ELSE '' END AS road, CASE id % 4 WHEN 0 THEN city WHEN 1 THEN 'Sub' WHEN 2 THEN 'County' ELSE '' END AS city,
  'US' AS country_code, 'ROOFTOP' AS location_type, CASE WHEN id % 7 = 0 THEN '' ELSE 'premise' END AS address_type, CASE WHEN id % 7 = 0 THEN '' WHEN id % 2 = 0 THEN 'street_address' ELSE 'premise' END AS best, CASE WHEN id % 5 = 0 THEN NULL ELSE id + 0.5 END::DOUBLE AS latitude, CASE WHEN id % 5 = 0 THEN NULL ELSE 0.0 END::DOUBLE AS longitude,
  CASE id % 4 WHEN 0 THEN city WHEN 1 THEN 'Sub' ELSE 'Z' || zip_code END AS neighborhood, 'us' AS country FROM addr""")
def geocodes_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-10 to K-13: a geocoder's result; the first component of a type counts."""
    k, s = F.col("id"), lambda x: x.cast("string")
    part = lambda long, short, *types: F.concat(F.lit('{"long_name": "'), long, F.lit('", "short_name": "'), short, F.lit(f'", "types": {list(types)}}}'.replace("'", '"')))
    city = F.when(k % 4 == 0, part(F.col("city"), F.lit("C"), "locality", "political")).when(k % 4 == 1, part(F.lit("Sub"), F.lit("S"), "political", "sublocality")).when(k % 4 == 2, part(F.lit("County"), F.lit("Co"), "administrative_area_level_2"))
    road = F.when(k % 3 == 0, F.concat_ws(", ", part(F.lit("Oak St"), F.lit("Oak"), "route"), part(F.lit("Elm St"), F.lit("Elm"), "route")))
    parts = F.concat_ws(", ", part(s(k % 90), s(k % 90), "street_number"), road, city, part(F.concat(F.lit("Z"), "zip_code"), F.lit("Z"), "postal_code"), part(F.lit("United States"), F.lit("us"), "country"))
    types = F.when(k % 7 == 0, "[]").when(k % 2 == 0, '["premise", "street_address"]').otherwise('["premise", "unheard"]')
    place = F.when(k % 5 == 0, '"location_type": "ROOFTOP"').otherwise(F.concat(F.lit('"location_type": "ROOFTOP", "location": {"lat": '), s(k + 0.5), F.lit("}")))
    result = F.concat(F.lit('{"formatted_address": "'), "city", F.lit('", "address_components": ['), parts, F.lit('], "types": '), types, F.lit(', "geometry": {'), place, F.lit("}}"))
    rows = addresses(spark, sf_dir).select("id", F.parse_json(result).alias("r"), F.parse_json(F.concat(F.lit('{"raw": '), result, F.lit("}"))).alias("geo"))
    rows = rows.withColumn("p", metadata.geocode_parts(F.col("r")))
    return rows.select("id", *(f"p.{x}" for x in ("display_name", "house_number", "road", "city", "country_code", "location_type", "address_type", "latitude", "longitude")), metadata.best_type(F.col("p.address_types")).alias("best"), metadata.neighborhood(F.col("geo")).alias("neighborhood"), metadata.component_at(F.col("geo"), ["nothing", "country"]).alias("country"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE c_name || ' // None, }' END AS name, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE c_custkey % 2 = 0 END AS ok, CASE WHEN c_custkey % 6 = 5 THEN 0 WHEN c_custkey % 6 = 4 THEN 3 ELSE 2 END AS n FROM customer""")
def loose_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-1 to K-3: what stands in quotes stays, whatever is put right around it."""
    k, c = F.col("c_custkey"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    name, python = c(F.col("c_name"), " // None, }"), F.when(k % 2 == 0, "True").otherwise("False")
    forms = [
        c('{"name": "', name, '", "ok": ', F.lower(python), "}"),
        c('Here:\n```json\n{"name": "', name, '", // a comment\n "ok": ', python, ",}\n```\nDone."),
        c("{“name”: “", name, "”, “ok”: ", python, "}"),
        c("/* so: */ {name: '", name, "', ok : ", python, "}"),
        c('Result {"name": "', name, '", "ok": ', python, ', "none": None} as asked'),
    ]
    loose = F.lit("no object at all")
    for i, form in enumerate(forms):
        loose = F.when(k % 6 == i, form).otherwise(loose)
    rows = table(spark, sf_dir, "customer").select(k, metadata.loose_object(loose).alias("v"))
    return rows.select(k, metadata.path(F.col("v"), ["$.name"]).alias("name"), metadata.path(F.col("v"), ["$.ok"], "boolean").alias("ok"), F.size(metadata.fields(F.col("v"))).alias("n"))


@query("""SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k, event_type AS building, event_id % 100 AS reverse, CASE WHEN event_id % 100 >= 90 THEN 'pano' END AS status, CASE WHEN event_id % 100 < 90 THEN NULL WHEN event_id % 3 = 0 THEN 'kept' ELSE 'upload' END AS old, CASE WHEN event_id % 100 >= 90 THEN 5 WHEN event_id % 3 = 0 THEN 4 ELSE 3 END AS n FROM events""")
def metadata_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-85, T-86, T-104: members put into events' properties; the street view's only at 90 and more, an earlier snapshot stays."""
    k, c = F.col("event_id"), F.col
    rows = _events(spark, sf_dir).withColumn("m", F.when(k % 3 == 0, metadata.with_fields(c("props"), old=F.parse_json(F.lit('{"by": "kept"}')))).otherwise(c("props")))
    building = F.parse_json(F.concat(F.lit('{"kind": "'), "event_type", F.lit('"}')))
    rows = rows.withColumn("m", metadata.with_fields(c("m"), buildings_address=building, reverse_geocode_confidence_score=F.parse_json((k % 100).cast("string"))))
    rows = rows.withColumn("m", metadata.with_streetview(c("m"), F.parse_json(F.lit('{"status": "pano"}')), F.parse_json(F.lit('{"by": "upload"}')), k % 100))
    at = lambda p, kind="string": metadata.path(c("m"), [p], kind)
    shown = at("$['google street view addresses'].status")
    old = F.when(shown.isNotNull(), at("$.old.by"))
    return rows.select(k, at("$.k", "bigint").alias("k"), at("$.buildings_address.kind").alias("building"), at("$.reverse_geocode_confidence_score", "bigint").alias("reverse"), shown.alias("status"), old.alias("old"), F.size(metadata.fields(c("m"))).alias("n"))


@query(f"""WITH {ADDRESSES} SELECT id, CASE id % 5 WHEN 1 THEN '1 V ' || id::VARCHAR WHEN 2 THEN coalesce(raw_address, '9 Elm Rd') ELSE coalesce(raw_address, '') END AS street, CASE id % 5 WHEN 2 THEN 'Austin' WHEN 3 THEN 'Newtown' ELSE city END AS city, CASE id % 5 WHEN 2 THEN 'TX' WHEN 3 THEN 'GA' ELSE state END AS state,
  CASE id % 5 WHEN 2 THEN '75001' WHEN 3 THEN '12345' ELSE zip_code END AS zip_code, CASE id % 5 WHEN 3 THEN 'CA' ELSE 'US' END AS country, CASE id % 5 WHEN 4 THEN 44.5 WHEN 2 THEN 7.5 ELSE lat END::DOUBLE AS lat, CASE id % 5 WHEN 3 THEN -99.0 ELSE lon END::DOUBLE AS lon,
  CASE WHEN id % 5 = 0 THEN 'final_resolution' WHEN id % 5 = 1 THEN 'agent1_smarty' WHEN id % 5 = 4 OR lat > 90 THEN 'none' ELSE 'upload' END AS origin FROM addr""")
def stage_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-36, C-39, C-43, I-42: parts from the row, its metadata's blocks and whole lines."""
    k, c, js = F.col("id"), F.col, F.lit
    own = spread(addresses(spark, sf_dir))
    meta = (
        F.when(k % 5 == 0, js('{"final_resolution": {"lat": 30.25, "longitude": -90}}'))
        .when(k % 5 == 2, js('{"ADDRESS": "9 Elm Rd, Austin, TX 75001-1234, USA", "Node Latitude": "7.5"}'))
        .when(k % 5 == 3, js('{"new": {"city_state": "Newtown, Georgia", "zip_postal_code": 12345, "longitude": "-99", "country_code": "ca"}}'))
        .otherwise(js("{}"))
    )
    bare = lambda name: F.when(~(k % 5).isin(2, 3), c(name))
    text = lambda: F.lit(None).cast("string")
    rows = own.select(
        "id", "raw_address", bare("city").alias("city"), bare("state").alias("state"), bare("zip_code").alias("zip_code"), F.when(k % 5 == 4, 0.0).when(k % 5 == 2, None).otherwise(c("lat")).alias("lat"), F.when(k % 5 != 3, c("lon")).alias("lon"),
        F.when(k % 5 == 1, F.concat(F.lit("1 V "), k.cast("string"))).alias("validated_street_line"), *(text().alias(n) for n in ("validated_raw_address", "validated_city_state", "validated_postcode", "validated_country_code")),
        *(F.lit(None).cast("double").alias(n) for n in ("validated_lat", "validated_lon")), F.when(k % 5 == 4, 44.5).alias("source_lat"), F.lit(None).cast("double").alias("source_lon"), F.parse_json(meta).alias("meta"),
        F.when(k % 5 == 1, 1.5).alias("smarty_lat"), F.when(k % 5 == 1, 2.5).alias("smarty_lon"), c("lat").alias("real_lat"), c("lon").alias("real_lon"),
    )
    out = inputs.address_input(rows)
    out = out.withColumns({"lat": F.when(k % 5 != 4, c("real_lat")), "lon": c("real_lon")}).withColumn("place", inputs.imagery_place(c("meta")))
    return out.select("id", *(f"input.{n}" for n in ("street", "city", "state", "zip_code", "country", "lat", "lon")), c("place.origin").alias("origin"))


@query(f"""WITH {ADDRESSES}, a AS (SELECT id, city, lat, lon, id % 5 <> 0 AS ok, CASE WHEN id % 31 = 0 THEN 30 ELSE id % 31 END AS rank FROM addr)
SELECT id, ok, CASE WHEN ok THEN city ELSE '' END AS formatted, CASE WHEN ok THEN lat END AS lat, CASE WHEN NOT ok THEN '' WHEN rank <= 10 THEN 'ROOFTOP' WHEN rank <= 20 THEN 'RANGE_INTERPOLATED' WHEN rank <= 25 THEN 'GEOMETRIC_CENTER' ELSE 'APPROXIMATE' END AS location_type,
  CASE WHEN ok THEN 'p' || id::VARCHAR ELSE '' END AS place_id, CASE WHEN ok THEN rank END::INTEGER AS place_rank, CASE WHEN NOT ok THEN 0 WHEN rank <= 10 THEN 93 WHEN rank <= 20 THEN 88 WHEN rank <= 25 THEN 82 ELSE 72 END::DOUBLE AS confidence FROM a""")
def osm_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-14: lists of results, some empty, some whose first one lacks a coordinate."""
    k, s = F.col("id"), lambda c: c.cast("string")
    one = F.concat(F.lit('{"lat": "'), s(F.col("lat")), F.lit('", "lon": '), s(F.col("lon")), F.lit(', "place_rank": '), s(k % 31), F.lit(', "place_id": "p'), s(k), F.lit('", "display_name": "'), "city", F.lit('"}'))
    listed = F.when(k % 10 == 0, "[]").when(k % 5 == 0, F.concat(F.lit('[{"lat": 1}, '), one, F.lit("]"))).otherwise(F.concat(F.lit("["), one, F.lit(', {"lat": 0}]')))
    rows = addresses(spark, sf_dir).select("id", metadata.osm_result(F.parse_json(listed)).alias("r"))
    return rows.select("id", *(f"r.{n}" for n in ("ok", "formatted", "lat", "location_type", "place_id", "place_rank", "confidence")))
