"""Inputs of stages: parts of an address and places by precedence."""

import json

from pyspark.sql import functions as F

from waymark.operators import inputs

SCHEMA = ", ".join(f"{c} {'double' if c.endswith(('lat', 'lon')) else 'string'}" for c in inputs.COLUMNS)


def given(spark, meta=None, **values):
    row = tuple(values.get(c) for c in inputs.COLUMNS)
    frame = spark.createDataFrame([(*row, json.dumps(meta or {}))], f"{SCHEMA}, m string").withColumn("meta", F.parse_json("m"))
    return inputs.address_input(frame)


def test_parts_by_precedence(spark):
    whole = {"ADDRESS": "214 Walnut Dr, Americus, GA 31719, USA"}
    assert tuple(given(spark, whole).first().input) == ("214 Walnut Dr", "Americus", "GA", "31719", "US", None, None)
    assert tuple(given(spark, whole, raw_address="1 Oak St", city="Austin", zip_code="75001-1234", lat=30.0, lon=-90.0).first().input) == ("1 Oak St", "Austin", "GA", "75001", "US", 30.0, -90.0)
    new = {"new": {"street_number_name": "5 Elm Rd", "city_state": "Waco, texas", "latitude": "31.5", "longitude": 0, "country_code": "mx"}, "lng": -97.0, "old": {"zip_postal_code": "11111"}}
    assert tuple(given(spark, new, raw_address="5 Elm").first().input) == ("5 Elm Rd", "Waco", "TX", "11111", "MX", 31.5, -97.0)
    final = {"final_resolution": {"address": "9 Final St"}, "new": {"street_number_name": "8 New St"}, "country": "U.S."}
    got = given(spark, final, raw_address="Res", validated_street_line="7 Valid St", validated_city_state="Reno, Nevada", source_lat=1.0, source_lon=2.0, lat=0.0)
    assert tuple(got.first().input) == ("9 Final St", "Reno", "NV", None, "US", 1.0, 2.0)
    street = got.select(inputs.street_payload(F.col("input")).alias("s"), inputs.global_payload(F.col("input")).alias("g")).first()
    assert street.s.zipcode == "" and street.s.candidates == 1 and street.g.loc == "Reno" and street.g.format == "JSON"
    assert tuple(given(spark).first().input) == ("", "", "", None, "US", None, None)


def test_places_by_precedence(spark):
    rows = [("geocoded", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), ("failed", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), (None, None, None, 91.0, 4.0, 5.0, 6.0), ("geocoded", 1.0, None, None, None, None, 6.0)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, geo_status string, geo_lat double, geo_lon double, smarty_lat double, smarty_lon double, lat double, lon double")
    got = [tuple(r.p) for r in frame.select("i", inputs.parcel_place(frame).alias("p")).orderBy("i").collect()]
    assert got == [(1.0, 2.0, "agent2_geocoding"), (3.0, 4.0, "agent1_smarty"), (5.0, 6.0, "addresses"), (None, None, "none")]
