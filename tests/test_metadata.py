"""Nested metadata: loose JSON, paths, merges."""

import json

from pyspark.sql import functions as F

from waymark.functions import metadata


def run(spark, rows, expr):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    return [r.x for r in frame.select("i", expr(F.try_parse_json("a"), F.try_parse_json("b")).alias("x")).orderBy("i").collect()]


def test_loose_json(spark):
    texts = {
        '{"a": 1}': {"a": 1},
        'Sure:\n```json\n{"a": [1, 2,], }\n```\nbye': {"a": [1, 2]},
        '{"url": "http://x//y /* no */", "t": "None, True,}"} // end': {"url": "http://x//y /* no */", "t": "None, True,}"},
        "{'it': 'say \"hi\"', n: None, ok: True, 'e': 'don\\'t'}": {"it": 'say "hi"', "n": None, "ok": True, "e": "don't"},
        "{“a”: “b ’c’”, // x\n “d”: False,}": {"a": "b ’c’", "d": False},
        '/* lead */ {"a": {"b": [True, {c: 1,},],},}': {"a": {"b": [True, {"c": 1}]}},
        "text [1, 2] text": [1, 2],
        '{"a": "unfinished': None,
        "   ": None,
        "nothing": None,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = [r.x for r in rows.select("i", F.to_json(metadata.loose_json(F.col("t"))).alias("x")).orderBy("i").collect()]
    assert [None if x is None else json.loads(x) for x in got] == [*texts.values(), None]
    objects = [r.x for r in rows.select("i", F.to_json(metadata.loose_object(F.col("t"))).alias("x")).orderBy("i").collect()]
    assert [json.loads(x) for x in objects] == [v if isinstance(v, dict) else {} for v in [*texts.values(), None]]


def test_merges(spark):
    rows = [('{"x":1,"o":{"p":1,"q":{"r":1}}}', '{"y":"s","o":{"p":[2],"q":{"t":null}}}'), ('{"x":1}', "5"), ('{"x":1}', None), (None, '{"x":1}'), ("[1]", '{"a":2}'), ("{}", "{}")]
    got = run(spark, rows, lambda a, b: F.to_json(metadata.merged(a, b)))
    assert [json.loads(x) for x in got] == [{"x": 1, "y": "s", "o": {"p": [2], "q": {"r": 1, "t": None}}}, 5, {"x": 1}, {"x": 1}, {"a": 2}, {}]
    got = run(spark, [('{"x":1,"z":2}', '{"n":1}'), ("7", "1"), (None, "1"), ('{"x":1}', None)], lambda a, b: F.to_json(metadata.with_fields(a, z=b)))
    assert [json.loads(x) for x in got] == [{"x": 1, "z": {"n": 1}}, {"z": 1}, {"z": 1}, {"x": 1}]


def test_paths(spark):
    rows = [('{"confidence": 0.87}', None), ('{"confidence": "none", "score": 55}', None), ('{"confidence": null}', None), (None, None), ("[]", None), ('{"confidence_score": "91.6", "score": 1}', None)]
    assert run(spark, rows, lambda a, b: metadata.payload_confidence(a).cast("int")) == [87, 55, None, None, None, 92]
    rows = [('{"reason": "x", "COMMENTS": "y", "remark": 5, "remarks": " ", "address_validation": {"k": "v", "n": 1}, "merge_classification": "no"}', None), ("5", None), (None, None)]
    assert run(spark, rows, lambda a, b: metadata.meta_texts(a)) == [["y", "x", "v"], [], []]
    rows = [('{"Lat": "33.5", "Lng": -84.2}', None), ('{"plat": 1, "latitude": 95, "node latitude": 12, "longitude": true}', None), ('{"lat": 0, "lon": {"a": 1}}', None), (None, None)]
    assert [tuple(x) for x in run(spark, rows, lambda a, b: metadata.coordinates_in(a))] == [(33.5, -84.2), (12.0, None), (None, None), (None, None)]


def test_geocodes(spark):
    part = lambda long, short, *types: {"long_name": long, "short_name": short, "types": list(types)}
    result = {"formatted_address": "1 Oak", "address_components": [part("1", "1", "street_number"), part("Oak Street", "Oak", "route"), part("Soho", "S", "sublocality", "political"), part("30301", "30301", "postal_code"), part("United States", "us", "country", "political")], "types": ["premise"], "geometry": {"location": {"lat": 1.5}, "location_type": "ROOFTOP"}}
    rows = [(json.dumps(result), None), ("{}", None), (None, None)]
    one, two, three = run(spark, rows, lambda a, b: metadata.geocode_parts(a))
    assert (one.house_number, one.road, one.city, one.postcode, one.country, one.country_code, one.location_type, one.address_type, one.latitude, one.longitude) == ("1", "Oak Street", "Soho", "30301", "United States", "US", "ROOFTOP", "premise", 1.5, 0.0)
    assert two == three and two.city == "" and two.latitude is None and two.address_types == []
    raw = [(json.dumps({"raw": result}), None), ('{"raw": 5}', None), (None, None)]
    assert run(spark, raw, lambda a, b: metadata.neighborhood(a)) == ["Soho", "", ""]
    assert run(spark, raw, lambda a, b: metadata.component_at(a, ["x", "route"])) == ["Oak", "", ""]
    kinds = spark.createDataFrame([(0, ["route", " Premise ", "x"]), (1, ["unheard", "other"]), (2, []), (3, None), (4, ["road", "route"])], "i int, t array<string>")
    assert [r.x for r in kinds.select("i", metadata.best_type(F.col("t")).alias("x")).orderBy("i").collect()] == ["premise", "unheard", "", "", "road"]


def test_streetview(spark):
    f = lambda n: lambda a, b: F.to_json(metadata.with_streetview(a, b, F.parse_json(F.lit('"up"')), F.lit(n)))
    key = "google street view addresses"
    rows = [('{"x": 1}', '{"s": 1}'), ('{"old": 5}', '{"s": 1}')]
    assert [json.loads(x) for x in run(spark, rows, f(90.0))] == [{"x": 1, "old": "up", key: {"s": 1}}, {"old": 5, key: {"s": 1}}]
    assert [json.loads(x) for x in run(spark, rows, f(89.4))] == [{"x": 1}, {"old": 5}] and json.loads(run(spark, rows, f(None))[0]) == {"x": 1}


def test_osm_results(spark):
    one = {"lat": "33.5", "lon": -84.25, "display_name": "1 Oak", "place_id": 77, "place_rank": 20}
    rows = [(json.dumps([one, {**one, "lat": "1"}]), None), ("[]", None), (None, None), (json.dumps([{**one, "lat": ""}]), None), (json.dumps([{**one, "place_rank": 0}]), None), (json.dumps([{**one, "place_rank": 10}]), None), (json.dumps([{"lat": 1, "lon": 2, "place_rank": 25}]), None)]
    got = [tuple(x) for x in run(spark, rows, lambda a, b: metadata.osm_result(a))]
    empty = (False, "", None, None, "", "", None, 0.0)
    assert got == [(True, "1 Oak", 33.5, -84.25, "RANGE_INTERPOLATED", "77", 20, 88.0), empty, empty, empty, (True, "1 Oak", 33.5, -84.25, "APPROXIMATE", "77", 30, 72.0), (True, "1 Oak", 33.5, -84.25, "ROOFTOP", "77", 10, 93.0), (True, "", 1.0, 2.0, "GEOMETRIC_CENTER", "", 25, 82.0)]
