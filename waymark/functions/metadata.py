"""Nested metadata as VARIANT: loose JSON, paths in order of precedence, deep merges, geocoders' results (inventory 2.K, T-85, T-86, T-104)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import confidence as conf

#: How exact the kinds of an address are.
TYPE_QUALITY = {"street_address": 100, "premise": 95, "subpremise": 92, "house": 90, "residential": 88, "building": 85, "establishment": 75, "point_of_interest": 70, "route": 45, "road": 45, "intersection": 40, "postal_code": 25, "neighborhood": 20, "locality": 15}
#: Keys whose texts may say which rule a row falls under, and objects whose texts may.
TEXT_KEYS = ["COMMENTS", "comments", "comment", "Comment", "remark", "remarks", "merge_reason", "rule_reason", "reason", "record_status", "validation_status"]
TEXT_OBJECTS = ["merge_classification", "address_validation", "final_resolution"]
LITERAL = r'"(?:[^"\\]|\\.)*"'


def _tidied(t: Column) -> Column:
    """Loose JSON to JSON: comments, single and curly quotes, Python's literals, bare keys and trailing commas; what stands in quotes stays."""
    tokens = F.regexp_extract_all(t, F.lit(rf"(?s)({LITERAL}|'(?:[^'\\]|\\.)*'|“[^”]*”|‘[^’]*’|//[^\n]*|/\*.*?\*/|[^\"'“‘/]+|.)"), F.lit(1))

    def token(x: Column) -> Column:
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        requoted = F.concat(F.lit('"'), F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
        return F.when(x.rlike(r"^(//|/\*)"), "").when(x.rlike("^(?s)['“‘].*['”’]$"), requoted).when(F.startswith(x, F.lit('"')), x).otherwise(bare)

    joined = F.array_join(F.transform(tokens, token), "")
    parts = F.regexp_extract_all(joined, F.lit(rf'(?s)({LITERAL}|[^"]+|")'), F.lit(1))

    def part(x: Column) -> Column:
        keyed = F.regexp_replace(x, r"([{,]\s*)([A-Za-z_][\w.-]*)(\s*:)", '$1"$2"$3')
        return F.when(F.startswith(x, F.lit('"')), x).otherwise(F.regexp_replace(keyed, r",(\s*[}\]])", "$1"))

    return F.array_join(F.transform(parts, part), "")


def loose_json(c: Column) -> Column:
    """K-1, K-3: the VARIANT of a text that holds JSON, in a fence, alone, or as its first to last brace or bracket; tidied where it is only nearly JSON. Null where nothing is."""
    t = F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    fence = F.nullif(F.regexp_extract(t, r"(?s)```(?:json|JSON)?\s*(.*?)\s*```", 1), F.lit(""))
    block = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    tries = [fence, t, block, _tidied(F.coalesce(fence, block, t))]
    return F.coalesce(*(F.try_parse_json(x) for x in tries))


def is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def loose_object(c: Column) -> Column:
    """K-2: as ``loose_json``, the empty object where that is none."""
    v = loose_json(c)
    return F.when(is_object(v), v).otherwise(F.parse_json(F.lit("{}")))


def fields(v: Column) -> Column:
    """The members of an object as a map; an empty one for what is no object."""
    none = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.when(is_object(v), F.try_variant_get(v, "$", "map<string,variant>")), none)


def path(v: Column, paths: list[str], kind: str = "string") -> Column:
    """The first of the paths that leads to a value of the kind; paths begin with ``$``."""
    return F.coalesce(*(F.try_variant_get(v, p, kind) for p in paths))


def text_at(v: Column, p: str) -> Column:
    """The text at a path, null where there is none or something else."""
    own = F.try_variant_get(v, p, "variant")
    return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(own, "$", "string"))


def to_object(m: Column) -> Column:
    """A map of VARIANTs to an object."""
    return F.to_variant_object(m)


def with_fields(v: Column, **values: Column) -> Column:
    """T-85, T-86: an object with members put in or replaced; what is no object counts as an empty one. Values are VARIANTs; null ones are left out."""
    new = F.map_filter(F.create_map(*(x for k, value in values.items() for x in (F.lit(k), value))), lambda k, x: x.isNotNull())
    old = F.map_filter(fields(v), lambda k, x: ~F.map_contains_key(new, k))
    return to_object(F.map_concat(old, new))


def merged(a: Column, b: Column, depth: int = 3) -> Column:
    """Both objects' members; where both have one, ``b``'s counts, but objects are merged in turn, ``depth`` levels down. ``b`` alone where either is no object; ``a`` where ``b`` is null."""
    if depth == 0:
        return F.coalesce(b, a)
    x, y = fields(a), fields(b)
    both = to_object(F.map_zip_with(x, y, lambda k, p, q: merged(p, q, depth - 1)))
    return F.when(is_object(a) & is_object(b), both).otherwise(F.coalesce(b, a))


def payload_confidence(v: Column) -> Column:
    """K-7: the first of confidence, confidence_score and score that is a percentage."""
    return F.coalesce(*(conf.percent_score(F.try_variant_get(v, f"$.{k}", "double")) for k in ("confidence", "confidence_score", "score")))


def meta_texts(v: Column) -> Column:
    """K-8: the texts under the fixed keys in their order, then all texts of the fixed objects; blank ones are left out."""
    own = F.array(*(text_at(v, f"$.{k}") for k in TEXT_KEYS))
    inner = [F.transform(F.map_values(fields(F.try_variant_get(v, f"$.{k}", "variant"))), lambda x: text_at(x, "$")) for k in TEXT_OBJECTS]
    return F.filter(F.concat(own, *inner), lambda t: t.isNotNull() & (F.trim(t) != ""))


COMPONENTS = "array<struct<long_name:string,short_name:string,types:array<string>>>"


def _component(parts: Column, kinds: list[str], names: tuple[str, str]) -> Column:
    """The first component with one of the types, types tried in order: its first name that isn't empty, trimmed."""
    some = lambda p, n: F.nullif(p[n], F.lit(""))
    hits = F.flatten(F.transform(F.array(*map(F.lit, kinds)), lambda kind: F.filter(parts, lambda p: F.array_contains(p["types"], kind))))
    hit = F.get(hits, F.lit(0))
    return F.coalesce(F.trim(F.coalesce(some(hit, names[0]), some(hit, names[1]))), F.lit(""))


def neighborhood(v: Column) -> Column:
    """K-10: of a geocode's ``raw`` result; empty without one."""
    parts = F.try_variant_get(v, "$.raw.address_components", COMPONENTS)
    return _component(parts, ["neighborhood", "sublocality", "sublocality_level_1", "locality", "postal_code"], ("long_name", "short_name"))


def component_at(v: Column, kinds: list[str]) -> Column:
    """K-11: the short name of a component of a geocode's ``raw`` result."""
    return _component(F.try_variant_get(v, "$.raw.address_components", COMPONENTS), kinds, ("short_name", "long_name"))


def geocode_parts(v: Column) -> Column:
    """K-12: a geocoder's result as a struct; for each type the first component that has it counts, texts are empty where they are absent."""
    parts = F.try_variant_get(v, "$.address_components", COMPONENTS)
    named = lambda kind: F.get(F.filter(parts, lambda p: F.array_contains(p["types"], kind)), F.lit(0))["long_name"]
    some = lambda c: F.nullif(c, F.lit(""))
    text = lambda c: F.coalesce(c, F.lit(""))
    countries = F.filter(F.transform(F.filter(parts, lambda p: F.array_contains(p["types"], "country")), lambda p: p["short_name"]), lambda s: s.isNotNull() & (s != ""))
    types = F.coalesce(F.try_variant_get(v, "$.types", "array<string>"), F.array().cast("array<string>"))
    place = F.try_variant_get(v, "$.geometry.location", "variant")
    return F.struct(
        text(F.try_variant_get(v, "$.formatted_address", "string")).alias("display_name"),
        text(named("street_number")).alias("house_number"),
        text(named("route")).alias("road"),
        text(F.coalesce(some(named("locality")), some(named("sublocality")), named("administrative_area_level_2"))).alias("city"),
        text(named("administrative_area_level_1")).alias("state"),
        text(named("postal_code")).alias("postcode"),
        text(named("country")).alias("country"),
        text(F.substring(F.upper(F.get(countries, F.size(countries) - 1)), 1, 8)).alias("country_code"),
        text(F.try_variant_get(v, "$.geometry.location_type", "string")).alias("location_type"),
        text(F.get(types, F.lit(0))).alias("address_type"),
        types.alias("address_types"),
        F.when(place.isNotNull(), F.coalesce(F.try_variant_get(place, "$.lat", "double"), F.lit(0.0))).alias("latitude"),
        F.when(place.isNotNull(), F.coalesce(F.try_variant_get(place, "$.lng", "double"), F.lit(0.0))).alias("longitude"),
    )


def best_type(types: Column) -> Column:
    """K-13: of an array of an address's kinds the most exact one, the first of equals; empty without one."""
    quality = F.create_map(*(F.lit(x) for pair in TYPE_QUALITY.items() for x in pair))
    known = F.filter(F.transform(types, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    ranked = F.transform(known, lambda t, i: F.struct(F.coalesce(F.try_element_at(quality, t), F.lit(0)).alias("q"), (-i).alias("i"), t.alias("t")))
    return F.coalesce(F.array_max(ranked)["t"], F.lit(""))


def coordinates_in(v: Column) -> Column:
    """K-16: struct ``lat``, ``lon`` of the first members, by name, whose names say so and whose values are in range; zeros, booleans, objects and lists don't count.

    An object's members have no order of their own in VARIANT, so they are tried by name.
    """
    none = F.lit(None).cast("double")
    members = F.filter(F.map_entries(fields(v)), lambda e: ~F.schema_of_variant(e["value"]).rlike("^(OBJECT|ARRAY|BOOLEAN|VOID)"))
    numbers = F.transform(members, lambda e: F.struct(F.lower(e["key"]).alias("k"), F.nullif(F.try_variant_get(e["value"], "$", "double"), F.lit(0.0)).alias("v")))
    numbers = F.filter(numbers, lambda e: e["v"].isNotNull())

    def step(s: Column, e: Column) -> Column:
        lat = s["lat"].isNull() & e["k"].rlike(r"\blat(itude)?\b") & e["v"].between(-90, 90)
        lon = ~lat & s["lon"].isNull() & e["k"].rlike(r"\b(lon|lng|long(itude)?)\b") & e["v"].between(-180, 180)
        return F.struct(F.when(lat, e["v"]).otherwise(s["lat"]).alias("lat"), F.when(lon, e["v"]).otherwise(s["lon"]).alias("lon"))

    return F.aggregate(numbers, F.struct(none.alias("lat"), none.alias("lon")), step)


def with_streetview(v: Column, block: Column, old: Column, confidence: Column, least: int = 90) -> Column:
    """T-104: ``block`` under its key, and ``old`` where the metadata has none, if the rounded confidence reaches ``least``; else as it was. All but ``confidence`` are VARIANTs."""
    enough = F.coalesce(F.bround(confidence) >= least, F.lit(False))
    kept = F.coalesce(F.try_variant_get(v, "$.old", "variant"), old)
    return F.when(enough, with_fields(v, **{"old": kept, "google street view addresses": block})).otherwise(v)


#: The largest place rank of each kind of location, with its confidence; what is beyond is approximate.
PLACE_RANKS = [(10, "ROOFTOP", 93.0), (20, "RANGE_INTERPOLATED", 88.0), (25, "GEOMETRIC_CENTER", 82.0)]
APPROXIMATE = ("APPROXIMATE", 72.0)


def osm_result(v: Column) -> Column:
    """K-14: struct ``ok``, ``formatted``, ``lat``, ``lon``, ``location_type``, ``place_id``, ``place_rank``, ``confidence`` of the first of a geocoder's results.

    Not ok, and empty, without a result or where it lacks a coordinate, as text or number; rank 30 where it has none or 0.
    """
    first = F.try_variant_get(v, "$[0]", "variant")
    at = lambda p, kind: F.try_variant_get(first, f"$.{p}", kind)
    lat, lon = at("lat", "double"), at("lon", "double")
    rank = F.coalesce(F.nullif(at("place_rank", "int"), F.lit(0)), F.lit(30))
    kind, sure = F.lit(APPROXIMATE[0]), F.lit(APPROXIMATE[1])
    for most, name, score in reversed(PLACE_RANKS):
        kind, sure = F.when(rank <= most, name).otherwise(kind), F.when(rank <= most, score).otherwise(sure)
    ok = lat.isNotNull() & lon.isNotNull()
    text = lambda c: F.when(ok, F.coalesce(c, F.lit(""))).otherwise("")
    return F.struct(
        ok.alias("ok"), text(at("display_name", "string")).alias("formatted"), F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"), text(kind).alias("location_type"),
        text(at("place_id", "string")).alias("place_id"), F.when(ok, rank).alias("place_rank"), F.when(ok, sure).otherwise(0.0).alias("confidence"),
    )
