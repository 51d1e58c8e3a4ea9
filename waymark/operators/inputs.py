"""What a stage gets as its input (inventory C-35 to C-39, C-43, I-42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, lines, metadata, uploads

#: How the United States are written.
UNITED_STATES = ["USA", "UNITED STATES", "U.S.A.", "U.S.", "UNITED STATES OF AMERICA"]
#: Columns of the address that ``address_input`` reads beside ``meta``.
COLUMNS = ["raw_address", "city", "state", "zip_code", "lat", "lon", "validated_street_line", "validated_raw_address", "validated_city_state", "validated_postcode", "validated_country_code", "validated_lat", "validated_lon", "source_lat", "source_lon"]


def country_code(c: Column) -> Column:
    """I-42: in capitals; ``US`` for the United States and for none."""
    t = F.upper(lines.strip(c))
    return F.when((t == "") | t.isin(UNITED_STATES), "US").otherwise(t)


def first_pair(*candidates: tuple[str, Column, Column]) -> Column:
    """C-35, C-39, C-43: struct ``lat``, ``lon``, ``origin`` of the first candidate with a valid pair; ``none`` without one."""
    out = F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit("none").alias("origin"))
    for name, lat, lon in reversed(candidates):
        out = F.when(F.coalesce(geo.valid_pair(lat, lon), F.lit(False)), F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.lit(name).alias("origin"))).otherwise(out)
    return out


def parcel_place(rows: DataFrame) -> Column:
    """C-39: of the columns ``geo_status``, ``geo_lat``, ``geo_lon``, ``smarty_lat``, ``smarty_lon``, ``lat``, ``lon``."""
    geocoded = F.col("geo_status") == "geocoded"
    return first_pair(("agent2_geocoding", F.when(geocoded, F.col("geo_lat")), F.when(geocoded, F.col("geo_lon"))), ("agent1_smarty", F.col("smarty_lat"), F.col("smarty_lon")), ("addresses", F.col("lat"), F.col("lon")))


def imagery_place(meta: Column) -> Column:
    """C-43: of the final resolution, ``smarty_lat`` and ``_lon``, ``validated_lat`` and ``_lon``, the metadata's ``new`` block, ``lat`` and ``lon``."""
    block = lambda p: tuple(metadata.path(meta, [f"$.{p}.{axis}", f"$.{p}.{short}"], "double") for axis, short in (("latitude", "lat"), ("longitude", "lon")))
    c = F.col
    return first_pair(("final_resolution", *block("final_resolution")), ("agent1_smarty", c("smarty_lat"), c("smarty_lon")), ("agent0_validated", c("validated_lat"), c("validated_lon")), ("agent0_validated_metadata", *block("new")), ("upload", c("lat"), c("lon")))


def address_input(rows: DataFrame) -> DataFrame:
    """C-36: ``rows`` (``COLUMNS`` and ``meta``, a VARIANT) with ``input``: the parts of each address that are validated.

    Each part is the first of its sources that isn't blank: the row's own or validated value, the metadata's ``new``
    block, the whole line under ADDRESS or as validated, further keys, the ``old`` block. The street line is the best
    address of the upload; where that has commas, the row's own line or the street of the whole line. Zips are cut to five,
    zeros are no coordinates, an unknown country is US.
    """
    c, none = F.col, F.lit(None).cast("string")
    some = lambda x: F.nullif(lines.strip(x), F.lit(""))
    at = lambda p: some(metadata.path(c("meta"), [f"$.{p}"]))
    plain = F.transform_values(metadata.fields(c("meta")), lambda k, v: F.when(~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(v, "$", "string")))
    rows = rows.withColumns({"__line": F.coalesce(at("ADDRESS"), some(c("validated_raw_address")), F.lit("")), "__map": plain})
    rows = rows.withColumn("__parsed", lines.address_parts(F.when(c("__line").contains(","), c("__line"))))
    rows = rows.withColumns({"__new": lines.city_and_state_code(at("new.city_state")), "__old": lines.city_and_state_code(at("old.city_state")), "__val": lines.city_and_state_code(c("validated_city_state"))})
    rows = uploads.with_parts(rows, c("__map"), c("raw_address"), c("city"), c("state"), c("zip_code"))
    rows = rows.withColumn("__best", uploads.best_address(uploads.built_address(), c("validated_street_line"), F.coalesce(at("new.street_number_name"), none), F.coalesce(at("final_resolution.address"), none)))
    part = lambda name: some(c(f"__parsed.{name}"))
    street = F.when(c("__best").contains(","), F.coalesce(some(c("raw_address")), part("street"), c("__best"))).otherwise(c("__best"))
    zip_code = F.substring(F.coalesce(some(c("zip_code")), some(c("validated_postcode")), at("new.zip_postal_code"), part("zip_code"), at("zip"), at("zip_code"), at("postal"), at("old.zip_postal_code")), 1, 5)
    number = lambda x: F.nullif(x.try_cast("double"), F.lit(0.0))
    rows, found = rows.withColumn("__found", metadata.coordinates_in(c("meta"))), c("__found")
    axis = lambda short, long: F.coalesce(number(c(short)), number(c(f"validated_{short}")), number(at(f"new.{long}")), found[short], number(c(f"source_{short}")))
    place = lambda name: F.coalesce(some(c(name)), some(c(f"__val.{name}")), some(c(f"__new.{name}")), part(name), at(name), some(c(f"__old.{name}")), F.lit(""))
    country = country_code(F.coalesce(some(c("validated_country_code")), at("new.country_code"), at("old.country_code"), at("country_code"), at("country")))
    fields = F.struct(street.alias("street"), place("city").alias("city"), lines.state_code(place("state")).alias("state"), zip_code.alias("zip_code"), country.alias("country"), axis("lat", "latitude").alias("lat"), axis("lon", "longitude").alias("lon"))
    return rows.withColumn("input", fields).drop("__line", "__map", "__parsed", "__new", "__old", "__val", "__best", "__found", *uploads.PARTS)


def street_payload(own: Column) -> Column:
    """C-37: the request of a US street validator from ``input``."""
    return F.struct(own["street"].alias("street"), own["city"].alias("city"), own["state"].alias("state"), F.coalesce(own["zip_code"], F.lit("")).alias("zipcode"), own["country"].alias("country"), F.lit(1).alias("candidates"))


def global_payload(own: Column) -> Column:
    """C-38: the request of a global validator from ``input``."""
    return F.struct(own["street"].alias("a1"), own["city"].alias("loc"), own["state"].alias("admarea"), F.coalesce(own["zip_code"], F.lit("")).alias("postal"), own["country"].alias("ctry"), F.lit("JSON").alias("format"))
