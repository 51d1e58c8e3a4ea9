"""Uploaded rows to the canonical schema (inventory 2.C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text, uploads

#: Headers (as ``normalize_header`` leaves them) of each canonical column.
ALIASES = {
    "city": ["city", "city name", "municipality", "town", "locality"],
    "state": ["state", "st", "state code", "province"],
    "zip_code": ["zip", "zip code", "zipcode", "postal code", "zip5", "postcode", "post code"],
    "latitude": ["lat", "latitude", "y", "y coordinate", "y coord", "northing", "decimal latitude", "latitude dd", "lat dec", "network node latitude", "node latitude", "node lat", "service latitude", "service lat", "drop latitude", "drop lat", "geo latitude", "geographic latitude", "point latitude", "coord lat", "location latitude", "site latitude", "premise latitude"],
    "longitude": ["lon", "lng", "long", "longitude", "x", "x coordinate", "x coord", "easting", "decimal longitude", "longitude dd", "lon dec", "network node longitude", "node longitude", "node lon", "node lng", "service longitude", "service lon", "drop longitude", "drop lon", "geo longitude", "geographic longitude", "point longitude", "coord lon", "coord lng", "location longitude", "site longitude", "premise longitude"],
    "network_node": ["node", "network node", "fiber node", "serving area", "service area", "hub", "pon", "network node name", "node name", "serving node"],
    "terminal_id": ["terminal", "terminal id", "terminalid", "terminal number", "terminalnumber", "tap", "mst", "fat", "tap id", "fat id", "mst id"],
    "address_id": ["address id", "addressid", "addr id", "customer id", "cust id", "location id", "id", "service id", "account id"],
    "coordinates": ["coordinates", "coords", "coordinate"],
}
#: Address headers, first one first; and others that count when none of these is there.
ADDRESS_FIRST = ["address", "secondary number", "secondarynumber", "street address", "street address 1", "service address", "full address", "property address", "delivery address", "site address", "premise address", "customer address", "placemark name", "name2", "location address", "location name"]
ADDRESS_ALSO = ["address 1", "address line 1", "address line", "addr1", "raw address", "work location", "installation address", "drop address", "node address", "service location", "service point address", "rawaddress"]


def named_values(fields: Column) -> Column:
    """C-2: headers, normalised, with cleaned values, in column order, without blank headers."""
    return F.filter(F.transform(F.map_entries(fields), lambda e: F.struct(text.normalize_header(e["key"]).alias("key"), text.clean_value(e["value"]).alias("value"))), lambda e: e["key"] != "")


def lookup(entries: Column) -> Column:
    """C-2: of ``named_values``, a column: header to value; values that are null are left out.

    Of columns whose headers are one when normalised, the last one's value counts, in the first one's place.
    """
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"].alias("value")))
    return F.filter(last, lambda e: e["value"].isNotNull())


def first_value(entries: Column, names: list[str]) -> Column:
    """C-3: the value of the first column, in the file's order, whose header is among the names."""
    return F.get(F.filter(entries, lambda e: e["key"].isin(names)), F.lit(0))["value"]


#: Columns that the upload itself adds, and those that may name an exchange.
UPLOAD_KEYS = ["upload_batch_id", "upload_file_index", "original_source_file", "source_format", "file_role", "upload_group_source_files"]
EXCHANGE_KEYS = ["win_exchange_id", "data_source", "noc_plan_desc", "network_node", "gcomms_ft_to_bb"]


def map_records(rows: DataFrame, labels: bool = True) -> DataFrame:
    """C-1 to C-6: rows with ``fields`` to canonical columns.

    Where either coordinate is absent, both come from the pair column; coordinates that aren't a valid pair are null. A
    city or state that isn't there is the exchange's. With ``labels``, the address is the best that the columns give
    (residential and commercial labels are none) and its key has the zip; without, it is the first address column, or
    the placemark's name. ``uploaded`` has the upload's own columns, ``meta`` these with what labels say, ``old`` the mapped
    values at this time.
    """
    e, fields = F.col("__entries"), F.col("fields")
    raw = lambda k: F.try_element_at(fields, F.lit(k))
    either = lambda *keys: text.clean_value(F.coalesce(*(F.nullif(raw(k), F.lit("")) for k in keys)))
    address = F.coalesce(*[first_value(e, [n]) for n in ADDRESS_FIRST], first_value(e, ADDRESS_ALSO), either("placemark_name", "name"))
    c = F.col
    rows = rows.withColumn("__named", named_values(fields)).withColumn("__entries", lookup(c("__named")))
    first = {"__pair": ALIASES["coordinates"], "__y": ALIASES["latitude"], "__x": ALIASES["longitude"], "__id": ALIASES["address_id"]}
    rows = rows.withColumns({n: first_value(e, names) for n, names in first.items()} | {"__node": either("win_lon", "WIN_LON"), "raw_address": address})
    pair_lat, pair_lon = geo.parse_coordinate(c("__pair"))
    rows = rows.withColumns({"__y": c("__y").try_cast("double"), "__x": c("__x").try_cast("double")})
    from_pair = (c("__y").isNull() | c("__x").isNull()) & c("__pair").isNotNull()
    rows = rows.withColumns({"__lat": F.when(from_pair, pair_lat).otherwise(c("__y")), "__lon": F.when(from_pair, pair_lon).otherwise(c("__x"))})
    valid = geo.mapper_pair(c("__lat"), c("__lon"))
    hint_city, hint_state = place_hint(*map(raw, EXCHANGE_KEYS))
    own_id, node = c("__id"), c("__node")
    uploaded = F.map_filter(fields, lambda k, v: ~k.isin(UPLOAD_KEYS) & ~F.startswith(k, F.lit("_")))
    out = rows.withColumns(
        {
            "city": F.coalesce(first_value(e, ALIASES["city"]), hint_city),
            "state": text.normalize_state(F.coalesce(first_value(e, ALIASES["state"]), hint_state)),
            "zip_code": text.normalize_zip(first_value(e, ALIASES["zip_code"])),
            "lat": F.when(valid, c("__lat")),
            "lon": F.when(valid, c("__lon")),
            "network_node": first_value(e, ALIASES["network_node"]),
            "terminal_id": first_value(e, ALIASES["terminal_id"]),
            "address_id": F.when((own_id.isNull() | own_id.isin("0", "0.0")) & F.startswith(F.upper(node), F.lit("A")), node).otherwise(own_id),
            "uploaded": uploaded,
            "meta": uploads.annotated(fields, c("raw_address")) if labels else fields,
        }
    )
    some = lambda name: F.coalesce(c(name), F.lit(""))
    if labels:
        out = uploads.with_parts(out, c("meta"), c("raw_address"), c("city"), c("state"), c("zip_code"))
        out = out.withColumn("__built", uploads.built_address())
        # built once more from itself, the address would be the same, so its key is that of the record
        out = out.withColumn("raw_address", F.coalesce(F.nullif("__built", F.lit("")), "raw_address"))
        key = uploads.best_key(c("__built"), c("zip_code"))
    else:
        place = F.when(c("zip_code").isNotNull(), c("zip_code")).when(c("city").isNotNull() & c("state").isNotNull(), F.concat_ws("|", F.upper("city"), F.upper("state")))
        key = F.when(text.address_key(c("raw_address")).isNotNull(), F.concat_ws("|", text.address_key(c("raw_address")), place))
    both = F.when((some("city") != "") & (some("state") != ""), F.concat_ws(", ", "city", "state")).otherwise(F.concat(some("city"), some("state")))
    old = F.struct(some("raw_address").alias("street_number_name"), some("zip_code").alias("zip_postal_code"), c("lat").alias("latitude"), c("lon").alias("longitude"), both.alias("city_state"), some("city").alias("city"), some("state").alias("state"), F.lit("").alias("country_code"))
    return out.withColumns({"normalized_key": key, "old": old}).drop("__named", "__entries", "__pair", "__y", "__x", "__id", "__node", "__lat", "__lon", "__built", *uploads.PARTS)


def household(category: Column, folder_path: Column) -> Column:
    """C-7: whether category or a folder names households or addresses."""
    parts = F.array_append(F.split(F.lower(F.coalesce(folder_path, F.lit(""))), "/"), F.lower(F.coalesce(category, F.lit(""))))
    return F.arrays_overlap(F.transform(parts, F.trim), F.array(*map(F.lit, ["household", "households", "address", "addresses"])))


def routes(rows: DataFrame) -> DataFrame:
    """C-15: which stages a row goes through: both, geocode only, validator only, or none."""
    has_address, has_coords = F.col("raw_address").isNotNull(), geo.valid_pair(F.col("lat"), F.col("lon"))
    return rows.withColumn("route", F.when(has_address & has_coords, "both").when(has_address, "geocode").when(has_coords, "validator").otherwise("skipped"))


#: Exchange codes and their place.
EXCHANGES = {"AMRC": ("Americus", "GA")}


def place_hint(*values: Column) -> tuple[Column, Column]:
    """C-6: (city, state) that exchange codes in the values hint at; else the state before the digits or at the end of such a code."""
    hay = F.upper(F.concat_ws(" ", *[F.coalesce(text.clean_value(v), F.lit("")) for v in values]))
    city, state = F.lit(None).cast("string"), F.nullif(F.regexp_extract(hay, r"\b[A-Z]{4}([A-Z]{2})\b", 1), F.lit(""))
    state = F.coalesce(F.nullif(F.regexp_extract(hay, r"\b([A-Z]{2})\d{3,}[A-Z]{3,}\b", 1), F.lit("")), state)
    for code, (named, of) in reversed(EXCHANGES.items()):
        city, state = F.when(hay.contains(code), named).otherwise(city), F.when(hay.contains(code), of).otherwise(state)
    return city, state
