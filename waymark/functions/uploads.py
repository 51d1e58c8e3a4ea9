"""The address of an uploaded row from its columns (inventory K-17, I-25, I-29 to I-38).

``meta`` is a map of an upload's headers to its values. Columns that label a row as residential or commercial are no
addresses, and a street number with a suffix of its own is more exact than a column with the whole address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import strip
from .text import address_key, clean_value, looks_like_street, normalize_header, without_category

#: Labels of residential and commercial rows, and the columns that hold them, first one first.
RESIDENTIAL = ["RES", "RESIDENTIAL", "RESIDENCE", "HOUSEHOLD", "HOUSEHOLDS"]
COMMERCIAL = ["COM", "COMMERCIAL", "BUSINESS"]
TYPE_KEYS = ["Address Type", "address_type", "addr_type", "type", "category"]
#: Columns of each part of an address, first one first.
FULL_KEYS = ["ADDRESS", "Address", "address", "Full Address", "full_address", "Service Address", "service_address", "Property Address", "property_address"]
NUMBER_KEYS = ["Street No", "Street Number", "street_no", "street_number", "house_number"]
SUFFIX_KEYS = ["Street Number Suffix", "street_number_suffix", "Street No Suffix", "street_no_suffix", "house_number_suffix", "Civic Number Suffix", "civic_number_suffix", "Number Suffix", "number_suffix"]
NAME_KEYS = ["Street Name", "street_name", "Street", "street", "road"]
KIND_KEYS = ["Street Type", "street_type", "Street Dir", "street_direction"]
CITY_KEYS = ["City", "city"]
STATE_KEYS = ["State", "state"]
ZIP_KEYS = ["Zip", "ZIP", "zip", "Zip Code", "zip_code", "zipcode", "Postal Code", "postal_code"]

#: Columns of ``with_parts``.
PARTS = [f"__u_{n}" for n in ("full", "raw", "segment", "named", "exact", "whole", "full_is", "raw_is")]


def plain(c: Column) -> Column:
    """Cleaned and stripped; empty where it reads like a null."""
    return F.coalesce(clean_value(strip(c)), F.lit(""))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normal_headers(keys: list[str]) -> list[str]:
    """``normalize_header`` of fixed keys, each once."""
    return list(dict.fromkeys(k.lower().replace("_", " ") for k in keys))


def entries_of(meta: Column) -> Column:
    """Normalised headers with their values, in order."""
    return F.transform(F.map_entries(meta), lambda e: F.struct(normalize_header(e["key"]).alias("k"), e["value"].alias("v")))


def first_of(meta: Column, entries: Column, keys: list[str]) -> Column:
    """K-17: the first value that isn't blank among the columns of these names, as written, then with normalised headers; else empty.

    Of columns whose headers are one when normalised, the first counts, also where it is blank. ``meta`` has ``plain`` values,
    ``entries`` are its own.
    """
    exact = F.transform(F.array(*map(F.lit, keys)), lambda k: F.try_element_at(meta, k))
    normal = F.transform(F.array(*map(F.lit, normal_headers(keys))), lambda k: F.get(F.filter(entries, lambda e: e["k"] == k), F.lit(0))["v"])
    some = lambda values: F.get(F.filter(values, lambda v: v != ""), F.lit(0))
    return F.coalesce(some(exact), some(normal), F.lit(""))


def address_type(c: Column) -> Column:
    """I-34: ``residential`` or ``commercial`` for such labels, else ``unknown``."""
    token = F.upper(plain(c))
    return F.when(token.isin(RESIDENTIAL), "residential").when(token.isin(COMMERCIAL), "commercial").otherwise("unknown")


def is_label(c: Column) -> Column:
    return address_type(c) != "unknown"


def looks_like_address(c: Column) -> Column:
    """I-35: a number and more, or a line with a comma and a digit; no label."""
    t = plain(c)
    return (t != "") & ~is_label(c) & (t.rlike(r"^\s*\d+[A-Za-z]?(?:-\d+[A-Za-z]?)?\s+\S+") | (t.contains(",") & t.rlike(r"\d")))


def with_parts(rows: DataFrame, meta: Column, raw_address: Column, city: Column | None = None, state: Column | None = None, zip_code: Column | None = None) -> DataFrame:
    """``rows`` with ``PARTS``: the parts of each row's address, made column by column, as one expression would hold each of them many times.

    They are no structs: Spark puts a struct's fields in place of what reads them, and so works each out as often.

    I-29 ``street_no``: the number with its suffix; a single letter, or one with a dash or stroke, follows at once, others after
    a space. I-30 ``segment``: number, name and kind of street, the kind only where the line doesn't end with it. I-31
    ``whole``: that with city, state and zip, given or from the columns; empty without a street. I-33 ``exact``: whether
    number and name columns are more exact than a whole address, as they have a suffix or another number.
    """
    c, none = F.col, F.lit(None).cast("string")
    given = {"raw": raw_address, "city": city, "state": state, "zip": zip_code}
    rows = rows.withColumns({"__meta": F.transform_values(meta, lambda _, v: plain(v)), **{f"__given_{n}": plain(none if x is None else x) for n, x in given.items()}})
    rows = rows.withColumn("__entries", entries_of(c("__meta")))
    found = [("number", NUMBER_KEYS), ("suffix", SUFFIX_KEYS), ("name", NAME_KEYS), ("kind", KIND_KEYS), ("full", FULL_KEYS), ("city", CITY_KEYS), ("state", STATE_KEYS), ("zip", ZIP_KEYS)]
    rows = rows.withColumns({f"__p_{n}": first_of(c("__meta"), c("__entries"), keys) for n, keys in found})
    p = lambda n: c(f"__p_{n}")
    raw = c("__given_raw")
    attached = p("suffix").rlike("^[A-Za-z]$") | p("suffix").rlike("^[-/]")
    has_it = (p("suffix") == "") | F.endswith(F.upper(p("number")), F.upper(p("suffix")))
    street_no = F.when((p("number") == "") | has_it, p("number")).when(attached, F.concat(p("number"), p("suffix"))).otherwise(F.concat(p("number"), F.lit(" "), p("suffix")))
    places = {n: _some(F.coalesce(_some(c(f"__given_{n}")), p(n))) for n in ("city", "state", "zip")}
    rows = rows.withColumns({"__no": street_no, "__place": F.concat_ws(", ", _some(F.concat_ws(", ", places["city"], places["state"])), F.substring(places["zip"], 1, 10))})
    rows = rows.withColumn("__line", strip(F.concat_ws(" ", _some(c("__no")), _some(p("name")))))
    ends = F.element_at(F.split(F.upper("__line"), r"\s+"), -1) == F.upper(p("kind"))
    rows = rows.withColumn("__segment", F.when((c("__line") == "") | (p("kind") == "") | ends, c("__line")).otherwise(F.concat("__line", F.lit(" "), p("kind"))))
    own = F.replace(F.upper("__no"), F.lit(" "), F.lit(""))
    leading = lambda t: F.upper(F.regexp_extract(strip(F.get(F.split(t, ",", 2), F.lit(0))), r"^\s*(\d+[A-Za-z]?)", 1))
    rows = rows.withColumn("__other", F.exists(F.array(p("full"), raw), lambda t: looks_like_address(t) & (leading(t) != "") & (leading(t) != own)))
    named = (p("number") != "") & (p("name") != "")
    done = {
        "full": p("full"), "raw": raw, "segment": c("__segment"), "named": named, "exact": named & ((p("suffix") != "") | c("__other")),
        "whole": F.when(c("__segment") == "", "").otherwise(F.concat_ws(", ", "__segment", _some(c("__place")))), "full_is": looks_like_address(p("full")), "raw_is": looks_like_address(raw),
    }
    rows = rows.withColumns({f"__u_{n}": x for n, x in done.items()})
    return rows.drop("__meta", "__entries", "__no", "__place", "__line", "__segment", "__other", *(f"__given_{n}" for n in given), *(f"__p_{n}" for n, _ in found))


def built_address() -> Column:
    """I-36, after ``with_parts``: the best address of an upload's columns; empty where there is a label and nothing else.

    Number and name columns where they are more exact, else a column that looks like an address, the given line that
    does, number and name columns, a whole address that is more than a number, the given line.
    """
    u = lambda n: F.col(f"__u_{n}")
    usable = (u("full") != "") & ~is_label(u("full")) & ~u("full").rlike(r"^\s*\d+[A-Za-z]?(?:-\d+[A-Za-z]?)?\s*$")
    return F.when(u("exact"), u("whole")).when(u("full_is"), u("full")).when(u("raw_is"), u("raw")).when(u("named"), u("whole")).when(usable, u("full")).otherwise(F.when(is_label(u("raw")), "").otherwise(u("raw")))


def built_street() -> Column:
    """I-37, after ``with_parts``: number and street alone, for keys by which tables are merged; empty where there are none."""
    u = lambda n: F.col(f"__u_{n}")
    first_part = lambda t: strip(F.get(F.split(t, ",", 2), F.lit(0)))
    return F.when(u("exact"), u("segment")).when(u("full_is"), first_part(u("full"))).when(u("raw_is"), first_part(u("raw"))).when(u("named"), u("segment")).otherwise("")


def annotated(meta: Column, raw_address: Column) -> Column:
    """I-34: ``meta`` with what its labels say under ``address_type``, ``address_type_code``, ``category``, ``res_com_handled`` and ``address_type_source_value``; columns that are there stay as they are."""
    kinds = F.concat(F.transform(F.array(*map(F.lit, TYPE_KEYS)), lambda k: address_type(F.try_element_at(meta, k))), F.array(address_type(raw_address)))
    kind = F.get(F.filter(kinds, lambda k: k != "unknown"), F.lit(0))
    home = kind == "residential"
    added = [("address_type", F.when(home, "Residential").otherwise("Commercial")), ("address_type_code", F.when(home, "Res").otherwise("Com")), ("category", F.when(home, "household").otherwise("commercial")), ("res_com_handled", F.lit("true")), ("address_type_source_value", F.when(is_label(raw_address), plain(raw_address)))]
    extra = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in added)), lambda e: e["value"].isNotNull() & ~F.map_contains_key(meta, e["key"])))
    return F.when(kind.isNull(), meta).otherwise(F.map_concat(meta, extra))


def best_address(built: Column, validated: Column, chosen: Column, final: Column) -> Column:
    """I-38: the final, chosen or validated line that looks like an address, in this order, else what the upload gives."""
    out = built
    for c in (validated, chosen, final):
        out = F.when(looks_like_address(c), plain(c)).otherwise(out)
    return out


def best_key(address: Column, zip_code: Column) -> Column:
    """The duplicate key of a best address, with the zip's first five behind it unless the key holds them; null without a key."""
    key, zip5 = address_key(address), F.substring(plain(zip_code), 1, 5)
    return F.when(key.isNull() | (zip5 == "") | key.contains(zip5), key).otherwise(F.concat(key, F.lit("|"), zip5))


def upload_line(raw_address: Column, meta: Column, resolved: Column, built: Column) -> Column:
    """I-25: the best street line of an upload: the built address where it looks like one, nothing for a label, else the first candidate that looks like a street, else the first there is.

    Candidates: the address columns and the placemark's name, the given line and a routed one without their category.
    """
    at = lambda k: strip(F.try_element_at(meta, F.lit(k)))
    bare = lambda c: without_category(strip(c), at("category"), at("placemark_name"))
    candidates = F.filter(F.array(at("ADDRESS"), at("Address"), at("address"), at("placemark_name"), bare(raw_address), bare(resolved)), lambda c: (c != "") & ~is_label(c))
    ordered = F.concat(F.filter(candidates, looks_like_street), candidates)
    return F.when(looks_like_address(built), built).when(is_label(raw_address), "").otherwise(F.coalesce(F.get(ordered, F.lit(0)), F.lit("")))
