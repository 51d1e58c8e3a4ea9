"""Column functions over strings and addresses (inventory 2.I). All stay in the JVM but ``token_set_ratio``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as null.
NULL_LIKE = ["", "none", "null", "nan", "nat", "n/a", "na", "<na>"]
#: Words of an address key, in the order in which they are replaced.
KEY_WORDS = [("N", "NORTH"), ("S", "SOUTH"), ("E", "EAST"), ("W", "WEST"), ("STREET", "ST"), ("AVENUE", "AVE"), ("BOULEVARD", "BLVD"), ("DRIVE", "DR"), ("ROAD", "RD"), ("COURT", "CT"), ("LANE", "LN")]
#: Words of the search key, in the order in which they are replaced.
SEARCH_WORDS = [("drive", "dr"), ("avenue", "ave"), ("street", "st"), ("road", "rd"), ("lane", "ln"), ("court", "ct"), ("terrace", "ter"), ("georgia", "ga"), ("florida", "fl"), ("usa", ""), ("united states", "")]


def clean_value(c: Column) -> Column:
    """I-1: trimmed, and null where it reads like a null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(NULL_LIKE), t)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_header(c: Column) -> Column:
    """I-2: lower case, without name-space prefix, one space between words."""
    t = F.regexp_replace(F.lower(c), r"^ns\d+:", "")
    return squeeze(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def address_key(c: Column) -> Column:
    """I-3: the duplicate key of an address; null when nothing is left."""
    t = F.upper(F.trim(c))
    for word, short in KEY_WORDS:
        t = F.regexp_replace(t, rf"\b{word}\b", short)
    return F.nullif(F.trim(F.regexp_replace(t, "[^A-Z0-9]+", " ")), F.lit(""))


def duplicate_key(c: Column) -> Column:
    """I-4: cleaned, then keyed."""
    return address_key(clean_value(c))


def stored_key(address: Column, zip_code: Column) -> Column:
    """I-39: the key with ``|zip5`` behind it, unless the key holds the zip already."""
    key, zip5 = address_key(address), F.substring(zip_code, 1, 5)
    return F.when(zip5.isNull() | (zip5 == "") | key.contains(zip5), key).otherwise(F.concat(key, F.lit("|"), zip5))


def compare_value(c: Column) -> Column:
    """I-6: upper case, whole numbers without ``.0``, squeezed."""
    return squeeze(F.regexp_replace(F.upper(F.trim(c)), r"^(\d+)\.0$", "$1"))


def normalize_zip(c: Column) -> Column:
    """I-9."""
    return F.nullif(F.regexp_replace(F.trim(c), r"^(\d+)\.0$", "$1"), F.lit(""))


def normalize_state(c: Column) -> Column:
    """I-10."""
    return F.upper(F.nullif(F.trim(c), F.lit("")))


def search_key(c: Column) -> Column:
    """Q-b: lower case, short suffixes and states, no country, one space between words."""
    t = F.lower(c)
    for word, short in SEARCH_WORDS:
        t = F.regexp_replace(t, rf"\b{word}\b", short)
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def safe_table_name(c: Column) -> Column:
    """I-12: ``src_`` and the file's stem as a slug."""
    stem = F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("src_"), slug)


def extract_zip(c: Column) -> Column:
    """I-15."""
    return F.nullif(F.regexp_extract(c, r"\b(\d{5})(?:-\d{4})?\b", 1), F.lit(""))


#: Forms of a leading house number, tried in this order: with a fraction, with a letter, with a letter apart
#: that is no direction, alone; and the first number anywhere.
NUMBER_FRACTION = r"^(\d+(?:-\d+)?(?:\s*[½¼¾]|\s*1/[234]|\s*3/4|-[½¼¾]|-1/[234]|-3/4))(?:\s|,|$)"
NUMBER_LETTER = r"^(\d+(?:-\d+)?[A-Za-z])\b"
NUMBER_UNIT = r"^(\d+(?:-\d+)?)\s+([A-DF-MO-RT-VX-Za-df-mo-rt-vx-z])\b"
NUMBER_PLAIN = r"^(\d+(?:-\d+)?)\b"
NUMBER_ANYWHERE = r"\b(\d+(?:-\d+)?[A-Za-z]?)\b"
FRACTIONS = (("½", "1/2"), ("¼", "1/4"), ("¾", "3/4"))


def house_number(c: Column) -> Column:
    """I-16: the leading number with its fraction or letter, else the first number anywhere; null without one."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    fraction = F.upper(F.regexp_extract(t, NUMBER_FRACTION, 1))
    for sign, digits in FRACTIONS:
        fraction = F.replace(fraction, F.lit(sign), F.lit(f" {digits}"))
    unit = F.concat(F.regexp_extract(t, NUMBER_UNIT, 1), F.regexp_extract(t, NUMBER_UNIT, 2))
    found = [squeeze(fraction), F.regexp_extract(t, NUMBER_LETTER, 1), unit, F.regexp_extract(t, NUMBER_PLAIN, 1), F.regexp_extract(t, NUMBER_ANYWHERE, 1)]
    return F.coalesce(*[F.nullif(F.upper(f), F.lit("")) for f in found])


def normalize_house_number(c: Column) -> Column:
    """I-17: without spaces, with fractions in digits; empty for null."""
    t = F.upper(c)
    for sign, digits in FRACTIONS:
        t = F.replace(t, F.lit(sign), F.lit(digits))
    t = F.regexp_replace(t, r"\s+", "")
    return F.coalesce(F.replace(F.replace(t, F.lit("-1/"), F.lit("1/")), F.lit("-3/"), F.lit("3/")), F.lit(""))


def house_numbers_equal(a: Column, b: Column) -> Column:
    """I-18: both there and equal."""
    x, y = normalize_house_number(a), normalize_house_number(b)
    return (x != "") & (x == y)


def house_numbers_differ(a: Column, b: Column) -> Column:
    """Two numbers that are both there and not equal."""
    x, y = normalize_house_number(a), normalize_house_number(b)
    return (x != "") & (y != "") & (x != y)


def house_numbers_match(a: Column, b: Column) -> Column:
    """I-19: of two lines; also true where either has none."""
    return ~house_numbers_differ(house_number(a), house_number(b))


def strip_house_number(c: Column) -> Column:
    """I-20: the line without its leading number in the first form that it has; empty for null."""
    t = F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    out = t
    for form in (NUMBER_PLAIN, NUMBER_UNIT, NUMBER_LETTER, NUMBER_FRACTION):
        out = F.when(t.rlike(form), F.regexp_replace(F.regexp_replace(t, form, ""), "^[ ,]+", "")).otherwise(out)
    return out


def match_text(c: Column) -> Column:
    """I-13: lower case, ordinals as numbers, words alone."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\b(\d+)(?:st|nd|rd|th)\b", "$1")
    return squeeze(F.regexp_replace(t, r"(?U)[^\w\s]", " "))


def without_category(line: Column, category: Column, placemark: Column) -> Column:
    """I-24: the placemark's name where the line is ``category: placemark``, empty where it is the category alone."""
    t, own, name = (F.trim(F.coalesce(x, F.lit(""))) for x in (line, category, placemark))
    whole = (own != "") & (name != "") & (F.lower(t) == F.lower(F.concat(own, F.lit(": "), name)))
    return F.when(whole, name).when((own != "") & (F.lower(t) == F.lower(own)), "").otherwise(t)


def comparison_candidates(address: Column, formatted: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """I-23: the distinct texts that an upload line is compared with, in this order."""
    parts = F.split(formatted, ",")
    return F.array_distinct(F.array(input_line(address, city, state, zip_code), F.trim(address), F.trim(formatted), F.trim(parts[0]), F.trim(F.concat_ws(",", F.slice(parts, 1, 2)))))


def match_percent(address: Column, formatted: Column, number: Column, formatted_number: Column) -> Column:
    """I-26: how far an upload line agrees with a geocoder's line, 0 to 100, given the house numbers of both.

    0 where either is blank; at most 40 where both have a house number and these differ; else 100 where the upload line
    has any word. (City, state, zip and distance can only raise a score; it is 100 already, as the line itself is among
    the texts that it is compared with.) Only lines whose numbers differ are compared word by word.
    """
    blank = (F.trim(F.coalesce(address, F.lit(""))) == "") | (F.trim(F.coalesce(formatted, F.lit(""))) == "")
    same = ~house_numbers_differ(number, formatted_number)
    ratio = token_set_ratio(F.when(~blank & ~same, address), formatted)
    return F.when(blank, 0).when(~same, F.least(ratio, F.lit(40))).when(match_text(address) == "", 0).otherwise(100).cast("int")


def match_percent_for_geo(percent: Column, address: Column, number: Column, geo_number: Column) -> Column:
    """I-28: ``percent`` of the line, at most 40 where the result's own house number differs; 100 for a blank upload line."""
    differ = house_numbers_differ(number, geo_number)
    return F.when(F.trim(F.coalesce(address, F.lit(""))) == "", 100).when(differ, F.least(percent, F.lit(40))).otherwise(percent).cast("int")


def matches_exactly(percent: Column, required: int = 100) -> Column:
    """I-27."""
    return percent >= required


def looks_like_street(c: Column) -> Column:
    """I-21: a number and more, or two words."""
    t = squeeze(c)
    return F.coalesce(t.rlike(r"^\d+\S*\s+\S") | (F.size(F.split(t, " ")) >= 2), F.lit(False))


def input_line(address: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """I-22: the address, then ``city, state`` as one part unless the address holds it, then the zip's first five unless it holds them."""
    edge = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    some = lambda c: F.nullif(c, F.lit(""))
    line = F.coalesce(address, F.lit(""))
    place, zip5 = some(F.concat_ws(", ", some(edge(city)), some(edge(state)))), some(F.substring(edge(zip_code), 1, 5))
    return F.concat_ws(", ", some(edge(line)), F.when(~F.lower(line).contains(F.lower(place)), place), F.when(~line.contains(zip5), zip5))


def suffix_address(address: Column, unit: Column) -> Column:
    """I-51: ``-k`` behind the leading number."""
    return F.when(address.rlike(r"^\d+"), F.concat(F.regexp_extract(address, r"^(\d+)", 1), F.lit("-"), unit.cast("string"), F.regexp_replace(address, r"^\d+", ""))).otherwise(F.concat(address, F.lit("-"), unit.cast("string")))


def clean_ocr(c: Column) -> Column:
    """I-57: letters that are misread digits."""
    return F.translate(F.upper(c), "OILSBZ", "011582")


def noise_house_number(c: Column) -> Column:
    """I-59: no digits, 0 or 1, or padded with zeros."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return digits.rlike("^(0*[01]?|0+[0-9]{2})$")


def valid_house_number(c: Column) -> Column:
    """I-58: two to five digits, not noise and no year. The digits are a lambda's variable, made once a row; as an expression they would be made in each condition of a filter."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")

    def valid(d: Column) -> Column:
        n, length = d.try_cast("int"), F.length(d)
        return length.between(2, 5) & (n >= F.when(length == 2, 2).otherwise(100)) & ~n.between(1900, 2100)

    return F.exists(F.array(digits), valid)


def address_tokens(c: Column) -> Column:
    """T-33: distinct alphanumeric tokens."""
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit("([A-Z0-9]+)"), 1))


def land_use(parcel: Column, address: Column) -> Column:
    """I-54: the parcel's own value, else keywords of the address, in this order."""
    a = F.lower(F.coalesce(address, F.lit("")))
    return (
        F.when(clean_value(parcel).isNotNull(), clean_value(parcel))
        .when(a.rlike(r"\bapt\b|apartment|unit #|ste |suite| #"), "Multi-Family")
        .when(a.rlike("hwy|highway|industrial|warehouse|park"), "Commercial")
        .when(a.rlike(r"\b(st|street|ave|avenue|rd|road|dr|drive|ln|lane|ct|court|blvd|boulevard)\b"), "Single-Family")
        .otherwise("Unknown")
    )


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a whole row of the table in the bits of one integer: a cleared bit is a step up."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        met = row & where.get(y, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def _indel(a: str, b: str) -> float:
    """Indel similarity in percent, from the longest common subsequence."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _token_set(a: str | None, b: str | None) -> int:
    x, y = (set((s or "").split()) for s in (a, b))
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    scores = [_indel(left, right)] + ([_indel(both, left), _indel(both, right)] if both else [])
    return round(max(scores))


def token_set_ratio(left: Column, right: Column) -> Column:
    """I-14: how alike two texts' sets of words are, 0 to 100; equal texts aren't taken apart."""
    left, right = match_text(left), match_text(right)
    same = (left == right) & (left != "")

    def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([_token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    return F.when(same, 100).otherwise(F.pandas_udf(ratio, "int")(F.when(~same, left), right))
