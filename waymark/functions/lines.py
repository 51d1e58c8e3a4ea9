"""Whole address lines to their parts (inventory I-40, I-41, T-91, T-131) and the likeness of two lines (I-52)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import address_tokens

#: Names and codes of the states, in natural order.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT",
    "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL",
    "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT",
    "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY",
    "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA",
    "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT",
    "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
#: Countries that may end a line.
COUNTRIES = ["USA", "US", "UNITED STATES"]
STATE_AND_ZIP = r"^([A-Za-z]{2,})\s+(\d{5}(?:-\d{4})?)$"
#: Words that don't tell one street from another.
STREET_STOPWORDS = "REDDICK FL FLORIDA USA US MARION GA GEORGIA ST STREET RD ROAD DR DRIVE AVE AVENUE TER TERRACE LN LANE CT COURT BLVD BOULEVARD HWY HIGHWAY NW NE SW SE N S E W".split()


def strip(c: Column) -> Column:
    """Without white space at both ends; empty for null."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def state_code(c: Column) -> Column:
    """I-41: two letters as they are, else the code of a state's name, else the text; in capitals, empty for null."""
    s = F.upper(strip(c))
    codes = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    return F.coalesce(F.try_element_at(codes, s), s)


def city_and_state(c: Column) -> Column:
    """T-131: struct of what stands before and after the first comma; without one all is the city."""
    s = strip(c)
    parts = F.split(s, ",", 2)
    return F.struct(strip(F.get(parts, F.lit(0))).alias("city"), strip(F.get(parts, F.lit(1))).alias("state"))


def city_and_state_code(c: Column) -> Column:
    """T-91: as ``city_and_state``, with the state's code."""
    own = city_and_state(c)
    return F.struct(own["city"].alias("city"), state_code(own["state"]).alias("state"))


def address_parts(c: Column) -> Column:
    """I-40: struct ``street``, ``city``, ``state``, ``zip_code`` of a line with commas, all empty where they aren't there.

    The parts are taken up from the left by a state machine: street, city, then state and zip; a country at the end is
    dropped first, and a third part is read only for a zip that the second one doesn't have.
    """
    parts = F.filter(F.transform(F.split(strip(c), ","), strip), lambda p: p != "")
    last = F.upper(F.get(parts, F.size(parts) - 1))
    tail = F.when((F.size(parts) > 1) & last.isin(COUNTRIES), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    empty = F.struct(F.lit(0).alias("at"), *(F.lit("").alias(x) for x in ("street", "city", "state", "zip_code")))

    def step(s: Column, p: Column) -> Column:
        found, zip_code = F.regexp_extract(p, STATE_AND_ZIP, 1), F.substring(F.regexp_extract(p, STATE_AND_ZIP, 2), 1, 5)
        both = p.rlike(STATE_AND_ZIP)
        again = (s["at"] == 3) & (s["zip_code"] == "") & both
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(s["at"] == 0, p).otherwise(s["street"]).alias("street"),
            F.when(s["at"] == 1, p).otherwise(s["city"]).alias("city"),
            F.when((s["at"] == 2) & ~both, state_code(p)).when((s["at"] == 2) | again, state_code(found)).otherwise(s["state"]).alias("state"),
            F.when(((s["at"] == 2) & both) | again, zip_code).otherwise(s["zip_code"]).alias("zip_code"),
        )

    done = F.aggregate(tail, empty, step)
    return F.struct(*(F.coalesce(done[x], F.lit("")).alias(x) for x in ("street", "city", "state", "zip_code")))


def leading_number(c: Column) -> Column:
    """The digits that a line begins with, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d+)", 1), F.lit(""))


def line_zip(c: Column) -> Column:
    """The last five digits that stand alone behind the leading number, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*\d+\b.*\b(\d{5})(?:-\d{4})?\b", 1), F.lit(""))


def street_tokens(c: Column) -> Column:
    """The distinct words of a line that tell its street: no numbers, no suffixes, directions or states."""
    return F.filter(address_tokens(F.coalesce(c, F.lit(""))), lambda t: ~t.isin(STREET_STOPWORDS) & ~t.rlike("^[0-9]+$"))


def line_facts(c: Column) -> Column:
    """What lines are compared by, made once a line: struct ``upper``, ``number``, ``words``, ``street``."""
    line = F.coalesce(c, F.lit(""))
    return F.struct(F.upper(line).alias("upper"), leading_number(line).alias("number"), address_tokens(line).alias("words"), street_tokens(line).alias("street"))


def facts_match(a: Column, b: Column) -> Column:
    """D-12's filter: equal leading numbers where both have one, and a street word in common where both have some; true where either line is blank."""
    blank = (a["upper"] == "") | (b["upper"] == "")
    numbers = F.coalesce(a["number"] == b["number"], F.lit(True))
    return blank | (numbers & ((F.size(a["street"]) == 0) | (F.size(b["street"]) == 0) | F.arrays_overlap(a["street"], b["street"])))


def facts_score(a: Column, b: Column) -> Column:
    """I-52: 100 for equal leading numbers (-1 for different ones), 5 for each word in common up to 40, 20 where one line holds the other; 0 where either is blank."""
    same = a["number"] == b["number"]
    words = F.least(F.size(F.array_intersect(a["words"], b["words"])) * 5, F.lit(40))
    score = F.when(same, 100).otherwise(0) + words + F.when(F.contains(a["upper"], b["upper"]) | F.contains(b["upper"], a["upper"]), 20).otherwise(0)
    return F.when((a["upper"] == "") | (b["upper"] == ""), 0).when(~same, -1).otherwise(score).cast("int")


def lines_match(a: Column, b: Column) -> Column:
    return facts_match(line_facts(a), line_facts(b))


def line_score(a: Column, b: Column) -> Column:
    return facts_score(line_facts(a), line_facts(b))
