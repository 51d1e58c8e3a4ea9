"""Building, imagery, validation and discovery rules over stage rows (inventory 2.B, 2.D, 2.E, 2.L, 2.M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..functions import text
from . import spatial


def footprint_match(rows: DataFrame) -> DataFrame:
    """L-26, L-27: a footprint (``distance_m``, ``area_m2``) more than 30 m away is rejected; more than 45 m, or large, it marks a vacant lot."""
    far = F.coalesce(F.col("distance_m") > 30, F.lit(False))
    vacant = far & ((F.col("distance_m") > 45) | F.coalesce(F.col("area_m2") >= 300, F.lit(False)))
    return rows.withColumns({"rejected": far, "vacant_signal": vacant})


def building_confidence(rows: DataFrame) -> DataFrame:
    """L-32: the band's confidence, raised to floors by coordinate match, validation score and footprint distance."""
    matched = F.when(F.col("coord_status") == "MATCH", F.when(F.col("coord_m") <= 5, 92).when(F.col("coord_m") <= 15, 88).otherwise(85)).otherwise(0)
    validated = F.when(F.col("validation") >= 99, 90).when(F.col("validation") >= 90, 85).otherwise(0)
    near = F.when(F.col("distance_m") <= 10, 90).when(F.col("distance_m") <= 20, 85).when(F.col("distance_m") <= 35, 80).when(F.col("distance_m") <= 50, 75).otherwise(0)
    return rows.withColumn("confidence", F.greatest(F.col("band"), matched, validated, near).cast("int"))


def coordinates_unreliable(status: Column, distance_m: Column) -> Column:
    """T-46."""
    return F.coalesce(status.isin("MISMATCH", "MISMATCH_WARN", "NO_COORDS") | (distance_m > 30), F.lit(False))


def imagery_score(tag: Column, crops: Column, has_metadata: Column, aerial_tags: Column, agreeing_views: Column, ocr: Column, unit_words: Column, good_quality: Column) -> Column:
    """L-37, its six sub-scores alone (structure, units, flags and floors are left out): their sum, 100 at most, halves to even: tag confidence by 50, crops up to 10, metadata 20, aerial tags 3 each up to 15, agreeing views 5 each up to 10, OCR 25 (10 with unit words), quality 10 or 5."""
    total = tag * 50 + F.least(crops, F.lit(10)) + F.when(has_metadata, 20).otherwise(0) + F.least(aerial_tags * 3, F.lit(15)) + F.least(agreeing_views * 5, F.lit(10)) + F.when(unit_words, 10).when(ocr, 25).otherwise(0) + F.when(good_quality, 10).otherwise(5)
    return F.bround(F.least(total, F.lit(100.0))).cast("int")


def validator_result(rows: DataFrame) -> DataFrame:
    """L-21: equal house numbers give 100 and AUTO_ACCEPT, others 35 and MANUAL_REVIEW; then a hard mismatch gives REJECT and 30 at most."""
    equal = text.house_numbers_equal(text.house_number(F.col("raw_address")), text.house_number(F.col("standardized")))
    score, status = F.when(equal, 100).otherwise(35), F.when(equal, "AUTO_ACCEPT").otherwise("MANUAL_REVIEW")
    hard = F.coalesce(F.col("coord_status").isin("ADDRESS_MISMATCH", "MISMATCH"), F.lit(False))
    return rows.withColumns({"confidence": F.when(hard, F.least(score, F.lit(30))).otherwise(score).cast("int"), "validation_status": F.when(hard, "REJECT").otherwise(status)})


def status_counters(rows: DataFrame, by: str) -> DataFrame:
    """E-11, E-12, E-c: how many rows of each group matched, mismatched or neither, in one aggregation."""
    match, mismatch = conf.is_match(F.col("status")), conf.is_mismatch(F.col("status"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(match).alias("matched"), F.count_if(mismatch & ~match).alias("mismatched"), F.count_if(~match & ~mismatch).alias("other"))


def without_unconfirmed(rows: DataFrame, scores: DataFrame, gate: int = 90) -> tuple[DataFrame, DataFrame]:
    """B-14: rows without the discovered ones that no stage confirms at the gate; and the ids that went."""
    confirmed = scores.filter(F.col("score") >= gate).select(F.col("address_id").alias("id")).distinct()
    gone = rows.filter("discovered").select("id").join(confirmed, "id", "left_anti")
    return rows.join(gone, "id", "left_anti"), gone


def new_geocodes(found: DataFrame, known: DataFrame, near_m: float = 25.0) -> DataFrame:
    """D-19, E-5: ``outcome`` of each geocode (``id``, ``ord``, ``address``, ``lat``, ``lon``, ``polygon_id``).

    In this order: ``failed`` without address or coordinates, ``outside`` any polygon, ``known`` by its key or near a
    known place, ``repeated`` by the key or near the place of an earlier new one, else ``new``.
    """
    keyed = found.withColumn("key", text.address_key(F.col("address")))
    keys = known.select(text.address_key(F.col("address")).alias("known_key")).filter("known_key is not null").distinct()
    near = spatial.near_any(keyed, known, near_m).select("id", "near")
    failed = (F.trim(F.coalesce("address", F.lit(""))) == "") | F.col("lat").isNull() | F.col("lon").isNull()
    outcome = F.when(failed, "failed").when(F.col("polygon_id").isNull(), "outside").when(F.col("known_key").isNotNull() | F.col("near"), "known")
    judged = keyed.join(keys, F.col("key") == F.col("known_key"), "left").join(near, "id").withColumn("outcome", outcome)
    new = spatial.first_of_key_or_place(judged.filter("outcome is null"), near_m).withColumn("new", F.lit(True))
    return judged.join(new, "id", "left").select("id", "key", F.coalesce("outcome", F.when(F.col("new"), "new"), F.lit("repeated")).alias("outcome"))


def tighter_views(current: Column, recommended: Column, steps: int = 5) -> Column:
    """M-4: fields of view to try, the recommended one first, all below the current one; none when that is too narrow already."""
    ladder = F.array(*map(F.lit, (25, 22, 20, 18, 15)))
    rest = F.filter(ladder, lambda v: (v < current) & (recommended.isNull() | (v != recommended)))
    head = F.when(recommended < current, F.array(recommended)).otherwise(F.array().cast("array<int>"))
    return F.when(current <= 15, F.array().cast("array<int>")).otherwise(F.slice(F.concat(head, rest), 1, steps))


def duration(seconds: Column) -> Column:
    """J-44: ``1h 5m``, ``5m 3s`` or ``7s``."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def parsed_json(c: Column) -> Column:
    """K-1, K-3: the object of a loosely written JSON text, as a map of texts: fences, comments, trailing commas and Python's literals are put right first; null where that isn't enough."""
    t = F.regexp_replace(c, r"(?s)^.*?```(?:json)?\s*(.*?)```.*$", "$1")
    t = F.regexp_replace(t, r"(?m)^\s*//.*$", "")
    t = F.translate(t, "“”‘’", "\"\"''")
    t = F.regexp_replace(t, r",\s*([}\]])", "$1")
    for python, json in (("None", "null"), ("True", "true"), ("False", "false")):
        t = F.regexp_replace(t, rf"(:\s*){python}\b", f"$1{json}")
    return F.from_json(t, "map<string,string>")
