"""Provider results as tables (inventory 2.N, 2.J, 2.K): lookups by rounded place or key, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..functions import geo, text


def place_key(lat: Column, lon: Column, places: int = 5) -> Column:
    """B.16: the cache's key of a place."""
    return F.concat(F.format_string(f"%.{places}f", lat), F.lit(","), F.format_string(f"%.{places}f", lon))


def looked_up(rows: DataFrame, results: DataFrame, places: int = 5, reject_m: float = 2000.0) -> DataFrame:
    """N-1, N-3, N-12: rows (``id``, ``lat``, ``lon``) with a reverse result (``place``, ``result_lat``, ``result_lon``, ...) of the same rounded place, unless that lies further away than ``reject_m``. Each place is looked up once however many rows share it."""
    keyed = rows.withColumn("place", place_key(F.col("lat"), F.col("lon"), places))
    joined = keyed.join(results, "place", "left")
    near = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("result_lat"), F.col("result_lon")) <= reject_m
    kept = [F.when(near, F.col(c)).alias(c) for c in results.columns if c != "place"]
    return joined.select(*keyed.columns, *kept)


def best_result(results: DataFrame) -> DataFrame:
    """G-1, G-2: the best of each row's results (``id``, ``position``, ``types``, ``location_type``, ``formatted_address``) by score; none at or below 0, of equals the first."""
    t = F.coalesce(F.col("types"), F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(t, F.array(*map(F.lit, names)))
    score = (
        F.when(has("street_address", "premise", "subpremise"), 100).otherwise(0)
        + F.when(has("point_of_interest", "establishment"), 25).otherwise(0)
        - F.when(has("locality", "political", "postal_code", "country"), 75).otherwise(0)
        + F.when(F.col("location_type") == "ROOFTOP", 40).when(F.col("location_type") == "RANGE_INTERPOLATED", 30).when(F.col("location_type") == "GEOMETRIC_CENTER", 10).otherwise(0)
        + F.when(F.col("formatted_address").rlike(r"^\d"), 25).otherwise(0)
    )
    scored = results.withColumn("score", score).filter(F.col("score") > 0)
    columns = [c for c in scored.columns if c != "id"]
    return scored.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("score", -F.col("position"))).alias("best")).select("id", "best.*")


def source_bonus(source: Column, distance_m: Column, pinned: Column, has_number: Column) -> Column:
    """J-25: for OSM 10 when pinned to the source, else 6 within 100 m; for interpolated results 8 with a house number, and 6 within 200 m or 3 within 500 m."""
    osm = F.when(pinned, 10).when(distance_m <= 100, 6).otherwise(0)
    interpolated = F.when(has_number, 8).otherwise(0) + F.when(distance_m <= 200, 6).when(distance_m <= 500, 3).otherwise(0)
    return F.when(source == "OSM", osm).when(source == "INTERPOLATED", interpolated).otherwise(0)


def fallback_penalty(source: Column, distance_m: Column) -> Column:
    """J-24: OSM 2 and interpolated results 5, within 50 m 1 and 3."""
    return F.when(source == "OSM", F.when(distance_m <= 50, 1).otherwise(2)).when(source == "INTERPOLATED", F.when(distance_m <= 50, 3).otherwise(5)).otherwise(0)


def estimated_cap(estimated: Column, distance_m: Column) -> Column:
    """J-26: 99; for estimated results 92 within 50 m, 88 within 200 m, else 82."""
    return F.when(estimated, F.when(distance_m <= 50, 92.0).when(distance_m <= 200, 88.0).otherwise(82.0)).otherwise(99.0)


def forward_confidence(base: Column, matched: Column, distance_m: Column, coord_status: Column, *, reverse_score: Column | None = None, validation_status: Column | None = None, validation_score: Column | None = None, source: Column | None = None, pinned: Column | None = None, has_number: Column | None = None, estimated: Column | None = None) -> Column:
    """J-27: the provider's base. Where the text matches: bonuses by distance and status, 5 for a reverse score of 80 or more, 6 for AUTO_ACCEPT or else 4 for a validation score of 80 or more, the source's bonus and penalty; elsewhere at most 35. From 0 up to the cap of estimated results. What isn't given counts as null."""
    pinned, has_number, estimated = (F.lit(None).cast("boolean") if c is None else c for c in (pinned, has_number, estimated))
    source, reverse_score, validation_score, validation_status = (F.lit(None) if c is None else c for c in (source, reverse_score, validation_score, validation_status))
    bonus = F.when(distance_m <= 20, 15).when(distance_m <= 50, 12).when(distance_m <= 100, 8).when(distance_m <= 200, 4).when(distance_m > 500, -12).otherwise(0)
    status = F.upper(F.trim(coord_status))
    status = F.when(status == "MATCH", 8).when(status == "MISMATCH_WARN", -5).when(status == "MISMATCH", -15).otherwise(0)
    reverse = F.when(F.floor(reverse_score) >= 80, 5).otherwise(0)
    validated = F.when(F.upper(validation_status) == "AUTO_ACCEPT", 6).when(F.floor(validation_score) >= 80, 4).otherwise(0)
    full = base + bonus + status + reverse + validated + source_bonus(source, distance_m, pinned, has_number) - fallback_penalty(source, distance_m)
    score = F.when(matched, full).otherwise(F.least(base, F.lit(35.0)))
    return F.greatest(F.lit(0.0), F.least(score, estimated_cap(estimated, distance_m)))


def parcels(rows: DataFrame, parcel: DataFrame, county: DataFrame) -> DataFrame:
    """L-25: parcel result 95, else the county's 85, 80 or 75 by how it was found, else 30 with a county's name, else 0; with the land use."""
    joined = rows.join(parcel.select(F.col("id"), F.col("land_use").alias("parcel_use")), "id", "left").join(county.select("id", "county", "match_type"), "id", "left")
    by_type = F.when(F.col("match_type") == "within", 85).when(F.col("match_type") == "near", 80).when(F.col("match_type") == "nearest", 75)
    score = F.when(F.col("parcel_use").isNotNull(), 95).otherwise(F.coalesce(by_type, F.when(F.col("county").isNotNull(), 30), F.lit(0)))
    return joined.select("id", text.land_use(F.col("parcel_use"), F.col("raw_address")).alias("land_use"), score.alias("confidence"))


def history_append(history: Column, stage: Column, score: Column, accepted: Column) -> Column:
    """K-5, K-6: one more entry of an array of structs ``stage``, ``score``, ``accepted``."""
    return F.array_append(history, F.struct(stage.alias("stage"), score.alias("score"), accepted.alias("accepted")))


def tag_confidence(tags: Column, words: list[str]) -> Column:
    """E-17: the largest confidence of the tags (structs ``name``, ``confidence``) among the words; 0 without one."""
    own = F.filter(tags, lambda t: F.lower(t["name"]).isin(words))
    return F.coalesce(F.array_max(F.transform(own, lambda t: t["confidence"])), F.lit(0.0))


def component(components: Column, kinds: list[str]) -> Column:
    """K-11: the long name of the first component that has one of the types, types tried in order."""
    picks = [F.get(F.filter(components, lambda c, k=k: F.array_contains(c["types"], k)), F.lit(0))["long_name"] for k in kinds]
    return F.coalesce(*picks)


def validation_score(rows: DataFrame) -> DataFrame:
    """L-9, C-30: kept where the best provider score exceeds 90, or the place is a rooftop's."""
    best = F.greatest(*[F.coalesce(conf.percent_score(F.col(c)), F.lit(0)) for c in ("smarty", "google", "osm")])
    return rows.withColumn("best", best).withColumn("kept", (F.col("best") > 90) | F.coalesce(F.col("location_type") == "ROOFTOP", F.lit(False)))


def ocr_consensus(detections: DataFrame) -> DataFrame:
    """E-7, F-f: the house number of each address with the largest sum of weights: the k-th sight of a number weighs its
    confidence, 0.8 k, and a bonus by length. Numbers that can't be one don't count; where the expected number (digits)
    is among the others, it alone counts. Of equals the one seen first.

    ``detections``: id, position, number, confidence, expected (or null). The weights of n sights sum to the confidences
    and 0.4 n (n + 1), so no window is needed.
    """
    bonus = F.when(F.length("number") == 3, 1.0).when(F.length("number") == 4, 1.5).when(F.length("number") == 5, 1.2).otherwise(0.0)
    hit = F.coalesce(F.col("number") == F.nullif(F.regexp_replace("expected", "[^0-9]", ""), F.lit("")), F.lit(False))
    sums = detections.filter(text.valid_house_number(F.col("number"))).groupBy("id", "number").agg(F.sum("confidence").alias("s"), F.count(F.lit(1)).alias("n"), F.min("position").alias("at"), F.max(hit).alias("hit"))
    weighed = sums.withColumn("weight", F.col("s") + F.lit(0.4) * F.col("n") * (F.col("n") + 1) + F.col("n") * bonus)
    order = F.struct("hit", F.round("weight", 9).alias("w"), (-F.col("at")).alias("at"))
    return weighed.groupBy("id").agg(F.max_by("number", order).alias("number"), F.round(F.max_by("weight", order), 4).alias("weight"))
