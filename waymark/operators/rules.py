"""Votes, gates and ladders over stage results (inventory 2.E, 2.L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..functions import geo, text


def wide_stages(scores: DataFrame, stages: list[str], addresses: DataFrame | None = None) -> DataFrame:
    """C-45, D-6: one row per address with each stage's score, status and structure: one aggregation instead of a join per stage.

    With ``addresses`` (``address_id``), all of them and no others have a row, with nulls where a stage has no result.
    """
    pick = lambda c, s: F.max(F.when(F.col("stage") == s, F.col(c))).alias(f"{s}_{c}")
    picks = [pick(c, s) for s in stages for c in ("score", "status", "structure")]
    if addresses is None:
        return scores.groupBy("address_id").agg(*picks)
    every = scores.withColumn("listed", F.lit(False)).unionByName(addresses.select("address_id", F.lit(True).alias("listed")), allowMissingColumns=True)
    return every.groupBy("address_id").agg(F.max("listed").alias("listed"), *picks).filter("listed").drop("listed")


def majority(votes: Column) -> Column:
    """E-6: the commonest of an array of votes but 'Unknown' and nulls; of equals the first."""
    known = F.filter(votes, lambda v: v.isNotNull() & (v != "Unknown"))
    best = F.array_max(F.transform(F.array_distinct(known), lambda v: F.struct(F.size(F.filter(known, lambda x: x == v)).alias("n"), (-F.array_position(known, v)).alias("at"), v.alias("v"))))
    return F.coalesce(best["v"], F.lit("Unknown"))


def low_confidence(scores: DataFrame, gate: int = 90, stages: tuple[str, ...] = ("agent1", "agent2", "agent3")) -> DataFrame:
    """C-18: addresses with any of the stages' scores below the gate; those without scores are left out."""
    return scores.filter(F.col("stage").isin(*stages)).groupBy("address_id").agg(F.min("score").alias("least")).filter(F.col("least") < gate)


def resolution_gate(scores: DataFrame, stage: str, threshold: int, status_counts: bool) -> DataFrame:
    """L-1: whether a stage resolves an address: a score at the threshold and, for some stages, a status that matches."""
    own = scores.filter(F.col("stage") == stage)
    passed = F.coalesce(F.col("score") >= threshold, F.lit(False))
    if status_counts:
        passed = passed & conf.is_match(F.col("status"))
    return own.select("address_id", "stage", "score", "status", F.when(passed, "accepted").otherwise("continued").alias("decision"))


#: Structure labels, with ``_`` for spaces and hyphens, and their categories.
STRUCTURE_LABELS = {
    "sfh": "SFH", "single_family": "SFH", "single_family_residential": "SFH", "detached_house": "SFH", "house": "SFH", "home": "SFH",
    "mdu": "MDU", "multi_family": "MDU", "multifamily": "MDU", "multi_family_residential": "MDU", "low_rise_apt": "MDU", "high_rise_apt": "MDU", "apartment": "MDU", "apartment_building": "MDU", "townhouse": "MDU",
    "commercial": "Commercial", "industrial": "Commercial", "mixed_use": "Commercial",
    "vacant": "Vacant", "vacant_lot": "Vacant", "empty_lot": "Vacant", "no_structure": "Vacant",
}


def structure_type(c: Column) -> Column:
    """I-55: SFH, MDU, Commercial or Vacant, else Unknown."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[- ]", "_")
    labels = F.create_map(*[F.lit(x) for pair in STRUCTURE_LABELS.items() for x in pair])
    return F.coalesce(labels[key], F.lit("Unknown"))


def synthesize(wide: DataFrame) -> DataFrame:
    """L-22, L-24: final status, structure, units, confidence and priority of each address.

    Reads ``agent1_status``, ``agent1_score``, ``vacant``, ``agent3_land_use``, ``agent4_structure``, ``agent4_score``,
    ``agent5_structure``, ``agent5_detail``, ``agent5_score``, ``units_min``, ``units_max`` and ``house_number_sure``;
    those that ``wide`` lacks count as null.
    """
    own = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in wide.columns else F.lit(other)
    a1, a4, seen5 = own("agent1_score", 0), own("agent4_score", 0), own("agent5_score", 0)
    status, vacant, sure, land = own("agent1_status", "UNKNOWN"), own("vacant", False), own("house_number_sure", False), F.lower(own("agent3_land_use", ""))
    kind4, detail, kind5 = structure_type(own("agent4_structure", "")), structure_type(own("agent5_detail", "")), structure_type(own("agent5_structure", ""))
    kind5 = F.when(detail != "Unknown", detail).otherwise(kind5)
    occupied = kind4.isin("SFH", "MDU", "Commercial") | kind5.isin("SFH", "MDU", "Commercial")
    use = F.when(land.contains("vacant"), F.when(~occupied, "Vacant")).when(land.contains("multi") | land.contains("apartment"), "MDU").when(land.contains("single") | land.contains("sfh"), "SFH").when(land.contains("commercial"), "Commercial")
    voted = wide.withColumn("vote_pool", F.filter(F.array(kind4, kind5, use), lambda v: v.isNotNull() & (v != "Unknown")))
    votes, kind = F.col("vote_pool"), majority(F.col("vote_pool"))
    some = lambda c: F.coalesce(F.nullif(own(c, 1), F.lit(0)), F.lit(1))
    units = F.when(kind == "Vacant", 0).otherwise(F.greatest(some("units_min"), some("units_max")))
    final = F.when(kind != "MDU", kind).when(units >= 8, "MDU_LARGE").otherwise("MDU_SMALL")
    agreement = F.when(F.size(votes) == 0, 0).when(F.size(F.array_distinct(votes)) == 1, 100).otherwise(50)
    a5 = F.when(sure, F.greatest(seen5, F.lit(90))).otherwise(seen5)
    score = F.least(F.lit(100), (a1 * 0.4 + F.greatest(a4, a5) * 0.4 + agreement * 0.2).cast("int"))
    score = F.when(sure & (final != "Unknown"), F.greatest(score, F.lit(90))).otherwise(score)
    priority = F.when(final == "Vacant", "SKIP").when(final == "MDU_LARGE", "HIGH").when((final == "MDU_SMALL") | ((final == "SFH") & (status == "AUTO_ACCEPT")), "MEDIUM").otherwise("LOW")
    rejected = status == "REJECT"
    pick = lambda no, empty, other: F.when(rejected, no).when(vacant, empty).otherwise(other)
    return voted.select(
        "address_id",
        F.when(rejected, "rejected").otherwise("classified").alias("status"),
        pick("Unknown", "Vacant", final).alias("final_structure_type"),
        pick(F.lit(None), F.lit(False), kind == "MDU").alias("final_is_mdu"),
        pick(F.lit(None), F.lit(0), F.when(kind.isin("MDU", "Vacant"), units).otherwise(1)).cast("int").alias("final_unit_count"),
        pick(F.lit(0), F.greatest(F.lit(80), a1.cast("int")), score).cast("int").alias("final_confidence"),
        pick("SKIP", "SKIP", priority).alias("priority"),
    )


def rule_status(rows: DataFrame) -> DataFrame:
    """L-3: the ordered ladder. Reads the flags sticky_duplicate, seen_before, missing_address, interpolated_conflict,
    coord_mismatch, is_geospatial, key_in_tabular, is_discovered, exact_found, exact_warning, not_found,
    failed_validation, has_final and flow_status."""
    c = F.col
    outside = c("is_geospatial") & ~c("key_in_tabular")
    status = (
        F.when(c("sticky_duplicate") | c("seen_before"), "duplicate")
        .when(c("missing_address"), "excluded")
        .when(c("interpolated_conflict") | c("coord_mismatch"), "invalid")
        .when(outside & c("is_discovered"), "new")
        .when(outside | c("exact_found") | c("exact_warning"), "verified")
        .when(c("not_found") | c("failed_validation"), "invalid")
        .when(c("has_final"), F.coalesce(c("flow_status"), F.lit("invalid")))
        .otherwise("invalid")
    )
    return rows.withColumn("rule_status", status).withColumn("color", color(F.col("rule_status")))


def color(status: Column) -> Column:
    """R-j."""
    return F.when(status == "verified", "green").when(status == "duplicate", "white").when(status == "new", "blue").when(status == "excluded", "gray").otherwise("red")


def coordinate_status(rows: DataFrame) -> DataFrame:
    """L-17: the coordinates' status before overrides: none, label only, forward result by distance, reverse only."""
    c = F.col
    status = (
        F.when(~c("has_coords"), "NO_COORDS")
        .when(~c("has_address"), "COORDS_VALIDATED")
        .when(c("forward_m") <= 100, "MATCH")
        .when(c("forward_m") <= 500, "MISMATCH_WARN")
        .when(c("forward_m").isNotNull(), "MISMATCH")
        .when(c("has_reverse"), "COORDS_VALIDATED")
        .otherwise("UNVERIFIED")
    )
    return rows.withColumn("coord_status", status)


def quality_gates(rows: DataFrame) -> DataFrame:
    """L-19, L-20: what demotes an accepted validation, in order."""
    s = F.col("score")
    s = F.when(~F.col("deliverable"), F.least(s, F.lit(89))).otherwise(s)
    s = F.when(F.col("number_mismatch"), F.least(s, F.lit(79))).otherwise(s)
    s = F.when(F.col("distance_m") > 150, F.least(s, F.lit(79))).otherwise(s)
    s = F.when(F.col("hard_mismatch"), F.least(s, F.lit(30))).otherwise(s)
    return rows.withColumn("gated_score", s.cast("int")).withColumn("gated_status", conf.status_from_score(s))


def _reaches(score: Column, threshold: Column) -> Column:
    """J-8 with a threshold per row; 70 where it is null."""
    return F.coalesce(score.cast("int"), F.lit(0)) >= F.coalesce(threshold.cast("int"), F.lit(70))


def flow_status(rows: DataFrame) -> DataFrame:
    """L-2, L-4: ``flow_status`` and ``rule_status`` from the first stage's and the final result.

    Reads sticky_duplicate, first_status, first_score, first_threshold, final_status, final_score, final_threshold and
    default_score, which counts where there is no final score. A final result with neither status nor score is none.
    """
    c = F.col
    score = F.coalesce("final_score", "default_score")
    named = F.nullif("final_status", F.lit("")).isNotNull()
    enough = _reaches(score, c("final_threshold"))
    status = (
        F.when(F.coalesce("sticky_duplicate", F.lit(False)), "duplicate")
        .when(conf.is_match(c("first_status")) & _reaches(c("first_score"), c("first_threshold")), "verified")
        .when(named & conf.is_mismatch(c("final_status")), "invalid")
        .when((c("final_status").isNotNull() | c("final_score").isNotNull()) & enough, "verified")
        .otherwise("invalid")
    )
    return rows.withColumn("flow_status", status).withColumn("rule_status", rule_of_merge(F.col("flow_status")))


def rule_of_merge(status: Column) -> Column:
    """L-4: a verified merge is valid; what is unknown is invalid."""
    s = F.lower(F.trim(status))
    return F.when(s == "verified", "valid").when(s.isin("duplicate", "new", "excluded"), s).otherwise("invalid")


def exact_with_warning(status: Column, *percents: Column) -> Column:
    """L-8: a soft coordinate warning where a text matched wholly."""
    whole = F.array_max(F.array(*[F.coalesce(p, F.lit(0)) for p in percents])) >= 100
    return F.coalesce(F.upper(F.trim(status)) == "MISMATCH_WARN", F.lit(False)) & whole


def executed(ids: DataFrame, results: DataFrame, stage: str) -> DataFrame:
    """C-16: addresses whose stage wasn't skipped; those without a result count as executed."""
    skipped = results.filter((F.col("stage") == stage) & (F.col("status") == "skipped")).select("address_id")
    return ids.join(skipped, "address_id", "left_anti")


def best_coordinates(rows: DataFrame, threshold: int = 90) -> DataFrame:
    """C-40: ``lat``, ``lon`` and their ``origin``, from the first source in order that is sure enough and has a valid pair.

    Sources are struct columns with ``lat`` and ``lon``: agent2 (with status, score), final_result and final_meta (with
    final_score on the row), validator (with score and, on the row, validator_score of its chosen result), parcel (with
    source, status, score), then validated, stored, final_meta, final_result and source at any score. Null structs are
    skipped.
    """
    c = F.col
    percent = lambda v: conf.as_percent(v) >= threshold
    works = lambda v: ~F.lower(F.trim(F.coalesce(v, F.lit("")))).isin("failed", "error", "skipped")
    final_sure = percent(c("final_score"))
    order = [
        ("agent2", works(c("agent2.status")) & percent(c("agent2.score"))),
        ("final_result", final_sure),
        ("final_meta", final_sure),
        ("validator", percent(c("validator.score")) | percent(c("validator_score"))),
        ("parcel", (F.lower(F.trim(F.coalesce("parcel.source", F.lit("")))) == "regrid") & works(c("parcel.status")) & percent(c("parcel.score"))),
        *[(name, F.lit(True)) for name in ("validated", "stored", "final_meta", "final_result", "source")],
    ]
    tried = [F.when(sure & geo.valid_pair(c(f"{name}.lat"), c(f"{name}.lon")), F.struct(c(f"{name}.lat").alias("lat"), c(f"{name}.lon").alias("lon"), F.lit(name).alias("origin"))) for name, sure in order]
    best = F.coalesce(*tried)
    return rows.withColumns({"lat": best["lat"], "lon": best["lon"], "origin": best["origin"]})


#: How exact types of addresses and of locations are.
ADDRESS_TYPE_QUALITY = {
    "street_address": 100, "premise": 95, "subpremise": 92, "house": 90, "residential": 88, "building": 85, "establishment": 75, "point_of_interest": 70, "route": 45, "road": 45,
    "intersection": 40, "postal_code": 25, "neighborhood": 20, "locality": 15, "administrative_area_level_1": 10, "administrative_area_level_2": 10, "country": 5,
}
LOCATION_TYPE_QUALITY = {"ROOFTOP": 100, "RANGE_INTERPOLATED": 80, "GEOMETRIC_CENTER": 55, "APPROXIMATE": 30}


def _quality(key: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], F.lit(0))


def geocode_rank(line: Column, found: Column, percent: Column) -> Column:
    """G-3: what orders two geocodes (structs ``house``, ``road``, ``types``, ``location_type``) of a line: equal house numbers, percent, best type, completeness, location."""
    types = F.transform(F.coalesce(found["types"], F.array().cast("array<string>")), lambda t: _quality(F.lower(F.trim(t)), ADDRESS_TYPE_QUALITY))
    equal = text.house_numbers_equal(text.house_number(line), found["house"])
    has = lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""
    return F.struct(
        F.coalesce(equal, F.lit(False)).cast("int").alias("house"),
        F.coalesce(percent.cast("int"), F.lit(0)).alias("percent"),
        F.coalesce(F.array_max(types), F.lit(0)).alias("type"),
        (has(found["house"]) & has(found["road"])).cast("int").alias("complete"),
        _quality(F.upper(F.trim(found["location_type"])), LOCATION_TYPE_QUALITY).alias("location"),
    )


def choose_geocode(rows: DataFrame) -> DataFrame:
    """G-4: ``direction`` of the geocode that counts, of the structs ``reverse`` and ``forward`` with ``reverse_percent`` and ``forward_percent``.

    By rank, equals to forward; rows marked ``coordinate_driven`` take reverse where it is there; without any, null.
    """
    c = F.col
    ahead = geocode_rank(c("line"), c("reverse"), c("reverse_percent")) > geocode_rank(c("line"), c("forward"), c("forward_percent"))
    both = c("reverse").isNotNull() & c("forward").isNotNull()
    only = F.when(c("reverse").isNotNull(), "reverse").when(c("forward").isNotNull(), "forward")
    return rows.withColumn("direction", F.when(both & ~F.coalesce("coordinate_driven", F.lit(False)), F.when(ahead, "reverse").otherwise("forward")).otherwise(only))


def final_geocoder_score(score: Column, location_type: Column, percent: Column, required: int = 100, cap: float = 35.0) -> Column:
    """J-31: the score of a rooftop result whose text matches as required; others have ``cap`` at most."""
    sure = (F.upper(F.trim(location_type)) == "ROOFTOP") & (F.coalesce(percent, F.lit(0)) >= required)
    return F.when(F.coalesce(sure, F.lit(False)), score.cast("double")).otherwise(F.least(score.cast("double"), F.lit(cap)))
