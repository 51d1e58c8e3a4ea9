"""Validation, duplicates, the greedy merge and keyed updates (inventory 2.B, 2.D, 2.E, 2.F, 2.H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text


def validate(df: DataFrame) -> DataFrame:
    """E-2: ``errors`` and ``warnings`` of each row, and ``dedupe_key``."""
    lat, lon = F.col("lat"), F.col("lon")
    key = text.duplicate_key(F.col("raw_address"))
    missing = text.clean_value(F.col("raw_address")).isNull()
    errors = F.array(F.when(missing, "missing_raw_address"), F.when(lat.isNotNull() & ~lat.between(-90, 90), "invalid_latitude"), F.when(lon.isNotNull() & ~lon.between(-180, 180), "invalid_longitude"), F.when(key.isNull() & ~missing, "missing_normalized_key"))
    warnings = F.array(F.when(lat.isNull() | lon.isNull(), "missing_coordinates"))
    return df.withColumns({"dedupe_key": key, "errors": F.array_compact(errors), "warnings": F.array_compact(warnings)})


def deduplicate(df: DataFrame, order: str = "ord") -> DataFrame:
    """E-1: ``row_class`` valid, invalid or duplicate, and ``canonical_id`` of a duplicate's first valid row.

    Rows that fail validation are never canonical, and a null key never repeats another. Every row of one key in one
    window would make a common address a hot task: the first row of a key is found by an aggregation that is partly
    done before the shuffle, and joined back, where Spark can split hot keys.
    """
    checked = validate(df)
    valid = checked.filter(F.size("errors") == 0)
    firsts = valid.groupBy("dedupe_key").agg(F.min(F.struct(order, "id")).alias("first"))
    own = checked.join(firsts.select(F.col("dedupe_key").alias("first_key"), "first"), F.col("dedupe_key") == F.col("first_key"), "left")
    repeats = (F.size("errors") == 0) & F.col("first").isNotNull() & (F.col(f"first.{order}") != F.col(order))
    return own.withColumns({"row_class": F.when(F.size("errors") > 0, "invalid").when(repeats, "duplicate").otherwise("valid"), "canonical_id": F.when(repeats, F.col("first.id"))}).drop("first", "first_key")


def duplicate_links(df: DataFrame) -> DataFrame:
    """D-5: each duplicate with its canonical row and the distance between them in metres."""
    rows = deduplicate(df)
    first = rows.select(F.col("id").alias("canonical_id"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    linked = rows.filter("row_class = 'duplicate'").join(first, "canonical_id")
    return linked.select("id", "canonical_id", "dedupe_key", F.round(geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 3).alias("distance_m"))


def stored_order(df: DataFrame) -> DataFrame:
    """H-b: ids in the order of storage, the valid rows before the invalid and these before the duplicates."""
    rows = deduplicate(df).select("id", "row_class", "ord")
    rank = F.when(F.col("row_class") == "valid", 0).when(F.col("row_class") == "invalid", 1).otherwise(2)
    return rows.withColumn("class_rank", rank)


def numbered(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))


def greedy_merge(df: DataFrame) -> DataFrame:
    """D-1: the k-th tabular row of a key is paired with its k-th geospatial row.

    ``merge_status``: paired rows are verified and their geospatial ones absorbed; geospatial rows left over are
    verified; tabular ones are unmatched if there are geospatial rows at all, else verified. Rows without key aren't
    paired.
    """
    rows = df.withColumn("merge_key", text.duplicate_key(F.col("raw_address")))
    tabular, spatial = rows.filter("file_role = 'tabular'"), rows.filter("file_role = 'geospatial'")
    left = numbered(tabular, "merge_key", "ord", "k").select(F.col("id").alias("csv_id"), "merge_key", "k")
    right = numbered(spatial, "merge_key", "ord", "k").select(F.col("id").alias("kmz_id"), "merge_key", "k")
    any_spatial = not spatial.isEmpty()
    pairs = left.filter("merge_key is not null").join(right.filter("merge_key is not null"), ["merge_key", "k"], "full_outer")
    keyless = left.filter("merge_key is null").withColumn("kmz_id", F.lit(None).cast("long")).unionByName(right.filter("merge_key is null").withColumn("csv_id", F.lit(None).cast("long")))
    status = F.when(F.col("csv_id").isNull(), "verified").when(F.col("kmz_id").isNotNull(), "verified").otherwise("unmatched" if any_spatial else "verified")
    return pairs.unionByName(keyless).select("csv_id", "kmz_id", "merge_key", status.alias("merge_status"), (F.col("csv_id").isNotNull() & F.col("kmz_id").isNotNull()).alias("absorbed"))


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """B-11: rows of both, the latest version of each key; the later table wins ties."""
    both = base.withColumn("__side", F.lit(0)).unionByName(delta.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (*keys, "__side")]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(version, "__side")).alias("__row"))
    return latest.select(*keys, "__row.*")


def unique_table_names(files: DataFrame) -> DataFrame:
    """B-10: the second file of a table name gets ``_2``, and so on."""
    named = files.withColumn("base", text.safe_table_name(F.col("source_file")))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("ord"))
    return named.withColumn("nth", nth).withColumn("table_name", F.when(F.col("nth") > 1, F.concat("base", F.lit("_"), F.col("nth").cast("string"))).otherwise(F.col("base"))).drop("nth")


def flattened_placemarks(df: DataFrame) -> DataFrame:
    """A-14, E-3: repeated rows of a placemark as one: last value of each field, first coordinates, first row number. Of rows with one number, the larger value and the smaller coordinates count."""
    fields = df.filter("field is not null and value is not null and trim(value) <> ''").groupBy("placemark", "field").agg(F.max_by("value", F.struct("row_number", "value")).alias("value"))
    folded = fields.groupBy("placemark").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
    heads = df.groupBy("placemark").agg(F.min("row_number").alias("row_number"), F.min_by("coordinates", F.when(F.col("coordinates").isNotNull(), F.struct("row_number", "coordinates"))).alias("coordinates"))
    return heads.join(folded, "placemark", "left")
