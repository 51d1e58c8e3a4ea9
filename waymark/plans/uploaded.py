"""Queries over uploaded rows, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, uploads
from ..operators import mapping
from ..sources import tabular
from ..sources.shared import new_folder
from .queries import query
from .views import ADDRESSES, addresses, key_sql, spread


def _map(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs whose value isn't null."""
    return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs)), lambda e: e["value"].isNotNull()))


@query(f"""WITH {ADDRESSES}, a AS (SELECT id, raw_address || CASE WHEN id % 4 = 0 THEN ', ' || lower(city) || ', ' || state WHEN id % 4 = 1 THEN ' ' || zip_code ELSE '' END AS line, CASE WHEN id % 5 = 0 THEN NULL ELSE ' ' || city END AS city, CASE WHEN id % 7 = 0 THEN '' ELSE state END AS state, CASE WHEN id % 3 = 0 THEN NULL ELSE zip_code || '-00' END AS zip FROM addr WHERE raw_address IS NOT NULL),
p AS (SELECT *, nullif(concat_ws(', ', nullif(trim(city), ''), nullif(trim(state), '')), '') AS place, substr(zip, 1, 5) AS z FROM a),
f AS (SELECT *, concat_ws(', ', line, CASE WHEN NOT contains(lower(line), lower(place)) THEN place END, CASE WHEN NOT contains(line, z) THEN z END) AS whole, line || ', ' || coalesce(place, '') || ', USA' AS fmt FROM p),
c AS (SELECT *, [whole, line, fmt, trim(string_split(fmt, ',')[1]), trim(array_to_string(string_split(fmt, ',')[1:2], ','))] AS l FROM f)
SELECT id, whole AS line, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS candidates FROM c""")
def input_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-22, I-23."""
    k, c = F.col("id"), F.concat
    line = F.when(k % 4 == 0, c("raw_address", F.lit(", "), F.lower("city"), F.lit(", "), "state")).when(k % 4 == 1, c("raw_address", F.lit(" "), "zip_code")).otherwise(F.col("raw_address"))
    rows = addresses(spark, sf_dir).filter("raw_address is not null").select("id", line.alias("line"), F.when(k % 5 != 0, c(F.lit(" "), "city")).alias("city"), F.when(k % 7 == 0, "").otherwise(F.col("state")).alias("state"), F.when(k % 3 != 0, c("zip_code", F.lit("-00"))).alias("zip"))
    place = F.concat_ws(", ", F.nullif(F.trim("city"), F.lit("")), F.nullif(F.trim("state"), F.lit("")))
    rows = rows.withColumn("fmt", c("line", F.lit(", "), place, F.lit(", USA")))
    parts = [F.col(x) for x in ("line", "city", "state", "zip")]
    return rows.select("id", text.input_line(*parts).alias("line"), F.array_join(text.comparison_candidates(F.col("line"), F.col("fmt"), *parts[1:]), "|").alias("candidates"))


#: Uploads in several forms: labels with parts, a suffix that a whole address lacks, another number, headers in other cases.
def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("id"), F.concat
    number, street = F.regexp_extract("raw_address", r"^(\d+)", 1), F.regexp_extract("raw_address", r"^\d+ (\w+)", 1)
    whole = c("raw_address", F.lit(", "), "city")
    forms = [
        _map(("Address Type", F.lit("Res")), ("Street No", number), ("Street Name", street), ("City", F.col("city")), ("Zip", F.col("zip_code"))),
        _map(("ADDRESS", whole), ("Street Number", number), ("Street Number Suffix", F.lit("A")), ("Street Name", street), ("Street Type", F.lit("ST"))),
        _map(("ADDRESS", whole), ("Street Number", number), ("Street Name", street)),
        _map(("address", whole), ("STREET NUMBER", c(number, F.lit("0"))), ("street-name", street), ("category", F.lit("commercial"))),
        _map(("type", F.lit("business")), ("Address", number)),
    ]
    meta = forms[4]
    for i, form in enumerate(forms[:4]):
        meta = F.when(k % 5 == i, form).otherwise(meta)
    rows = spread(addresses(spark, sf_dir).filter("raw_address is not null"))
    return rows.select("id", meta.alias("meta"), F.when(k % 5 == 0, "Res").when(k % 5 == 4, F.when(k % 2 == 0, "Com").otherwise(F.col("raw_address"))).alias("raw"), "zip_code")


_UPLOADED = r"""SELECT *, regexp_extract(raw_address, '^(\d+)', 1) AS n, regexp_extract(raw_address, '^\d+ (\w+)', 1) AS s FROM addr WHERE raw_address IS NOT NULL"""


@query(f"""WITH {ADDRESSES}, a AS ({_UPLOADED}),
b AS (SELECT id, zip_code, CASE id % 5 WHEN 0 THEN n || ' ' || s || ', ' || city || ', ' || zip_code WHEN 1 THEN n || 'A ' || s || ' ST' WHEN 2 THEN raw_address || ', ' || city WHEN 3 THEN n || '0 ' || s ELSE CASE WHEN id % 2 = 0 THEN n ELSE raw_address END END AS built0,
  CASE id % 5 WHEN 0 THEN n || ' ' || s WHEN 1 THEN n || 'A ' || s || ' ST' WHEN 2 THEN raw_address WHEN 3 THEN n || '0 ' || s ELSE CASE WHEN id % 2 = 0 THEN '' ELSE raw_address END END AS street,
  CASE id % 5 WHEN 0 THEN 'household' WHEN 3 THEN 'commercial' WHEN 4 THEN 'commercial' END AS category, CASE id % 5 WHEN 0 THEN 'Residential' WHEN 3 THEN 'Commercial' WHEN 4 THEN 'Commercial' END AS address_type FROM a),
d AS (SELECT *, CASE WHEN id % 5 = 4 AND id % 2 = 0 THEN '' ELSE built0 END AS built FROM b), k AS (SELECT *, {key_sql('built')} AS key FROM d)
SELECT id, built, street, category, address_type, CASE WHEN contains(key, zip_code) THEN key ELSE key || '|' || zip_code END AS key FROM k""")
def upload_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-17, I-29 to I-37: the best address, its street line, its key and what labels say."""
    none = F.lit(None).cast("string")
    rows = uploads.with_parts(_uploads(spark, sf_dir), F.col("meta"), F.col("raw"))
    rows = rows.withColumn("built", uploads.best_address(uploads.built_address(), none, none, none)).withColumn("m", uploads.annotated(F.col("meta"), F.col("raw")))
    at = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return rows.select("id", "built", uploads.built_street().alias("street"), at("category"), at("address_type"), uploads.best_key(F.col("built"), F.col("zip_code")).alias("key"))


@query(f"""WITH {ADDRESSES} SELECT id, CASE id % 6 WHEN 0 THEN raw_address WHEN 1 THEN raw_address WHEN 2 THEN '' WHEN 3 THEN 'Old Mill' WHEN 4 THEN raw_address ELSE 'Pole' END AS line FROM addr WHERE raw_address IS NOT NULL""")
def upload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-25: a placemark's name behind its category, labels, a routed line, and what is no street at all."""
    k, raw = F.col("id"), F.col("raw_address")
    category = F.when(k % 6 == 0, "Households").when(k % 6 == 2, "Res").when(k % 6 == 4, "Poles")
    rows = spread(addresses(spark, sf_dir).filter("raw_address is not null")).select(
        "id",
        _map(("category", category), ("placemark_name", F.when(k % 6 == 0, raw)), ("Address", F.when(k % 6 == 5, "Pole"))).alias("meta"),
        F.when(k % 6 == 0, F.concat(F.lit("Households: "), raw)).when(k % 6 == 1, raw).when(k % 6 == 2, "Res").when(k % 6 == 4, "Poles").alias("raw"),
        F.when(k % 6 == 3, "Old Mill").when(k % 6 == 4, raw).alias("resolved"),
    )
    rows = uploads.with_parts(rows, F.col("meta"), F.col("raw"))
    return rows.select("id", uploads.upload_line(F.col("raw"), F.col("meta"), F.col("resolved"), uploads.built_address()).alias("line"))


@query(f"""WITH {ADDRESSES}, a AS (SELECT *, id % 7 AS f, lat BETWEEN -90 AND 90 AS fits FROM addr),
m AS (SELECT id, coalesce(raw_address, 'Pole ' || id::VARCHAR) AS raw_address, CASE f WHEN 1 THEN 'Americus' WHEN 2 THEN NULL ELSE city END AS city, CASE f WHEN 1 THEN 'GA' WHEN 2 THEN 'TX' ELSE CASE WHEN id % 2 = 0 THEN 'GA' ELSE 'AL' END END AS state, zip_code,
  CASE WHEN f = 3 THEN 33.5::DOUBLE WHEN fits THEN lat END AS lat, CASE WHEN f = 3 THEN -85.25::DOUBLE WHEN fits THEN lon END AS lon, CASE WHEN f = 4 THEN 'A' || id::VARCHAR WHEN f = 5 THEN '0' ELSE id::VARCHAR END AS address_id, 'N' || (id % 5)::VARCHAR AS network_node FROM a),
k AS (SELECT *, {key_sql('raw_address')} AS key FROM m)
SELECT id, raw_address, city, state, zip_code, lat, lon, address_id, network_node, CASE WHEN contains(key, zip_code) THEN key ELSE key || '|' || zip_code END AS normalized_key, CASE WHEN city IS NULL THEN state ELSE city || ', ' || state END AS old_place, CASE id % 7 WHEN 1 THEN 8 WHEN 2 THEN 8 WHEN 4 THEN 11 ELSE 10 END - CASE WHEN starts_with(raw_address, 'Pole') THEN 1 ELSE 0 END AS n_uploaded FROM k""")
def mapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-1 to C-6: exchange hints, half a pair beside a pair, ids from another column, repeated headers, the placemark's name."""
    k, f = F.col("id"), F.col("id") % 7
    hinted = (f == 1) | (f == 2)
    fields = F.map_concat(
        _map(("Address", F.col("raw_address")), ("placemark_name", F.concat(F.lit("Pole "), k.cast("string"))), ("Zip Code", F.concat("zip_code", F.lit(".0"))), ("upload_batch_id", F.lit("b")), ("_row", k)),
        _map(("City", F.when(~hinted, "old")), ("city ", F.when(~hinted, F.col("city"))), ("STATE", F.when(~hinted, F.when(k % 2 == 0, "ga").otherwise("al"))), ("win_exchange_id", F.when(f == 1, "AMRC01")), ("noc_plan_desc", F.when(f == 2, "TX123ABC"))),
        _map(("Lat", F.col("lat")), ("Longitude", F.when(f != 3, F.col("lon"))), ("coordinates", F.when(f == 3, "-85.25,33.5,0")), ("Address ID", F.when((f == 4) | (f == 5), F.lit("0")).otherwise(k.cast("string"))), ("win_lon", F.when(f == 4, F.concat(F.lit("A"), k.cast("string")))), ("Node", F.concat(F.lit("N"), (k % 5).cast("string")))),
    )
    out = mapping.map_records(spread(addresses(spark, sf_dir)).select("id", fields.alias("fields")))
    return out.select("id", "raw_address", "city", "state", "zip_code", "lat", "lon", "address_id", "network_node", "normalized_key", F.col("old.city_state").alias("old_place"), F.size("uploaded").alias("n_uploaded"))


@query(rf"""WITH {ADDRESSES}, a AS (SELECT id, raw_address || CASE WHEN id % 3 = 0 THEN chr(10) || 'Apt "' || (id % 7)::VARCHAR || '", rear' ELSE '' END AS line, CASE WHEN id % 5 = 0 THEN NULL ELSE city || ', ' || state END AS city, lat FROM addr)
SELECT id::VARCHAR AS id, line AS address, city, CASE WHEN lat <= 90 THEN lat END AS lat, CASE WHEN id % 4 = 0 THEN 'two' END AS note FROM a""")
def uploaded_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-1, C-1: CSV files with quotes, commas and line breaks in fields, a header twice, null-like texts; read and mapped."""
    k, c = F.col("id"), F.concat
    line = F.when(k % 3 == 0, c("raw_address", F.lit('\nApt "'), (k % 7).cast("string"), F.lit('", rear'))).otherwise(F.col("raw_address"))
    rows = addresses(spark, sf_dir).select(
        k.cast("string").alias("Address ID"), line.alias("Address"), F.when(k % 5 == 0, " N/A ").otherwise(c("city", F.lit(", "), "state")).alias("City"), F.col("lat").cast("string").alias("Lat"), F.col("lon").cast("string").alias("Long"), F.lit("one").alias("note"), F.when(k % 4 == 0, "two").otherwise("none").alias("note "),
    )
    rows.write.csv(path := new_folder(spark, "csv"), header=True, escape='"', quoteAll=True)
    read = tabular.read_csv(spark, path)
    mapped = mapping.map_records(read, labels=False)
    return mapped.select(F.col("address_id").alias("id"), F.col("raw_address").alias("address"), "city", "lat", F.col("fields")["note"].alias("note"))
