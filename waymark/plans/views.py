"""Address and stage-score tables derived from the business tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STREETS = ["OAK", "MAIN", "HILL", "LAKE", "PARK"]
STRUCTURES = ["SFH", "Apartment Building", "mixed-use", "Unknown", "vacant_lot"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows dealt out to all cores, for long work on each row of a table whose files are small and so would be one task each."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address per customer; many share a key, some lack text or have a latitude out of range."""
    k = F.col("c_custkey")
    street = F.element_at(F.array(*map(F.lit, STREETS)), (F.pmod(k * 7, F.lit(5)) + 1).cast("int"))
    line = F.concat((F.pmod(k, F.lit(23)) + 1).cast("string"), F.lit(" "), street, F.when(k % 2 == 0, " STREET").otherwise(" ST"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        k.alias("id"),
        k.alias("ord"),
        F.when(k % 29 != 0, line).alias("raw_address"),
        F.col("n_name").alias("city"),
        F.upper(F.substring("n_name", 1, 2)).alias("state"),
        (30000 + F.col("n_nationkey") * 7).cast("string").alias("zip_code"),
        F.when(k % 31 == 0, 95.0).otherwise(32.0 + (k % 1000) / 10000.0).alias("lat"),
        (-84.0 - ((k * 13) % 1000) / 10000.0).alias("lon"),
        F.when(k % 3 == 0, "geospatial").otherwise("tabular").alias("file_role"),
        F.col("c_mktsegment").alias("category"),
    )


ADDRESSES = """addr AS (
  SELECT c_custkey AS id, c_custkey AS ord,
    CASE WHEN c_custkey % 29 <> 0 THEN (c_custkey % 23 + 1)::VARCHAR || ' ' || (['OAK','MAIN','HILL','LAKE','PARK'])[(c_custkey * 7) % 5 + 1] || CASE WHEN c_custkey % 2 = 0 THEN ' STREET' ELSE ' ST' END END AS raw_address,
    n_name AS city, upper(substr(n_name, 1, 2)) AS state, (30000 + n_nationkey * 7)::VARCHAR AS zip_code,
    CASE WHEN c_custkey % 31 = 0 THEN 95.0::DOUBLE ELSE 32.0::DOUBLE + (c_custkey % 1000) / 10000.0::DOUBLE END AS lat,
    -84.0::DOUBLE - ((c_custkey * 13) % 1000) / 10000.0::DOUBLE AS lon,
    CASE WHEN c_custkey % 3 = 0 THEN 'geospatial' ELSE 'tabular' END AS file_role, c_mktsegment AS category
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the stages agent0 to agent5, one per order; an address has several of a stage, the last of which counts."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("address_id"),
        F.concat(F.lit("agent"), F.pmod(k + F.col("o_custkey"), F.lit(6)).cast("string")).alias("stage"),
        k.alias("version"),
        F.pmod(F.floor("o_totalprice"), F.lit(101)).cast("int").alias("score"),
        F.when(F.col("o_orderstatus") == "F", "MATCH").when(F.col("o_orderstatus") == "O", "AUTO_ACCEPT").otherwise("REJECT").alias("status"),
        F.element_at(F.array(*map(F.lit, STRUCTURES)), (F.pmod(k * 3 + F.col("o_custkey"), F.lit(5)) + 1).cast("int")).alias("structure"),
    )


SCORES = """scores AS (
  SELECT o_custkey AS address_id, 'agent' || ((o_orderkey + o_custkey) % 6)::VARCHAR AS stage, o_orderkey AS version, (floor(o_totalprice)::BIGINT % 101)::INTEGER AS score,
    CASE o_orderstatus WHEN 'F' THEN 'MATCH' WHEN 'O' THEN 'AUTO_ACCEPT' ELSE 'REJECT' END AS status,
    (['SFH','Apartment Building','mixed-use','Unknown','vacant_lot'])[(o_orderkey * 3 + o_custkey) % 5 + 1] AS structure
  FROM orders)"""
LATEST = """latest AS (
  SELECT address_id, stage, version, score, status, structure FROM scores
  QUALIFY row_number() OVER (PARTITION BY address_id, stage ORDER BY version DESC) = 1)"""


def key_sql(c: str) -> str:
    """SQL of the address key."""
    out = f"upper(trim({c}))"
    for word, short in (("N", "NORTH"), ("S", "SOUTH"), ("E", "EAST"), ("W", "WEST"), ("STREET", "ST"), ("AVENUE", "AVE"), ("BOULEVARD", "BLVD"), ("DRIVE", "DR"), ("ROAD", "RD"), ("COURT", "CT"), ("LANE", "LN")):
        out = rf"regexp_replace({out}, '\b{word}\b', '{short}', 'g')"
    return f"nullif(trim(regexp_replace({out}, '[^A-Z0-9]+', ' ', 'g')), '')"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * 6371000.0::DOUBLE * asin(sqrt(least(greatest({a}, 0.0), 1.0)))"
