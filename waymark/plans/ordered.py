"""Queries over quotas, turns, tiers, refreshes and upserts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import quotas, refresh, search, waterfall
from ..sources.shared import new_folder
from ..streaming import upserts
from .queries import _search_sql, query
from .views import ADDRESSES, addresses, key_sql, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in groups of very different size: a third of the orders is of one group."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, 0).otherwise(F.pmod("o_custkey", F.lit(40))).cast("int").alias("grp"), (k % 977).alias("ord"))


_ORDERS = "o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 40 END::INTEGER AS grp, o_orderkey % 977 AS ord FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord, o_orderkey) - 1 AS rank FROM o)"


@query(f"WITH {_ORDERS} SELECT o_orderkey, grp, ord, rank FROM r")
def ranks_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas.ranked(_orders(spark, sf_dir), ["grp"], ["ord", "o_orderkey"])


@query(f"WITH {_ORDERS}, q AS (SELECT *, row_number() OVER (ORDER BY grp, rank) AS n FROM r WHERE rank < 120) SELECT o_orderkey, grp, ord FROM q WHERE n <= 2500")
def candidate_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-b, M-9."""
    return quotas.within_quotas(_orders(spark, sf_dir), "grp", ["ord", "o_orderkey"], 120, 2500)


@query(f"WITH {_ORDERS}, q AS (SELECT *, row_number() OVER (ORDER BY rank, grp) - 1 AS turn FROM r WHERE rank < 300) SELECT o_orderkey, grp, ord, turn FROM q WHERE turn < 5000")
def candidate_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-g: groups take turns."""
    return quotas.round_robin(_orders(spark, sf_dir), "grp", ["ord", "o_orderkey"], 300, 5000)



def _provider_sql(name: str, salt: int) -> str:
    return f"""{name} AS (SELECT id, id % {salt} <> 0 AS ok, CASE WHEN id % {salt + 2} = 1 THEN '9' || raw_address || ', ' || city WHEN id % {salt + 2} = 2 THEN 'Elsewhere' ELSE raw_address || ', ' || city END AS formatted, (id * {salt} % 101)::DOUBLE AS confidence FROM addr WHERE id % {salt + 1} <> 0)"""


def _provider(spark: SparkSession, sf_dir: str, salt: int) -> DataFrame:
    """A provider's table: its line for an address, with another house number at times, and how sure it is."""
    k = F.col("id")
    line = F.concat("raw_address", F.lit(", "), "city")
    rows = addresses(spark, sf_dir).filter(k % (salt + 1) != 0)
    rows = rows.select("id", (k % salt != 0).alias("ok"), F.when(k % (salt + 2) == 1, F.concat(F.lit("9"), line)).when(k % (salt + 2) == 2, "Elsewhere").otherwise(line).alias("formatted"), F.lit(None).cast("string").alias("number"), (k * salt % 101).cast("double").alias("confidence"))
    return rows


def _final_sql(name: str, tier: str, place: int) -> str:
    """A result agrees if its line has no number or the upload's own."""
    same = r"(regexp_extract(formatted, '^(\d+)', 1) = '' OR regexp_extract(formatted, '^(\d+)', 1) = regexp_extract(raw_address, '^(\d+)', 1))"
    return f"SELECT id, '{tier}' AS tier, {place} AS place, formatted, confidence, 100 AS match FROM {name} JOIN addr USING (id) WHERE ok AND raw_address IS NOT NULL AND {same} AND confidence > 0"


@query(f"""WITH {ADDRESSES}, {_provider_sql('g', 5)}, {_provider_sql('s', 7)}, {_provider_sql('t', 3)},
a AS ({_final_sql('g', 'first', 0)} UNION ALL {_final_sql('s', 'second', 1)} UNION ALL {_final_sql('t', 'third', 2)}),
w AS (SELECT *, CASE place WHEN 0 THEN confidence >= 80 WHEN 1 THEN confidence >= 60 ELSE false END AS settled FROM a)
SELECT id, tier, formatted, confidence, match, settled FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY settled DESC, CASE WHEN settled THEN place ELSE 0 END, confidence DESC, place) = 1""")
def provider_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-5, C-28, J-30: three providers' tables, each asked for what is still open."""
    tiers = [waterfall.Tier(name, lambda left, own=_provider(spark, sf_dir, salt): own, settles) for name, salt, settles in (("first", 5, 80.0), ("second", 7, 60.0), ("third", 3, 1000.0))]
    rows = addresses(spark, sf_dir).filter("raw_address is not null").select("id", F.col("raw_address").alias("line"))
    return waterfall.waterfall(rows, tiers)


#: The second state of the flags: every 17th address is found exactly by then, every 23rd has lost its line, and every 29th is gone.
_CHANGED = "id % 29 <> 4"


def _inputs(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    k = F.col("id")
    flag = lambda n, r: k % n == r
    rows = addresses(spark, sf_dir)
    line = F.when(flag(23, 5) & F.lit(later), None).otherwise(F.col("raw_address"))
    out = rows.select(
        "id", text.address_key(F.concat(line, F.lit(" "), "zip_code")).alias("key"), "file_role", F.when(flag(2, 0), "verified").alias("flow_status"), flag(41, 0).alias("sticky_duplicate"), line.isNull().alias("missing_address"), flag(37, 1).alias("interpolated_conflict"), (F.col("lat") > 90).alias("coord_mismatch"),
        (F.col("file_role") == "geospatial").alias("is_geospatial"), flag(2, 0).alias("is_discovered"), (flag(5, 0) | (flag(17, 3) & F.lit(later))).alias("exact_found"), flag(7, 0).alias("exact_warning"), flag(11, 0).alias("not_found"), flag(13, 0).alias("failed_validation"), flag(3, 1).alias("has_final"),
    )
    return out.filter(_CHANGED) if later else out


@query(f"""WITH {ADDRESSES}, a AS (SELECT *, CASE WHEN id % 23 = 5 THEN NULL ELSE raw_address END AS line FROM addr WHERE {_CHANGED}),
k AS (SELECT *, {key_sql("(line || ' ' || zip_code)")} AS key FROM a),
c AS (SELECT *, key IS NOT NULL AND id > min(id) OVER (PARTITION BY key) AS seen, key IS NOT NULL AND bool_or(file_role = 'tabular') OVER (PARTITION BY key) AS tab FROM k),
r AS (SELECT id, CASE WHEN id % 41 = 0 OR seen THEN 'duplicate' WHEN line IS NULL THEN 'excluded' WHEN id % 37 = 1 OR lat > 90 THEN 'invalid' WHEN file_role = 'geospatial' AND NOT tab AND id % 2 = 0 THEN 'new'
  WHEN (file_role = 'geospatial' AND NOT tab) OR id % 5 = 0 OR id % 17 = 3 OR id % 7 = 0 THEN 'verified' WHEN id % 11 = 0 OR id % 13 = 0 THEN 'invalid' WHEN id % 3 = 1 AND id % 2 = 0 THEN 'verified' ELSE 'invalid' END AS rule_status FROM c)
SELECT id, rule_status, count(*) OVER (PARTITION BY rule_status) AS n_status FROM r""")
def refreshed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-8, E-c: statuses after a change, from those before it; equal to a full run in SQL."""
    first = refresh.refreshed(_inputs(spark, sf_dir, False))
    then = refresh.refreshed(_inputs(spark, sf_dir, True), first)
    counts = F.create_map(*(F.lit(x) for pair in then.counts.items() for x in pair))
    return then.rows.select("id", "rule_status", F.element_at(counts, F.col("rule_status")).cast("long").alias("n_status"))


@query("""SELECT o_custkey AS address_id, 'agent' || (o_orderkey % 6)::VARCHAR AS stage, o_orderkey AS version, (floor(o_totalprice)::BIGINT % 101)::INTEGER AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 6 ORDER BY o_orderkey DESC) = 1""")
def streamed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-11 to B-13: results from a stream, the latest version of each address and stage."""
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/order[s].parquet")  # a pattern, as a stream from one file needs one
    k = F.col("o_orderkey")
    results = orders.select(F.col("o_custkey").alias("address_id"), F.concat(F.lit("agent"), (k % 6).cast("string")).alias("stage"), k.alias("version"), F.pmod(F.floor("o_totalprice"), F.lit(101)).cast("int").alias("score"))
    path, keys = new_folder(spark, "results"), ["address_id", "stage"]
    upserts.upsert_stream(results, path, new_folder(spark, "progress"), keys, "version").awaitTermination()
    return upserts.current(spark, path, "address_id bigint, stage string, version bigint, score int", keys, "version")


_ASKED = "SELECT id AS query_id, CASE id % 5 WHEN 0 THEN substr(raw_address, 2) WHEN 1 THEN raw_address || ', ' || lower(left(city, 4)) WHEN 2 THEN ' ' || lower(substr(raw_address, 1, 4)) WHEN 3 THEN left(raw_address, 2) ELSE 'zz' || raw_address END AS query FROM addr WHERE id % 20 = 1 OR id % 20 = 12"


@query(f"""WITH {ADDRESSES}, h AS (SELECT id, raw_address || ', ' || city || ', USA' AS t, CASE id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'new' ELSE 'invalid' END AS st FROM addr WHERE raw_address IS NOT NULL),
n AS (SELECT *, lower(t) AS r, {_search_sql('t')} AS k FROM h), q0 AS ({_ASKED}), q AS (SELECT query_id, lower(trim(query)) AS r, {_search_sql('lower(trim(query))')} AS k FROM q0 WHERE query IS NOT NULL),
m AS (SELECT query_id, n.id, n.k, CASE st WHEN 'verified' THEN 3 WHEN 'new' THEN 2 ELSE 1 END AS rank FROM q JOIN n ON q.k <> '' AND (contains(n.r, q.r) OR contains(n.k, q.k))),
b AS (SELECT query_id, k, min(id) AS first, max(struct_pack(r := rank, i := -id)) AS z FROM m GROUP BY query_id, k)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY first))::INTEGER AS place, -z.i AS id FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first) <= 30""")
def address_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-f, Q-c, Q-d: parts of one address in ten as queries."""
    k, raw = F.col("id"), F.col("raw_address")
    rows = addresses(spark, sf_dir)
    query = F.when(k % 5 == 0, F.substring(raw, 2, 1000)).when(k % 5 == 1, F.concat(raw, F.lit(", "), F.lower(F.substring("city", 1, 4)))).when(k % 5 == 2, F.concat(F.lit(" "), F.lower(F.substring(raw, 1, 4)))).when(k % 5 == 3, F.substring(raw, 1, 2)).otherwise(F.concat(F.lit("zz"), raw))
    asked = rows.filter("id % 20 in (1, 12)").select(k.alias("query_id"), query.alias("query"))
    held = rows.filter("raw_address is not null").select("id", F.concat(raw, F.lit(", "), "city", F.lit(", USA")).alias("text"), F.when(k % 4 == 0, "verified").when(k % 4 == 1, "new").otherwise("invalid").alias("rule_status"))
    return search.search(held, asked)
