"""Roll-ups, histograms, overlays and pages (inventory 2.G, 2.Q, 2.R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text


def summary(rows: DataFrame) -> DataFrame:
    """R-h: demand, served, not served, additional, engineered and discrepancy, in one aggregation."""
    counted = rows.agg(
        F.count_if((F.col("file_role") == "tabular") & (F.col("rule_status") != "duplicate")).alias("demand"),
        F.count_if(F.col("rule_status") == "verified").alias("served"),
        F.count_if(F.col("rule_status") == "invalid").alias("not_served"),
        F.count_if(F.col("rule_status") == "new").alias("additional"),
    )
    share = F.col("not_served") / F.nullif(F.col("demand"), F.lit(0))
    return counted.withColumns({"engineered": F.col("served") + F.col("additional"), "discrepancy": F.round(share, 6)})


def histogram(rows: DataFrame) -> DataFrame:
    """Q-i: count and share of each ``bucket``."""
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def confidence_histogram(rows: DataFrame, score: str) -> DataFrame:
    """Q-h."""
    c = F.col(score)
    return histogram(rows.filter(c.isNotNull()).select(F.when(c <= 0, "invalid").when(c >= 90, "high").when(c >= 70, "medium").otherwise("low").alias("bucket")))


def overlay(scores: DataFrame, chained: bool, final: str = "agent5") -> DataFrame:
    """R-l: the best score of each address and its first stage; where stages are chained, the final stage's if there is one."""
    best = F.max(F.col("score"))
    first = F.min_by("stage", F.struct(-F.col("score"), "stage"))
    if not chained:
        return scores.groupBy("address_id").agg(best.alias("score"), first.alias("stage"))
    return scores.groupBy("address_id").agg(F.coalesce(F.max(F.when(F.col("stage") == final, F.col("score"))), best).alias("score"), F.coalesce(F.max(F.when(F.col("stage") == final, F.col("stage"))), first).alias("stage"))


def categories(rows: DataFrame, category: str) -> DataFrame:
    """Q-k, Q-l: rows and rows without address of each category, with a colour by rank."""
    counts = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw_address").isNull()).alias("missing_address"))
    return counts.withColumn("color_index", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), category)) % 6).cast("long"))


def page(rows: DataFrame, column: str, search: str, number: int, size: int) -> DataFrame:
    """G-d: one page of the rows that contain a text, in order of id."""
    if not 1 <= size <= 500 or number < 1:
        raise ValueError("a page has 1 to 500 rows")
    return rows.filter(F.lower(column).contains(search.lower())).orderBy("id").offset((number - 1) * size).limit(size)


def search_results(rows: DataFrame) -> DataFrame:
    """Q-c: one row per search key: verified before new before others, ties to the smaller id."""
    rank = F.when(F.col("rule_status") == "verified", 3).when(F.col("rule_status") == "new", 2).otherwise(1)
    best = rows.filter("raw_address is not null").groupBy(text.search_key(F.col("raw_address")).alias("search_key")).agg(F.max(F.struct(rank.alias("rank"), (-F.col("id")).alias("back"))).alias("b"))
    return best.select("search_key", "b.rank", (-F.col("b.back")).alias("id"))


def job_totals(jobs: DataFrame) -> DataFrame:
    """Q-s, E-19: jobs, rows and time span by status."""
    out = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("row_count"), F.min("started").alias("first_start"), F.max("ended").alias("last_end"))
    return out.withColumn("seconds", F.greatest(F.lit(0), F.unix_timestamp("last_end") - F.unix_timestamp("first_start")))


def polyline_lengths(points: DataFrame, line: str) -> DataFrame:
    """Q-m: metres along each line's points in order."""
    w = Window.partitionBy(line).orderBy("ord")
    d = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("d", d).groupBy(line).agg(F.round(F.sum("d"), 2).alias("metres"))
