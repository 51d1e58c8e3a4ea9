"""Text search over addresses by an inverted index of character triples (inventory G-f, Q-c, Q-d)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import written

#: Postings that are intersected for a query: those of its rarest triples.
RAREST = 3


def _grams(c: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text that has as many."""
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _forms(rows: DataFrame, column: str) -> DataFrame:
    """A row for each form of the text: ``r`` in lower case, ``n`` as a search key."""
    forms = F.array(F.struct(F.lit("r").alias("form"), F.lower(F.col(column)).alias("own")), F.struct(F.lit("n").alias("form"), text.search_key(F.col(column)).alias("own")))
    return rows.withColumn("__f", F.explode(forms)).select(*rows.columns, "__f.form", "__f.own")


def search(rows: DataFrame, queries: DataFrame, limit: int = 30) -> DataFrame:
    """(``query_id``, ``place``, ``id``): the first ``limit`` addresses that hold each query's text.

    ``rows``: ``id``, ``text``, ``rule_status``; ``queries``: ``query_id``, ``query``. A text holds a query that is in it as it
    stands, in lower case, or as a search key. Of texts with one search key the best counts (verified, then new, then
    others, ties to the smaller id), in the place of the first that holds the query. Blank queries, and those of which no
    letter or digit is left as a search key, find nothing.

    An index maps the runs of three characters of each text to its rows (shorter queries have runs of their own length).
    A query's rarest runs are looked up and their postings intersected; only what is in all of them is compared. Equal texts
    are one entry, under the smallest of their ids, and equal queries are one search.
    """
    c = F.col
    wanted = written(queries.select(c("query_id").alias("own_id"), F.lower(F.trim("query")).alias("query_id")).filter(text.search_key(c("query_id")) != ""), "wanted")
    asked = _forms(wanted.select("query_id", c("query_id").alias("q")).distinct(), "q").filter("own <> ''").withColumn("size", F.least(F.length("own"), F.lit(3)))
    asked = written(asked.select("query_id", "form", "own", "size"), "asked")
    sizes = [r["size"] for r in asked.select("size").distinct().collect()]  # three at most
    if not sizes:
        return queries.select("query_id").limit(0).join(rows.select("id").limit(0), F.lit(True), "inner").select("query_id", F.lit(0).alias("place"), "id")
    rank = F.when(c("rule_status") == "verified", 3).when(c("rule_status") == "new", 2).otherwise(1)
    better = F.struct(rank.alias("r"), (-c("id")).alias("i"))
    once = rows.filter("text is not null").groupBy("text").agg(F.min("id").alias("id"), F.max(better).alias("z"))
    texts = written(_forms(once, "text").withColumn("key", text.search_key(c("text"))), "texts")
    runs = F.explode(F.flatten(F.array(*(_grams(c("own"), n) for n in sorted(sizes))))).alias("gram")
    postings = written(texts.select("form", "id", runs), "postings")
    common = postings.groupBy("form", "gram").agg(F.count(F.lit(1)).alias("n"))
    by_size = F.coalesce(*(F.when(c("size") == n, _grams(c("own"), n)) for n in sorted(sizes)))
    looked = asked.select("query_id", "form", "own", F.explode(by_size).alias("gram")).join(common, ["form", "gram"], "left")
    # a run that no text has empties the query's answer; of the others the rarest are looked up
    rarest = looked.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "form").orderBy(F.coalesce("n", F.lit(0)), "gram"))).filter(c("k") <= RAREST)
    needed = rarest.groupBy("query_id", "form").agg(F.count(F.lit(1)).alias("needed"))
    hits = rarest.select("query_id", "form", "gram").join(postings, ["form", "gram"]).groupBy("query_id", "form", "id").agg(F.count(F.lit(1)).alias("met"))
    hits = hits.join(needed, ["query_id", "form"]).filter("met = needed").select("query_id", "form", "id")
    held = hits.join(asked, ["query_id", "form"]).join(texts.select("form", "id", c("own").alias("hay"), "key", "z"), ["form", "id"]).filter(F.contains("hay", "own") & (c("key") != ""))
    best = held.groupBy("query_id", "key").agg(F.min("id").alias("first"), (-F.max("z")["i"]).alias("id"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).filter(c("place") <= limit)
    return wanted.join(placed, "query_id").select(c("own_id").alias("query_id"), "place", "id")
