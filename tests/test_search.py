"""Text search against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import search


def test_search_key(spark):
    texts = ["12 Peach Street, Americus, Georgia, USA", "USA Drive", "United States Avenue 5", "Roadside Terrace", " - ", None, "Jones Bridge Road.Unit 4"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.search_key(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ["12 peach st americus ga", "dr", "ave 5", "roadside ter", "", None, "jones bridge rd unit 4"]


def scan(spark, rows, queries, limit):
    key = {t: r for t, r in spark.createDataFrame([(t,) for t in {x for _, x, _ in rows} | {(q or "").strip(" ").lower() for _, q in queries} if t is not None], "t string").select("t", text.search_key(F.col("t"))).collect()}
    out = []
    for i, q in queries:
        q = (q or "").strip(" ").lower()
        if not key[q]:
            continue
        best = {}
        for j, t, st in sorted(rows):
            if t is not None and key[t] and (q in t.lower() or key[q] in key[t]):
                rank = {"verified": 3, "new": 2}.get(st, 1)
                if key[t] not in best:
                    best[key[t]] = (rank, j)
                elif rank > best[key[t]][0]:
                    best[key[t]] = (rank, j)
        out += [(i, p + 1, j) for p, (_, j) in enumerate(list(best.values())[:limit])]
    return sorted(out)


@pytest.mark.parametrize("seed, limit", [(1, 30), (2, 3)])
def test_against_a_scan(spark, seed, limit):
    rng = random.Random(seed)
    words = ["12", "112", "oak", "Oaken", "street", "St", "drive", "Hill", "GA", "usa", "é", "-"]
    rows = [(i, rng.choice([" ".join(rng.choices(words, k=rng.randint(1, 5))), None, "12 Oak St"]), rng.choice(["verified", "new", "x", None])) for i in range(150)]
    queries = [(i, rng.choice([None, "", " ", "-", "1", "2 o", "oak", "driv", "usa", "12 oak street", "qqq", "é", " ".join(rng.choices(words, k=2))])) for i in range(60)]
    got = search.search(spark.createDataFrame(rows, "id long, text string, rule_status string"), spark.createDataFrame(queries, "query_id long, query string"), limit)
    assert sorted(map(tuple, got.collect())) == scan(spark, rows, queries, limit)


def test_nothing_to_search(spark):
    rows = spark.createDataFrame([(1, "12 Oak St", "new")], "id long, text string, rule_status string")
    asked = spark.createDataFrame([(1, " "), (2, None)], "query_id long, query string")
    assert search.search(rows, asked).count() == 0 and search.search(rows.limit(0), asked.withColumn("query", F.lit("oak"))).count() == 0


def test_copies_are_one_entry_and_one_search(spark, monkeypatch):
    """Equal texts and equal queries: the index and the searches have the distinct ones, the answer has all queries."""
    sizes, of = {}, search.written

    def counted(df, name):
        out = of(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(search, "written", counted)
    k = F.col("id")
    rows = spark.range(400).select("id", F.when(k % 2 == 0, "12 Oak Street, Reddick").otherwise("7 Elm Road").alias("text"), F.when(k == 300, "verified").when(k % 7 == 1, "new").otherwise("x").alias("rule_status"))
    asked = spark.range(300).select(k.alias("query_id"), F.when(k % 3 == 0, "oak st").when(k % 3 == 1, " Elm").otherwise("k").alias("query"))
    got = sorted(map(tuple, search.search(rows, asked).collect()))
    first = {0: [300], 1: [1], 2: [300]}
    assert got == [(q, p + 1, i) for q in range(300) for p, i in enumerate(first[q % 3])]
    assert sizes["texts"] <= 4 and sizes["asked"] <= 6
