"""Address lines, their likeness, and property records picked by blocking keys."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import lines
from waymark.operators import linkage


def of(spark, expr, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()
    return [tuple(r.x) if isinstance(r.x, tuple) else r.x for r in rows]


def test_address_lines(spark):
    texts = ["214 Walnut Dr, Americus, GA 31719, USA", "214 Walnut Dr", "214 Walnut Dr, Americus", "1 A St, B, Georgia, GA 31719-1234", "1 A St, B, new york 10001", "1 A St, B, north carolina 27601", " ,, ", None, "1 A St, USA", "1 A St, B, GA 31719, TX 75001", "USA", "1 A St,\tB ,\nGA\t31719 ", "1 A St, B, GA 3171"]
    want = [("214 Walnut Dr", "Americus", "GA", "31719"), ("214 Walnut Dr", "", "", ""), ("214 Walnut Dr", "Americus", "", ""), ("1 A St", "B", "GA", "31719"), ("1 A St", "B", "NEW YORK 10001", ""), ("1 A St", "B", "NORTH CAROLINA 27601", ""), ("", "", "", ""), ("", "", "", ""), ("1 A St", "", "", ""), ("1 A St", "B", "GA", "31719"), ("USA", "", "", ""), ("1 A St", "B", "GA", "31719"), ("1 A St", "B", "GA 3171", "")]
    assert of(spark, lines.address_parts, texts) == want
    assert of(spark, lines.state_code, ["ga", " Georgia ", "district of columbia", "Ontario", "", None, "G1"]) == ["GA", "GA", "DC", "ONTARIO", "", "", "G1"]
    assert of(spark, lines.city_and_state, ["Austin, TX", "Austin", "", None, "A, B, C"]) == [("Austin", "TX"), ("Austin", ""), ("", ""), ("", ""), ("A", "B, C")]
    assert of(spark, lines.city_and_state_code, ["Austin, texas", "A, B, C"]) == [("Austin", "TX"), ("A", "B, C")]
    assert len(lines.STATES) == 51 and len(set(lines.STATES.values())) == 51


def test_line_likeness(spark):
    pairs = [("15060 NW 7TH AVE", "15050 NW 7TH AVE"), ("15060 NW 7TH AVE", "15060 NW 7TH AVE, REDDICK, FL 32686"), ("12 Oak St", "12 Elm St"), ("Oak St", "12 Oak Rd"), ("", "12 Oak"), (None, None), ("12 Oak St", "12 Oak Road Austin")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", lines.lines_match(F.col("a"), F.col("b")).alias("m"), lines.line_score(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert [r.m for r in rows] == [False, True, False, True, True, True, True]
    assert [r.s for r in rows] == [-1, 100 + 20 + 20, 100 + 10, 5, 0, 0, 100 + 10]


def brute(targets, props, max_miles=None):
    import math
    import re

    def parts(line):
        up = (line or "").upper()
        n = re.match(r"\s*(\d+)", up)
        tok = set(re.findall("[A-Z0-9]+", up))
        z = re.match(r"\s*\d+\b.*\b(\d{5})(?:-\d{4})?\b", up)
        return n and n[1], tok, {t for t in tok if t not in lines.STREET_STOPWORDS and not t.isdigit()}, z and z[1], up

    def miles(a, b):
        if None in (*a, *b):
            return 0.0
        y1, x1, y2, x2 = map(math.radians, (*a, *b))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return round(2 * 6371000 * math.asin(min(1, math.sqrt(h))) / 1609.344, 6)

    out = {}
    for i, line, *at in targets:
        n, tok, street, z, up = parts(line)
        best = None
        for p, other, *there in props:
            m, tok2, street2, z2, up2 = parts(other)
            if n and n == m and (street & street2 or ((not street or not street2) and z and z == z2)):
                d = miles(at, there)
                s = 100 + min(5 * len(tok & tok2), 40) + 20 * (up in up2 or up2 in up)
                if (max_miles is None or d <= max_miles) and (best is None or (-s, d, p) < best):
                    best = (-s, d, p)
        if best:
            out[i] = (best[2], -best[0], best[1])
    return out


@pytest.mark.parametrize("block", [20_000, 3])
def test_pick_against_all_pairs(spark, monkeypatch, block):
    """Also where frequent keys are cut in slices."""
    monkeypatch.setattr(linkage, "BLOCK", block)
    rng = random.Random(block)

    def row(i):
        line = " ".join(filter(None, [rng.choice(["1", "2", "17", ""]), rng.choice(["NW", ""]), rng.choice(["Oak", "Elm Hill", "", "Main"]), rng.choice(["St", "Road"]), rng.choice([", Austin", ""]), rng.choice(["30301", "30302-1111", ""])]))
        return (i, rng.choice([line, line, line, None]), rng.choice([33.0, 33.001, None]), rng.choice([-84.0, -84.002]))

    targets, props = [row(i) for i in range(80)], [row(i) for i in range(120)]
    t = spark.createDataFrame(targets, "id long, line string, lat double, lon double")
    p = spark.createDataFrame(props, "property_id long, line string, lat double, lon double")
    for most in (None, 0.1):
        got = {r.id: (r.property_id, r.score, r.miles) for r in linkage.pick_properties(t, p, most).collect()}
        want = brute(targets, props, most)
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert linkage.pick_properties(t.limit(0), p).count() == 0 and linkage.pick_properties(t, p.limit(0)).count() == 0


def test_lookup_takes_no_neighbour(spark):
    props = spark.createDataFrame([(1, "15050 NW 7TH AVE", 29.0, -82.0), (2, "15060 NW 7TH AVE", 29.0001, -82.0), (3, None, 29.5, -82.5), (4, "9 Far St", 10.0, 10.0)], "property_id long, line string, lat double, lon double")
    targets = spark.createDataFrame([(1, "15060 NW 7TH AVE", 29.0, -82.0), (2, "15061 NW 7TH AVE", 29.0, -82.0), (3, "1 Elm St", 29.5, -82.5), (4, "77 X St", 0.0, 0.0), (5, None, 29.0, -82.0), (6, "8 Far St", None, None)], "id long, line string, lat double, lon double")
    candidates = spark.createDataFrame([(1, 0, "15060 Elsewhere"), (1, 1, "15060 NW 7th Ave, Reddick"), (2, 0, "15061 NW 7TH AVE"), (3, 0, "1 Elm St"), (6, 0, "8 Far St"), (6, 1, "9 Far St"), (4, 0, "")], "id long, k int, line string")
    got = {r.id: (r.property_id, r.via) for r in linkage.lookup_properties(targets, candidates, props).collect()}
    assert got == {1: (2, 1), 3: (3, None), 5: (1, None), 6: (4, 1)}


def test_lines_are_scored_once_for_all_places(spark, monkeypatch):
    """Many rows of few lines at few places: lines are scored, and distances measured, once for all of them."""
    seen, of = {}, linkage._met

    def counted(left, right, by, spread):
        out = of(left, right, by, spread)
        seen[by] = seen.get(by, 0) + out.count()
        return out

    monkeypatch.setattr(linkage, "_met", counted)
    k = F.col("id")
    rows = lambda n, name, line: spark.range(n).select(k.alias(name), line.alias("line"), F.when(k % 5 > 0, 33.0 + k % 5 * 0.001).alias("lat"), F.lit(-84.0).alias("lon"))
    targets = rows(300, "id", F.when(k % 2 == 0, "12 Oak St, Reddick").otherwise("12 Oak Road"))
    props = rows(400, "property_id", F.when(k % 3 == 0, "12 Oak Rd").when(k % 3 == 1, "12 OAK ST").otherwise("13 Oak St"))
    got = {r.id: (r.property_id, r.score) for r in linkage.pick_properties(targets, props).collect()}
    want = brute([tuple(r) for r in targets.collect()], [tuple(r) for r in props.collect()])
    assert got == {i: v[:2] for i, v in want.items()} and len(got) == 300
    assert seen["key"] <= 8 and seen["p_line"] <= 60


def test_neighbours_are_met_by_places_not_by_rows(spark, monkeypatch):
    """Lines that lead nowhere, blank ones among them: what is near is found once for each place."""
    seen, of = [], linkage.spatial.pairs_within

    def counted(*a):
        out = of(*a)
        seen.append(out.count())
        return out

    monkeypatch.setattr(linkage.spatial, "pairs_within", counted)
    k = F.col("id")
    lat = 33.0 + k % 3 * 0.0001
    targets = spark.range(200).select("id", F.when(k % 2 == 0, None).otherwise("Elm Lane").alias("line"), lat.alias("lat"), F.lit(-84.0).alias("lon"))
    props = spark.range(300).select(k.alias("property_id"), F.when(k % 4 == 0, None).when(k % 4 == 1, "9 Elm Ln").otherwise("9 Oak St").alias("line"), lat.alias("lat"), F.lit(-84.0).alias("lon"))
    got = {r.id: (r.property_id, r.score, r.miles, r.via) for r in linkage.lookup_properties(targets, targets.select("id", F.lit(0).alias("k"), "line").filter("line is not null"), props, 0.1, 0.1).collect()}
    blank, named = {0: 0, 1: 1, 2: 2}, {0: 9, 1: 1, 2: 5}
    assert {i: v[0] for i, v in got.items()} == {i: blank[i % 3] if i % 2 == 0 else named[i % 3] for i in range(200)}
    assert all(v[2:] == (0.0, None) and v[1] == (0 if i % 2 == 0 else 5) for i, v in got.items()) and sum(seen) <= 9


def test_only_the_best_lines_are_searched(spark, monkeypatch):
    """What is kept for targets, places and lines doesn't grow with lines of lower scores, other numbers or blank ones."""
    sizes, of = {}, linkage.written

    def counted(df, name):
        out = of(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(linkage, "written", counted)
    k = F.col("id")
    at = [(33.0 + k % 10 * 0.0001).alias("lat"), F.lit(-84.0).alias("lon")]
    targets = spark.range(100).select("id", F.when(k % 2 == 0, "12 Oak St, Reddick").alias("line"), *at)
    props = spark.range(600).select(k.alias("property_id"), F.when(k % 3 == 0, "12 Oak St, Reddick").when(k % 3 == 1, F.concat(F.lit("12 Oak Rd, X"), k)).when(k % 9 < 6, F.concat(k + 100, F.lit(" Oak St"))).alias("line"), *at)
    got = {r.id: (r.property_id, r.score, r.miles, r.via) for r in linkage.lookup_properties(targets, targets.select("id", F.lit(0).alias("k"), "line").filter("line is not null"), props, 0.1, 0.1).collect()}
    first = {i: min(p for p in range(0, 600, 3) if p % 10 == i) for i in range(10)}
    assert got == {i: (first[i % 10], 140, 0.0, 0) if i % 2 == 0 else (i % 10, 0, 0.0, None) for i in range(100)}
    assert sizes["wanted"] == 5 and sizes.get("nearest", 0) == 0


@pytest.mark.parametrize("size", [256, 2])
def test_lookup_by_place_against_all_pairs(spark, monkeypatch, size):
    """Blank lines and lines without number on either side, ties of distance, and lists of places that are cut."""
    monkeypatch.setattr(linkage, "LIST", size)
    monkeypatch.setattr(linkage, "BLOCK", 2 * size)
    rng = random.Random(size)

    def row(i):
        line = " ".join(filter(None, [rng.choice(["1", "2", ""]), rng.choice(["Oak", "Elm Hill", ""]), rng.choice(["St", "Road"])]))
        return (i, rng.choice([line, line, line, line, None, ""]), rng.choice([33.0, 33.001, 33.002, None]), rng.choice([-84.0, -84.001]))

    targets, props = [row(i) for i in range(150)], [row(i) for i in range(60)]
    t = spark.createDataFrame(targets, "id long, line string, lat double, lon double")
    p = spark.createDataFrame(props, "property_id long, line string, lat double, lon double")
    pairs = t.join(p.select("property_id", F.col("line").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), F.lit(True))
    pairs = pairs.withColumn("miles", F.round(linkage.geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / linkage.MILE_M, 6)).filter("lat is not null and lat2 is not null and miles <= 0.08")
    a, b = F.col("line"), F.col("other")
    pairs = pairs.select("id", "property_id", "miles", lines.line_score(a, b).alias("score")).where(lines.lines_match(a, b)).filter("score >= 0")
    best = {}
    for r in sorted(pairs.collect(), key=lambda r: (-r.score, r.miles, r.property_id)):
        best.setdefault(r.id, (r.property_id, r.score, r.miles))
    none = t.select("id", F.lit(0).alias("k"), "line").limit(0)
    got = {r.id: (r.property_id, r.score, r.miles) for r in linkage.lookup_properties(t, none, p, 0.1, 0.08).collect()}
    assert got == best and min(v[1] for v in best.values()) == 0 and max(v[1] for v in best.values()) >= 100
    found = linkage.pick_properties(t, p, 0.08).collect()
    assert {r.id: (r.property_id, r.score) for r in found} == {i: v[:2] for i, v in brute(targets, props, 0.08).items()}
