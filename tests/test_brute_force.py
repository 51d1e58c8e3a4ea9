"""Queries that SQL can't express, against brute force."""

import random
from functools import lru_cache

from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import spatial


def longest_common(a, b):
    @lru_cache(maxsize=None)
    def at(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + at(i + 1, j + 1) if a[i] == b[j] else max(at(i + 1, j), at(i, j + 1))

    return at(0, 0)


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcé ", k=rng.randint(0, 14))) for _ in range(2))
        assert text._common(a, b) == longest_common(a, b)
    assert text._common("ab" * 500, "ba" * 500) == 999 and text._indel("", "") == 100.0 and text._indel("a", "") == 0.0


def alike(a, b):
    """The best of three ratios over the sorted words that both have and those that one has."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    one, two = ((both + " " + " ".join(sorted(s))).strip() for s in (x - y, y - x))
    ratio = lambda p, q: 200.0 * longest_common(p, q) / (len(p) + len(q)) if p or q else 100.0
    return round(max([ratio(one, two)] + ([ratio(both, one), ratio(both, two)] if both else [])))


def test_token_sets(spark):
    rng = random.Random(4)
    words = ["12", "oak", "oaks", "st", "main", "n", "park"]
    pairs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(200)]
    rows = spark.createDataFrame(pairs, "i int, a string, b string").select("i", text.token_set_ratio(F.col("a"), F.col("b")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: 100 if a == b != "" else alike(a, b) for i, a, b in pairs}


def corners(points):
    """Points that no triangle or segment of the others holds, by half planes: a corner is the end of some edge that has all on one side."""
    found = set()
    for a in points:
        for b in points:
            if a != b:
                sides = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in points]
                on = [c for c, s in zip(points, sides) if s == 0]
                if all(s >= 0 for s in sides):
                    found |= {min(on), max(on)}
    return found or set(points)


def test_hulls(spark):
    rng = random.Random(5)
    points = [(rng.choice(["a", "b", "c", None]), float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(160)]
    points += [("one", 1.0, 1.0)] * 3 + [("line", float(k), float(k)) for k in range(4)] + [("gone", None, 1.0)]
    frame = spark.createDataFrame(points, "g string, lat double, lon double").repartition(5)
    got = {}
    for r in spatial.hulls(frame, "g").collect():
        got.setdefault(r.g, []).append((r.place, (r.lon, r.lat)))
    for g in {p[0] for p in points} - {"gone"}:
        ring = [q for _, q in sorted(got[g])]
        assert set(ring) == corners(sorted({(x, y) for own, y, x in points if own == g})) and len(set(ring)) == len(ring)
        area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))
        assert area >= 0 and ring[0] == min(ring)
    assert "gone" not in got
