"""Footprint tiles: GeoJSON lines, covers, pruning by the points' own tiles, choice of sources."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.sources import footprints


def square(lat, lon, h):
    return [(lat - h, lon - h), (lat - h, lon + h), (lat + h, lon + h), (lat + h, lon - h)]


def frame(spark, rows):
    return spark.createDataFrame([(i, r, [{"lat": y, "lon": x} for y, x in ring]) for i, r, ring in rows], f"polygon_id long, region string, ring {footprints.RING}")


def test_lines_that_are_no_features_are_skipped(spark, tmp_path):
    ring = [[0, 0], [0, 1], [1, 1], [0, 0]]
    lines = [
        json.dumps({"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "Polygon", "coordinates": [ring, [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2]]]}}),
        "",
        "{broken",
        json.dumps({"type": "Feature", "properties": {"id": 2}, "geometry": None}),
        json.dumps({"type": "Feature", "properties": {"id": 3}}),
        json.dumps({"type": "Feature", "properties": {"id": 4}, "geometry": {"type": "Point", "coordinates": [1, 2]}}),
        json.dumps({"type": "Feature", "properties": {"id": 5}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring[::-1]]]}}),
        json.dumps([1, 2]),
    ]
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    got = sorted((r.properties["id"], r.part, [(c.lon, c.lat) for c in r.ring]) for r in footprints.read_features(spark, str(tmp_path / "a.csv.gz")).collect())
    assert [(i, p) for i, p, _ in got] == [("1", 0), ("5", 0), ("5", 1)] and got[0][2] == [(0, 0), (0, 1), (1, 1), (0, 0)] and got[2][2][1] == (1, 1)
    (tmp_path / "b.txt").write_text("\n".join(lines[:1]))
    assert footprints.read_features(spark, str(tmp_path / "b.txt")).count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_cover_is_exact_and_has_no_tile_twice(spark, seed):
    rng = random.Random(seed)
    s, w = rng.uniform(-80, 70), rng.uniform(-170, 150)
    n, e = s + rng.uniform(0, 12), w + rng.uniform(0, 20)
    box = spark.createDataFrame([(s, w, n, e)], "south double, west double, north double, east double")
    fine = {r.quadkey for r in footprints.tiles_of_box(box, 9).collect()}
    mixed = [r.quadkey for r in footprints.tile_cover(box, 9).collect()]
    grown = [k + "".join(t) for k in mixed for t in _endings(9 - len(k))]
    assert sorted(grown) == sorted(fine) and len(set(mixed)) == len(mixed) and len(mixed) <= len(fine)
    points = [(rng.uniform(s, n), rng.uniform(w, e)) for _ in range(50)]
    keys = spark.createDataFrame(points, "lat double, lon double").select(geo.quadkey(F.col("lat"), F.col("lon"), 9).alias("k"))
    assert all(r.k in fine for r in keys.collect())


def _endings(n):
    return [()] if n == 0 else [(d, *rest) for d in "0123" for rest in _endings(n - 1)]


def test_tiles_are_pruned_by_the_points(spark, tmp_path):
    """Many tiles on disk, points in a few: the plan prunes at run time and the other files aren't opened."""
    rng = random.Random(1)
    rows = [(i, "US", square(rng.uniform(25, 48), rng.uniform(-120, -75), rng.choice([0.01, 0.01, 0.4]))) for i in range(1500)]
    path = str(tmp_path / "tiles")
    footprints.write_tiles(frame(spark, rows), path)
    files = len(list((tmp_path / "tiles").rglob("*.parquet")))
    lengths = {len(p.name) for p in (tmp_path / "tiles").glob("tile=*")}
    assert len(lengths) > 1 and files > 300
    places = [(k, *rows[k * 7][2][0]) for k in range(6)] + [(100, 0.0, 0.0), (101, None, None), (102, 95.0, 1.0)]
    points = spark.createDataFrame(places, "id long, lat double, lon double")
    found = footprints.tiles_with(points, path)
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()
    assert found.count() > 0
    read = scanned_files(found)
    assert 0 < read < files / 4
    got = {r.id: r.polygon_id for r in footprints.footprints_at(points, path).collect()}
    inside = lambda y, x, ring: ring[0][0] <= y <= ring[2][0] and ring[0][1] <= x <= ring[2][1]
    assert got == {i: None if y is None else min((p for p, _, ring in rows if inside(y, x, ring)), default=None) for i, y, x in places}


def scanned_files(df):
    """The number of files that the scan of ``tile=`` folders opened."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    plan = execution.executedPlan()
    todo, total = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            metrics = node.metrics()
            total += metrics.apply("numFiles").value()
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_large_footprints_have_short_keys(spark, tmp_path):
    rows = [(1, "US", square(40.0, -100.0, 0.001)), (2, "US", square(40.0, -100.0, 6.0)), (3, "US", square(10.0, 10.0, 9.9)), (4, "US", [(0.0, 0.0), (1.0, 1.0)]), (5, "US", square(89.0, 0.0, 3.0))]
    footprints.write_tiles(frame(spark, rows), str(tmp_path / "t"))
    got = spark.read.schema(footprints.TILES).parquet(str(tmp_path / "t")).groupBy("polygon_id").agg(F.count("*").alias("n"), F.max(F.length("tile")).alias("l")).collect()
    by = {r.polygon_id: (r.n, r.l) for r in got}
    assert set(by) == {1, 2, 3} and all(n <= 4 for n, _ in by.values()) and by[1][1] == 10 and by[2][1] < 8
    points = spark.createDataFrame([(1, 40.0, -100.0), (2, 45.0, -97.0), (3, 12.0, 4.0), (4, -60.0, 5.0)], "id long, lat double, lon double")
    assert {r.id: r.polygon_id for r in footprints.footprints_at(points, str(tmp_path / "t")).collect()} == {1: 1, 2: 2, 3: 3, 4: None}


def test_sources_across_the_border(spark):
    index = [("302", "Canada", "u1", 1), ("302", "United States", "u2", 2), ("302", "UnitedStates", "u1", 3), ("302", "Greenland", "u0", 0), ("302", "Canada", " ", 4), ("31", "Mexico", "m", 5)]
    index = spark.createDataFrame(index, "quadkey string, location string, url string, ord int")
    asked = lambda *rows: [(r.quadkey, r.choice, r.region, r.url) for r in footprints.tile_sources(spark.createDataFrame(rows, "quadkey string, preferred string"), index).orderBy("quadkey", "choice").collect()]
    key = "000000302"
    assert asked((key, "United States")) == [(key, 1, "UnitedStates", "u2"), (key, 2, "Canada", "u1"), (key, 3, "Greenland", "u0")]
    assert asked(("302", "Canada")) == [(key, 1, "Canada", "u1"), (key, 2, "UnitedStates", "u2"), (key, 3, "Greenland", "u0")]
    assert [x[2] for x in asked(("302", None))] == ["Greenland", "Canada", "UnitedStates"] and asked(("33", "Canada")) == []


def test_regions_of_wide_footprints_are_not_cut_in_small_tiles(spark, monkeypatch):
    """Boxes of a continent's size: 200 million tiles of level 14, of which the points have three."""
    cut = footprints.tiles_of_box
    monkeypatch.setattr(footprints, "tiles_of_box", lambda *a: pytest.fail("cut in tiles of the points' level") if a else cut)
    rows = [(i, "Canada" if i % 2 else "United States", square(40.0, -100.0, 30.0)) for i in range(60)] + [(90, "Canada", square(33.0, 20.0, 0.001)), (91, "United States", square(33.0, 20.0, 0.3)), (92, "United States", square(-33.0, 20.0, 0.0001))]
    points = spark.createDataFrame([(1, 40.0, -100.0), (2, 33.002, 20.002), (3, 33.0021, 20.0019), (4, -33.0, 20.001), (5, None, None)], "id long, lat double, lon double")
    keys = {r.id: r.k for r in points.filter("lat is not null").select("id", geo.quadkey(F.col("lat"), F.col("lon"), 14).alias("k")).collect()}
    sources = spark.createDataFrame([(k, n, r, "u") for k in set(keys.values()) for n, r in ((1, "Canada"), (2, "UnitedStates"))], "quadkey string, choice int, region string, url string")
    got = {r.quadkey: r.region for r in footprints.chosen_regions(points, frame(spark, rows), sources, 14).collect()}
    assert got == {keys[1]: "Canada", keys[2]: "UnitedStates"}
