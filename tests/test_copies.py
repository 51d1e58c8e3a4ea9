"""Equal rows are compared once: joins don't grow with the square of the copies."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import uploads
from waymark.operators import spatial


def square(lat, lon, h):
    return [{"lat": lat - h, "lon": lon - h}, {"lat": lat - h, "lon": lon + h}, {"lat": lat + h, "lon": lon + h}, {"lat": lat + h, "lon": lon - h}]


@pytest.fixture
def pairs(monkeypatch):
    """The numbers of pairs of points and polygons that are compared."""
    seen, of = [], spatial._around_polygons

    def counted(*a):
        out = of(*a)
        seen.append(out.count())
        return out

    monkeypatch.setattr(spatial, "_around_polygons", counted)
    return seen


def copies(spark):
    points = spark.range(600).select("id", (32.0 + F.col("id") % 3 * 0.4).alias("lat"), F.lit(-84.0).alias("lon"))
    rings = spark.createDataFrame([(i, square(32.0 + i % 2 * 0.5, -84.0, 0.3)) for i in range(400, 0, -1)], "polygon_id long, ring array<struct<lat:double,lon:double>>")
    return points, rings


def test_copies_are_contained_once(spark, pairs):
    points, rings = copies(spark)
    more = points.unionByName(spark.createDataFrame([(600, None, -84.0), (601, float("nan"), 1.0), (602, 0.0, 0.0)], points.schema))
    got = {r.id: r.polygon_id for r in spatial.containing(more, rings).collect()}
    assert got == {i: {0: 2, 1: 1, 2: None}[i % 3] if i % 3 < 2 else 1 for i in range(600)} | {600: None, 601: None, 602: None}
    assert sum(pairs) <= 6


def test_copies_are_nearest_once(spark, pairs):
    points, rings = copies(spark)
    got = {r.id: (r.polygon_id, r.confidence) for r in spatial.nearest_polygon(points, rings).collect()}
    assert got == {i: [(2, 85), (1, 85), (1, 80)][i % 3] for i in range(600)}
    assert sum(pairs) <= 20


@pytest.mark.parametrize("query", ["upload_addresses", "mapped_records", "stage_inputs", "metadata_paths"])
def test_long_work_on_rows_is_dealt_out(spark, query):
    """Small files are one task each; the rows go to all cores before the work on them."""
    import __spark_entry__

    plan = __spark_entry__.plans.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_parts_of_uploads_are_made_once(spark):
    """Fields of a struct would be put in place of what reads them, and so each be worked out many times."""
    rows = spark.createDataFrame([(1, {"Street No": "12", "Street Name": "Oak"})], "id int, meta map<string,string>")
    rows = uploads.with_parts(rows, F.col("meta"), F.lit("x"))
    plan = rows.select(uploads.built_address(), uploads.built_street())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("house_number_suffix") <= 2  # the keys of a part, as written and normalised, stand in the plan once
