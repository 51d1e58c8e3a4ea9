"""Streams give what the same functions give over tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waymark.streaming import limiter, windows


@pytest.fixture
def folder(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, f"k{i % 3}", start + timedelta(seconds=i * 7 % 600), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp, value double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in"), tmp_path


def drained(stream, name, mode, where):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(where / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_limiter_stream(spark, folder):
    df, path, where = folder
    stream = spark.readStream.schema(df.schema).parquet(path).select("event_id", "key", "ts")
    got = drained(limiter.limited_stream(stream, 5, 60.0), "limited", "append", where)
    want = limiter.limited(df, 5, 60.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter(~F.col("allowed")).count() > 0


def test_windowed_counts(spark, folder):
    df, path, where = folder
    got = drained(windows.windowed_counts(spark.readStream.schema(df.schema).parquet(path), "key"), "windowed", "complete", where)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.windowed_counts(df, "key").collect()))


def test_quiet_keys_leave_the_state(spark, tmp_path):
    """Three keys, then an hour of another one: the three logs are gone, and what came before still counts in the decisions."""
    start = datetime(2024, 1, 1)
    files = [[(k * 10 + n, f"k{k}", start + timedelta(seconds=n)) for k in range(3) for n in range(8)], [(100, "z", start + timedelta(hours=1))], [(101, "z", start + timedelta(hours=2)), (102, "k0", start + timedelta(hours=2))]]
    schema, seen, allowed = "event_id long, key string, ts timestamp", [], []
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = limiter.limited_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5, 60.0)
        q = stream.writeStream.foreachBatch(lambda b, i: allowed.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(q.recentProgress[-1].stateOperators[0].numRowsTotal)
    assert seen[0] > 0 and seen[-1] < seen[0]
    by = {i: ok for i, _, _, ok in allowed}
    assert all(by[k * 10 + n] == (n < 5) for k in range(3) for n in range(8)) and by[100] and by[101] and by[102]
    assert len(allowed) == 27
