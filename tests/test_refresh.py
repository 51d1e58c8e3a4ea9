"""Incremental refresh against a full one, and upserts from a stream that is replayed, late and killed."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import refresh
from waymark.streaming import upserts

SCHEMA = "id long, key string, file_role string, flow_status string, " + ", ".join(f"{f} boolean" for f in refresh.FLAGS)


def random_row(rng, i):
    flags = [rng.choice([True, False, False, False, None]) for _ in refresh.FLAGS]
    return (i, rng.choice([None, *(f"k{n}" for n in range(40))]), rng.choice(["tabular", "geospatial", None]), rng.choice(["verified", None]), *flags)


def state(done):
    return sorted(tuple(r) for r in done.rows.select("id", "key", "rule_status", "color").collect())


def test_refresh_equals_a_full_one_and_touches_no_more(spark):
    rng = random.Random(7)
    rows = {i: random_row(rng, i) for i in range(150)}
    done = refresh.refreshed(spark.createDataFrame(list(rows.values()), SCHEMA))
    assert done.recomputed.count() == 150
    for step in range(3):
        before, changed = dict(rows), set()
        for i in rng.sample(sorted(rows), 6):
            changed.add(i)
            if rng.random() < 0.3:
                del rows[i]
            else:
                rows[i] = random_row(rng, i)
        for i in (1000 + 10 * step, 1001 + 10 * step, -5 - step):
            changed.add(i)
            rows[i] = random_row(rng, i)
        frame = spark.createDataFrame(list(rows.values()), SCHEMA)
        done, full = refresh.refreshed(frame, done), refresh.refreshed(frame)
        assert state(done) == state(full) and done.counts == full.counts and sum(done.counts.values()) == len(rows)
        keys = {t[i][1] for i in changed for t in (before, rows) if i in t} - {None}
        redone = {r.id for r in done.recomputed.collect()}
        assert redone == {i for i, r in rows.items() if i in changed and r != before.get(i) or r[1] in {t[i][1] for i in changed if before.get(i) != rows.get(i) for t in (before, rows) if i in t} - {None}}
        assert redone <= {i for i, r in rows.items() if i in changed or r[1] in keys} and len(redone) < len(rows)
    same = refresh.refreshed(frame, done)
    assert same.recomputed.count() == 0 and state(same) == state(done) and same.counts == done.counts


def test_refresh_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    done = refresh.refreshed(none)
    assert done.rows.count() == 0 and set(done.counts.values()) == {0}
    one = refresh.refreshed(spark.createDataFrame([random_row(random.Random(1), 1)], SCHEMA), done)
    assert sum(one.counts.values()) == 1 and sum(refresh.refreshed(none, one).counts.values()) == 0


ROWS = "address_id long, stage string, version long, score int"


@pytest.fixture
def arrivals(spark, tmp_path):
    rng = random.Random(2)
    files = []
    for n in range(4):  # versions go up and down, so some rows come late
        rows = [(rng.randrange(20), f"agent{rng.randrange(2)}", rng.randrange(60), rng.randrange(100)) for _ in range(40)]
        files.append([(*r[:2], r[2], r[2] * 7 % 101) for r in rows])
    return files


def add(spark, folder, rows, n):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def latest(files):
    out = {}
    for rows in files:
        for a, s, v, x in rows:
            if (a, s) not in out or v >= out[(a, s)][0]:
                out[(a, s)] = (v, x)
    return sorted((*k, *v) for k, v in out.items())


def test_stream_upserts(spark, tmp_path, arrivals):
    table, keys = str(tmp_path / "table"), ["address_id", "stage"]
    now = lambda path=table: sorted(tuple(r) for r in upserts.current(spark, path, ROWS, keys, "version").select("address_id", "stage", "version", "score").collect())
    for n, rows in enumerate(arrivals[:2]):
        add(spark, tmp_path, rows, n)
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        upserts.upsert_stream(stream, table, str(tmp_path / "cp"), keys, "version").awaitTermination()
        assert now() == latest(arrivals[: n + 1])
    # a batch that is run once more changes nothing
    upserts._write_batch(spark.createDataFrame(arrivals[1], ROWS), 1, table, keys, "version")
    assert now() == latest(arrivals[:2])
    # killed after the write of the third batch and before its commit: the restarted query writes it once more
    add(spark, tmp_path, arrivals[2], 2)
    upserts._write_batch(spark.createDataFrame(arrivals[2][:20], ROWS), 2, table, keys, "version")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upserts.upsert_stream(stream, table, str(tmp_path / "cp"), keys, "version").awaitTermination()
    assert now() == latest(arrivals[:3])
    # a query that fails in the middle of a batch, then a new one
    add(spark, tmp_path, arrivals[3], 3)
    stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    broken = stream.withColumn("score", F.expr("if(address_id >= 0, raise_error('killed'), score)"))
    with pytest.raises(Exception, match="killed"):
        upserts.upsert_stream(broken, table, str(tmp_path / "cp"), keys, "version").awaitTermination()
    assert now() == latest(arrivals[:3])
    upserts.upsert_stream(stream, table, str(tmp_path / "cp"), keys, "version").awaitTermination()
    assert now() == latest(arrivals)
    upserts.compacted(spark, table, str(tmp_path / "folded"), ROWS, keys, "version")
    assert now(str(tmp_path / "folded")) == latest(arrivals)
