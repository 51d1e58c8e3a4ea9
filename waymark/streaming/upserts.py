"""Upserts of stage results from a stream (inventory B-11 to B-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_number"


def _write_batch(batch: DataFrame, number: int, path: str, keys: list[str], version: str) -> None:
    """The latest row of each key of a batch, in the batch's own folder. A replayed batch overwrites that folder with the same rows, so it changes nothing."""
    columns = [c for c in batch.columns if c not in keys]
    latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(F.col(version).alias("v"), F.xxhash64(*columns).alias("h"))).alias("row"))
    latest.select(*keys, "row.*").write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")


def upsert_stream(results: DataFrame, path: str, checkpoint: str, keys: list[str], version: str, **trigger: object) -> StreamingQuery:
    """Starts the upsert of ``results`` into the table at ``path``: of each key the row with the greatest ``version`` counts.

    Each batch writes what it has into a folder with its number, so writing it twice is writing it once, a query that was
    killed between the write and its commit goes on where it was, and a late row never replaces a later version. The
    table is read by ``current`` and folded by ``compacted``.
    """
    run = lambda batch, number: _write_batch(batch, number, path, keys, version)
    return results.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str, schema: str, keys: list[str], version: str) -> DataFrame:
    """The latest version of each key over all batches; of equal versions the row of the later batch."""
    rows = spark.read.schema(f"{schema}, {BATCH} bigint").parquet(path)
    columns = [c for c in rows.columns if c not in (*keys, BATCH)]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(F.col(version).alias("v"), F.col(BATCH).alias("b"))).alias("row"))
    return latest.select(*keys, "row.*")


def compacted(spark: SparkSession, path: str, new_path: str, schema: str, keys: list[str], version: str) -> None:
    """Folds all batches into one at ``new_path``, under the last one's number, so that a stream can go on there."""
    last = spark.read.schema(f"{schema}, {BATCH} bigint").parquet(path).agg(F.max(BATCH).alias("b")).first().b
    if last is not None:
        current(spark, path, schema, keys, version).write.mode("overwrite").parquet(f"{new_path}/{BATCH}={last}")
