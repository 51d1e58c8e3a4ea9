"""Rows in order without a window over everything: ranks, quotas for groups and for all, round-robin (inventory M-9, F-g, G-b).

Rows are ranged by group and order and numbered as they stand. A row's rank in its group follows from its number, the
smallest number of its group in its partition, and how many of its group stand in earlier partitions. Only these counts, one
for each group and partition that meet, are ever joined; no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

_ALL = "__all"
#: Groups whose sizes are summed in one task.
BLOCK = 10_000


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: the place, from 0, of each row in its group by ``order`` (null first), which must tell the rows of a group apart; without ``group``, among all."""
    by = group or [_ALL]
    if not group:
        rows = rows.withColumn(_ALL, F.lit(0))
    keys = [F.asc_nulls_first(c) for c in (*by, *order)]
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"__at": F.spark_partition_id(), "__n": F.monotonically_increasing_id()})
    placed = written(placed, "placed")
    counts = placed.groupBy(*by, "__at").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__c"))
    # a group has a row for each partition that it meets
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.withColumn("__before", before), "places")
    own = counts.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), F.col("__at").alias("__there"), "__first", "__before")
    on = F.col("__at") == F.col("__there")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__{i}"))
    joined = placed.join(own, on).withColumn(name, F.col("__n") - F.col("__first") + F.col("__before"))
    return joined.select(*(c for c in rows.columns if c != _ALL), name)


def first_in_order(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows by ``order``, however many these are; all for 0."""
    return ranked(rows, [], order, "__rank").filter(F.col("__rank") < limit).drop("__rank") if limit else rows


def within_quotas(rows: DataFrame, group: str, order: list[str], per_group: int = 0, total: int = 0) -> DataFrame:
    """G-b: group by group, in the groups' order, the first ``per_group`` rows of each until ``total`` are taken; 0 is no limit."""
    own = ranked(rows, [group], order, "__rank")
    if per_group:
        own = own.filter(F.col("__rank") < per_group)
    if not total:
        return own.drop("__rank")
    own = written(own, "within-group")
    sizes = ranked(own.groupBy(group).agg(F.count(F.lit(1)).alias("__c")), [], [group], "__g")
    # running sums in two steps, over blocks of groups and inside each block, so that no window has more than BLOCK rows or a row a block
    sizes = written(sizes.withColumn("__block", F.floor(F.col("__g") / BLOCK)), "sizes")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.groupBy("__block").agg(F.sum("__c").alias("s")).withColumn("__wide", F.floor(F.col("__block") / BLOCK))
    wide = starts.groupBy("__wide").agg(F.sum("s").alias("w"))
    starts = starts.withColumn("__in", earlier("s", Window.partitionBy("__wide").orderBy("__block")))
    before = {r["__wide"]: r["w"] for r in wide.collect()}  # a row for each BLOCK * BLOCK groups
    start, run = F.lit(0), 0
    for w in sorted(before):
        start, run = F.when(F.col("__wide") == w, F.lit(run)).otherwise(start), run + before[w]
    starts = starts.select("__block", (F.col("__in") + start).alias("__start"))
    inside = earlier("__c", Window.partitionBy("__block").orderBy("__g"))
    quota = F.lit(total) - F.col("__start") - F.col("__inside")
    quotas = sizes.withColumn("__inside", inside).join(starts, "__block").filter(quota > 0).select(F.col(group).alias("__own"), quota.alias("__quota"))
    return own.join(quotas, F.col(group).eqNullSafe(F.col("__own"))).filter(F.col("__rank") < F.col("__quota")).drop("__rank", "__own", "__quota")


def round_robin(rows: DataFrame, group: str, order: list[str], per_group: int = 0, total: int = 0) -> DataFrame:
    """The groups' rows in turn: each group's first, in the groups' order, then each one's second, and so on; ``turn`` is the place, from 0.

    At most ``per_group`` of a group and ``total`` of all are taken; 0 is no limit.
    """
    own = ranked(rows, [group], order, "__rank")
    if per_group:
        own = own.filter(F.col("__rank") < per_group)
    out = ranked(own, [], ["__rank", group], "turn").drop("__rank")
    return out.filter(F.col("turn") < total) if total else out
