"""Incremental refresh of rule statuses (inventory E-8, E-c)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import rules

#: Flags of the ladder that a row brings itself; two more come from the rows that share its key.
FLAGS = ["sticky_duplicate", "missing_address", "interpolated_conflict", "coord_mismatch", "is_geospatial", "is_discovered", "exact_found", "exact_warning", "not_found", "failed_validation", "has_final"]
STATUSES = ["verified", "duplicate", "invalid", "new", "excluded"]


@dataclass(frozen=True)
class Refreshed:
    """``rows``: ``id``, ``key``, ``digest``, ``rule_status``, ``color`` of all rows; ``counts`` by status; ``recomputed``: the ids that were classified anew."""

    rows: DataFrame
    counts: dict[str, int]
    recomputed: DataFrame


def digested(rows: DataFrame) -> DataFrame:
    """``rows`` with the digest of all that their status depends on but for other rows."""
    inputs = F.to_json(F.struct("key", "file_role", *FLAGS, "flow_status"), {"ignoreNullFields": "false"})
    return rows.withColumn("digest", F.unhex(F.sha2(inputs, 256)))


def classified(rows: DataFrame) -> DataFrame:
    """E-8: each row's status. ``rows`` must hold all rows of each key that they hold.

    A row whose key an earlier row (of smaller ``id``) has is a duplicate; a geospatial row is new or uploaded only if no
    tabular row has its key. Rows without a key share it with none.
    """
    context = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("__first"), F.bool_or(F.coalesce(F.col("file_role") == "tabular", F.lit(False))).alias("__tabular"))
    own = rows.join(context, "key", "left").withColumns({"seen_before": F.coalesce(F.col("id") > F.col("__first"), F.lit(False)), "key_in_tabular": F.coalesce("__tabular", F.lit(False))})
    return rules.rule_status(own.withColumns({f: F.coalesce(f, F.lit(False)) for f in FLAGS})).select("id", "key", "digest", "rule_status", "color")


def _counts(rows: DataFrame) -> dict[str, int]:
    return {r["rule_status"]: r["n"] for r in rows.groupBy("rule_status").agg(F.count(F.lit(1)).alias("n")).collect()}


def refreshed(rows: DataFrame, before: Refreshed | None = None) -> Refreshed:
    """The statuses of ``rows`` (``id``, distinct; ``key``, ``file_role``, ``FLAGS``, ``flow_status``), anew or on top of those before.

    With ``before``, only rows are classified whose inputs have another digest than then, and those that share a key, now
    or then, with one that has changed, come or gone. The others' statuses and counts are taken over; the counts that go
    and come are added to them, so no row that stays is counted again.
    """
    now = written(digested(rows), "digests")
    if before is None:
        done = written(classified(now), "statuses")
        return Refreshed(done, {s: 0 for s in STATUSES} | _counts(done), done.select("id"))
    old = before.rows.select("id", F.col("key").alias("old_key"), F.col("digest").alias("old_digest"))
    both = now.select("id", "key", "digest").join(old, "id", "full_outer")
    changed = written(both.filter(~F.col("digest").eqNullSafe(F.col("old_digest"))), "changed")
    keys = written(changed.select(F.explode(F.array("key", "old_key")).alias("key")).filter("key is not null").distinct(), "touched")
    by_key = now.join(keys, "key", "left_semi").select("id")
    todo = written(by_key.unionByName(changed.filter("digest is not null").select("id")).distinct(), "to-classify")
    new = written(classified(now.join(todo, "id", "left_semi")), "statuses")
    gone = changed.filter("digest is null").select("id").unionByName(todo)
    kept, left = before.rows.join(gone, "id", "left_anti"), before.rows.join(gone, "id", "left_semi")
    minus, plus = _counts(left), _counts(new)
    counts = {s: before.counts.get(s, 0) - minus.get(s, 0) + plus.get(s, 0) for s in {*STATUSES, *before.counts, *plus}}
    return Refreshed(written(kept.unionByName(new), "refreshed"), counts, todo)
