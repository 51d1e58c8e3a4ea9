"""A waterfall over tables of providers (inventory G-5, C-28, J-30)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import written

#: The match that is required, and the confidence that a result without it has at most.
MATCH_REQUIRED, LOW_MATCH_CAP = 100, 35


@dataclass(frozen=True)
class Tier:
    """A provider: its ``answers`` to rows that are still open (``id``, ``line``), with ``id``, ``ok``, ``formatted``, ``number`` and ``confidence``, and the confidence at which an accepted one settles a row."""

    name: str
    answers: Callable[[DataFrame], DataFrame]
    settles: float


def accepted(ok: Column, agrees: Column, confidence: Column) -> Column:
    """C-28: found, in agreement with the line, and of some confidence."""
    return F.coalesce(ok & agrees & (F.coalesce(confidence, F.lit(0.0)) > 0), F.lit(False))


def finalized(answers: DataFrame, required: int = MATCH_REQUIRED, cap: float = LOW_MATCH_CAP) -> DataFrame:
    """J-30: ``answers`` with ``line``, its house number ``own``, ``ok``, ``formatted``, ``number``, ``confidence`` get ``match``, ``agrees`` and their final ``confidence``.

    What matches less than is required has ``cap`` at most, unless the house numbers of both lines are equal: such a result
    is accepted with 100. What wasn't found is left as it is and agrees with nothing.
    """
    c = F.col
    other = F.coalesce(F.nullif(F.upper("number"), F.lit("")), text.house_number(c("formatted")))
    rows = answers.withColumn("__other", other)
    rows = rows.withColumn("match", F.when(c("ok"), text.match_percent(c("line"), c("formatted"), c("own"), c("__other"))))
    low = c("match") < required
    same = low & F.coalesce(c("own") == c("__other"), F.lit(False))
    final = F.when(~c("ok"), c("confidence")).when(same, 100.0).when(low, F.least("confidence", F.lit(float(cap)))).otherwise(c("confidence"))
    return rows.withColumns({"agrees": F.coalesce(c("ok") & (~low | same), F.lit(False)), "confidence": final}).drop("__other")


def waterfall(rows: DataFrame, tiers: list[Tier]) -> DataFrame:
    """G-5: (``id``, ``tier``, ``formatted``, ``confidence``, ``match``, ``settled``) of each row (``id``, ``line``) that any tier answers.

    Tiers are tried in order, each on the rows that none before has settled, which are written in between, so a tier reads
    what it needs once. A row that no tier settles gets its accepted answer of the highest confidence, the earliest of
    equals; one without an accepted answer has no row. A tier that gives several answers to a row counts with the best.
    """
    c = F.col
    left, settled, others = written(rows.select("id", "line", text.house_number(c("line")).alias("own")), "open"), [], []
    for place, tier in enumerate(tiers):
        own = finalized(tier.answers(left).join(left, "id"))
        # no filter before: it would be pushed down, and each of its columns computed anew
        best = own.groupBy("id").agg(F.max(F.when(accepted(c("ok"), c("agrees"), c("confidence")), F.struct("confidence", "match", "formatted"))).alias("b")).filter("b is not null")
        best = written(best.select("id", F.lit(place).alias("place"), F.lit(tier.name).alias("tier"), "b.formatted", "b.confidence", "b.match"), f"tier-{place}")
        settled.append(best.filter(c("confidence") >= tier.settles))
        others.append(best.filter(c("confidence") < tier.settles))
        left = written(left.join(settled[-1].select("id"), "id", "left_anti"), f"open-{place}")
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    rest = union(others).join(left.select("id"), "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("tier", "formatted", "confidence", "match"), F.struct("confidence", (-c("place")).alias("p"))).alias("b"))
    names = ["id", "tier", "formatted", "confidence", "match"]
    return union(settled).select(*names, F.lit(True).alias("settled")).unionByName(rest.select("id", "b.tier", "b.formatted", "b.confidence", "b.match", F.lit(False).alias("settled")))
