"""Mixing sources to target weights: Poisson replication.

A source's mean repetition rate is its target share of the output divided by its share of the input. Each document
draws a uniform number from a seeded hash of its id, inverts its source's Poisson distribution with it, is exploded by
that count, and all copies are shuffled by a hash of id and copy. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, written

#: Up to so many sources, their rates are broadcast; beyond, they are joined by a shuffle, where Spark splits hot sources.
BROADCAST_SOURCES = 10_000


def uniform(id_col: str, seed: str) -> Column:
    """In [0, 1), from the first 52 bits of a hash of seed and id; a null id counts as empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """Array of P(X <= k), k = 0, 1, ..., until what is left is below double precision."""
    start = F.struct((-rate).alias("lp"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        lp = s["lp"] + F.log(rate) - F.log(k.cast("double"))
        c = s["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.array_append(s["cdf"], c).alias("cdf"))

    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """One row per source: ``source``, ``n_docs``, ``rate``."""
    stats = written(docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs")), "sources")
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == F.lit(name), F.lit(float(w))).otherwise(weight)
    stats = stats.withColumn("weight", weight)
    total = stats.agg(F.sum("weight").alias("w"), F.sum("n_docs").alias("n")).first()
    scale = epochs * (total.n or 0) / total.w if total.w else 0.0
    return stats.select("source", "n_docs", (F.lit(float(scale)) * F.col("weight") / F.col("n_docs")).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, alpha: float = 0.5, epochs: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy_no") -> DataFrame:
    """``docs`` repeated to target weights, in a random global order, with the number of each copy from 1 in ``copy_col``.

    ``weights`` gives a source's share of the output (any scale; sources that it lacks are left out); without it, a
    source of n documents weighs n ** ``alpha``. The output has about ``epochs`` times as many rows as the input. A null
    source is a source of its own. Repeated rows with one id draw one count. Text plays no part, so null and empty
    texts stay. A column named ``copy_col`` is replaced. An empty table gives an empty table.
    """
    if not math.isfinite(alpha) or epochs < 0:
        raise ValueError("alpha must be finite and epochs not negative")
    rates = source_rates(docs, source_col, weights, alpha, epochs).select(F.col("source").alias(f"{OWN}source"), poisson_cdf(F.col("rate")).alias(f"{OWN}cdf"))
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates
    drawn = docs.drop(copy_col).join(rates, F.col(source_col).eqNullSafe(F.col(f"{OWN}source"))).withColumn(f"{OWN}u", uniform(id_col, seed))
    count = F.size(F.filter(f"{OWN}cdf", lambda c: c <= F.col(f"{OWN}u")))
    copies = drawn.withColumn(f"{OWN}n", count).filter(F.col(f"{OWN}n") > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(f"{OWN}n"))))
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col(copy_col))
    shuffled = copies.drop(f"{OWN}source", f"{OWN}cdf", f"{OWN}u", f"{OWN}n").withColumn(f"{OWN}at", place)
    # the partition comes from other bits than the order within it
    return shuffled.repartition(F.xxhash64(F.lit(f"{seed}:part"), f"{OWN}at")).sortWithinPartitions(f"{OWN}at").drop(f"{OWN}at")
