"""The corpus pipeline: quality, near copies, benchmark leaks, private data, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one. All
stages read whole texts however long, give an empty table for an empty one, keep further columns as they are, and use
names of their own with a prefix that no column has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, jaccard, mixing, pii, quality
from waymark.llm.common import OWN, id_remainder, table, written
from waymark.llm.queries import PII_KEY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects: those with a score below 0.3.

    Null and empty texts have the score of the output layer's bias alone; repeated rows have equal scores and share one
    fate, and a null id counts as empty text in the fold. A score of exactly 0.3 is kept.
    """
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"), "quality", id_remainder("doc_id", 5) != 0)
    return quality.score_quality(docs, model, out_col=f"{OWN}score").filter(F.col(f"{OWN}score") >= 0.3).drop(f"{OWN}score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles with Jaccard 0.8 or more.

    Null and empty texts are linked with nothing and stay, as do rows without id. Rows that repeat an id are documents of
    their own: of equal or linked ones one stays, and those that have nothing but the id in common all stay.
    """
    return jaccard.one_of_each(docs, 5, 80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold 0.8 or more of a benchmark item's five-word shingles.

    Null and empty texts hold nothing and stay; repeated rows share one fate; an item without words is in nothing.
    """
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"), n=5, percent=80)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces private data by surrogates; ``n_chars`` follows the text where that has changed.

    No row goes. Null and empty texts stay as they are; repeated rows get equal texts.
    """
    out = pii.pseudonymize(docs, PII_KEY, count_col=f"{OWN}n")
    return out.withColumn("n_chars", F.when(F.col(f"{OWN}n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(f"{OWN}n")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that a source of n documents gets a share in proportion to the square root of n.

    A null source is a source of its own; texts play no part; repeated rows of an id draw one count.
    """
    return mixing.mix_sources(docs, alpha=0.5, epochs=1.0, seed="mix")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("private", replace_private),
    ("mixture", mix),
]

#: The classifier and the surrogates have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
