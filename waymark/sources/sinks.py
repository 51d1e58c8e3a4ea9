"""Exports (inventory 2.B): CSV, JSON and KML, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """B-x."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """B-24."""
    df.write.mode("overwrite").json(path)


def _escaped(name: str):
    c = F.coalesce(F.col(name).cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def placemark_lines(df: DataFrame) -> DataFrame:
    """B-z: one line of KML for each row (``raw_address``, ``rule_status``, ``lat``, ``lon``) with coordinates."""
    line = F.concat(F.lit("<Placemark><name>"), _escaped("raw_address"), F.lit("</name><description>"), _escaped("rule_status"), F.lit("</description><Point><coordinates>"), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("</coordinates></Point></Placemark>"))
    return df.filter("lat is not null and lon is not null").select(line.alias("value"))


def write_kml(df: DataFrame, path: str) -> None:
    """B-z: a folder of part files, each a whole KML document."""

    def documents(batches):
        yield_head = True
        for b in batches:
            if yield_head:
                b.loc[b.index[:1], "value"] = '<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + b["value"].iloc[:1]
                yield_head = False
            yield b
        if not yield_head:
            yield type(b)({"value": ["</Document></kml>"]})

    placemark_lines(df).mapInPandas(documents, "value string").write.mode("overwrite").text(path)
