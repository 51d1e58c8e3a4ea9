"""KML and KMZ readers (inventory 2.A): one row per placemark that counts as an address or a polygon."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text

SCHEMA = "source_file string, row_number long, name string, folder_path string, category string, geometry_type string, coordinates string, vertex_count int, description string, fields map<string,string>"
#: Folders whose points are addresses.
ADDRESS_FOLDERS = ["household", "households", "address", "addresses"]


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _child(e: ElementTree.Element, name: str) -> str | None:
    return next((c.text for c in e if _tag(c) == name), None)


def _placemark(e: ElementTree.Element, folders: list[str]) -> tuple | None:
    fields = {}
    for d in e.iter():
        if _tag(d) == "Data":
            fields[d.get("name", "")] = next((c.text for c in d if _tag(c) == "value"), None)
        elif _tag(d) == "SimpleData":
            fields[d.get("name", "")] = d.text
    shapes = [d for d in e.iter() if _tag(d) in ("Point", "Polygon", "LineString")]
    shape = next((s for s in shapes if _tag(s) == "Point"), shapes[0] if shapes else None)
    found = next((c.text for c in shape.iter() if _tag(c) == "coordinates"), None) if shape is not None else None
    points = (found or "").split()
    return (_child(e, "name"), "/".join(folders), folders[-1] if folders else None, _tag(shape) if shape is not None else None, " ".join(points), len(points), _child(e, "description"), fields)


def _walk(e: ElementTree.Element, folders: list[str]) -> Iterator[tuple]:
    for c in e:
        if _tag(c) == "Folder":
            yield from _walk(c, [*folders, (_child(c, "name") or "").strip()])
        elif _tag(c) == "Document":
            yield from _walk(c, folders)
        elif _tag(c) == "Placemark":
            yield _placemark(c, folders)


def _members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """A KML file itself; of an archive, each KML member."""
    if content[:2] != b"PK":
        yield name, content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for member in archive.namelist():
            if member.lower().endswith(".kml"):
                yield f"{name}:{member}", archive.read(member)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """A-3 to A-8, A-12: all placemarks of KML and KMZ files, numbered within each file. A file is one task's; files that aren't XML give no rows."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b.path, b.content, strict=True):
                for name, data in _members(file.rsplit("/", 1)[-1], content):
                    try:
                        root = ElementTree.fromstring(data)
                    except ElementTree.ParseError:
                        continue
                    rows = [(name, n, *p) for n, p in enumerate(_walk(root, []), 1)]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.sub(r"<.*?>", "", SCHEMA).split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMA)


def description_fields(c: Column) -> Column:
    """A-7: ``key: value`` lines of an HTML description, with keys under 40 characters."""
    lines = F.split(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), "\n")
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    pairs = F.filter(plain, lambda x: x.rlike(r"^[^:]{1,39}:\s*\S"))
    return F.map_from_entries(F.array_compact(F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)).alias("value")))))


def address_placemarks(placemarks: DataFrame) -> DataFrame:
    """A-5, A-11: points of address folders and all polygons, with address and place; other placemarks go."""
    parts = F.transform(F.split(F.lower(F.coalesce("folder_path", F.lit(""))), "/"), F.trim)
    household = F.arrays_overlap(parts, F.array(*map(F.lit, ADDRESS_FOLDERS)))
    lat, lon = geo.parse_coordinate(F.col("coordinates"))
    by_header = lambda name: F.get(F.filter(F.map_values(F.map_filter("fields", lambda k, v: text.normalize_header(k) == name)), lambda v: v.isNotNull()), F.lit(0))
    described = F.get(F.map_values(F.map_filter(description_fields(F.coalesce("description", F.lit(""))), lambda k, v: F.lower(k) == "address")), F.lit(0))
    candidates = [by_header("address"), F.col("name"), by_header("street"), described]
    line = F.coalesce(*[F.when(text.looks_like_street(c), F.trim(c)) for c in candidates], text.clean_value(F.col("name")))
    kept = placemarks.filter((F.col("geometry_type") == "Polygon") | ((F.col("geometry_type") == "Point") & household))
    return kept.withColumns({"raw_address": line, "lat": lat, "lon": lon, "map_layer_only": F.col("geometry_type") == "Polygon"})


