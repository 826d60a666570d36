"""Shapefiles: points and polygons as rows, with the attributes of their tables.

Files are read as bytes through Spark, from any store, plain (.shp, .dbf) or zipped together; they hold tens of zones or a
grid's points, so one task parses a file. Layouts follow the format's public description (main file and dBASE III table).
"""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: shape types of points and polygons (plain, with Z, with M).
POINTS, POLYGONS = (1, 11, 21), (5, 15, 25)


def members(path: str, content: bytes) -> dict[str, bytes]:
    """Contents by ending (.shp, .dbf) of a file or of the first shapefile in a zip."""
    if not path.lower().endswith(".zip"):
        return {path.lower().rpartition(".")[2]: content}
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = sorted(n for n in archive.namelist() if n.lower().endswith((".shp", ".dbf")))
    shapes = [n for n in names if n.lower().endswith(".shp")]
    stem = shapes[0][:-4] if shapes else None
    return {n.lower().rpartition(".")[2]: archive.read(n) for n in names if stem is None or n[:-4] == stem}


def records(content: bytes):
    """Number (from 0), type and body of each record of a main file."""
    at, number = 100, 0
    while at + 8 <= len(content):
        (words,) = struct.unpack(">i", content[at + 4 : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        yield number, struct.unpack("<i", body[:4])[0], body
        at, number = at + 8 + 2 * words, number + 1


def vertices(content: bytes) -> list[tuple[int, int, int, float, float]]:
    """feature, ring, seq, x, y of a main file: rings of polygons, and points as rings of one."""
    out = []
    for number, kind, body in records(content):
        if kind in POINTS:
            out.append((number, 0, 0, *struct.unpack("<2d", body[4:20])))
        elif kind in POLYGONS:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            for ring, (a, b) in enumerate(zip(starts, starts[1:])):
                closed = b - a > 1 and xy[2 * a : 2 * a + 2] == xy[2 * b - 2 : 2 * b]
                out += [(number, ring, k - a, xy[2 * k], xy[2 * k + 1]) for k in range(a, b - closed)]
    return out


def attributes(content: bytes) -> list[tuple[int, str, str]]:
    """feature, name, value (text, trimmed) of a dBASE table; deleted rows keep their number but have no values."""
    rows, header, size = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), content[at + 16]))
        at += 32
    out = []
    for k in range(rows):
        row = content[header + k * size : header + (k + 1) * size]
        if row[:1] == b"*":
            continue
        place = 1
        for name, width in fields:
            raw = row[place : place + width]
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
            out.append((k, name, text.strip().strip("\0")))
            place += width
    return out


def parsed(spark: SparkSession, path: str, ending: str, parse, schema: str) -> DataFrame:
    """parse() of the file's member with this ending, as rows."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def work(frames):
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"]):
                found = members(where, content)
                if ending in found:
                    yield pd.DataFrame(parse(found[ending]), columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, schema)


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """feature, ring, seq, x, y of a .shp file or a zip that holds one."""
    return parsed(spark, path, "shp", vertices, "feature int, ring int, seq int, x double, y double")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """feature, name, value of a .dbf file or a zip that holds one."""
    return parsed(spark, path, "dbf", attributes, "feature int, name string, value string")


def read_zones(spark: SparkSession, path: str, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (zone_id, ring, seq, x, y) and labels (zone_id, zone_label) of a zipped polygon file; zone_id is the feature's place.

    label: the attribute that names zones, the first one without.
    """
    rows = read_attributes(spark, path)
    named = rows.where(F.col("name") == label) if label else rows.groupBy("feature").agg(F.first("value").alias("value"))
    return read_vertices(spark, path).withColumnRenamed("feature", "zone_id"), named.select(F.col("feature").alias("zone_id"), F.col("value").alias("zone_label"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """ID (the feature's place), lon, lat of a point file."""
    return read_vertices(spark, path).select(F.col("feature").cast("long").alias("ID"), F.col("x").alias("lon"), F.col("y").alias("lat"))
