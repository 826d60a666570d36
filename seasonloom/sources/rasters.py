"""Rasters in classic NetCDF files (CDF-1, CDF-2 and CDF-5): a grid by day as rows of cell, day and value.

Files are read as bytes through Spark, one task a file; header and layout follow the format's public description. Files
of the later HDF5-based format are named in an error: they need a library that is not there.
"""

from __future__ import annotations

import datetime as dt
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonloom.sources.readers import exists

#: Fixed values of the format: numpy types by type number.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Names that coordinates go by.
COORDINATES = {"lat": ("lat", "latitude", "y"), "lon": ("lon", "longitude", "x"), "time": ("time", "t", "z", "date")}


class Classic:
    """Dimensions, attributes and variables of a classic file's bytes."""

    def __init__(self, content: bytes):
        if content[:4] == b"\x89HDF":
            raise ValueError("an HDF5-based file: convert it to a classic one")
        if content[:3] != b"CDF" or content[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.content, self.at, self.version = content, 4, content[3]
        self.records = self.size()
        self.dimensions = [(self.name(), self.size()) for _ in range(self.listed())]
        self.attributes = self.attribute_list()
        self.variables = {}
        for _ in range(self.listed()):
            name = self.name()
            dims = [self.size() for _ in range(self.size())]
            attributes = self.attribute_list()
            kind, size = self.number(">i", 4), self.size()
            begin = self.number(">i", 4) if self.version == 1 else self.number(">q", 8)
            self.variables[name] = (dims, attributes, kind, size, begin)

    def number(self, kind: str, width: int) -> int:
        self.at += width
        return struct.unpack(kind, self.content[self.at - width : self.at])[0]

    def size(self) -> int:
        return self.number(">q", 8) if self.version == 5 else self.number(">i", 4)

    def listed(self) -> int:
        self.number(">i", 4)
        return self.size()

    def name(self) -> str:
        n = self.size()
        raw = self.content[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        return raw.decode("utf-8", "replace")

    def attribute_list(self) -> dict:
        out = {}
        for _ in range(self.listed()):
            name, kind, n = self.name(), self.number(">i", 4), self.size()
            width = np.dtype(TYPES[kind]).itemsize * n
            raw = self.content[self.at : self.at + width]
            self.at += -(-width // 4) * 4
            out[name] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, TYPES[kind])
        return out

    def values(self, name: str) -> np.ndarray:
        """A variable's numbers as doubles, missing ones NaN, scaled as its attributes say."""
        dims, attributes, kind, _, begin = self.variables[name]
        shape = [self.dimensions[d][1] for d in dims]
        dtype = np.dtype(TYPES[kind])
        if shape and shape[0] == 0:  # along the record dimension
            shape[0] = self.records
            one = dtype.itemsize * int(np.prod(shape[1:], dtype=np.int64))
            of_record = [v for v in self.variables.values() if v[0] and self.dimensions[v[0][0]][1] == 0]
            step = one if len(of_record) == 1 else sum(v[3] for v in of_record)
            raw = b"".join(self.content[begin + r * step : begin + r * step + one] for r in range(self.records))
        else:
            raw = self.content[begin : begin + dtype.itemsize * int(np.prod(shape, dtype=np.int64))]
        found = np.frombuffer(raw, dtype).reshape(shape).astype(float)
        for missing in ("_FillValue", "missing_value"):
            if missing in attributes and not isinstance(attributes[missing], str):
                found[found == float(attributes[missing][0])] = np.nan
        one = lambda key, default: float(attributes[key][0]) if key in attributes else default
        return found * one("scale_factor", 1.0) + one("add_offset", 0.0)

    def coordinate(self, kind: str) -> str:
        """The variable that holds a coordinate."""
        for option in COORDINATES[kind]:
            for name in self.variables:
                if name.lower() == option:
                    return name
        raise KeyError(f"no {kind} among {sorted(self.variables)}")

    def days(self) -> list[dt.date]:
        """The days of the time coordinate: days, hours, minutes or seconds since a date."""
        name = self.coordinate("time")
        units = self.variables[name][1].get("units", "")
        m = re.match(r"\s*(day|hour|minute|second)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ](\d+):(\d+))?", units)
        if not m:
            raise ValueError(f"time in unknown units: {units!r}")
        first = dt.datetime(int(m[2]), int(m[3]), int(m[4]), int(m[5] or 0), int(m[6] or 0))
        return [(first + dt.timedelta(**{m[1] + "s": float(x)})).date() for x in self.values(name)]


def grid_rows(content: bytes) -> pd.DataFrame:
    """ID (row * columns + column), FECHA, Value of the first variable over time, latitude and longitude; missing cells have no row."""
    file = Classic(content)
    lat, lon, time = (file.coordinate(k) for k in ("lat", "lon", "time"))
    dims = {n: file.variables[n][0][0] for n in (lat, lon, time)}
    wanted = [dims[time], dims[lat], dims[lon]]
    name = next(n for n, v in file.variables.items() if sorted(v[0]) == sorted(wanted))
    cube = np.transpose(file.values(name), [file.variables[name][0].index(d) for d in wanted])
    t, cell = np.nonzero(~np.isnan(cube.reshape(len(cube), -1)))
    days = np.array(file.days(), dtype=object)
    return pd.DataFrame({"ID": cell.astype(np.int64), "FECHA": days[t], "Value": cube.reshape(len(cube), -1)[t, cell]})


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """ID, FECHA, Value of all classic files of a folder whose names don't hold mean."""

    def work(frames):
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"]):
                if "mean" not in where.rpartition("/")[2].lower():
                    yield grid_rows(content)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nc").load(path)
    return files.select("path", "content").mapInPandas(work, "ID long, FECHA date, Value double")


def extract_months(spark: SparkSession, rasters: DataFrame, points: DataFrame, out: str, variable: str, months: int | None = None) -> list[str]:
    """Monthly files of the points' cells (ID, cell) that aren't there yet, at most months of them; their paths."""
    from seasonloom.operators.spatial import sample_points

    there = rasters.select(F.year("FECHA").alias("y"), F.month("FECHA").alias("m")).distinct().orderBy("y", "m").collect()  # a few hundred months
    made = []
    for r in there:
        target = f"{out}/{variable}/Outputs/{variable}_daily_{r['y']:04d}_{r['m']:02d}.parquet"
        if exists(spark, target) or months is not None and len(made) >= months:
            continue
        month = rasters.where((F.year("FECHA") == r["y"]) & (F.month("FECHA") == r["m"]))
        sample_points(month, points).orderBy("ID", "FECHA").write.parquet(target)
        made.append(target)
    return made
