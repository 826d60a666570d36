"""Grids and zones: raster cells as rows, nearest cells, points in polygons, stratified samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the transverse Mercator projection (WGS 84 ellipsoid; scale and false easting of UTM zones).
SEMI_AXIS, FLATTENING, SCALE, EASTING, SOUTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def grid_index(lats, lons, spark) -> DataFrame:
    """ID, lat, lon of a grid, row by row over latitudes and longitudes: ID = row * columns + column."""
    rows = spark.createDataFrame([(list(map(float, lats)), list(map(float, lons)))], "lats array<double>, lons array<double>")
    cells = rows.select(F.posexplode("lats").alias("i", "lat"), "lons").select("i", "lat", F.size("lons").alias("n"), F.posexplode("lons").alias("j", "lon"))
    return cells.select((F.col("i") * F.col("n") + F.col("j")).cast("long").alias("ID"), "lat", "lon")


def raster_long(rasters: DataFrame) -> DataFrame:
    """ID, FECHA, Value (float) of rasters: rows of FECHA and cells array<array<double>> (latitude by longitude)."""
    rows = rasters.select("FECHA", F.posexplode("cells").alias("i", "row")).select("FECHA", "i", F.size("row").alias("n"), F.posexplode("row").alias("j", "v"))
    return rows.select((F.col("i") * F.col("n") + F.col("j")).cast("long").alias("ID"), "FECHA", F.col("v").cast("float").alias("Value"))


def nearest_cell(points: DataFrame, lat0: float, lon0: float, step: float, n_lat: int, n_lon: int) -> DataFrame:
    """points (ID, lat, lon) with cell: the nearest cell of a regular grid from (lat0, lon0), by rounding and so without a join."""
    place = lambda c, start, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.round((F.col(c) - start) / step).cast("int")))
    return points.withColumn("cell", (place("lat", lat0, n_lat) * n_lon + place("lon", lon0, n_lon)).cast("long"))


def sample_points(raster: DataFrame, points: DataFrame) -> DataFrame:
    """ID, FECHA, Value of each point from its cell's raster rows (ID is the cell there)."""
    cells = raster.withColumnRenamed("ID", "cell")
    return points.select("ID", "cell").join(cells, "cell").select("ID", "FECHA", "Value")


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """zone_id, ring, x1, y1, x2, y2 from vertices (zone_id, ring, seq, x, y); rings close by themselves."""
    ring = Window.partitionBy("zone_id", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    return vertices.select("zone_id", "ring", F.col("x").alias("x1"), F.col("y").alias("y1"), after("x").alias("x2"), after("y").alias("y2"))


def points_in_zones(points: DataFrame, vertices: DataFrame, bin_size: float = 1.0) -> DataFrame:
    """ID, zone_id: the first zone (by number) that holds each point (ID, x, y); -1 if none.

    Points meet the edges of their horizontal strip by an equijoin on strips, and the parity of the edges to their right
    decides. An edge is in every strip that it crosses.
    """
    edges = polygon_edges(vertices).where("y1 != y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    edges = edges.withColumn("strip", F.explode(F.sequence(F.floor(low / bin_size), F.floor(high / bin_size))))
    placed = points.withColumn("strip", F.floor(F.col("y") / bin_size))
    crossing = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    right = F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    hits = placed.join(edges, "strip").where(crossing & right).groupBy("ID", "zone_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    first = hits.groupBy("ID").agg(F.min("zone_id").alias("zone_id"))
    return points.select("ID").join(first, "ID", "left").select("ID", F.coalesce("zone_id", F.lit(-1)).cast("int").alias("zone_id"))


def projected(points: DataFrame, meridian: float = -75.0, lon: str = "lon", lat: str = "lat", south: bool = True) -> DataFrame:
    """points with x, y in metres: transverse Mercator around a meridian (zone 18 south by default), by series to the sixth power."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(F.col(lon) - meridian)
    n = SEMI_AXIS / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    t, c, a = F.tan(phi) ** 2, ep * F.cos(phi) ** 2, lam * F.cos(phi)
    m = SEMI_AXIS * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - 35 * e2**3 / 3072 * F.sin(6 * phi))
    x = EASTING + SCALE * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a**5 / 120)
    y = SCALE * (m + n * F.tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a**6 / 720))
    return points.withColumn("x", x).withColumn("y", y + (SOUTHING if south else 0.0))


def nearest_zone(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """ID, zone_id, distance of the zone with the nearest edge to each point (x, y in the plane); ties to the smaller number.

    Zones are few (tens of polygons), points many: the edges of all zones are broadcast as one row, and each point walks
    through them where it is, so that no pair of point and zone or edge is ever a row.
    """
    edges = polygon_edges(vertices).where("zone_id is not null").groupBy("zone_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    zones = edges.agg(F.collect_list(F.struct("zone_id", "edges")).alias("zones"))

    def distance(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((F.col("x") - e["x1"]) * dx + (F.col("y") - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.sqrt((F.col("x") - e["x1"] - at * dx) ** 2 + (F.col("y") - e["y1"] - at * dy) ** 2)

    nearest = F.array_min(F.transform("zones", lambda z: F.struct(F.array_min(F.transform(z["edges"], distance)).alias("distance"), z["zone_id"].alias("zone_id"))))
    # the walk is long for its few bytes: a fixed number of parts, which the grouping keeps
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = points.select("ID", "x", "y").repartition(parts, "ID").crossJoin(F.broadcast(zones)).select("ID", nearest.alias("best"))
    return far.groupBy("ID").agg(F.min("best").alias("best")).where("best is not null").select("ID", F.col("best.zone_id").cast("int").alias("zone_id"), F.col("best.distance").alias("distance"))


def zone_table(points: DataFrame, vertices: DataFrame, labels: DataFrame, limit: float = math.inf) -> DataFrame:
    """ID, zone_id, zone_label, lon, lat: the zone that holds each point, else the nearest within limit, else -1."""
    inside = points_in_zones(points, vertices)
    outside = points.join(inside.where("zone_id = -1").select("ID"), "ID", "left_semi")
    near = nearest_zone(outside, vertices).where(F.col("distance") <= limit).select("ID", F.col("zone_id").alias("near"))
    placed = inside.join(near, "ID", "left").select("ID", F.when(F.col("zone_id") >= 0, F.col("zone_id")).otherwise(F.coalesce("near", "zone_id")).alias("zone_id"))
    return points.join(placed, "ID").join(labels, "zone_id", "left").select("ID", "zone_id", "zone_label", "lon", "lat")


def stratified_sample(zones: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """min(n, size) locations of each assigned zone, by digest of location and seed."""
    order = Window.partitionBy("zone_id").orderBy(F.md5(F.concat(F.col("ID").cast("string"), F.lit(f":{seed}")).cast("binary")), "ID")
    return zones.where("zone_id >= 0").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def zone_counts(zones: DataFrame) -> DataFrame:
    """zone_id, n: locations by zone, most first."""
    return zones.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "zone_id")
