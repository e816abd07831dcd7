"""Coordinates: metric projections, equal areas, windows around points; all as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half axis and squared eccentricity of the ellipsoids, and degrees in km.
WGS84, GRS80 = (6_378_137.0, 0.0066943799901413165), (6_378_137.0, 0.0066943800229007876)
KM_PER_DEG = 111.32


def metric_system(lon: Column, lat: Column) -> Column:
    """Code of the system for lengths: Albers in the conterminous states, else the zone of the transverse Mercator grid."""
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    return F.when(lon.between(-126, -65) & lat.between(23, 50.5), F.lit("EPSG:5070")).otherwise(F.concat(F.lit("EPSG:"), (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("string")))


def box_around(lon: Column, lat: Column, half_km: Column) -> dict[str, Column]:
    """The window of ``half_km`` to each side, within the globe."""
    dy = half_km / KM_PER_DEG
    dx = half_km / F.greatest(KM_PER_DEG * F.cos(F.radians(lat)), F.lit(1e-6))
    return {"x0": F.greatest(F.lit(-180.0), lon - dx), "y0": F.greatest(F.lit(-90.0), lat - dy), "x1": F.least(F.lit(180.0), lon + dx), "y1": F.least(F.lit(90.0), lat + dy)}


def search_half_km(expected_km2: Column) -> Column:
    """Half side of the window for outlet candidates: the search radius and a fifth of it."""
    return 1.2 * F.when(expected_km2 > 0, F.least(F.lit(30.0), F.greatest(F.lit(3.0), 1.5 * F.sqrt(expected_km2)))).otherwise(3.0)


def local_half_km(upa_km2: Column) -> Column:
    """Half side of the first window around a snapped outlet."""
    return F.least(F.lit(20.0), F.greatest(F.lit(3.0), 2.0 * F.sqrt(F.greatest(upa_km2, F.lit(0.0)))))


def cell_km2(step_x: Column, step_y: Column, lat: Column) -> Column:
    return F.abs(step_x) * F.abs(step_y) * KM_PER_DEG**2 * F.cos(F.radians(lat))


def _authalic(lat: Column, e2: float) -> Column:
    """``q`` of the authalic latitude."""
    e, s = math.sqrt(e2), F.sin(F.radians(lat))
    return (1 - e2) * (s / (1 - e2 * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area metres, true at 30 degrees."""
    a, e2 = WGS84
    k0 = math.cos(math.pi / 6) / math.sqrt(1 - e2 * 0.25)
    return a * k0 * F.radians(lon), a * _authalic(lat, e2) / (2 * k0)


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Conic equal-area metres of the conterminous states: parallels 29.5 and 45.5, origin 23 N 96 W."""
    a, e2 = GRS80
    e = math.sqrt(e2)
    m2 = lambda d: math.cos(math.radians(d)) ** 2 / (1 - e2 * math.sin(math.radians(d)) ** 2)
    q = lambda d: (1 - e2) * (math.sin(math.radians(d)) / (1 - e2 * math.sin(math.radians(d)) ** 2) - math.log((1 - e * math.sin(math.radians(d))) / (1 + e * math.sin(math.radians(d)))) / (2 * e))
    n = (m2(29.5) - m2(45.5)) / (q(45.5) - q(29.5))
    c = m2(29.5) + n * q(29.5)
    rho0 = a * math.sqrt(c - n * q(23.0)) / n
    rho, theta = a * F.sqrt(c - n * _authalic(lat, e2)) / n, n * F.radians(lon + 96.0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def basin_measures(vertices: DataFrame, outlets: DataFrame) -> DataFrame:
    """``(basin_id, area_km2, length_km, centroid_km)`` of rings ``(basin_id[, ring, hole], seq, lon, lat)`` in the conterminous
    states: equal area, farthest vertex from the outlet ``(basin_id, lon, lat)``, and outlet to centroid."""
    from tarnflow.operators.terrain import polygon_measures

    x, y = equal_area(F.col("lon"), F.col("lat"))
    areas = polygon_measures(vertices.withColumn("x", x).withColumn("y", y).drop("lon", "lat")).select("basin_id", (F.col("area") / 1e6).alias("area_km2"))
    ax, ay = albers(F.col("lon"), F.col("lat"))
    flat = vertices.withColumn("x", ax).withColumn("y", ay).drop("lon", "lat")
    out = outlets.select("basin_id", ax.alias("ox"), ay.alias("oy"))
    far = flat.join(out, "basin_id").groupBy("basin_id").agg((F.max(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))) / 1000).alias("length_km"))
    centre = polygon_measures(flat).join(out, "basin_id").select("basin_id", (F.hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy")) / 1000).alias("centroid_km"))
    return areas.join(far, "basin_id", "left").join(centre, "basin_id", "left")
