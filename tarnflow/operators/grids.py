"""Rasters on other grids: transverse Mercator zones as columns, nearest and bilinear resampling, spacing in metres, pyramids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import geodesy

#: Third flattening of the ellipsoid, scale on the central meridian, and the false origin in metres.
N, K0, EAST, SOUTH = 0.0016792203863837047, 0.9996, 500_000.0, 10_000_000.0
#: Rectifying radius, and the series from the conformal sphere to the plane and back, in powers of ``N``.
RADIUS = geodesy.WGS84[0] / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
FORWARD = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BACK = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
TURNS = 4  #: of Newton's rule for the latitude; the third no longer changes it


def zone_of(lon: Column) -> Column:
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def to_zone(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Metres east and north in a zone, by the series of Krueger to the fourth order: exact to micrometres within a zone."""
    e = math.sqrt(geodesy.WGS84[1])
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    away = F.radians(F.pmod(lon - (zone * 6 - 183) + 180, F.lit(360.0)) - 180)
    xi, eta = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(t * t + F.cos(away) * F.cos(away)))
    x, y = eta, xi
    for j, c in enumerate(FORWARD, 1):
        x, y = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + K0 * RADIUS * x, F.when(south, SOUTH).otherwise(0.0) + K0 * RADIUS * y


def from_zone(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of metres east and north in a zone."""
    e2 = geodesy.WGS84[1]
    e = math.sqrt(e2)
    xi, eta = (y - F.when(south, SOUTH).otherwise(0.0)) / (K0 * RADIUS), (x - EAST) / (K0 * RADIUS)
    p, q = xi, eta
    for j, c in enumerate(BACK, 1):
        p, q = p - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta), q - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.sin(p) / F.cosh(q)
    goal = conformal / F.sqrt(1 - conformal * conformal)
    # the tangent of the latitude whose conformal tangent is the goal; the steps stand in lambdas, so that each is written once
    sigma = lambda t: F.sinh(e * F.atanh(e * t / F.sqrt(1 + t * t)))
    own = lambda t: t * F.sqrt(1 + sigma(t) * sigma(t)) - sigma(t) * F.sqrt(1 + t * t)
    step = lambda t: t + (goal - own(t)) / F.sqrt(1 + own(t) * own(t)) * (1 + (1 - e2) * t * t) / ((1 - e2) * F.sqrt(1 + t * t))
    tangent = F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), goal, lambda t, _: step(t))
    lon = zone * 6 - 183 + F.degrees(F.atan2(F.sinh(q), F.cos(p)))
    return F.pmod(lon + 180, F.lit(360.0)) - 180, F.degrees(F.atan(tangent))


def target_cells(grids: DataFrame) -> DataFrame:
    """``(raster_id, row, col, x, y, ...)``: the centres of the cells of ``grids (raster_id, x0, y0, size, n_rows, n_cols, ...)``,
    ``(x0, y0)`` being the upper left corner."""
    g = grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    return g.withColumn("x", F.col("x0") + (F.col("col") + 0.5) * F.col("size")).withColumn("y", F.col("y0") - (F.col("row") + 0.5) * F.col("size"))


def resampled(wanted: DataFrame, cells: DataFrame, bilinear: bool = True) -> DataFrame:
    """``(raster_id, row, col, value)``: source cells ``(raster_id, row, col, value)`` at the places ``(raster_id, row, col, r, c)``,
    ``(r, c)`` being positions on the source grid, where cell ``(i, j)`` has its centre at ``(i + 0.5, j + 0.5)``.

    Each place asks for the cells that it needs, one or four, by an equality join, and one aggregate weighs the answers.
    Between centres values are weighed by nearness; a missing neighbour leaves its weight to the others, as at a rim.
    Outside the source's cells, and where all of them are missing, there is no value.
    """
    place = ["raster_id", "row", "col"]
    if not bilinear:
        near = wanted.select(*place, F.floor("r").cast("int").alias("sr"), F.floor("c").cast("int").alias("sc"))
        source = cells.select("raster_id", F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
        return near.join(source, ["raster_id", "sr", "sc"], "left").select(*place, "value")
    r, c = F.col("r") - 0.5, F.col("c") - 0.5
    fr, fc = r - F.floor(r), c - F.floor(c)
    asks = F.array(*(F.struct((F.floor(r) + i).cast("int").alias("sr"), (F.floor(c) + j).cast("int").alias("sc"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = wanted.select(*place, F.floor("r").cast("int").alias("hr"), F.floor("c").cast("int").alias("hc"), F.explode(asks).alias("a")).select(*place, "hr", "hc", "a.*")
    source = cells.select("raster_id", F.col("row").alias("sr"), F.col("col").alias("sc"), "value", F.lit(True).alias("there"))
    j = asked.join(source, ["raster_id", "sr", "sc"], "left")
    known = F.col("value").isNotNull()
    inside = F.bool_or((F.col("sr") == F.col("hr")) & (F.col("sc") == F.col("hc")) & F.col("there"))
    a = j.groupBy(*place).agg(F.sum(F.when(known, F.col("w") * F.col("value"))).alias("v"), F.sum(F.when(known, F.col("w"))).alias("w"), inside.alias("inside"))
    return a.select(*place, F.when(F.col("inside") & (F.col("w") > 0), F.col("v") / F.col("w")).alias("value"))


def onto_zone(cells: DataFrame, sources: DataFrame, grids: DataFrame, bilinear: bool = True) -> DataFrame:
    """Rasters in degrees on grids of a zone: ``sources (raster_id, lon0, lat0, step)`` place the cells, ``grids (raster_id, zone,
    south, x0, y0, size, n_rows, n_cols)`` say what is wanted."""
    t = target_cells(grids)
    lon, lat = from_zone(F.col("x"), F.col("y"), F.col("zone"), F.col("south"))
    t = t.select("raster_id", "row", "col", lon.alias("lon"), lat.alias("lat")).join(sources, "raster_id")
    return resampled(t.select("raster_id", "row", "col", ((F.col("lat0") - F.col("lat")) / F.col("step")).alias("r"), ((F.col("lon") - F.col("lon0")) / F.col("step")).alias("c")), cells, bilinear)


#: Units of a coordinate system in metres.
UNITS = {"metre": 1.0, "meter": 1.0, "m": 1.0, "foot": 0.3048, "us survey foot": 1200 / 3937, "us foot": 1200 / 3937, "kilometre": 1000.0}


def metric_spacing(rasters: DataFrame) -> DataFrame:
    """``(raster_id, dx, dy, reason)`` of rasters ``(raster_id, system, unit, step_x, step_y)``: metres of a cell, or why there are
    none: no system, degrees, a unit that is not known, a step that is zero or no number."""
    factor = F.try_element_at(F.create_map(*(F.lit(x) for p in UNITS.items() for x in p)), F.lower(F.trim("unit")))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) == 0)
    reason = (
        F.when(F.col("system").isNull(), "no_system").when(F.lower(F.trim("unit")).isin("degree", "degrees", "deg"), "geographic")
        .when(factor.isNull(), "unknown_unit").when(bad("step_x") | bad("step_y"), "no_spacing")
    )
    metres = lambda c: F.when(reason.isNull(), F.abs(c) * factor)
    return rasters.select("raster_id", metres("step_x").alias("dx"), metres("step_y").alias("dy"), reason.alias("reason"))


def coarser(cells: DataFrame, factor: int) -> DataFrame:
    """One level of a pyramid: the mean of ``factor`` by ``factor`` cells, over those that have a value."""
    at = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return cells.groupBy("raster_id", at("row"), at("col")).agg(F.avg("value").alias("value"))
