"""Terrain: neighbourhood kernels over cell tables ``(raster_id, row, col, value)`` and shape formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slope_horn(cells: DataFrame, size: float) -> DataFrame:
    """Slope in degrees from the eight neighbours; null where one is missing.

    Each cell sends its value to its neighbours' keys with its weights, so one aggregate replaces eight joins and a
    partition needs no raster as a whole.
    """
    weights = [(r, c, (c * (2 if r == 0 else 1)), (r * (2 if c == 0 else 1))) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]
    to = F.array(*(F.struct((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), (F.col("value") * dx).alias("x"), (F.col("value") * dy).alias("y"), F.lit(0).alias("own")) for r, c, dx, dy in weights), F.struct(F.col("row"), F.col("col"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1).alias("own")))
    sent = cells.where("value IS NOT NULL").withColumn("value", F.col("value").cast("double")).select("raster_id", F.explode(to).alias("t")).select("raster_id", "t.*")
    a = sent.groupBy("raster_id", "row", "col").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n"), F.max("own").alias("own")).where("own = 1")
    grade = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / (8 * size)
    return a.select("raster_id", "row", "col", F.when(F.col("n") == 9, F.degrees(F.atan(grade))).alias("slope_deg"))


def slope_gradient(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """Slope in degrees from central differences, one-sided at edges."""

    def along(line: str, at: str, d: float) -> Column:
        w = Window.partitionBy("raster_id", line).orderBy(at)
        before, after = (F.when(F.abs(f(at).over(w) - F.col(at)) == 1, f("value").over(w)) for f in (F.lag, F.lead))
        v = F.col("value")
        return F.coalesce((after - before) / (2 * d), (after - v) / d, (v - before) / d)

    x = cells.withColumn("gx", along("row", "col", dx)).withColumn("gy", along("col", "row", dy))
    return x.select("raster_id", "row", "col", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))).alias("slope_deg"))


def wetness_index(accumulation: Column, slope_deg: Column, size: float, min_slope_deg: float = 0.1) -> Column:
    return F.ln(accumulation * size / F.tan(F.radians(F.greatest(slope_deg, F.lit(min_slope_deg)))))


def wetness_class(twi: Column) -> Column:
    return F.when(twi < 6, "well_drained").when(twi <= 10, "moderate").when(twi > 10, "saturated")


def zone_shares(cells: DataFrame, value: str = "twi") -> DataFrame:
    """Mean, extremes, population deviation and shares in percent of the three wetness zones for each raster."""
    v = F.col(value)
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return cells.where(v.isNotNull()).groupBy("raster_id").agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), share(v < 6).alias("low_pct"), share((v >= 6) & (v <= 10)).alias("mid_pct"), share(v > 10).alias("high_pct"))


def shape_indices(area: Column, perimeter: Column, length: Column) -> dict[str, Column]:
    pos = lambda d, x: F.when(d > 0, x)
    return {
        "form_factor": pos(length, area / (length * length)),
        "circularity": pos(perimeter, 4 * F.pi() * area / (perimeter * perimeter)),
        "elongation": pos(length, 2 * F.sqrt(area / F.pi()) / length),
        "shape_factor": pos(area, length * length / area),
        "unity": pos(area, length / F.sqrt(area)),
    }


def relief(cells: DataFrame, outlets: DataFrame, radius: int = 3) -> DataFrame:
    """``(raster_id, z_max, z_outlet, h_m)``: the outlet's height is the least in the smallest ring that has a value."""
    tops = cells.groupBy("raster_id").agg(F.max("value").alias("z_max"))
    # an outlet asks for the cells around it by their keys
    asks = F.explode(F.array(*(F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), F.lit(max(abs(r), abs(c))).alias("ring")) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1))))
    near = outlets.select("raster_id", asks.alias("a")).select("raster_id", "a.*").join(cells.where("value IS NOT NULL").select("raster_id", "row", "col", "value"), ["raster_id", "row", "col"])
    low = near.groupBy("raster_id").agg(F.min(F.struct("ring", F.col("value").alias("z")))["z"].alias("z_outlet"))
    j = tops.join(low, "raster_id", "left")
    h = F.when(F.col("z_outlet").isNotNull(), F.greatest(F.lit(0.0), F.col("z_max") - F.col("z_outlet")))
    return j.withColumn("h_m", h)


def stream_metrics(area: Column, perimeter: Column, length: Column, h_m: Column) -> dict[str, Column]:
    """Approximations from relief; all that needs relief is null without it."""
    d = F.when(h_m.isNotNull(), F.greatest(F.lit(0.5), F.least(0.5 + h_m / 1000, F.lit(5.0))))
    main = 1.5 * length
    slope = F.when(main > 0, h_m / (main * 1000))
    return {"drainage_density": d, "ruggedness": h_m / 1000 * d, "channel_maintenance": F.when(d > 0, 1 / d), "fineness": F.when(perimeter > 0, d * area / perimeter), "stream_frequency": F.when(area > 0, d * area / area), "main_channel_km": main, "channel_slope": slope, "slope_10_85": 0.75 * slope}


def advanced_indices(area: Column, shape_factor: Column, channel_slope: Column, density: Column, centroid_km: Column) -> dict[str, Column]:
    steep = channel_slope > 0
    return {"hkr": F.when(steep & (density > 0), area / (channel_slope * F.sqrt(density))), "gray": F.when(steep, centroid_km / F.sqrt(channel_slope)), "murphey": F.when(area > 0, shape_factor / area)}


def _ring_edges(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Edges ``(*keys, x1, y1, x2, y2)`` of closed rings; ``ring`` is one of the keys where the table has it."""
    by = [*keys, "ring"] if "ring" in vertices.columns else keys
    w = Window.partitionBy(*by).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y"))
    return vertices.select(*by, F.col("x").alias("x1"), F.col("y").alias("y1"), nx.alias("x2"), ny.alias("y2"))


def polygon_measures(vertices: DataFrame) -> DataFrame:
    """``(basin_id, area, perimeter, cx, cy)`` of rings ``(basin_id[, ring, hole], seq, x, y)`` in metres, open or closed.

    Rings of one basin add up, those with ``hole`` count against the area and the centre; the perimeter is that of all.
    """
    by = ["basin_id", "ring"] if "ring" in vertices.columns else ["basin_id"]
    k = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    e = _ring_edges(vertices, ["basin_id"]).withColumn("k", k)
    r = e.groupBy(*by).agg((F.sum("k") / 2).alias("s"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("p"), F.sum((F.col("x1") + F.col("x2")) * F.col("k")).alias("mx"), F.sum((F.col("y1") + F.col("y2")) * F.col("k")).alias("my"))
    if "hole" in vertices.columns:
        r = r.join(vertices.groupBy(*by).agg(F.max("hole").alias("hole")), by)
        sign = F.when(F.col("hole"), -1).otherwise(1) * F.signum("s")
    else:
        sign = F.signum("s")
    a = r.groupBy("basin_id").agg(F.sum(F.col("s") * sign).alias("a"), F.sum("p").alias("perimeter"), F.sum(F.col("mx") * sign).alias("mx"), F.sum(F.col("my") * sign).alias("my"))
    return a.select("basin_id", F.col("a").alias("area"), "perimeter", F.try_divide(F.col("mx"), 6 * F.col("a")).alias("cx"), F.try_divide(F.col("my"), 6 * F.col("a")).alias("cy"))


def inside_ring(cells: DataFrame, vertices: DataFrame, band: float = 1.0) -> DataFrame:
    """Cells ``(raster_id, row, col, x, y)`` with ``inside``: whether the centre lies in the rings of its raster, by ray
    casting; a hole is a ring within a ring.

    Edges go to the bands of ``band`` heights that they span, so a cell meets only those that its ray may cross.
    """
    e = _ring_edges(vertices, ["raster_id"]).where("y1 <> y2")
    e = e.withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band)))).drop("ring")
    crosses = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    n = F.count(F.when(crosses & (F.col("x") < at), 1))
    return cells.withColumn("band", F.floor(F.col("y") / band)).join(e, ["raster_id", "band"], "left").groupBy("raster_id", "row", "col", "x", "y").agg((n % 2 == 1).alias("inside"))


def fill_dem(cells: DataFrame) -> DataFrame:
    """Heights below -500 are missing; missing ones take the raster's median; ``flat`` marks rasters of less than 1 m of relief."""
    v = F.when(F.col("value") >= -500, F.col("value"))
    m = cells.groupBy("raster_id").agg(F.median(v).alias("_m"), F.coalesce(F.max(v) - F.min(v) < 1.0, F.lit(True)).alias("flat"))
    return cells.join(m, "raster_id").withColumn("value", F.coalesce(v, "_m")).drop("_m")


def boundary_edges(cells: DataFrame) -> DataFrame:
    """``(raster_id, row, col, side)`` of the cell edges around a mask ``(raster_id, row, col)``: those no neighbour shares."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), (F.col("row") + r).alias("nr"), (F.col("col") + c).alias("nc")) for s, r, c in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1))))
    e = cells.select("raster_id", "row", "col", F.explode(sides).alias("s")).select("raster_id", "row", "col", "s.*")
    there = cells.select("raster_id", F.col("row").alias("nr"), F.col("col").alias("nc"))
    return e.join(there, ["raster_id", "nr", "nc"], "left_anti").select("raster_id", "row", "col", "side")
