"""Catchments of culverts on fine elevation: an embankment notch, routing, snap and windows, for many pour points at once.

Each pour point has its own notch, so it has its own copy of the window around it; windows are small and bounded.  All
points of a round are routed together, as rasters of one table; those whose basin touches its window go on to the next
window, the others are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators import network, routing

#: Fixed values in metres: from where the notch takes its level, where it is cut, how far an outlet is moved, half sides of
#: the windows; and the area in km2 below which the outlet is likely a ditch beside the road.
SOURCE_M, NOTCH_M, SNAP_M, HALVES_M, DITCH_KM2 = 60.0, 30.0, 40.0, (2_500.0, 5_000.0, 10_000.0), 0.05


def windows(points: DataFrame, dem: DataFrame, half: float, size: float) -> DataFrame:
    """``(raster_id, row, col, value, dist)``: for each of ``points (outlet_id, x, y)`` the cells ``(row, col, x, y, value)`` of
    ``dem`` whose centre is within ``half`` to each side; points meet cells by tiles of that size."""
    tile = lambda c: F.floor(F.col(c) / half)
    near = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    p = points.withColumn("i", near).withColumn("j", near).select("outlet_id", F.col("x").alias("px"), F.col("y").alias("py"), (tile("x") + F.col("i")).alias("tx"), (tile("y") + F.col("j")).alias("ty"))
    j = p.join(network.shuffled(dem.withColumn("tx", tile("x")).withColumn("ty", tile("y"))), ["tx", "ty"]).where((F.abs(F.col("x") - F.col("px")) <= half) & (F.abs(F.col("y") - F.col("py")) <= half))
    return j.select(F.col("outlet_id").alias("raster_id"), "row", "col", F.col("value").cast("double").alias("value"), F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")).alias("dist"))


def notched(cells: DataFrame) -> DataFrame:
    """``cells`` with the least height within ``SOURCE_M`` of the point at all cells within ``NOTCH_M``, and that ``notch``."""
    low = cells.where(F.col("value").isNotNull() & (F.col("dist") <= SOURCE_M)).groupBy("raster_id").agg(F.min("value").alias("notch"))
    return cells.join(network.shuffled(low), "raster_id").withColumn("value", F.when(F.col("value").isNotNull() & (F.col("dist") <= NOTCH_M), F.col("notch")).otherwise(F.col("value")))


def routed(cells: DataFrame, size: float, snap_m: float, tile: int) -> DataFrame:
    """``(raster_id, row, col, snap_m, n_cells, touches)``: the cell within ``snap_m`` of each raster's point that most cells
    drain through, the first of equals in row order, and whether its basin reaches the raster's outermost rows or columns."""
    there = cells.where("value IS NOT NULL")
    flow = routing.directions(routing.filled(there.select("raster_id", "row", "col", "value"), tile))
    key = lambda r, c: F.struct(F.col("raster_id").alias("g"), F.col(r).cast("int").alias("r"), F.col(c).cast("int").alias("c"))
    edges = flow.select(key("row", "col").alias("comid"), F.when(F.col("to_row").isNotNull(), key("to_row", "to_col")).alias("nextdown"), F.lit(1).cast("long").alias("n"), *(F.col(c).alias(a) for a, c in (("r0", "row"), ("r1", "row"), ("c0", "col"), ("c1", "col"))))
    basin = network.upstream_sums(edges, ["n"], ["r0", "c0"], ["r1", "c1"]).select(F.col("comid.g").alias("raster_id"), F.col("comid.r").alias("row"), F.col("comid.c").alias("col"), "n", "r0", "r1", "c0", "c1")
    frame = cells.groupBy("raster_id").agg(*(f(c).alias(a) for a, f, c in (("t", F.min, "row"), ("b", F.max, "row"), ("l", F.min, "col"), ("r", F.max, "col"))))
    w = Window.partitionBy("raster_id").orderBy(F.desc("n"), "row", "col")
    best = there.where(F.col("dist") <= snap_m).select("raster_id", "row", "col", "dist").join(network.shuffled(basin), ["raster_id", "row", "col"]).withColumn("k", F.row_number().over(w)).where("k = 1").join(network.shuffled(frame), "raster_id")
    touches = (F.col("r0") == F.col("t")) | (F.col("r1") == F.col("b")) | (F.col("c0") == F.col("l")) | (F.col("c1") == F.col("r"))
    return best.select("raster_id", "row", "col", F.col("dist").alias("snap_m"), F.col("n").alias("n_cells"), touches.alias("touches"))


def catchments(points: DataFrame, dem: DataFrame, size: float, notch: bool = True, halves: tuple[float, ...] = HALVES_M, snap_m: float = SNAP_M, tile: int = routing.TILE) -> DataFrame:
    """``(outlet_id, status, row, col, snap_m, area_km2, half_m, n_windows, notch_m, flags)`` of points ``(outlet_id, x, y)``.

    ``ok``; ``touches_max_window`` where even the last window does not hold the basin; ``no_dem`` where no height is near
    enough for the notch, or for the snap.  An embankment across a channel dams it on bare-earth elevation; the notch lets
    the water through at the level of the channel.
    """
    left, done, low = points, [], None
    for k, half in enumerate(halves, 1):
        cells = windows(left, dem, half, size)
        cells = network.saved(notched(cells) if notch else cells.withColumn("notch", F.lit(None).cast("double")))
        found = network.saved(routed(cells, size, snap_m, tile).join(network.shuffled(cells.groupBy("raster_id").agg(F.max("notch").alias("notch"))), "raster_id"))
        last = k == len(halves)
        done.append((found if last else found.where("NOT touches")).select("*", F.lit(half).alias("half_m"), F.lit(k).alias("n_windows")))
        left = left.join(network.shuffled(found.where("touches").select(F.col("raster_id").alias("outlet_id"))), "outlet_id", "left_semi")
        if last or left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    out = points.select("outlet_id").join(network.shuffled(out.withColumnRenamed("raster_id", "outlet_id")), "outlet_id", "left")
    area = F.col("n_cells") * size * size / 1e6
    flags = F.concat_ws(",", F.when(F.lit(notch) & F.col("n_cells").isNotNull(), "EMBANKMENT_NOTCH_APPLIED"), F.when(F.col("touches"), "BASIN_TOUCHES_MAX_WINDOW"), F.when(area < DITCH_KM2, "LIKELY_DITCH_SNAP"))
    status = F.when(F.col("n_cells").isNull(), "no_dem").when(F.col("touches"), "touches_max_window").otherwise("ok")
    return out.select("outlet_id", status.alias("status"), "row", "col", "snap_m", area.alias("area_km2"), "half_m", "n_windows", F.col("notch").alias("notch_m"), flags.alias("flags"))
