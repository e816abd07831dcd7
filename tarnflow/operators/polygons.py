"""Polygons of cell sets: rings of ``(raster_id, label, row, col)``, their holes, and unions of labels.

A cell covers ``col .. col + 1`` and ``row .. row + 1``, rows counted downwards.  Cells that share an edge are of one
polygon, those that only share a corner are not.  Every cell has four directed edges, itself to their right; an edge
that two cells of a label share is inside and goes.  What is left forms rings: at a corner where two rings meet, an edge
goes on with the one of its own cell.  Rings are found by pointers that double their reach, so no ring is walked and
none meets in one task; positions along a ring follow from the same rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators import network

KEY = ["raster_id", "label"]


def edges(cells: DataFrame) -> DataFrame:
    """``(raster_id, label, e, dir, x1, y1, x2, y2)``: boundary edges; ``dir`` 0 to 3 is east, south, west, north."""
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    sides = ((0, c, r, c + 1, r), (1, c + 1, r, c + 1, r + 1), (2, c + 1, r + 1, c, r + 1), (3, c, r + 1, c, r))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dir"), *(v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), s))) for d, *s in sides)))
    e = cells.select(*KEY, "row", "col").distinct().select(*KEY, each.alias("e")).select(*KEY, "e.*")
    line = [F.least("x1", "x2").alias("lx"), F.least("y1", "y2").alias("ly"), (F.col("dir") % 2).alias("axis")]
    once = e.groupBy(*KEY, *line).agg(F.count("*").alias("n"), *(F.first(v).alias(v) for v in ("dir", "x1", "y1", "x2", "y2"))).where("n = 1")
    return once.select(*KEY, F.struct("y1", "x1", "dir").alias("e"), "dir", "x1", "y1", "x2", "y2")


def _followed(e: DataFrame) -> DataFrame:
    """``(raster_id, label, e, next)``: which edge goes on; to the right before straight on before to the left."""
    after = e.select(*KEY, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("e").alias("next"), F.col("dir").alias("to"))
    turn = (F.col("to") - F.col("dir") + 4) % 4
    best = F.min(F.struct(F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2).alias("turn"), "next"))["next"]
    return e.join(after, [*KEY, "x2", "y2"]).groupBy(*KEY, "e").agg(best.alias("next"))


def _ordered(steps: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(raster_id, label, e, ring, left)``: the least edge of each edge's ring, and how many steps away it is."""
    now = network.saved(steps.select(*KEY, "e", "next", F.col("e").alias("ring"), F.lit(0).cast("long").alias("left")))
    for k in range(max_rounds):
        far = now.select(*KEY, F.col("e").alias("next"), F.col("next").alias("further"), F.col("ring").alias("its"), (F.col("left") + (1 << k)).alias("its_left"))
        lower = F.col("its") < F.col("ring")
        then = network.saved(now.join(far, [*KEY, "next"]).select(*KEY, "e", F.col("further").alias("next"), F.when(lower, F.col("its")).otherwise(F.col("ring")).alias("ring"), F.when(lower, F.col("its_left")).otherwise(F.col("left")).alias("left"), lower.alias("moved")))
        now = then.drop("moved")
        if then.where("moved").isEmpty():
            return now.drop("next")
    raise ValueError("a ring is too long")


def rings(cells: DataFrame) -> DataFrame:
    """``(raster_id, label, ring, seq, x, y)``: the corners of every ring in order, those on a straight line left out.

    Outer rings run with the cells to their right, holes too, so a shoelace sum is positive for an outer ring and negative
    for a hole.  ``ring`` numbers the rings of a label from its top, an outer ring and its holes alike.
    """
    e = network.saved(edges(cells))
    at = network.saved(_ordered(_followed(e)).join(e, [*KEY, "e"]))
    w = Window.partitionBy(*KEY, "ring").orderBy(F.desc("seq"))
    # from the least edge on: it has none left, the one after it the most
    at = at.withColumn("seq", F.when(F.col("left") == 0, F.lit((1 << 62) + 0)).otherwise(F.col("left")))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("dir").over(w), F.last("dir").over(whole))
    corners = at.withColumn("turns", before != F.col("dir")).where("turns")
    named = corners.select(*KEY, "ring").distinct().withColumn("id", F.row_number().over(Window.partitionBy(*KEY).orderBy("ring")) - 1)
    corners = corners.withColumn("place", F.row_number().over(w) - 1)
    return corners.join(named, [*KEY, "ring"]).select(*KEY, F.col("id").alias("ring"), F.col("place").alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y"))


def ring_areas(corners: DataFrame) -> DataFrame:
    """``(raster_id, label, ring, area, n_corners, x0, y0)``: signed areas in cells, and the first corner, top then left."""
    w = Window.partitionBy(*KEY, "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y"))
    c = corners.withColumn("cross", F.col("x") * ny - nx * F.col("y"))
    top = F.min(F.struct("y", "x"))
    return c.groupBy(*KEY, "ring").agg((F.sum("cross") / 2).alias("area"), F.count("*").alias("n_corners"), top.alias("t")).select(*KEY, "ring", "area", "n_corners", F.col("t.x").alias("x0"), F.col("t.y").alias("y0"))


def polygons(corners: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(raster_id, label, ring, outer, area, n_corners)``: each ring with the outer ring that it is of, itself or, for a
    hole, the one around it.

    Just left of a hole's first corner lies a cell of its polygon.  The nearest ring to the left of that cell is of the
    same polygon; where that is a hole as well, its own answer holds.
    """
    a = network.saved(ring_areas(corners))
    w = Window.partitionBy(*KEY, "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    side = corners.withColumn("x2", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("y2", F.coalesce(F.lead("y").over(w), F.first("y").over(whole))).where("x = x2")
    # upright sides in the rows that they pass; those that run north have their cells to the right
    rows = side.where("y2 < y").select(*KEY, F.col("ring").alias("met"), "x", F.explode(F.sequence(F.col("y2"), F.col("y") - 1)).alias("row"))
    holes = a.where("area < 0").select(*KEY, "ring", F.col("x0").alias("x"), F.col("y0").alias("row"))
    line = rows.select(*KEY, "row", "x", "met", F.lit(None).cast("int").alias("ring")).union(holes.select(*KEY, "row", "x", F.lit(None).cast("int"), "ring"))
    # a hole's own left side runs south; the last north-running side before it opens the run of cells beside it
    before = Window.partitionBy(*KEY, "row").orderBy("x", F.col("ring").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    up = line.withColumn("up", F.last("met", True).over(before)).where("ring IS NOT NULL").select(*KEY, "ring", "up")
    now = network.saved(a.join(up, [*KEY, "ring"], "left").select(*KEY, "ring", "area", "n_corners", F.coalesce("up", "ring").alias("outer")))
    for _ in range(max_rounds):
        above = now.select(*KEY, F.col("ring").alias("outer"), F.col("outer").alias("further"))
        then = network.saved(now.join(above, [*KEY, "outer"]).select(*KEY, "ring", "area", "n_corners", F.col("further").alias("outer"), (F.col("further") != F.col("outer")).alias("moved")))
        now = then.drop("moved")
        if then.where("moved").isEmpty():
            return now.select(*KEY, "ring", "outer", "area", "n_corners")
    raise ValueError("rings do not settle")


def dissolved(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``cells`` under new labels ``groups (label, into)``: the union of polygons is the rings of the union of their cells;
    labels without a group go."""
    return cells.join(groups, "label").select("raster_id", F.col("into").alias("label"), "row", "col").distinct()


def first_outlets(flow: DataFrame, outlets: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(comid, outlet)``: the first of ``outlets (comid)`` that each cell of ``flow (comid, nextdown)`` drains through, itself
    included; null where it meets none.  So nested basins become parts that do not overlap, in rounds that double."""
    o = outlets.select("comid", F.col("comid").alias("outlet"))
    now = network.saved(flow.select("comid", "nextdown").join(o, "comid", "left").select("comid", "outlet", F.when(F.col("outlet").isNull(), F.col("nextdown")).alias("nextdown")))
    for _ in range(max_rounds):
        far = now.select(F.col("comid").alias("nextdown"), F.col("outlet").alias("its"), F.col("nextdown").alias("further"))
        then = network.saved(now.join(far, "nextdown", "left").select("comid", F.coalesce("outlet", "its").alias("outlet"), F.when(F.coalesce("outlet", "its").isNull(), F.col("further")).alias("nextdown")))
        now = then
        if then.where("nextdown IS NOT NULL").isEmpty():
            return now.select("comid", "outlet")
    raise ValueError("cells drain in a circle")
