"""Drainage networks ``(comid, nextdown, area_km2)``, flow-direction grids and ranked outlet candidates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (row, column) steps of the flow-direction codes; the grid's own sinks have other codes.
D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a session without it gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarnflow-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, which is computed once and which a lost executor's tasks read again."""
    path = f"{shared_folder(df.sparkSession)}/tarnflow-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and never broadcast.

    Spark takes a table for as large as its compressed files, and a table after ``explode`` for no larger than before, so
    tables of a million cells come out small enough for the driver to collect.  What grows with the input goes through here.
    """
    return df.hint("merge")


def upstream(edges: DataFrame, outlets: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(outlet, comid)`` of all that drains through each of ``outlets (comid)``, itself included; cycles end by themselves.

    A frontier is joined with the edges until it is empty; for whole basins at once use ``upstream_totals``.
    """
    seen = saved(edges.join(outlets.select(F.col("comid")), "comid", "left_semi").select(F.col("comid").alias("outlet"), "comid").distinct())
    front = seen
    for _ in range(max_rounds):
        step = edges.select("comid", F.col("nextdown").alias("to")).join(front.withColumnRenamed("comid", "to"), "to").select("outlet", "comid").distinct()
        front = saved(step.join(seen, ["outlet", "comid"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = saved(seen.union(front))
    raise ValueError("the network is deeper than max_rounds")


def upstream_sums(edges: DataFrame, sums: list[str], least: list[str] = (), most: list[str] = (), max_rounds: int = 64) -> DataFrame:
    """``(comid, ...)``: for each of ``edges (comid, nextdown, ...)`` the sums, least and greatest values of the named columns
    over all that drains through it, itself included.

    After ``k`` rounds a row has what reaches it in fewer than ``2 ** k`` steps; it then adds what the rows exactly that
    far above it have.  A round has a row for each, and rounds are the logarithm of the depth.
    """
    of = {**{c: (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))) for c in sums}, **{c: (F.min, F.least) for c in least}, **{c: (F.max, F.greatest) for c in most}}
    ids = edges.select(F.col("comid").alias("nextdown"), F.lit(True).alias("there"))
    now = saved(edges.join(shuffled(ids), "nextdown", "left").select("comid", F.when(F.col("there") & (F.col("nextdown") != F.col("comid")), F.col("nextdown")).alias("to"), *of))
    for _ in range(max_rounds):
        moving = now.where("to IS NOT NULL")
        if moving.isEmpty():
            return now.drop("to")
        gain = moving.groupBy(F.col("to").alias("comid")).agg(*(f(c).alias(f"d_{c}") for c, (f, _) in of.items()))
        far = now.select(F.col("comid").alias("to"), F.col("to").alias("further"))
        now = saved(now.join(shuffled(gain), "comid", "left").join(shuffled(far), "to", "left").select("comid", F.col("further").alias("to"), *(plus(F.col(c), F.col(f"d_{c}")).alias(c) for c, (_, plus) in of.items())))
    raise ValueError("the network has a cycle or is too deep")


def upstream_totals(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(comid, n_upstream, area_km2)``: units and area that drain through each unit, itself included."""
    units = edges.select("comid", "nextdown", F.lit(1).cast("long").alias("n_upstream"), F.col("area_km2").cast("double").alias("area_km2"))
    return upstream_sums(units, ["n_upstream", "area_km2"], max_rounds=max_rounds)


def d8_edges(cells: DataFrame) -> DataFrame:
    """``(raster_id, row, col, to_row, to_col)``; cells with other codes drain nowhere."""
    table = F.create_map(*(x for k, (r, c) in D8.items() for x in (F.lit(k), F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")))))
    s = F.try_element_at(table, F.col("value").cast("int"))
    return cells.select("raster_id", "row", "col", (F.col("row") + s["r"]).alias("to_row"), (F.col("col") + s["c"]).alias("to_col"))


def clean_direction(code: Column) -> Column:
    """Valid codes stay, 0 is a sink at the sea, all others are not data (247)."""
    return F.when(code.isin(0, *D8), code).otherwise(247)


def touches_edge(mask: DataFrame, rows: int, cols: int, margin: int = 2) -> DataFrame:
    """``(raster_id, touches)`` of cells inside a basin; a basin without cells touches."""
    at = (F.col("row") < margin) | (F.col("col") < margin) | (F.col("row") >= rows - margin) | (F.col("col") >= cols - margin)
    return mask.groupBy("raster_id").agg(F.coalesce(F.bool_or(F.when(F.col("inside"), at)), F.lit(True)).alias("touches"))


#: Least and most search radius in metres, metres a root of expected area, and from where a snap is far.
RADIUS, RADIUS_OF_AREA, FAR_M = (3_000.0, 30_000.0), 1_500.0, 5_000.0


def search_radius(expected_km2: Column) -> Column:
    """Metres around an outlet: more for a large expected area."""
    return F.when(expected_km2 > 0, F.least(F.lit(RADIUS[1]), F.greatest(F.lit(RADIUS[0]), RADIUS_OF_AREA * F.sqrt(expected_km2)))).otherwise(RADIUS[0])


def snap(outlets: DataFrame, cells: DataFrame, radius: float | None, expected: bool = False, same: tuple[str, ...] = ()) -> DataFrame:
    """The best stream cell for each outlet ``(outlet_id, x, y, expected_km2)`` among ``(row, col, x, y, upa[, wth])``.

    Streams drain at least 1 km2 or have a width; without one within the radius any draining cell counts, then any.  Near
    and large cells score low; with an expected area, its relative error and the distance do.  Ties go to the first in row
    order.  Outlets and cells must agree in the columns ``same``.  Cells are joined by tiles of the radius, so an outlet meets only the nine tiles around it; without a radius each
    outlet has that of its expected area.  ``quality`` says by what it was chosen, and whether it is far.
    """
    size_of_tile = radius or RADIUS[1]
    tile = lambda c: F.floor(F.col(c) / size_of_tile)
    near = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    o = outlets.withColumn("dx", near).withColumn("dy", near).withColumn("radius", F.lit(radius) if radius else search_radius(F.col("expected_km2") if expected else F.lit(None).cast("double")))
    o = o.select("outlet_id", F.col("x").alias("ox"), F.col("y").alias("oy"), "expected_km2", "radius", *same, (tile("x") + F.col("dx")).alias("tx"), (tile("y") + F.col("dy")).alias("ty"))
    c = cells.withColumn("tx", tile("x")).withColumn("ty", tile("y"))
    j = o.join(c, ["tx", "ty", *same]).withColumn("dist", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))).where("dist <= radius")
    stream = F.col("upa") >= 1
    if "wth" in cells.columns:
        stream = stream | F.coalesce(F.col("wth") > 0, F.lit(False))
    kind = F.when((F.col("upa") > 0) & stream, 0).when(F.col("upa") > 0, 1).otherwise(2)
    w = Window.partitionBy("outlet_id")
    j = j.withColumn("kind", kind).withColumn("best_kind", F.min("kind").over(w)).where("kind = best_kind")
    size = F.log1p(F.greatest(F.coalesce("upa", F.lit(0.0)), F.lit(0.0)))
    away = F.col("dist") / F.greatest("radius", F.lit(1.0))
    by_area = F.abs(F.col("upa") - F.col("expected_km2")) / F.greatest(F.col("expected_km2"), F.lit(1.0)) + 0.35 * away
    by_distance = away - 0.2 * size / F.greatest(F.max(size).over(w), F.lit(1.0))
    targeted = (F.col("expected_km2") > 0) if expected else F.lit(False)
    j = j.withColumn("score", F.when(targeted, by_area).otherwise(by_distance)).withColumn("n", F.row_number().over(w.orderBy("score", "row", "col"))).where("n = 1")
    quality = F.concat(F.when(targeted, "area_targeted").otherwise("nearest_merit_stream"), F.when(F.col("dist") > FAR_M, "_far").otherwise(""))
    return j.select("outlet_id", "row", "col", "dist", "upa", quality.alias("quality"))


def gated(outlets: DataFrame, cells: DataFrame, radius: float, tolerance: float = 0.1, same: tuple[str, ...] = ()) -> DataFrame:
    """The nearest stream cell of each outlet whose area is within ``tolerance`` of the expected one; others have no row."""
    near = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    tile = lambda c: F.floor(F.col(c) / radius)
    o = outlets.where("expected_km2 > 0").withColumn("dx", near).withColumn("dy", near)
    o = o.select("outlet_id", F.col("x").alias("ox"), F.col("y").alias("oy"), "expected_km2", *same, (tile("x") + F.col("dx")).alias("tx"), (tile("y") + F.col("dy")).alias("ty"))
    c = cells.where("upa >= 1").withColumn("tx", tile("x")).withColumn("ty", tile("y"))
    off = F.abs(F.col("upa") - F.col("expected_km2"))
    j = o.join(c, ["tx", "ty", *same]).where(off <= tolerance * F.col("expected_km2"))
    j = j.select("outlet_id", "row", "col", "upa", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")).alias("dist"), (off / F.col("expected_km2")).alias("rel")).where(F.col("dist") <= radius)
    w = Window.partitionBy("outlet_id").orderBy(F.round("dist", 3), "rel", "row", "col")
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").select("outlet_id", "row", "col", "dist", "upa", F.lit("area_gated").alias("quality"))


def snap_area_gated(outlets: DataFrame, cells: DataFrame, radius: float, tolerance: float = 0.1, plain_radius: float | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """The gated snap; the plain one, within ``plain_radius`` and marked, where there is none."""
    found = gated(outlets, cells, radius, tolerance, same)
    plain = snap(outlets, cells, plain_radius or radius, same=same).withColumn("quality", F.concat("quality", F.lit("_area_gate_no_match")))
    return found.union(plain.join(found, "outlet_id", "left_anti"))


def locate(points: DataFrame, boxes: DataFrame, near: float = 0.05) -> DataFrame:
    """The unit of each point ``(point_id, x, y)`` among boxes ``(comid, x0, y0, x1, y1, uparea)``.

    One that holds the point, else the nearest within ``near``; ties, of distances equal to nine decimals, go to the larger
    upstream area, then the smaller id.
    """
    dx = F.greatest(F.col("x0") - F.col("x"), F.lit(0.0), F.col("x") - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col("y"), F.lit(0.0), F.col("y") - F.col("y1"))
    size = 1.0
    tiles = lambda a, z: F.sequence(F.floor((F.col(a) - near) / size), F.floor((F.col(z) + near) / size))
    b = boxes.withColumn("tx", F.explode(tiles("x0", "x1"))).withColumn("ty", F.explode(tiles("y0", "y1")))
    p = points.withColumn("tx", F.floor(F.col("x") / size)).withColumn("ty", F.floor(F.col("y") / size))
    j = p.join(b, ["tx", "ty"]).withColumn("dist", F.hypot(dx, dy)).where(F.col("dist") <= near)
    w = Window.partitionBy("point_id").orderBy(F.round("dist", 9), F.desc("uparea"), "comid")
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").select("point_id", "comid", "dist")


def tile_size(boxes: DataFrame) -> float:
    """A size for tiles from the data: the mean longer side of the boxes, so that a box touches few tiles."""
    side = boxes.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0]
    return side if side and side > 0 else 1.0


def ring_edges(rings: DataFrame) -> DataFrame:
    """``(unit, x1, y1, x2, y2)``: the edges of rings ``(unit, ring, seq, x, y)``, each closed by itself."""
    w = Window.partitionBy("unit", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rings.select("unit", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y2"))


def from_segment(px: Column, py: Column) -> tuple[Column, Column]:
    """Distance of a point from the segment ``(x1, y1, x2, y2)``, and how far along the segment, from 0 to 1, it is nearest."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((px - F.col("x1")) * dx + (py - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(px - F.col("x1") - t * dx, py - F.col("y1") - t * dy), t


def ring_relation(points: DataFrame, rings: DataFrame, near: float) -> DataFrame:
    """``(point_id, unit, inside, dist)`` of points ``(point_id, x, y)`` and polygons of rings ``(unit, ring, seq, x, y)``:
    whether the point is inside, by crossings, and how far the nearest edge is; exact up to ``near``, polygons farther
    away may be left out.

    Points meet boxes by tiles whose size follows from the data; edges are dealt to bands of height, so a point meets
    only those of its band and within ``near`` of it.
    """
    boxes = rings.groupBy("unit").agg((F.min("x") - near).alias("x0"), (F.min("y") - near).alias("y0"), (F.max("x") + near).alias("x1"), (F.max("y") + near).alias("y1"))
    size, e = tile_size(boxes), ring_edges(rings)
    height = max(e.agg(F.avg(F.abs(F.col("y2") - F.col("y1")))).first()[0] or 0.0, near, size / 64)
    p = points.withColumn("tx", F.floor(F.col("x") / size)).withColumn("ty", F.floor(F.col("y") / size))
    band = lambda c: F.floor(c / height)
    pairs = p.join(shuffled(in_tiles(boxes, size)), ["tx", "ty"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select("point_id", "unit", F.col("x").alias("px"), F.col("y").alias("py"), band(F.col("y")).alias("band"))
    e = e.withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2") - near), band(F.greatest("y1", "y2") + near))))
    far, _ = from_segment(F.col("px"), F.col("py"))
    crosses = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < F.col("x1") + F.try_divide((F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1")))
    return pairs.join(shuffled(e), ["unit", "band"]).groupBy("point_id", "unit").agg((F.count(F.when(crosses, 1)) % 2 == 1).alias("inside"), F.min(far).alias("edge")).select("point_id", "unit", "inside", F.when(F.col("inside"), 0.0).otherwise(F.col("edge")).alias("dist"))


def locate_polygons(points: DataFrame, rings: DataFrame, sizes: DataFrame, near: float = 0.05) -> DataFrame:
    """``(point_id, unit, how)``: the unit that contains a point, else one it touches, else the nearest within ``near``; ties
    go to the larger ``(unit, uparea)``, then the smaller name.  Points without one have no row."""
    r = ring_relation(points, rings, near).where(F.col("dist") <= near).join(shuffled(sizes), "unit", "left")
    kind = F.when(F.col("inside"), 0).when(F.col("dist") == 0, 1).otherwise(2)
    w = Window.partitionBy("point_id").orderBy("kind", "dist", F.desc_nulls_last("uparea"), "unit")
    best = r.withColumn("kind", kind).withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select("point_id", "unit", F.element_at(F.array(*map(F.lit, ("contains", "touches", "nearest"))), F.col("kind") + 1).alias("how"))


def nearest_lines(points: DataFrame, lines: DataFrame, max_rounds: int = 64, decimals: int | None = None) -> DataFrame:
    """``(point_id, line, x, y, dist)``: for each point ``(point_id, x, y)`` the nearest of ``lines (line, seq, x, y)``, where on it,
    and how far; ties, with ``decimals`` of distances rounded to these, go to the smaller line.

    Nothing is said about how far the nearest may be.  A segment goes to all tiles within half a tile of it, so a point
    meets in its own tile all that is as near; what it finds so near is proven.  The others look again in tiles of twice
    the size, so each round has fewer points and fewer tiles.  The least distance comes first, as a number that needs no
    sort of all that met, and then the lines at that distance.  Without lines there are no rows.
    """
    w = Window.partitionBy("line").orderBy("seq")
    s = lines.select("line", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    s = saved(s.where("x2 IS NOT NULL"))
    bounds = s.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0]
    left = saved(points.where("x IS NOT NULL AND y IS NOT NULL").select("point_id", F.col("x").alias("px"), F.col("y").alias("py")))
    if bounds is None:
        return left.select("point_id", F.lit(None).cast(dict(lines.dtypes)["line"]).alias("line"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("dist")).limit(0)
    size, done = max(bounds, 1e-9), []
    far, t = from_segment(F.col("px"), F.col("py"))
    least, slack = (far, 0.0) if decimals is None else (F.round(far, decimals), 10.0**-decimals)
    for _ in range(max_rounds):
        reach = size / 2
        tile = lambda c: F.floor(c / size)  # noqa: B023, E731
        span = lambda a, z: F.explode(F.sequence(tile(F.least(a, z) - reach), tile(F.greatest(a, z) + reach)))  # noqa: B023, E731
        boxes = s.select("line", "x1", "y1", "x2", "y2").withColumn("tx", span("x1", "x2")).withColumn("ty", span("y1", "y2"))
        off, _ = from_segment((F.col("tx") + 0.5) * size, (F.col("ty") + 0.5) * size)
        boxes = shuffled(boxes.where(off <= (reach + size * 0.5**0.5) * 1.001))
        asked = left.withColumn("tx", tile(F.col("px"))).withColumn("ty", tile(F.col("py")))
        near = saved(asked.join(boxes, ["tx", "ty"]).groupBy("tx", "ty", "point_id", "px", "py").agg(F.min(least).alias("least")).where(F.col("least") <= reach * (1 - 1e-9) - slack))
        found = near.join(boxes, ["tx", "ty"]).where(least <= F.col("least"))
        row = F.struct("least", "line", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"), far.alias("dist"))
        best = saved(found.select("point_id", row.alias("b")).groupBy("point_id").agg(F.min("b").alias("b")))
        done.append(best)
        left = saved(left.join(shuffled(best), "point_id", "left_anti"))
        if left.isEmpty():
            break
        size *= 2
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("point_id", "b.line", "b.x", "b.y", "b.dist")


#: Degrees of a generalised coast, and of the zone along a border.
COAST_DEG, BORDER_DEG = 0.02, 0.25


def outlet_zone(points: DataFrame, rings: DataFrame) -> DataFrame:
    """``(point_id, zone)`` of outlets against the rings of the ``home`` and ``border`` regions: ``conus`` inside home or at
    its coast, ``conus_border_zone`` there but near the border, else ``non_conus``; ``undetermined`` without coordinates."""
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    r = ring_relation(known, rings.withColumnRenamed("region", "unit"), BORDER_DEG)
    at = lambda unit, d: F.coalesce(F.bool_or((F.col("unit") == unit) & (F.col("dist") <= d)), F.lit(False))
    z = r.groupBy("point_id").agg(at("home", COAST_DEG).alias("home"), at("border", BORDER_DEG).alias("border"))
    j = points.join(z, "point_id", "left").join(known.select("point_id", F.lit(True).alias("known")), "point_id", "left")
    zone = F.when(F.col("known").isNull(), "undetermined").when(~F.coalesce("home", F.lit(False)), "non_conus").when(F.col("border"), "conus_border_zone").otherwise("conus")
    return j.select("point_id", zone.alias("zone"))


def missing_ids(wanted: DataFrame, there: DataFrame) -> DataFrame:
    return wanted.join(there, "comid", "left_anti")


def river_band(uparea: Column) -> Column:
    """Band 0 drains at least 10,000 km2, then 2,500, 500, 100; the rest and unknown areas are band 4."""
    return F.when(uparea >= 10_000, 0).when(uparea >= 2_500, 1).when(uparea >= 500, 2).when(uparea >= 100, 3).otherwise(4)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.power(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.power(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * 6_371_008.8 * F.asin(F.sqrt(a))


def set_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``(raster_id, n_a, n_b, n_both, iou)`` of two cell sets, by one full join."""
    j = a.select("raster_id", *keys).distinct().withColumn("_a", F.lit(1)).join(b.select("raster_id", *keys).distinct().withColumn("_b", F.lit(1)), ["raster_id", *keys], "full")
    c = j.groupBy("raster_id").agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n_both"), F.count("*").alias("n"))
    return c.select("raster_id", "n_a", "n_b", "n_both", (F.col("n_both") / F.col("n")).alias("iou"))


def boxes_overlap(a: str, b: str) -> Column:
    return F.expr(f"{a}.x0 <= {b}.x1 AND {a}.x1 >= {b}.x0 AND {a}.y0 <= {b}.y1 AND {a}.y1 >= {b}.y0")


def refine_terminal(edges: DataFrame, inside: DataFrame, outlets: DataFrame) -> DataFrame:
    """``(outlet, comid)`` of what drains to an outlet through cells of its own unit only; ``inside (comid)``."""
    kept = edges.join(inside, "comid", "left_semi")
    return upstream(kept, outlets)


def in_tiles(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes ``(..., x0, y0, x1, y1)`` once for each tile ``(tx, ty)`` that they touch."""
    span = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(z) / size)))
    return boxes.withColumn("tx", span("x0", "x1")).withColumn("ty", span("y0", "y1"))


def smallest_holding(points: DataFrame, boxes: DataFrame, size: float = 10.0) -> DataFrame:
    """``(point_id, unit_id)``: the smallest unit ``(unit_id, x0, y0, x1, y1, area)`` that holds a point; they meet by tiles."""
    p = points.withColumn("tx", F.floor(F.col("x") / size)).withColumn("ty", F.floor(F.col("y") / size))
    j = p.join(in_tiles(boxes, size), ["tx", "ty"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return j.groupBy("point_id").agg(F.min(F.struct("area", "unit_id"))["unit_id"].alias("unit_id"))


def overlapping(views: DataFrame, boxes: DataFrame, size: float = 10.0) -> DataFrame:
    """``(preset, code)`` of views and boxes, both ``(name, x0, y0, x1, y1)``, that overlap; they meet by tiles."""
    v, b = in_tiles(views, size).alias("v"), in_tiles(boxes, size).alias("b")
    return v.join(b, ["tx", "ty"]).where(boxes_overlap("v", "b")).select("preset", "code").distinct()


def layer(features: DataFrame, views: DataFrame, most: int, size: float = 1.0) -> DataFrame:
    """What a map shows of each view ``(view_id, x0, y0, x1, y1)``: of the features ``(feature_id, x0, y0, x1, y1, weight)``
    that touch it the ``most`` heaviest, with their rank and the number found."""
    v, f = in_tiles(views, size).alias("v"), in_tiles(features, size).alias("f")
    j = v.join(f, ["tx", "ty"]).where(boxes_overlap("v", "f")).select("view_id", "feature_id", "weight").distinct()
    w = Window.partitionBy("view_id")
    j = j.withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), "feature_id"))).withColumn("n_found", F.count("*").over(w))
    return j.where(F.col("rank") <= most).select("view_id", "feature_id", "rank", "n_found")


def looked_up(wanted: DataFrame, units: DataFrame, lines: DataFrame) -> DataFrame:
    """``(comid, uparea, length_km, status)`` of each wanted id: its unit's area and its reach, or what is missing."""
    j = wanted.select("comid").distinct().join(units.select("comid", "uparea"), "comid", "left").join(lines.select("comid", "length_km"), "comid", "left")
    return j.withColumn("status", F.when(F.col("uparea").isNull(), "missing").when(F.col("length_km").isNull(), "no_line").otherwise("found"))


def best_area_match(candidates: DataFrame, most: int = 60) -> DataFrame:
    """Of the reaches ``(outlet_id, comid, seq, area_km2, expected_km2)`` found around an outlet, the first being where it
    lies, the one whose area is nearest to the expected one, among the first ``most``; ties go to the earlier one."""
    off = F.abs(F.col("area_km2") - F.col("expected_km2"))
    best = F.min(F.when(off.isNotNull(), F.struct(off.alias("off"), "seq", "comid", "area_km2")))
    a = candidates.where(F.col("seq") < most).groupBy("outlet_id").agg(best.alias("b"), F.min(F.struct("seq", "comid"))["comid"].alias("start"), F.count("*").alias("n_candidates"))
    return a.select("outlet_id", F.coalesce("b.comid", "start").alias("comid"), "b.area_km2", "n_candidates", (F.col("b.comid") != F.col("start")).alias("moved"))


def merge_tiles(tiles: DataFrame) -> DataFrame:
    """One row for each ``tile_id`` of ``(tile_id, source_rank, payload)``: that of the first source, in order of ids."""
    return tiles.groupBy("tile_id").agg(F.min(F.struct("source_rank", "payload")).alias("t"), F.count("*").alias("n_sources")).select("tile_id", "t.payload", "n_sources")
