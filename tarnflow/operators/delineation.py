"""Delineation of many outlets at once: snap, locate, union of units, test of the reach, refinement, windows.

Cells are rows ``(row, col, x, y, code, km2, unit[, upa])`` of one flow-direction raster: ``unit`` is the unit catchment
that a cell belongs to, ``upa`` the area of an accumulation raster where there is one.  Positions are in metres of one
metric system.  Nothing is routed for a single outlet: sums over all that drains through a cell or a unit are taken for
the whole raster in rounds that double their reach, and an outlet reads its own row of them.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators import geodesy, network, reliability

WIDE = 1 << 31  #: a cell's key is ``row * WIDE + col``
#: Cells of upstream units that make a cell part of the main stem; share of the inflow below which an outlet is
#: off the reach; radius and tolerance of the gated snap, and from where it is distant; radius of the plain snap, in metres.
FEEDER_CELLS, OFF_REACH, GATE_M, TOLERANCE, DISTANT_M, PLAIN_M = 120, 0.9, 1_000.0, 0.1, 500.0, 3_000.0
#: Cells beside a terminal unit's window, and most cells of an interactive and of a scientific one.
MARGIN, INTERACTIVE_CELLS, SCIENTIFIC_CELLS = 32, 60_000_000, 120_000_000
#: Growth of a window, its largest half side in km, and the margin of cells that a basin must not reach.
GROWTH, LARGEST_KM, EDGE = 1.6, 1_200.0, 2
LOCAL_KM = 20.0  #: fixed value: largest half side of a window that stands in for a failed refinement


def cell_key(row: Column, col: Column) -> Column:
    return row.cast("long") * WIDE + col


def flow(cells: DataFrame) -> DataFrame:
    """``cells`` with their key ``comid`` and the key ``nextdown`` of the cell that they drain to; cells without a valid code
    are left out, sinks drain nowhere."""
    table = F.create_map(*(x for k, (r, c) in network.D8.items() for x in (F.lit(k), F.lit(r * WIDE + c))))
    key = cell_key(F.col("row"), F.col("col"))
    code = F.col("code").cast("int")
    return cells.where(code.isin(0, *network.D8)).select("*", key.alias("comid"), (key + F.try_element_at(table, code)).alias("nextdown"))


def feeding(pairs: DataFrame, units: DataFrame, totals: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Those of ``pairs (u, v)`` where unit ``u`` drains through ``v``.  All pairs walk down the network together; one ends
    when it meets ``v``, or a unit that has as many units above it, which only lies below."""
    size = totals.select(F.col("comid").alias("v"), F.col("n_upstream").alias("size"))
    step = units.select(F.col("comid").alias("at"), "nextdown").join(totals.select(F.col("comid").alias("at"), "n_upstream"), "at")
    walk, found = network.saved(pairs.join(size, "v").select("u", "v", "size", F.col("u").alias("at"))), []
    for _ in range(max_rounds):
        moved = network.saved(walk.join(step, "at").where("n_upstream < size").select("u", "v", "size", F.col("nextdown").alias("at")).where("at IS NOT NULL"))
        if moved.isEmpty():
            break
        found.append(moved.where("at = v").select("u", "v"))
        walk = moved.where("at <> v")
    out = pairs.limit(0)
    for f in found:
        out = out.union(f)
    return network.saved(out)


def unit_drainage(cells: DataFrame, units: DataFrame, feeder_cells: int = FEEDER_CELLS) -> DataFrame:
    """``(row, col, x, y, unit, local_km2, receives, upa)``: what drains to each cell inside its own unit, and the area that
    it has on the whole network, from flow directions alone.

    Water stays inside units for the local area.  Where at least ``feeder_cells`` cells of units above drain through a
    cell, it is on the main stem, and the area of all units above is added to it.
    """
    totals = network.upstream_totals(units.withColumn("area_km2", F.coalesce("area_km2", F.lit(0.0))))
    f = network.saved(flow(cells).select("row", "col", "x", "y", "unit", "km2", "comid", "nextdown"))
    to = f.select(F.col("comid").alias("nextdown"), F.col("unit").alias("to_unit"))
    f = network.saved(f.join(to, "nextdown", "left"))
    crossing = f.where("unit <> to_unit").select(F.col("unit").alias("u"), F.col("to_unit").alias("v")).distinct()
    allowed = feeding(crossing, units, totals)
    inside = f.select("comid", F.when(F.col("unit") == F.col("to_unit"), F.col("nextdown")).alias("nextdown"), F.col("km2").alias("local_km2"), F.lit(1).cast("long").alias("local_n"))
    local = network.upstream_sums(inside, ["local_km2", "local_n"])
    linked = f.join(allowed.select(F.col("u").alias("unit"), F.col("v").alias("to_unit"), F.lit(True).alias("linked")), ["unit", "to_unit"], "left")
    whole = linked.select("comid", F.when((F.col("unit") == F.col("to_unit")) | F.col("linked"), F.col("nextdown")).alias("nextdown"), F.lit(1).cast("long").alias("n"))
    fed = network.upstream_sums(whole, ["n"])
    inflow = totals.join(units.select("comid", F.col("area_km2").alias("own")), "comid").select(F.col("comid").alias("unit"), (F.col("area_km2") - F.coalesce("own", F.lit(0.0))).alias("inflow_km2"))
    j = f.select("comid", "row", "col", "x", "y", "unit").join(local, "comid").join(fed, "comid").join(inflow, "unit", "left")
    receives = (F.col("n") - F.col("local_n") >= feeder_cells) & (F.col("inflow_km2") > 0)
    return j.select("row", "col", "x", "y", "unit", "local_km2", receives.alias("receives"), (F.col("local_km2") + F.when(receives, F.col("inflow_km2")).otherwise(0.0)).alias("upa"))


def reach_position(points: DataFrame, reaches: DataFrame) -> DataFrame:
    """``(point_id, line_m, fraction)`` of points ``(point_id, x, y, unit)`` and the lines ``(unit, seq, x, y)`` of their units,
    from the downstream end: how far the line is, and how far along it."""
    w = Window.partitionBy("unit").orderBy("seq")
    s = reaches.select("unit", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 IS NOT NULL")
    s = s.withColumn("length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    s = s.withColumn("before", F.sum("length").over(w) - F.col("length")).withColumn("total", F.sum("length").over(Window.partitionBy("unit")))
    far, t = network.from_segment(F.col("x"), F.col("y"))
    j = points.join(s, "unit").select("point_id", F.struct(far.alias("line_m"), "seq", F.try_divide(F.col("before") + t * F.col("length"), F.col("total")).alias("fraction")).alias("r"))
    return j.groupBy("point_id").agg(F.min("r").alias("r")).select("point_id", "r.line_m", "r.fraction")


def window_basins(outlets: DataFrame, cells: DataFrame, size: float, largest_km: float = LARGEST_KM, most_cells: int = INTERACTIVE_CELLS, cut_last: bool = False) -> DataFrame:
    """``(outlet_id, status, n_windows, half_km, n_cells, basin_km2)`` of outlets ``(outlet_id, row, col, half_km)`` on cells of
    ``size`` metres: windows grow 1.6 times until the basin no longer reaches their margin.

    A basin cut at a window's edge reaches its margin exactly if the whole basin leaves the window less that margin.  So one
    set of sums gives every cell's basin, as its box and area, and each outlet compares its windows with the box: no
    raster is routed again.  With ``cut_last`` the last window is cut to ``largest_km``.  ``contained``; ``extent_maxed`` where no window up to ``largest_km`` holds the basin;
    ``too_large`` where one would have more than ``most_cells``; ``no_direction`` where the outlet's cell has none.
    """
    f = flow(cells).select("comid", "nextdown", "km2", *(F.col(c).alias(n) for n, c in (("r0", "row"), ("r1", "row"), ("c0", "col"), ("c1", "col"))))
    basin = network.upstream_sums(f, ["km2"], ["r0", "c0"], ["r1", "c1"])
    limits = cells.agg(*(g(c).alias(n) for n, g, c in (("t", F.min, "row"), ("b", F.max, "row"), ("l", F.min, "col"), ("r", F.max, "col")))).first()
    edge = {n: F.lit(limits[n] or 0) for n in "tblr"}
    j = outlets.join(basin, cell_key(F.col("row"), F.col("col")) == basin["comid"], "left")
    k = F.posexplode(F.sequence(F.lit(0), F.lit(ceil(log(max(largest_km / 1e-3, 2.0), GROWTH)))))
    w = j.select("*", k.alias("k", "_")).withColumn("half", F.col("half_km") * F.pow(F.lit(GROWTH), F.col("k")))
    w = w.where((F.col("k") == 0) | (F.col("half") < largest_km * GROWTH)).withColumn("half", F.least("half", F.lit(largest_km))) if cut_last else w.where(F.col("half") <= largest_km)
    n = F.floor(F.col("half") * 1000 / size)
    top, bottom, left, right = F.greatest(F.col("row") - n, edge["t"]), F.least(F.col("row") + n, edge["b"]), F.greatest(F.col("col") - n, edge["l"]), F.least(F.col("col") + n, edge["r"])
    w = w.withColumn("n_cells", (bottom - top + 1).cast("long") * (right - left + 1))
    held = (F.col("r0") >= top + EDGE) & (F.col("r1") <= bottom - EDGE) & (F.col("c0") >= left + EDGE) & (F.col("c1") <= right - EDGE)
    status = F.when(F.col("n_cells") > most_cells, "too_large").when(held, "contained").otherwise("extent_maxed")
    w = w.withColumn("status", status)
    # the first window that ends the search; the last one where none does
    best = F.min(F.struct((F.col("status") == "extent_maxed").alias("open"), F.when(F.col("status") == "extent_maxed", -F.col("k")).otherwise(F.col("k")).alias("order"), "k", "half", "n_cells", "status"))
    b = w.where("comid IS NOT NULL").groupBy("outlet_id", "km2").agg(best.alias("w"))
    out = j.select("outlet_id", F.col("comid").isNotNull().alias("routed")).join(b, "outlet_id", "left")
    status = F.when(~F.col("routed"), "no_direction").otherwise(F.coalesce("w.status", F.lit("extent_maxed")))
    return out.select("outlet_id", status.alias("status"), F.coalesce(F.col("w.k") + 1, F.lit(0)).alias("n_windows"), F.col("w.half").alias("half_km"), F.col("w.n_cells").alias("n_cells"), F.when(F.col("w.status") == "contained", F.col("km2")).alias("basin_km2"))


def _snapped(outlets: DataFrame, cells: DataFrame, same: tuple[str, ...]) -> DataFrame:
    """The gated snap where an area is expected, else the plain one."""
    expected = F.coalesce(F.col("expected_km2") > 0, F.lit(False))
    return network.snap_area_gated(outlets.where(expected), cells, GATE_M, TOLERANCE, PLAIN_M, same).union(network.snap(outlets.where(~expected), cells, PLAIN_M, same=same))


def hybrid(outlets: DataFrame, regions: DataFrame, rings: DataFrame, units: DataFrame, cells: DataFrame, size: float, reaches: DataFrame | None = None, near: float = 5_000.0, feeder_cells: int = FEEDER_CELLS, most_cells: int = INTERACTIVE_CELLS) -> DataFrame:
    """The basin of each outlet ``(outlet_id, x, y, expected_km2)`` from unit catchments and one refined terminal unit.

    ``regions`` and ``rings`` are the polygons ``(unit, ring, seq, x, y)`` of regions and units, ``units`` the network
    ``(comid, nextdown, area_km2, uparea_km2)``, a null area being a unit without polygon, ``reaches`` its lines.  All
    outlets move on together:

    1. region and home unit; without one (within ``near``) an outlet is refused;
    2. snap on the accumulation raster where it has cells for the region's outlet, else on the flow directions inside the
       home unit, else the outlet stays unsnapped and keeps the whole terminal unit;
    3. the terminal unit with all above it; an outlet that drains less than nine tenths of the inflow is off the reach
       and keeps only what drains to it, unless the expected area is nearer to the whole;
    4. the terminal unit is refined to what drains to the outlet inside it; where its window is too large and the outlet
       drains only part of it, by a window around the outlet;
    5. areas, flags in order of names, and how far the result can be trusted.
    """
    points = outlets.select(F.col("outlet_id").alias("point_id"), "x", "y")
    sizes = lambda ids: ids.select(F.col("unit"), F.lit(None).cast("double").alias("uparea")).distinct()
    region = network.locate_polygons(points, regions, sizes(regions), near).select(F.col("point_id").alias("outlet_id"), F.col("unit").alias("region"))
    home = network.locate_polygons(points, rings, units.select(F.col("comid").alias("unit"), F.col("uparea_km2").alias("uparea")), near).select(F.col("point_id").alias("outlet_id"), F.col("unit").alias("home"))
    o = network.saved(outlets.join(region, "outlet_id", "left").join(home, "outlet_id", "left"))
    if "upa" not in cells.columns:
        cells = cells.withColumn("upa", F.lit(None).cast("double"))
    drained = network.saved(unit_drainage(cells, units, feeder_cells))
    ready = o.where("region IS NOT NULL AND home IS NOT NULL").withColumn("unit", F.col("home"))
    on_raster = network.saved(_snapped(ready, cells.where("upa IS NOT NULL"), ()))
    inside = _snapped(ready.join(on_raster, "outlet_id", "left_anti"), drained, ("unit",))
    marked = F.when(F.col("quality") == "area_gated", F.col("quality")).otherwise(F.concat(F.lit("offline_flowdir_home_catchment"), F.when(F.endswith("quality", F.lit("_area_gate_no_match")), "_area_gate_no_match").otherwise("")))
    found = on_raster.withColumn("by_flow", F.lit(False)).union(inside.withColumn("quality", marked).withColumn("by_flow", F.lit(True)))
    at = cells.select("row", "col", F.col("unit").alias("at_unit")).join(drained.select("row", "col", "local_km2"), ["row", "col"], "left")
    s = network.saved(o.join(found.join(at, ["row", "col"]), "outlet_id", "left").withColumn("unit", F.when(F.col("row").isNotNull(), F.col("at_unit")).otherwise(F.col("home"))))
    # units: totals, how many have no polygon, and the window of each in cells
    known = units.select("comid", "nextdown", F.coalesce("area_km2", F.lit(0.0)).alias("vector_km2"), F.col("area_km2").isNull().cast("long").alias("n_missing"))
    totals = network.upstream_sums(known, ["vector_km2", "n_missing"])
    box = cells.groupBy("unit").agg(((F.max("row") - F.min("row") + 1 + 2 * MARGIN).cast("long") * (F.max("col") - F.min("col") + 1 + 2 * MARGIN)).alias("window_cells"))
    t = totals.join(units.select("comid", F.col("area_km2").alias("terminal_km2"), "uparea_km2"), "comid").withColumnRenamed("comid", "unit").join(box, "unit", "left")
    s = s.join(t, "unit", "left").withColumn("inflow_km2", F.col("vector_km2") - F.coalesce("terminal_km2", F.lit(0.0)))
    snapped, gated = F.col("row").isNotNull(), F.col("expected_km2") > 0
    s = s.withColumn("off", snapped & (F.col("inflow_km2") > 0) & F.coalesce(F.col("upa") < OFF_REACH * F.col("inflow_km2"), F.lit(False)))
    s = s.withColumn("refined_km2", F.when(snapped & (F.col("window_cells") <= most_cells), F.col("local_km2")))
    wanting = snapped & F.col("refined_km2").isNull() & (F.col("off") | (F.col("inflow_km2") <= 0)) & (F.col("upa") < OFF_REACH * F.col("terminal_km2"))
    s = network.saved(s.withColumn("wanting", F.coalesce(wanting, F.lit(False))))
    ask = s.where("wanting").select("outlet_id", "row", "col", geodesy.local_half_km(F.col("upa")).alias("half_km"))
    windows = window_basins(ask, cells, size, LOCAL_KM, cut_last=True).where("status = 'contained'").select("outlet_id", F.col("basin_km2").alias("window_km2"))
    s = s.join(windows, "outlet_id", "left")
    s = s.withColumn("local", F.coalesce("refined_km2", "window_km2", "terminal_km2"))
    error = lambda a: F.abs(F.ln(a / F.col("expected_km2")))
    s = s.withColumn("kept", F.col("off") & F.coalesce(gated & (F.col("local") > 0) & (F.col("vector_km2") > 0) & (error(F.col("vector_km2")) < error(F.col("local"))), F.lit(False)))
    mode = F.when(~F.col("off"), "union_upstream").when(F.col("kept"), "union_upstream_kept_by_expected_area").otherwise("local_only")
    area = F.when(F.col("kept"), F.col("vector_km2")).when(F.col("off"), F.col("local")).otherwise(F.col("inflow_km2") + F.col("local"))
    reason = F.when(F.col("region").isNull(), "no_region").when(F.col("home").isNull(), "no_unit").when(F.col("terminal_km2").isNull(), "terminal_without_polygon")
    s = s.withColumn("reason", reason).withColumn("mode", mode).withColumn("area", area)
    if reaches is None:
        s = s.withColumn("line_m", F.lit(None).cast("double")).withColumn("fraction", F.lit(None).cast("double"))
    else:
        place = reach_position(s.where(~snapped).select(F.col("outlet_id").alias("point_id"), "x", "y", "unit"), reaches)
        s = s.join(place.withColumnRenamed("point_id", "outlet_id"), "outlet_id", "left")
    no_match = F.endswith("quality", F.lit("_area_gate_no_match"))
    flags = {
        "AMBIGUOUS_OUTLET": F.col("off") & ~F.col("kept") & ~F.coalesce(gated, F.lit(False)),
        "AREA_GATE_NO_MATCH": no_match,
        "AREA_GATE_SNAP_DISTANT": (F.col("quality") == "area_gated") & (F.col("dist") > DISTANT_M),
        "HYBRID_LOCAL_ONLY": F.col("mode") == "local_only",
        "HYBRID_ROUTING_USED": F.lit(True),
        "OFFLINE_FLOWDIR_SNAP_UNVALIDATED": F.col("by_flow") & (F.col("quality") != "area_gated"),
        "OFFLINE_FLOWDIR_SNAP_USED": F.col("by_flow"),
        "OUTLET_OFF_TERMINAL_REACH": F.col("off"),
        "SNAP_UPA_DIFFERS_FROM_EXPECTED": no_match & (F.abs(F.col("upa") - F.col("expected_km2")) > TOLERANCE * F.col("expected_km2")),
        "TERMINAL_CATCHMENT_LOCAL_WINDOW_USED": F.col("window_km2").isNotNull(),
        "TERMINAL_CATCHMENT_REFINEMENT_FAILED": snapped & F.col("refined_km2").isNull(),
        "TERMINAL_CATCHMENT_REFINEMENT_SKIPPED_UNSNAPPED": ~snapped,
        "VECTOR_ASSEMBLY_INCOMPLETE": F.col("n_missing") > 0,
        "VECTOR_ASSEMBLY_UPAREA_MISMATCH": (F.col("uparea_km2") > 0) & (F.col("vector_km2") > 0) & (F.abs(F.col("vector_km2") - F.col("uparea_km2")) > 0.02 * F.col("uparea_km2")),
    }
    unsure = reliability.unsnapped_unreliable(F.col("area"), F.col("terminal_km2"), F.col("inflow_km2"), F.col("line_m"), F.col("fraction"))
    trust = F.when(~snapped & unsure, "unreliable").when(~snapped | (F.col("by_flow") & (F.col("quality") != "area_gated")), "provisional")
    done = F.col("reason").isNull()
    when = lambda c: F.when(done, c)
    return s.select(
        "outlet_id", F.when(done, "done").otherwise("refused").alias("state"), "reason", when(F.col("unit")).alias("terminal"), when(F.col("row")).alias("row"), when(F.col("col")).alias("col"), when(F.col("dist")).alias("snap_m"), when(F.col("upa")).alias("upa_km2"),
        when(F.coalesce("quality", F.lit("offline_unsnapped"))).alias("quality"), when(F.col("inflow_km2")).alias("inflow_km2"), when(F.coalesce("refined_km2", "window_km2")).alias("refined_km2"), when(F.col("mode")).alias("mode"), when(F.col("area")).alias("area_km2"),
        when(trust).alias("reliability"), F.when(done, F.concat_ws(",", *(F.when(v, n) for n, v in flags.items()))).alias("flags"),
    )
