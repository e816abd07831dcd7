"""Routing on elevation: filled depressions, flow directions, accumulation and wetness of rasters ``(raster_id, row, col, value)``.

A cell's level is the least height from which water gets out of the raster: along its best path to the rim, the highest
cell.  ``steps`` counts the cells of a flat to where its level falls, so flats drain by the shortest way.  Both come from
one fixed point.  Rasters are cut into tiles; a task solves one tile by a heap, from the levels that its neighbours have
reached; rounds end when no tile changes, so their number follows the tiles that water crosses, not the cells.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import network, terrain

TILE = 256  #: rows and columns of a tile
FAR = 1e300


def settle(rows: np.ndarray, cols: np.ndarray, z: np.ndarray, level: np.ndarray, steps: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels and steps of a tile's own cells; the others hold what is known around it."""
    at = {p: i for i, p in enumerate(zip(rows.tolist(), cols.tolist()))}
    w, s, heights, mine = level.tolist(), steps.tolist(), z.tolist(), own.tolist()
    heap = [(w[i], s[i], i) for i in range(len(w)) if w[i] < FAR]
    heapify(heap)
    r, c = rows.tolist(), cols.tolist()
    while heap:
        a, b, i = heappop(heap)
        if (a, b) != (w[i], s[i]):
            continue
        for dr, dc in network.D8.values():
            j = at.get((r[i] + dr, c[i] + dc))
            if j is None or not mine[j]:
                continue
            new = (heights[j], 0) if heights[j] > a else (a, b + 1)
            if new < (w[j], s[j]):
                w[j], s[j] = new
                heappush(heap, (*new, j))
    return np.array(w)[own], np.array(s)[own]


def filled(cells: DataFrame, tile: int = TILE, max_rounds: int = 100_000) -> DataFrame:
    """``(raster_id, row, col, value, level, steps)``; cells next to a missing one or the rim drain out by themselves."""
    there = cells.where("value IS NOT NULL").select("raster_id", "row", "col", F.col("value").cast("double").alias("value"))
    sent = there.select("raster_id", F.explode(F.array(*(F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in network.D8.values()))).alias("t")).select("raster_id", "t.*")
    n = sent.groupBy("raster_id", "row", "col").agg(F.count("*").alias("n"))
    rim = F.coalesce("n", F.lit(0)) < 8
    now = network.saved(there.join(network.shuffled(n), ["raster_id", "row", "col"], "left").select("raster_id", "row", "col", "value", F.when(rim, F.col("value")).otherwise(FAR).alias("level"), F.lit(0).cast("long").alias("steps")))
    of = lambda c: F.floor(F.col(c) / tile)
    kind = dict(now.dtypes)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["own"].to_numpy()
        level, steps = settle(*(frame[c].to_numpy() for c in ("row", "col", "value", "level", "steps")), own)
        mine = frame[own]
        changed = bool(((level != mine["level"].to_numpy()) | (steps != mine["steps"].to_numpy())).any())
        return mine[["raster_id", "row", "col", "value"]].assign(level=level, steps=steps, changed=changed)

    shifts = F.array_distinct(F.flatten(F.array(*(F.array(F.struct(F.floor((F.col("row") + r) / tile).alias("tr"), F.floor((F.col("col") + c) / tile).alias("tc"))) for r in (-1, 0, 1) for c in (-1, 0, 1)))))
    for _ in range(max_rounds):
        dealt = now.withColumn("t", F.explode(shifts)).withColumn("own", (F.col("t.tr") == of("row")) & (F.col("t.tc") == of("col"))).withColumn("tr", F.col("t.tr")).withColumn("tc", F.col("t.tc")).drop("t")
        then = network.saved(dealt.groupBy("raster_id", "tr", "tc").applyInPandas(solve, f"raster_id {kind['raster_id']}, row {kind['row']}, col {kind['col']}, value double, level double, steps long, changed boolean"))
        now = then.drop("changed")
        if then.where("changed").isEmpty():
            return now
    raise ValueError("levels did not settle")


def directions(levels: DataFrame) -> DataFrame:
    """``(raster_id, row, col, to_row, to_col)``: down the steepest fall of the levels, on a flat towards its way out; the
    first of equals in order of codes; cells at the rim without a lower neighbour drain nowhere."""
    moves = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), F.lit(float(np.hypot(r, c))).alias("dist")) for k, (r, c) in enumerate(network.D8.values())))
    seen = levels.select("raster_id", F.explode(moves).alias("m"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("level").alias("nl"), F.col("steps").alias("ns")).select("raster_id", "m.k", "m.row", "m.col", "m.dist", "to_row", "to_col", "nl", "ns")
    j = levels.join(network.shuffled(seen), ["raster_id", "row", "col"])
    falls, flat = F.col("nl") < F.col("level"), (F.col("nl") == F.col("level")) & (F.col("ns") == F.col("steps") - 1)
    rank = F.struct(F.when(falls & (F.col("steps") == 0), 0).otherwise(1).alias("a"), F.when(falls, (F.col("nl") - F.col("level")) / F.col("dist")).otherwise(0.0).alias("b"), "k", "to_row", "to_col")
    best = j.where((falls & (F.col("steps") == 0)) | flat).groupBy("raster_id", "row", "col").agg(F.min(rank).alias("t"))
    return levels.select("raster_id", "row", "col").join(network.shuffled(best), ["raster_id", "row", "col"], "left").select("raster_id", "row", "col", "t.to_row", "t.to_col")


def accumulation(flow: DataFrame, width: int = 1 << 20) -> DataFrame:
    """``(raster_id, row, col, n_cells)``: cells that drain through each, itself included."""
    key = lambda r, c: F.struct(F.col("raster_id").alias("g"), F.col(r).alias("r"), F.col(c).alias("c"))
    edges = flow.select(key("row", "col").alias("comid"), F.when(F.col("to_row").isNotNull(), key("to_row", "to_col")).alias("nextdown"), F.lit(1.0).alias("area_km2"))
    t = network.upstream_totals(edges)
    return t.select("comid.g", "comid.r", "comid.c", "n_upstream").toDF("raster_id", "row", "col", "n_cells")


def wetness(cells: DataFrame, size: float, tile: int = TILE) -> DataFrame:
    """``(raster_id, row, col, n_cells, slope_deg, twi)`` after filling, directions and accumulation; square cells of ``size`` metres."""
    acc = accumulation(directions(filled(cells, tile)))
    slope = terrain.slope_gradient(cells, size, size)
    return acc.join(network.shuffled(slope), ["raster_id", "row", "col"]).withColumn("twi", terrain.wetness_index(F.col("n_cells"), F.col("slope_deg"), size))
