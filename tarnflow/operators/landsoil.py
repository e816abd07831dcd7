"""Land cover, soil and curve numbers: rasters are tables of cells, overlays are joins with small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Curve numbers of the land-cover classes for soil groups A to D.
CURVE_NUMBERS = {
    11: (100, 100, 100, 100), 12: (100, 100, 100, 100), 21: (49, 69, 79, 84), 22: (61, 75, 83, 87), 23: (72, 82, 88, 91), 24: (89, 92, 94, 95), 31: (77, 86, 91, 94), 41: (36, 60, 73, 79),
    42: (36, 60, 73, 79), 43: (36, 60, 73, 79), 52: (35, 56, 70, 77), 71: (49, 69, 79, 84), 81: (39, 61, 74, 80), 82: (67, 78, 85, 89), 90: (80, 87, 93, 95), 95: (80, 87, 93, 95),
}
#: Classes of two other land-cover products in terms of the classes above.
REMAP = {
    "worldcover": {10: 42, 20: 52, 30: 71, 40: 82, 50: 24, 60: 31, 70: 12, 80: 11, 90: 95, 95: 90, 100: 52},
    "dynamic_world": {0: 11, 1: 42, 2: 71, 3: 95, 4: 82, 5: 52, 6: 24, 7: 31, 8: 12},
}
GROUPS = {"A": 1, "B": 2, "C": 3, "D": 4}
KW_TO_SI = 0.1317


def curve_number_table(spark: SparkSession) -> DataFrame:
    """``(class, group, cn)``: 64 rows."""
    rows = [(c, g, v) for c, vs in CURVE_NUMBERS.items() for g, v in enumerate(vs, 1)]
    return spark.createDataFrame(rows, "class int, group int, cn int")


def overlay(cells: DataFrame) -> DataFrame:
    """Add ``cn`` to cells ``(..., class, group)``; null where either is missing or unknown. The table has 64 rows."""
    return cells.join(F.broadcast(curve_number_table(cells.sparkSession)), ["class", "group"], "left")


def texture_group(sand: Column, silt: Column, clay: Column, ksat: Column | None = None) -> Column:
    """Soil group 1 to 4 from texture, refined by conductivity where it is given."""
    b = ((sand >= 50) & (sand <= 70) & (clay < 20)) | ((silt > 50) & (clay < 27))
    base = F.when(b, 2).when((sand > 70) & (clay < 10), 1).when((clay >= 20) & (clay < 40), 3).otherwise(4)
    if ksat is None:
        return base
    return F.when(ksat > 15, 1).when((ksat > 5) & (base > 2), 2).when((ksat > 1.5) & (ksat <= 5) & (base > 3), 3).otherwise(base)


def drainage_groups(hydgrp: Column) -> Column:
    """``struct(drained, undrained, is_dual)`` of a group such as ``C`` or ``B/D``; nulls where it is not known."""
    parts = F.filter(F.transform(F.split(F.upper(hydgrp), "/"), lambda s: F.trim(s)), lambda s: s != "")
    code = lambda s: sum((F.when(s == k, v).otherwise(0) for k, v in GROUPS.items()), F.lit(0))
    a, z = code(F.try_element_at(parts, F.lit(1))), code(F.try_element_at(parts, F.lit(-1)))
    ok = (F.size(parts) > 0) & (a > 0) & (z > 0)
    return F.struct(F.when(ok, a).alias("drained"), F.when(ok, z).alias("undrained"), F.coalesce(F.contains(hydgrp, F.lit("/")), F.lit(False)).alias("is_dual"))


def component_rows(component: DataFrame, horizon: DataFrame) -> DataFrame:
    """Components with their surface horizon, if they have one: a left join on the key and a depth of 0."""
    return component.join(horizon.where("hzdept_r = 0"), "cokey", "left")


def summarize_components(rows: DataFrame) -> DataFrame:
    """One row for each map unit of ``(mukey, seq, comppct, hydgrp, kw, sand, silt, clay)``.

    Means are weighted by percentage over components that have a value; the group is that of the largest component that
    has one, the first of equals.
    """
    w = F.when(F.col("comppct") > 0, F.col("comppct"))
    mean = lambda c: F.try_divide(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w)))
    group = F.nullif(F.trim("hydgrp"), F.lit(""))
    dominant = F.min(F.when(group.isNotNull(), F.struct((-F.coalesce("comppct", F.lit(0.0))).alias("k"), "seq", group.alias("hydgrp"))))["hydgrp"]
    return rows.groupBy("mukey").agg(*(mean(c).alias(c) for c in ("kw", "sand", "silt", "clay")), dominant.alias("hydgrp"))


def spread(cells: DataFrame, units: DataFrame) -> DataFrame:
    """Properties of the map unit of each cell ``(..., mukey)``."""
    return cells.join(units.withColumn("kw_si", F.col("kw") * KW_TO_SI).withColumn("g", drainage_groups(F.col("hydgrp"))), "mukey", "left")


def zones(cn: Column) -> list[Column]:
    """Shares of cells in percent: below 70, 70 to 85, above 85."""
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return [share(cn < 70).alias("low_pct"), share((cn >= 70) & (cn <= 85)).alias("medium_pct"), share(cn > 85).alias("high_pct")]


def curve_number_stats(cells: DataFrame) -> DataFrame:
    """Statistics of ``cn`` for each ``raster_id``: over cells inside the basin, or over all if none is inside."""
    has = cells.where("inside AND cn IS NOT NULL").groupBy("raster_id").agg(F.lit(1).alias("_in"))
    x = cells.where("cn IS NOT NULL").join(has, "raster_id", "left").where("inside OR _in IS NULL")
    p = F.percentile("cn", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    a = x.groupBy("raster_id").agg(
        F.avg("cn").alias("cn_mean"), F.min("cn").cast("double").alias("cn_min"), F.max("cn").cast("double").alias("cn_max"), F.stddev_pop("cn").alias("cn_std"), p.alias("p"),
        *zones(F.col("cn")), F.when(F.max("_in").isNull(), "raster_extent").otherwise("basin_polygon").alias("stats_basis"),
    )
    return a.select("raster_id", "cn_mean", F.col("p")[2].alias("cn_median"), "cn_min", "cn_max", "cn_std", F.col("p")[0].alias("cn_p10"), F.col("p")[1].alias("cn_p25"), F.col("p")[3].alias("cn_p75"), F.col("p")[4].alias("cn_p90"), "low_pct", "medium_pct", "high_pct", "stats_basis")


def built_grid(cells: DataFrame) -> DataFrame:
    """Cells ``(raster_id, ..., class, hydgrp, sand, silt, clay)`` with ``group``, ``undrained``, ``cn`` and ``cn_undrained``.

    A raster that has recorded groups uses these alone, so a cell without one has none; a raster without any has its
    groups inferred from texture, drained and undrained alike.  ``method`` says which.
    """
    recorded = drainage_groups(F.col("hydgrp"))
    x = cells.withColumn("_g", recorded)
    has = x.where("_g.drained IS NOT NULL").groupBy("raster_id").agg(F.lit(True).alias("_recorded"))
    x = x.join(has, "raster_id", "left").withColumn("method", F.when(F.col("_recorded"), "recorded").otherwise("texture_thresholds"))
    inferred = F.when(F.col("sand").isNotNull() & F.col("silt").isNotNull() & F.col("clay").isNotNull(), texture_group(F.col("sand"), F.col("silt"), F.col("clay")))
    x = x.withColumn("group", F.when(F.col("_recorded"), F.col("_g.drained")).otherwise(inferred)).withColumn("undrained", F.when(F.col("_recorded"), F.col("_g.undrained")).otherwise(inferred)).drop("_g", "_recorded")
    wet = F.broadcast(curve_number_table(cells.sparkSession)).select("class", F.col("group").alias("undrained"), F.col("cn").alias("cn_undrained"))
    return overlay(x).join(wet, ["class", "undrained"], "left")


def soil_record(built: DataFrame, nodata: int = 127) -> DataFrame:
    """Where each raster's soil groups come from: method, whether inferred, the share of land-cover cells without a group,
    cells and mean curve numbers inside the basin, and flags."""
    valid = F.col("class").isNotNull() & (F.col("class") != nodata)
    inside = F.col("inside") & F.col("cn").isNotNull()
    a = built.groupBy("raster_id").agg(
        F.max("method").alias("method"), F.avg(F.when(valid, F.when(F.col("group").isNull(), 1.0).otherwise(0.0))).alias("missing"), F.count(F.when(inside, 1)).alias("cells_basin"),
        F.avg(F.when(inside, F.col("cn"))).alias("cn_mean_basin"), F.avg(F.when(F.col("inside"), F.col("cn_undrained"))).alias("cn_mean_undrained"),
    )
    inferred = F.col("method") == "texture_thresholds"
    flags = F.array_compact(F.array(F.when(F.col("cells_basin") == 0, F.lit("basin_cn_stats_empty")), F.when(inferred, F.lit("hsg_inferred_from_texture"))))
    return a.select("raster_id", "method", inferred.alias("inferred"), F.when(~inferred, F.col("missing")).alias("missing_fraction"), "cells_basin", "cn_mean_basin", "cn_mean_undrained", F.array_join(flags, ",").alias("flags"))


def class_fractions(cells: DataFrame, nodata: int = 127) -> DataFrame:
    """``(raster_id, class, n_cells, fraction)`` over valid cells; class 11 is open water."""
    n = cells.where((F.col("class") != nodata) & F.col("class").isNotNull()).groupBy("raster_id", "class").agg(F.count("*").alias("n_cells"))
    return n.withColumn("fraction", F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy("raster_id")))


def remapped(cells: DataFrame, product: str) -> DataFrame:
    """Replace ``class`` of another product; unknown codes become null, an unknown product counts as worldcover."""
    pairs = REMAP.get(product, REMAP["worldcover"])
    table = F.broadcast(cells.sparkSession.createDataFrame(list(pairs.items()), "_code int, _class int"))
    return cells.join(table, F.round("class").cast("int") == F.col("_code"), "left").withColumn("class", F.col("_class")).drop("_code", "_class")


def unit_shares(cells: DataFrame) -> DataFrame:
    """For each raster of cells ``(raster_id, mukey, drained, is_dual)``: coverage, dual share, shares of groups in percent."""
    has = F.col("drained").isNotNull()
    share = lambda c: F.avg(F.when(has, F.when(c, 100.0).otherwise(0.0)))
    return cells.groupBy("raster_id").agg(F.count_distinct("mukey").alias("n_units"), F.avg(F.when(has, 1.0).otherwise(0.0)).alias("coverage"), *(share(F.col("drained") == v).alias(f"group_{k.lower()}_pct") for k, v in GROUPS.items()), share(F.col("is_dual")).alias("dual_pct"))


def parse_table(payload: Column) -> Column:
    """Records, as maps, of a service's answer ``{"Table": [[names], [values], ...]}``."""
    rows = F.from_json(payload, "Table array<array<string>>")["Table"]
    return F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.map_from_arrays(rows[0], r))
