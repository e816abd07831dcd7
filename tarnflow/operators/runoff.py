"""Event runoff and soil loss: column expressions; inputs outside the domain of a formula give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cover factors by name, in order of matching, and the default.
COVER = (
    ("water", 0.0), ("snow", 0.0), ("ice", 0.0), ("urban", 0.0), ("built", 0.0), ("developed", 0.0), ("forest", 0.003), ("tree", 0.003), ("wetland", 0.003),
    ("shrubland", 0.014), ("shrub", 0.014), ("grassland", 0.01), ("grass", 0.01), ("savanna", 0.04), ("herbaceous", 0.04), ("cropland", 0.24), ("crop", 0.24),
    ("agriculture", 0.24), ("bare", 0.45), ("barren", 0.45), ("sparse", 0.30), ("moss", 0.05), ("lichen", 0.05),
)
DEFAULT_COVER = 0.1
US_TO_SI = 0.1317


def severity(loss: Column) -> Column:
    """Band of a yearly soil loss in tonnes a hectare: below 2, 10, 50 and above."""
    return F.when(loss < 2, "low").when(loss < 10, "moderate").when(loss < 50, "high").when(loss >= 50, "severe")


def storage(cn: Column) -> Column:
    """Retention S in mm."""
    return F.when((cn > 0) & (cn <= 100), 25400.0 / cn - 254.0)


def curve_number_runoff(rain: Column, cn: Column) -> Column:
    """Runoff depth in mm; none up to the initial abstraction of 0.2 S."""
    s = storage(cn)
    return F.when(s.isNull() | rain.isNull(), None).when(rain <= 0.2 * s, 0.0).otherwise(F.power(rain - 0.2 * s, F.lit(2)) / (rain + 0.8 * s))


def kirpich(length_km: Column, slope: Column) -> Column:
    """Time of concentration in hours."""
    return F.when((length_km > 0) & (slope > 0), 0.0663 * F.power(length_km, F.lit(0.77)) * F.power(slope, F.lit(-0.385)))


def hydrographs(basins: DataFrame, dt_hours: float | None = None) -> DataFrame:
    """``(basin_id, step, time_hr, discharge_cms)`` of triangular hydrographs of ``(basin_id, area_km2, tc_hr, runoff_mm)``.

    Evenly spaced from 0 to the base time; the step is a tenth of the time to the peak unless given.
    """
    tc = F.col("tc_hr")
    tp = 0.6 * tc + 0.133 * tc / 2
    x = basins.where("area_km2 > 0 AND tc_hr > 0").select("basin_id", tp.alias("tp"), (2.67 * tp).alias("tb"), (0.208 * F.col("area_km2") * F.col("runoff_mm") / tp).alias("qp"))
    dt = F.lit(dt_hours) if dt_hours else F.col("tp") / 10
    x = x.withColumn("n", F.greatest(F.ceil(F.col("tb") / dt).cast("int") + 1, F.lit(3)))
    x = x.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("tb") * F.col("step") / (F.col("n") - 1)
    q = F.when(t <= F.col("tp"), F.col("qp") * t / F.col("tp")).otherwise(F.greatest(F.col("qp") * (F.col("tb") - t) / (F.col("tb") - F.col("tp")), F.lit(0.0)))
    return x.select("basin_id", "step", F.round(t, 4).alias("time_hr"), F.round(q, 4).alias("discharge_cms"))


def rusle(r: Column, k: Column, ls: Column, c: Column, p: Column | float = 1.0) -> Column:
    return r * k * ls * c * p


def fournier(monthly: Column) -> Column:
    """Modified Fournier index of an array of twelve monthly totals."""
    total = F.aggregate(monthly, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(monthly, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(F.size(monthly) != 12, None).when(total <= 0, 0.0).otherwise(squares / total)


def r_factor(monthly: Column) -> Column:
    f = fournier(monthly)
    return F.when(f <= 55, 0.07397 * F.power(f, F.lit(1.847))).otherwise(95.77 - 6.081 * f + 0.4770 * f * f)


def k_factor(sand: Column, silt: Column, clay: Column, carbon: Column | None = None) -> Column:
    c = F.lit(1.0) if carbon is None else carbon
    rest = 1 - sand / 100
    coarse = 0.2 + 0.3 * F.exp(-0.0256 * sand * (1 - silt / 100))
    fine = F.when(clay + silt > 0, F.power(silt / (clay + silt), F.lit(0.3))).otherwise(0.0)
    organic = 1 - 0.25 * c / (c + F.exp(3.72 - 2.95 * c))
    high_sand = 1 - 0.7 * rest / (rest + F.exp(-5.51 + 22.9 * rest))
    return coarse * fine * organic * high_sand * US_TO_SI


def ls_factor(slope_pct: Column, length_m: Column) -> Column:
    s = F.sin(F.atan(slope_pct / 100))
    m = F.when(slope_pct >= 5, 0.5).when(slope_pct >= 3, 0.4).when(slope_pct >= 1, 0.3).otherwise(0.2)
    return F.power(length_m / 22.13, m) * (65.41 * s * s + 4.56 * s + 0.065)


def c_factor(cover: Column) -> Column:
    """By name: the whole name, else the first listed name inside it, else the default."""
    key = F.lower(F.trim(cover))
    out = F.when(F.lit(False), 0.0)
    for name, value in COVER:
        out = out.when(key == name, value)
    for name, value in COVER:
        out = out.when(F.contains(key, F.lit(name)), value)
    return out.otherwise(DEFAULT_COVER)


def design_storm(area_km2: Column, tc_hr: Column, cn: Column, rain_mm: Column) -> dict[str, Column]:
    """Runoff, peak and timing of a design storm."""
    ok = (area_km2 > 0) & (tc_hr > 0)
    q = curve_number_runoff(rain_mm, cn)
    tp = F.when(ok, 0.6 * tc_hr + 0.133 * tc_hr / 2)
    return {"runoff_mm": q, "runoff_coefficient": F.when(rain_mm > 0, q / rain_mm).otherwise(0.0), "time_to_peak_hr": tp, "base_time_hr": 2.67 * tp, "peak_discharge_cms": 0.208 * area_km2 * q / tp, "runoff_volume_m3": q / 1000 * area_km2 * 1e6}
