"""Flow statistics, flow duration, extremes, timing and water balance of daily series ``(basin_id, d, q)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators import periods, series

#: Exceedance points of the flow-duration curve, in percent.
EXCEEDANCE = (5, 10, 25, 50, 75, 90, 95)


def flow_stats(daily: DataFrame, min_days: int = 365) -> DataFrame:
    """Mean, population deviation, 5th, 50th and 95th percentile; nulls below ``min_days`` valid days."""
    p = F.percentile("q", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    a = daily.groupBy("basin_id").agg(F.count("q").alias("n_days"), F.avg("q").alias("m"), F.stddev_pop("q").alias("s"), p.alias("p"))
    ok = F.col("n_days") >= min_days
    return a.select("basin_id", "n_days", *(F.when(ok, c).alias(n) for n, c in (("q_mean", F.col("m")), ("q_std", F.col("s")), ("q5", F.col("p")[0]), ("q_median", F.col("p")[1]), ("q95", F.col("p")[2]))))


def event_stats(daily: DataFrame) -> DataFrame:
    """Frequency (days a year) and mean length (days) of high and low flow, share of days without flow, variability.

    Thresholds and denominators use valid days; runs are on the calendar, so a gap ends a run.
    """
    t = daily.groupBy("basin_id").agg(F.count("q").alias("n"), F.avg("q").alias("mean"), F.percentile("q", F.lit(0.5)).alias("median"), F.stddev_pop("q").alias("std"), F.count(F.when(F.col("q") <= 0, 1)).alias("n_zero"))
    marked = daily.where("q IS NOT NULL").join(t.where("mean > 0"), "basin_id")
    sides = marked.select("basin_id", "d", F.explode(F.array(F.struct(F.lit("high").alias("kind"), (F.col("q") > 9 * F.col("median")).alias("on")), F.struct(F.lit("low").alias("kind"), (F.col("q") <= 0.2 * F.col("mean")).alias("on")))).alias("e"))
    on = sides.where("e.on").select(F.struct("basin_id", "e.kind").alias("basin_id"), "d")
    runs = series.islands(on, F.lit(True)).select("basin_id.basin_id", "basin_id.kind", "n_days")
    r = runs.groupBy("basin_id").agg(*(f(F.when(F.col("kind") == k, F.col("n_days"))).alias(f"{k}_{n}") for k in ("high", "low") for n, f in (("sum", F.sum), ("avg", F.avg))))
    j = t.join(r, "basin_id", "left")
    ok = F.col("mean") > 0
    freq = lambda k: F.coalesce(f"{k}_sum", F.lit(0)) / F.col("n") * 365.25
    return j.select("basin_id", *(F.when(ok, c).alias(n) for n, c in (("high_q_freq", freq("high")), ("high_q_dur", F.col("high_avg")), ("low_q_freq", freq("low")), ("low_q_dur", F.col("low_avg")), ("zero_q_freq", F.col("n_zero") / F.col("n")), ("flow_variability", F.col("std") / F.col("mean")))))


def half_flow_dates(daily: DataFrame, min_days: int = 300) -> DataFrame:
    """``(basin_id, water_year, hfd)``: day of the water year by which half of its flow has passed."""
    d = daily.where("q IS NOT NULL").withColumn("water_year", periods.label(F.col("d"), "water"))
    w = Window.partitionBy("basin_id", "water_year")
    so_far = w.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    x = d.select("basin_id", "water_year", "d", F.sum("q").over(so_far).alias("c"), F.sum("q").over(w).alias("t"), F.count("*").over(w).alias("n"))
    x = x.where((F.col("n") >= min_days) & (F.col("t") > 0) & (F.col("c") >= 0.5 * F.col("t")))
    return x.groupBy("basin_id", "water_year").agg((F.datediff(F.min("d"), periods.first_day(F.col("water_year"), "water")) + 1).alias("hfd"))


def timing_stats(daily: DataFrame, min_days: int = 300) -> DataFrame:
    h = half_flow_dates(daily, min_days).groupBy("basin_id").agg(F.count("*").alias("n_years"), F.avg("hfd").alias("m"), F.stddev_pop("hfd").alias("s"))
    ok = F.col("n_years") >= 2
    return h.select("basin_id", "n_years", F.when(ok, F.col("m")).alias("hfd_mean"), F.when(ok, F.col("s")).alias("half_flow_date_std"))


def fdc_slopes(daily: DataFrame, min_days: int = 100) -> DataFrame:
    """Slope of the middle of the flow-duration curve: linear over the mean, and in logarithms of positive flow."""
    pos = F.when(F.col("q") > 0, F.col("q"))
    a = daily.groupBy("basin_id").agg(F.count("q").alias("n"), F.avg("q").alias("m"), F.percentile("q", F.array(F.lit(0.33), F.lit(0.66))).alias("p"), F.count(pos).alias("n_pos"), F.percentile(pos, F.array(F.lit(0.34), F.lit(0.67))).alias("l"))
    enough = F.col("n") >= min_days
    return a.select(
        "basin_id",
        F.when(enough & (F.col("m") > 0), (F.col("p")[1] - F.col("p")[0]) / (F.col("m") * 0.33)).alias("slope_fdc"),
        F.when(enough & (F.col("n_pos") >= min_days), (F.ln(F.col("l")[1]) - F.ln(F.col("l")[0])) / (0.66 - 0.33)).alias("slope_fdc_sawicz2011"),
    )


def fdc_points(daily: DataFrame, points: tuple[int, ...] = EXCEEDANCE) -> DataFrame:
    """``(basin_id, exceedance_pct, flow)``; negative flow is left out; at least two values."""
    q = F.when(F.col("q") >= 0, F.col("q"))
    a = daily.groupBy("basin_id").agg(F.count(q).alias("n"), F.percentile(q, F.array(*(F.lit(1 - p / 100) for p in points))).alias("p")).where("n >= 2")
    pairs = F.arrays_zip(F.array(*(F.lit(p) for p in points)).alias("k"), F.col("p").alias("v"))
    return a.select("basin_id", F.explode(pairs).alias("z")).select("basin_id", F.col("z.k").alias("exceedance_pct"), F.round("z.v", 6).alias("flow"))


def fdc_curve(daily: DataFrame) -> DataFrame:
    """Every value with its Weibull exceedance; ranked within each basin."""
    w = Window.partitionBy("basin_id")
    return daily.where("q >= 0").select("basin_id", "d", "q", (F.row_number().over(w.orderBy(F.desc("q"), "d")) / (F.count("*").over(w) + 1)).alias("exceedance"))


def trailing_mean(daily: DataFrame, days: int = 7) -> DataFrame:
    """Mean of the last ``days`` calendar days; null where one of them has no value."""
    w = Window.partitionBy("basin_id").orderBy("d").rowsBetween(1 - days, 0)
    full = F.count("q").over(w) == days
    return series.dense(daily).withColumn("mean", F.when(full, F.avg("q").over(w)))


def annual_minima(daily: DataFrame, days: int = 7, freq: str = "climatic", min_fraction: float = 0.95, min_windows: float = 0.95, custom: int | None = None) -> DataFrame:
    """``(basin_id, period, min_q)`` of years complete in days and in windows."""
    rolled = trailing_mean(daily, days).withColumn("period", periods.label(F.col("d"), freq, custom))
    report = periods.completeness(daily, freq, min_fraction, custom)
    got = rolled.groupBy("basin_id", "period").agg(F.count("mean").alias("n"), F.min("mean").alias("min_q"))
    return report.where("is_complete").join(got, ["basin_id", "period"]).where(F.col("n") / F.col("expected_days") >= min_windows - 1e-12).select("basin_id", "period", "min_q")


def annual_maxima(daily: DataFrame, freq: str = "water", min_fraction: float = 0.95, custom: int | None = None) -> DataFrame:
    report = periods.completeness(daily, freq, min_fraction, custom)
    return periods.complete_only(daily, report, freq, custom).groupBy("basin_id", "period").agg(F.max("q").alias("max_q"))


def complete_water_years(paired: DataFrame, min_fraction: float = 0.95) -> DataFrame:
    """``(basin_id, period, n, fraction, is_complete)`` of the water years of a paired series."""
    r = periods.completeness(paired.select("basin_id", "d", "q"), "water", min_fraction)
    return r.select("basin_id", "period", F.col("observed_days").alias("n"), F.round("fraction", 4).alias("fraction"), "is_complete")


def water_balance(paired: DataFrame, min_days: int = 365, low: float = 1e-3, high: float = 3.0, min_fraction: float = 0.95) -> DataFrame:
    """Runoff ratio over complete water years, or the reason why there is none."""
    years = complete_water_years(paired, min_fraction)
    used = periods.complete_only(paired, years, "water")
    n = paired.groupBy("basin_id").agg(F.count("*").alias("overlap"))
    a = used.groupBy("basin_id").agg(F.avg("q").alias("q_mean"), F.avg("p").alias("p_mean"), F.count_distinct("period").alias("n_years"))
    j = n.join(a, "basin_id", "left").withColumn("rr", F.when(F.col("p_mean") != 0, F.col("q_mean") / F.col("p_mean")))
    reason = F.when(F.col("overlap") < min_days, "overlap").when(F.col("n_years").isNull(), "no_complete_water_year").when(F.col("rr").isNull(), "not_finite").when((F.col("rr") < low) | (F.col("rr") > high), "outside_range")
    return j.select("basin_id", "overlap", F.coalesce("n_years", F.lit(0)).alias("n_years"), F.when(reason.isNull(), F.col("rr")).alias("runoff_ratio"), reason.alias("reason"))


def elasticity(paired: DataFrame, min_years: int = 3, min_fraction: float = 0.95) -> DataFrame:
    """Median over complete water years of the relative change of flow for that of precipitation."""
    used = periods.complete_only(paired, complete_water_years(paired, min_fraction), "water")
    years = used.groupBy("basin_id", "period").agg(F.avg("q").alias("mq"), F.avg("p").alias("mp"))
    totals = used.groupBy("basin_id").agg(F.avg("q").alias("tq"), F.avg("p").alias("tp"))
    e = F.try_divide(F.try_divide(F.col("mq") - F.col("tq"), F.col("tq")), F.try_divide(F.col("mp") - F.col("tp"), F.col("tp")))
    x = years.join(totals, "basin_id").withColumn("e", periods.finite(e)).groupBy("basin_id").agg(F.count("*").alias("n_years"), F.median("e").alias("m"))
    return x.select("basin_id", "n_years", F.when(F.col("n_years") >= min_years, F.col("m")).alias("stream_elas"))


def extract(daily: DataFrame, precipitation: DataFrame | None = None, unit: str | None = None, min_fraction: float = 0.95) -> DataFrame:
    """All signatures of every basin, and where they come from; what cannot be computed is null.

    Both series are written once and read by all parts.  Precipitation that its gate refuses gives neither runoff ratio nor
    elasticity, and its reason; elasticity needs a runoff ratio.
    """
    from tarnflow.operators.baseflow import baseflow_index, warmup_biased
    from tarnflow.operators.network import saved

    daily = saved(daily.select("basin_id", "d", F.col("q").cast("double").alias("q")))
    out = daily.groupBy("basin_id").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    for part in (flow_stats(daily), event_stats(daily), timing_stats(daily).drop("n_years"), fdc_slopes(daily), baseflow_index(daily)):
        out = out.join(part, "basin_id", "left")
    out = out.withColumn("baseflow_warmup_biased", warmup_biased(F.col("n_days")))
    if precipitation is not None:
        p = saved(precipitation.select("basin_id", "d", F.col("p").cast("double").alias("p")))
        gate = series.precipitation_problem(p, unit).select("basin_id", F.col("reason").alias("gate"))
        paired = saved(series.align(daily, p.join(gate.where("gate IS NULL"), "basin_id", "left_semi")))
        balance = water_balance(paired, min_fraction=min_fraction).select("basin_id", "runoff_ratio", "n_years", "reason")
        j = out.join(gate, "basin_id", "left").join(balance, "basin_id", "left").join(elasticity(paired, min_fraction=min_fraction).select("basin_id", "stream_elas"), "basin_id", "left")
        why = F.coalesce(F.concat(F.lit("precipitation_"), F.col("gate")), "reason", F.when(F.col("runoff_ratio").isNull(), "overlap"))
        out = j.withColumn("stream_elas", F.when(F.col("runoff_ratio").isNotNull(), F.col("stream_elas"))).withColumn("water_balance_reason", why).withColumnRenamed("n_years", "water_balance_years").drop("gate", "reason")
    return out
