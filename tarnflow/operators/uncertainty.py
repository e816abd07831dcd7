"""Confidence intervals by resampling whole water years, and exposure to qualified days."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import periods

#: Resamples, level, least number of complete years, share of days that completes a year.
RESAMPLES, LEVEL, MIN_YEARS, COMPLETE = 2000, 0.9, 10, 0.95


def draws(resamples: int, n: int) -> np.ndarray:
    """Which of ``n`` things each draw takes, a row a resample: by number and place alone, as ``drawn_years`` has it."""
    x = np.arange(resamples, dtype=np.int64)[:, None] * 7919 + np.arange(n, dtype=np.int64)[None, :] * 104729 + 12345
    for _ in range(2):
        x = x * 48271 % 2147483647
    return x // 65536 % n


def _drawn_statistics(q: np.ndarray, year: np.ndarray, n_years: int, times: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each resample (row of ``times``, how often it takes each year) of days ``q``, sorted by value.

    Sums come from sums of years; a quantile is where the running count of days, each as often as its year, passes it.
    """
    sums = lambda v: times @ np.bincount(year, v, n_years)
    n = sums(np.ones(len(q)))
    mean = sums(q) / n
    spread = np.sqrt(np.maximum(sums((q - q.mean()) ** 2) / n - (mean - q.mean()) ** 2, 0))
    out = {"q_mean": mean, "q_median": 0.5, "q5": 0.05, "q95": 0.95, "flow_variability": np.where(mean > 0, spread / np.where(mean > 0, mean, 1), np.nan)}
    running = np.cumsum(times[:, year], axis=1)
    for name in ("q_median", "q5", "q95"):
        h = (n - 1) * out[name]
        low = np.floor(h)
        below, above = (np.array([np.searchsorted(r, k, side="right") for r, k in zip(running, i)]) for i in (low, np.minimum(low + 1, n - 1)))
        out[name] = q[below] + (h - low) * (q[above] - q[below])
    return out


AT_ONCE = 1 << 22  #: days of resamples in memory at once


def flow_intervals(daily: DataFrame, resamples: int = RESAMPLES, level: float = LEVEL, min_years: int = MIN_YEARS) -> DataFrame:
    """``(basin_id, statistic, value, ci_low, ci_high, n_years, reason)``; refused below ``min_years`` complete years.

    Whole water years are drawn, partial ones too, by the fixed rule; no resample is put together, its years are counted.
    """
    x = daily.where("q IS NOT NULL").withColumn("wy", periods.label(F.col("d"), "water"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["q", "d"])
        q, wy = frame["q"].to_numpy(float), frame["wy"].to_numpy()
        years, year, n = np.unique(wy, return_inverse=True, return_counts=True)
        whole = int(sum(k >= COMPLETE * (366 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 365) - 1e-9 for y, k in zip(years, n)))
        point = {k: v[0] for k, v in _drawn_statistics(q, year, len(years), np.ones((1, len(years)), np.int64)).items()}
        lo = hi = dict.fromkeys(point, np.nan)
        if whole >= min_years:
            taken = draws(resamples, len(years))
            times = np.stack([np.bincount(t, minlength=len(years)) for t in taken])
            step = max(1, AT_ONCE // len(q))
            parts = [_drawn_statistics(q, year, len(years), times[a : a + step]) for a in range(0, resamples, step)]
            drawn = {k: np.concatenate([p[k] for p in parts]) for k in point}
            lo, hi = ({k: np.quantile(v[~np.isnan(v)], (1 + s * level) / 2) if (~np.isnan(v)).any() else np.nan for k, v in drawn.items()} for s in (-1, 1))
        return pd.DataFrame([{"basin_id": frame["basin_id"].iloc[0], "statistic": k, "value": v, "ci_low": lo[k], "ci_high": hi[k], "n_years": whole, "reason": None if whole >= min_years else "too_few_complete_years"} for k, v in point.items()])

    kind = dict(daily.dtypes)["basin_id"]
    return x.groupBy("basin_id").applyInPandas(run, f"basin_id {kind}, statistic string, value double, ci_low double, ci_high double, n_years long, reason string")


#: Fixed value: a relative change of precipitation below this makes a year's elasticity unstable.
NEAR_ZERO = 0.02


def yearly(daily: DataFrame, num: str, den: str) -> DataFrame:
    """``(basin_id, wy, n, a, b, whole)``: days and sums of each water year; ``whole`` if it has enough of its days."""
    y = daily.where(f"{num} IS NOT NULL AND {den} IS NOT NULL").groupBy("basin_id", periods.label(F.col("d"), "water").alias("wy")).agg(F.count("*").alias("n"), F.sum(num).alias("a"), F.sum(den).alias("b"))
    return y.withColumn("whole", F.col("n") / periods.period_days(F.col("wy"), "water") >= COMPLETE - 1e-12)


def drawn_years(years: DataFrame, resamples: int) -> DataFrame:
    """Each basin's years drawn as often as it has years, ``resamples`` times: ``(basin_id, rep, i, y)``.

    The year of a draw follows from its number and place alone, by a fixed linear rule, so a lost task draws the same again.
    """
    listed = years.groupBy("basin_id").agg(F.array_sort(F.collect_list(F.struct("wy", "n", "a", "b"))).alias("ys"))
    draws = listed.select("basin_id", "ys", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("rep")).select("basin_id", "rep", "ys", F.explode(F.sequence(F.lit(0), F.size("ys") - 1)).alias("i"))
    x = (F.col("rep").cast("long") * 7919 + F.col("i").cast("long") * 104729 + 12345) * 48271 % 2147483647
    x = x * 48271 % 2147483647
    return draws.select("basin_id", "rep", "i", F.element_at("ys", (F.floor(x / 65536) % F.size("ys") + 1).cast("int")).alias("y"))


def _with_refusal(point: DataFrame, reps: DataFrame, years: DataFrame, name: str, level: float, min_years: int) -> DataFrame:
    """One row a basin with the same columns whether or not there is an interval."""
    ends = reps.where("r IS NOT NULL").groupBy("basin_id").agg(F.percentile("r", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("p"), F.count("*").alias("n_valid"))
    groups = years.groupBy("basin_id").agg(F.count(F.when(F.col("whole"), 1)).alias("n_years"), F.count(F.when(~F.col("whole"), 1)).alias("n_partial"), F.sum("n").alias("n_days"))
    ok = F.col("n_years") >= min_years
    j = groups.join(point, "basin_id").join(ends, "basin_id", "left")
    return j.select("basin_id", F.lit(name).alias("statistic"), "value", F.when(ok, F.col("p")[0]).alias("ci_low"), F.when(ok, F.col("p")[1]).alias("ci_high"), "n_days", "n_years", "n_partial", F.when(ok, F.coalesce("n_valid", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_valid"), (~ok).alias("refused"), F.when(~ok, "too_few_complete_years").alias("reason"))


def ratio_interval(daily: DataFrame, num: str, den: str, name: str, resamples: int = RESAMPLES, level: float = LEVEL, min_years: int = MIN_YEARS) -> DataFrame:
    """Interval of ``sum(num) / sum(den)`` over drawn water years (baseflow index, runoff ratio); partial years are drawn too
    but do not count towards ``min_years``, below which it is refused."""
    years = yearly(daily, num, den)
    reps = drawn_years(years, resamples).groupBy("basin_id", "rep").agg(F.try_divide(F.sum("y.a"), F.sum("y.b")).alias("r"))
    point = years.groupBy("basin_id").agg(F.try_divide(F.sum("a"), F.sum("b")).alias("value"))
    return _with_refusal(point, reps, years, name, level, min_years)


def elasticity_interval(paired: DataFrame, resamples: int = RESAMPLES, level: float = LEVEL, min_years: int = MIN_YEARS) -> DataFrame:
    """Interval of the streamflow elasticity: of each drawn set of years the median over them of the relative change of flow
    for that of precipitation, from the means over all drawn days.  ``n_near_zero`` years have hardly a change of precipitation."""
    years = yearly(paired, "q", "p")
    change = lambda c, t: F.try_divide(F.col(c) - F.col(t), F.col(t))

    def median(rows: DataFrame, by: list[str]) -> DataFrame:
        t = rows.groupBy(*by).agg((F.sum("a") / F.sum("n")).alias("tq"), (F.sum("b") / F.sum("n")).alias("tp"))
        e = rows.withColumn("mq", F.col("a") / F.col("n")).withColumn("mp", F.col("b") / F.col("n")).join(t, by)
        return e.withColumn("dp", change("mp", "tp")).withColumn("e", periods.finite(F.try_divide(change("mq", "tq"), F.col("dp"))))

    reps = median(drawn_years(years, resamples).select("basin_id", "rep", "y.n", "y.a", "y.b"), ["basin_id", "rep"]).groupBy("basin_id", "rep").agg(F.median("e").alias("r"))
    one = median(years, ["basin_id"]).groupBy("basin_id").agg(F.median("e").alias("value"), F.count(F.when(F.abs("dp") < NEAR_ZERO, 1)).alias("near"))
    out = _with_refusal(one.select("basin_id", "value"), reps, years, "stream_elas", level, min_years)
    return out.join(one.select("basin_id", F.col("near").alias("n_near_zero")), "basin_id").withColumn("degraded", F.col("refused") | (F.col("n_near_zero") > 0))


def baseflow_interval(daily: DataFrame, **options) -> DataFrame:
    """Interval of the baseflow index: the filter runs once over the series, then water years are drawn."""
    from tarnflow.operators.baseflow import lyne_hollick

    flow = lyne_hollick(daily).where("baseflow IS NOT NULL AND q IS NOT NULL").withColumn("base", F.greatest(F.lit(0.0), F.least("baseflow", "q")))
    return ratio_interval(flow, "base", "q", "baseflow_index", **options)


def resampled_ratio(paired: DataFrame, num: str, den: str, resamples: int = RESAMPLES, level: float = LEVEL, min_years: int = MIN_YEARS) -> DataFrame:
    """``(basin_id, ratio, ci_low, ci_high, n_years, reason)`` of sums over drawn complete water years; refused below ``min_years``."""
    whole = yearly(paired, num, den).where("whole").select("basin_id", "wy")
    used = paired.withColumn("wy", periods.label(F.col("d"), "water")).join(whole, ["basin_id", "wy"], "left_semi").drop("wy")
    r = ratio_interval(used, num, den, "ratio", resamples, level, min_years)
    every = paired.select("basin_id").distinct().join(r, "basin_id", "left")
    return every.select("basin_id", F.col("value").alias("ratio"), "ci_low", "ci_high", F.coalesce("n_years", F.lit(0)).alias("n_years"), F.coalesce("reason", F.when(F.col("n_years").isNull(), "too_few_complete_years")).alias("reason"))


def exposure(daily: DataFrame) -> DataFrame:
    """Share of qualified days in the days that determine a signature.

    ``daily``: ``(basin_id, d, q, approval, qualifiers)`` with qualifiers separated by commas; ``e`` means estimated,
    approval ``P`` provisional.  Returns ``(basin_id, day_set, n_days, n_estimated, n_other, n_any, n_provisional)``.
    """
    x = daily.where("q IS NOT NULL")
    t = x.groupBy("basin_id").agg(F.avg("q").alias("mean"), F.percentile("q", F.array(*map(F.lit, (0.1, 0.33, 0.5, 0.66, 0.9)))).alias("p"))
    q, p = F.col("q"), F.col("p")
    sets = {
        "all_days": F.lit(True), "mid_range": (q >= p[1]) & (q <= p[3]), "low_tail": q <= p[0], "high_tail": q >= p[4],
        "low_flow_events": q <= 0.2 * F.col("mean"), "high_flow_events": q > 9 * p[2], "zero_days": q <= 0, "baseflow_days": q <= p[2],
    }
    tokens = F.filter(F.transform(F.split(F.coalesce("qualifiers", F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    y = x.join(t, "basin_id").select(
        "basin_id", F.array_contains(tokens, "e").alias("e"), (F.size(F.filter(tokens, lambda s: s != "e")) > 0).alias("o"), (F.size(tokens) > 0).alias("any"), (F.coalesce("approval", F.lit("")) == "P").alias("prov"),
        F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in sets.items())))).alias("day_set"),
    )
    count = lambda c: F.count(F.when(F.col(c), 1))
    return y.groupBy("basin_id", "day_set").agg(F.count("*").alias("n_days"), count("e").alias("n_estimated"), count("o").alias("n_other"), count("any").alias("n_any"), count("prov").alias("n_provisional"))
