"""Standardised indices of monthly totals: precipitation (gamma) and climatic balance (log-logistic)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions import special
from tarnflow.operators import periods

FLOOR, CEIL = 0.001, 0.999  #: limits of probabilities before they are standardised
MIN_WINDOWS = 5


def monthly_totals(daily: DataFrame, min_fraction: float = 1.0) -> DataFrame:
    """``(basin_id, month, total)`` of every month of the span; null where a month is not complete."""
    report = periods.completeness(daily, "month", min_fraction)
    sums = daily.dropDuplicates(["basin_id", "d"]).groupBy("basin_id", periods.label(F.col("d"), "month").alias("period")).agg(F.sum("q").alias("t"))
    return report.join(sums, ["basin_id", "period"], "left").select("basin_id", F.col("period").alias("month"), F.when(F.col("is_complete"), F.col("t")).alias("total"))


def rolling(monthly: DataFrame, months: int) -> DataFrame:
    """``(basin_id, month, total, rolled)``: sums over ``months`` months that all have a total."""
    w = Window.partitionBy("basin_id").orderBy("month").rowsBetween(1 - months, 0)
    return monthly.withColumn("rolled", F.when(F.count("total").over(w) == months, F.sum("total").over(w)))


def gringorten(rolled: DataFrame) -> DataFrame:
    """``(basin_id, month, p)``: plotting positions within each calendar month."""
    x = rolled.where("rolled IS NOT NULL").withColumn("m", F.substring("month", 6, 2))
    w = Window.partitionBy("basin_id", "m")
    return x.select("basin_id", "month", ((F.row_number().over(w.orderBy("rolled", "month")) - 0.44) / (F.count("*").over(w) + 0.12)).alias("p"))


def _positions(x: np.ndarray) -> np.ndarray:
    return (np.argsort(np.argsort(x, kind="stable"), kind="stable") + 1 - 0.44) / (len(x) + 0.12)


def probabilities(x: np.ndarray, kind: str) -> np.ndarray:
    """Of values of one calendar month; plotting positions where a distribution cannot be fitted."""
    if kind == "gamma":
        above = x[x > 0]
        if len(above) < 4 or np.allclose(above, above[0]):
            return _positions(x)
        zero = float((x <= 0).mean())
        shape, scale = special.gamma_fit(above)
        return zero + (1 - zero) * np.array([special.gamma_cdf(v / scale, shape) for v in x])
    if np.allclose(x, x[0]):
        return _positions(x)
    y = np.log(x if x.min() > 0 else x - x.min() + 1)
    m, s = special.logistic_mle(y)
    return 1 / (1 + np.exp(-(y - m) / s))


def standardise(monthly: DataFrame, months: int, kind: str) -> DataFrame:
    """``(basin_id, month, index)``: each calendar month by itself, with at least five windows; others null."""
    x = rolling(monthly, months).withColumn("m", F.substring("month", 6, 2))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("month")
        out = pd.Series(np.nan, frame.index)
        there = frame["rolled"].notna()
        if there.sum() >= MIN_WINDOWS:
            p = probabilities(frame.loc[there, "rolled"].to_numpy(float), kind)
            out[there] = special.normal_ppf(np.clip(p, FLOOR, CEIL))
        return frame[["basin_id", "month"]].assign(index=out)

    key = dict(monthly.dtypes)["basin_id"]
    return x.groupBy("basin_id", "m").applyInPandas(run, f"basin_id {key}, month string, index double").withColumn("index", F.nanvl("index", F.lit(None).cast("double")))


def spi(precipitation: DataFrame, months: int = 3) -> DataFrame:
    return standardise(monthly_totals(precipitation), months, "gamma")


def spei(precipitation: DataFrame, pet: DataFrame, months: int = 3) -> DataFrame:
    """Of the balance ``p - pet``; a day without either has none."""
    both = precipitation.alias("a").join(pet.alias("b"), ["basin_id", "d"]).select("basin_id", "d", (F.col("a.q") - F.col("b.q")).alias("q"))
    return standardise(monthly_totals(both), months, "loglogistic")
