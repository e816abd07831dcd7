"""Baseflow: recursive digital filter on gap-free segments, and smoothed minima."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators import series

#: Fixed values of the published filter: constant, passes, reflected days.
ALPHA, PASSES, REFLECT = 0.925, 3, 30


BLOCK = 64  #: days whose states are one product


def recursion(first: float, steps: np.ndarray, alpha: float) -> np.ndarray:
    """``f[0] = first``, ``f[t] = alpha f[t-1] + steps[t-1]``, a block of days at a time."""
    n = len(steps)
    powers = alpha ** np.arange(BLOCK + 1)
    weights = np.tril(powers[np.abs(np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK)))])
    blocks = np.zeros(-(-n // BLOCK) * BLOCK)
    blocks[:n] = steps
    own = blocks.reshape(-1, BLOCK) @ weights.T
    state, out = first, np.empty_like(own)
    for k, row in enumerate(own):
        out[k] = row + state * powers[1:]
        state = out[k, -1]
    return np.concatenate([[first], out.ravel()[:n]])


def filter_segment(q: np.ndarray, alpha: float = ALPHA, passes: int = PASSES, reflect: int = REFLECT) -> np.ndarray:
    """Baseflow of one segment without gaps; both ends are reflected, passes run forward and backward in turn, each from its first value.

    The quickflow recursion ``f[t] = alpha f[t-1] + (1 + alpha) / 2 (y[t] - y[t-1])`` keeps negative states;
    baseflow is ``y - f`` where ``f`` is positive, else ``y``.
    """
    y = np.concatenate([q[1 : reflect + 1][::-1], q, q[-reflect - 1 : -1][::-1]]).astype(float)
    for k in range(passes):
        y = y[::-1] if k % 2 else y
        f = recursion(y[0], (1 + alpha) / 2 * np.diff(y), alpha)
        y = np.where(f > 0, y - f, y)
        y = y[::-1] if k % 2 else y
    return np.maximum(y[reflect : reflect + len(q)], 0.0)


def lyne_hollick(daily: DataFrame, alpha: float = ALPHA, passes: int = PASSES, reflect: int = REFLECT) -> DataFrame:
    """``(basin_id, d, q, baseflow)``; null in gaps and in segments of up to ``reflect`` days. Negative flow counts as 0.

    One task holds one gap-free segment of one basin at a time.
    """
    if not 0 <= alpha < 1 or passes < 1:
        raise ValueError("alpha must be in [0, 1) and passes at least 1")
    w = Window.partitionBy("basin_id").orderBy("d")
    valid = daily.where("q IS NOT NULL").select("basin_id", "d", F.greatest("q", F.lit(0.0)).alias("q"))
    parts = valid.withColumn("segment", F.date_sub("d", F.row_number().over(w)))
    long = parts.withColumn("_n", F.count("*").over(Window.partitionBy("basin_id", "segment"))).where(F.col("_n") > reflect).drop("_n")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("d")
        return frame[["basin_id", "d"]].assign(baseflow=filter_segment(frame["q"].to_numpy(), alpha, passes, reflect))

    kind = dict(daily.dtypes)["basin_id"]
    filtered = long.groupBy("basin_id", "segment").applyInPandas(run, f"basin_id {kind}, d date, baseflow double")
    return series.dense(daily).join(filtered, ["basin_id", "d"], "left")


def legacy_clamped(daily: DataFrame, alpha: float = ALPHA, passes: int = PASSES) -> DataFrame:
    """``(basin_id, d, baseflow)`` by the form used before: baseflow itself recurses, never above the flow, over all valid
    days in order.  Only to give old numbers again; ``lyne_hollick`` is the published filter."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("d")
        q = b = np.maximum(frame["q"].to_numpy(float), 0.0)
        for k in range(passes):
            y = (b[::-1] if k % 2 else b).tolist()
            sums = [(1 - alpha) / 2 * (u + v) for u, v in zip(y, y[1:])]
            out = np.array([*accumulate(zip(sums, y[1:]), lambda last, x: min(alpha * last + x[0], x[1]), initial=y[0])])
            b = out[::-1] if k % 2 else out
        return frame[["basin_id", "d"]].assign(baseflow=np.clip(b, 0.0, q))

    kind = dict(daily.dtypes)["basin_id"]
    return daily.where("q IS NOT NULL").groupBy("basin_id").applyInPandas(run, f"basin_id {kind}, d date, baseflow double")


def ukih(daily: DataFrame, block: int = 5, factor: float = 0.9) -> DataFrame:
    """``(basin_id, d, q, baseflow)`` by smoothed minima: turning points among block minima, joined by straight lines.

    A block of ``block`` valid days has its first minimum; it turns where ``factor`` times it is below both neighbours;
    the first and the last always do.  Flat outside, never above the flow or below 0.
    """
    w = Window.partitionBy("basin_id").orderBy("d")
    x = daily.where("q IS NOT NULL").withColumn("i", F.row_number().over(w) - 1)
    x = x.withColumn("n_blocks", F.floor(F.count("*").over(Window.partitionBy("basin_id")) / block)).withColumn("b", F.floor(F.col("i") / block))
    lows = x.where("b < n_blocks").groupBy("basin_id", "b", "n_blocks").agg(F.min(F.struct("q", "i")).alias("m"))
    v = Window.partitionBy("basin_id").orderBy("b")
    q = F.col("m.q")
    edge = F.lag("b").over(v).isNull() | F.lead("b").over(v).isNull()
    turn = lows.withColumn("turns", edge | ((factor * q < F.lag(q).over(v)) & (factor * q < F.lead(q).over(v)))).where("turns").select("basin_id", F.col("m.i").alias("i"), q.alias("tq"))
    y = x.join(turn, ["basin_id", "i"], "left")
    point = F.when(F.col("tq").isNotNull(), F.struct("i", "tq"))
    by = Window.partitionBy("basin_id").orderBy("i")
    y = y.withColumn("lo", F.last(point, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.first(point, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)))
    line = F.when(F.col("lo").isNull(), F.col("hi.tq")).when(F.col("hi").isNull() | (F.col("hi.i") == F.col("lo.i")), F.col("lo.tq")).otherwise(F.col("lo.tq") + (F.col("hi.tq") - F.col("lo.tq")) * (F.col("i") - F.col("lo.i")) / (F.col("hi.i") - F.col("lo.i")))
    base = F.when(F.col("n_blocks") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(line, F.col("q"))))
    return y.select("basin_id", "d", "q", base.alias("baseflow"))


def bfi(flow: DataFrame) -> DataFrame:
    """``(basin_id, bfi)`` from ``(basin_id, q, baseflow)``: over days that have both; null without flow."""
    both = F.col("q").isNotNull() & F.col("baseflow").isNotNull()
    a = flow.where(both).groupBy("basin_id").agg(F.sum(F.greatest(F.lit(0.0), F.least("baseflow", "q"))).alias("b"), F.sum("q").alias("t"))
    return a.select("basin_id", F.when(F.col("t") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b") / F.col("t")))).alias("bfi"))


def baseflow_index(daily: DataFrame) -> DataFrame:
    return bfi(lyne_hollick(daily)).withColumnRenamed("bfi", "baseflow_index")


def warmup_biased(n_days):
    """Whether a record is so short that the ends of the filter weigh on its index."""
    return n_days.between(REFLECT + 1, 364)
