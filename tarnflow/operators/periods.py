"""Period labels, bounds and completeness of daily series ``(basin_id, d, q)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default share of days that a period needs, and the first month of each kind of year.
MIN_FRACTION = {"month": 1.0, "calendar": 0.95, "water": 0.95, "climatic": 0.95, "custom": 0.95}
START_MONTH = {"calendar": 1, "water": 10, "climatic": 4}


def start_month(freq: str, custom: int | None = None) -> int:
    if freq == "custom":
        if custom is None or not 1 <= custom <= 12:
            raise ValueError("a custom year needs a start month from 1 to 12")
        return custom
    if freq not in START_MONTH:
        raise ValueError(f"unknown period {freq!r}")
    return START_MONTH[freq]


def label(d: Column, freq: str, custom: int | None = None) -> Column:
    """``yyyy-MM`` for months; the year: water years by their end, climatic and custom years by their begin."""
    if freq == "month":
        return F.date_format(d, "yyyy-MM")
    m = start_month(freq, custom)
    if freq == "calendar":
        return F.year(d)
    if freq == "water":
        return F.year(d) + F.when(F.month(d) >= m, 1).otherwise(0)
    return F.year(d) - F.when(F.month(d) < m, 1).otherwise(0)


def first_day(period: Column, freq: str, custom: int | None = None) -> Column:
    if freq == "month":
        return F.to_date(F.concat(period, F.lit("-01")))
    m = start_month(freq, custom)
    year = period - 1 if freq == "water" else period
    return F.make_date(year, F.lit(m), F.lit(1))


def last_day(period: Column, freq: str, custom: int | None = None) -> Column:
    first = first_day(period, freq, custom)
    return F.last_day(first) if freq == "month" else F.date_sub(F.add_months(first, 12), 1)


def period_days(period: Column, freq: str, custom: int | None = None) -> Column:
    return F.datediff(last_day(period, freq, custom), first_day(period, freq, custom)) + 1


def finite(x: Column) -> Column:
    """``x``, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def absent(d: Column, calendar: str) -> Column:
    """Days that a source without leap days (365-day years, 31 December missing in leap years) can never hold."""
    if calendar == "standard":
        return F.lit(False)
    leap = (F.year(d) % 4 == 0) & ((F.year(d) % 100 != 0) | (F.year(d) % 400 == 0))
    return leap & (F.month(d) == 12) & (F.dayofmonth(d) == 31)


def completeness(daily: DataFrame, freq: str, min_fraction: float | None = None, custom: int | None = None, calendar: str = "standard", known_absent: DataFrame | None = None) -> DataFrame:
    """``(basin_id, period, observed_days, expected_days, fraction, is_complete)`` of every period in each basin's span.

    One shuffle on the basin and period; empty periods come from a spine made of each basin's first and last label.
    Days that the source can never hold, by its calendar or listed in ``known_absent (basin_id, d)``, are not expected.
    """
    share = MIN_FRACTION[freq] if min_fraction is None else min_fraction
    if not 0 < share <= 1:
        raise ValueError("min_fraction must be in (0, 1]")
    if known_absent is not None:
        known_absent = known_absent.select("basin_id", "d").distinct().where(~absent(F.col("d"), calendar))
        daily = daily.join(known_absent, ["basin_id", "d"], "left_anti")
    counted = daily.groupBy("basin_id", label(F.col("d"), freq, custom).alias("period")).agg(F.count_distinct(F.when(finite(F.col("q")).isNotNull() & ~absent(F.col("d"), calendar), F.col("d"))).cast("int").alias("n"))
    span = counted.groupBy("basin_id").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    if freq == "month":
        months = F.sequence(first_day(F.col("lo"), freq), first_day(F.col("hi"), freq), F.expr("interval 1 month"))
        spine = span.select("basin_id", F.explode(months).alias("m")).select("basin_id", F.date_format("m", "yyyy-MM").alias("period"))
    else:
        spine = span.select("basin_id", F.explode(F.sequence("lo", "hi")).alias("period"))
    p = F.col("period")
    days = period_days(p, freq, custom)
    if calendar != "standard":
        last = last_day(p, freq, custom)
        first = first_day(p, freq, custom)
        december = F.when(first <= F.make_date(F.year(first), F.lit(12), F.lit(31)), F.make_date(F.year(first), F.lit(12), F.lit(31)))
        days = days - F.when((december <= last) & absent(december, calendar), 1).otherwise(0)
    if known_absent is not None:
        lost = known_absent.groupBy("basin_id", label(F.col("d"), freq, custom).alias("period")).agg(F.count("*").alias("lost"))
        spine, days = spine.join(lost, ["basin_id", "period"], "left"), days - F.coalesce("lost", F.lit(0))
    out = spine.join(counted, ["basin_id", "period"], "left").select("basin_id", "period", F.coalesce("n", F.lit(0)).alias("observed_days"), days.cast("int").alias("expected_days"))
    fraction = F.col("observed_days") / F.col("expected_days")
    return out.withColumn("fraction", fraction).withColumn("is_complete", fraction >= share - 1e-12)


def complete_only(daily: DataFrame, report: DataFrame, freq: str, custom: int | None = None) -> DataFrame:
    """The rows of complete periods, with their ``period``."""
    keep = report.where("is_complete").select("basin_id", "period")
    return daily.withColumn("period", label(F.col("d"), freq, custom)).join(keep, ["basin_id", "period"], "left_semi")


def convention(freq: str, custom: int | None = None) -> str:
    """How a kind of period is cut and named."""
    if freq == "month":
        return "calendar month, named yyyy-MM"
    m = start_month(freq, custom)
    return f"year from the first day of month {m}, named by the year in which it {'ends' if freq == 'water' else 'begins'}"
