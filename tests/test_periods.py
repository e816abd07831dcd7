import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import periods, series, signatures


def daily(spark, rows, basin="a"):
    return spark.createDataFrame([(basin, d, v) for d, v in rows], "basin_id string, d date, q double")


def days(start, n):
    return [start + dt.timedelta(k) for k in range(n)]


def test_labels_and_bounds(spark):
    x = spark.createDataFrame([(dt.date(2004, 9, 30),), (dt.date(2004, 10, 1),), (dt.date(2004, 3, 31),)], "d date")
    got = [tuple(r) for r in x.select(*(periods.label(F.col("d"), f) for f in ("month", "calendar", "water", "climatic")), periods.label(F.col("d"), "custom", 7)).collect()]
    assert got == [("2004-09", 2004, 2004, 2004, 2004), ("2004-10", 2004, 2005, 2004, 2004), ("2004-03", 2004, 2004, 2003, 2003)]
    b = spark.range(1).select(periods.first_day(F.lit(2004), "water"), periods.last_day(F.lit(2004), "water"), periods.period_days(F.lit(2004), "water"), periods.period_days(F.lit("2004-02"), "month")).first()
    assert tuple(b) == (dt.date(2003, 10, 1), dt.date(2004, 9, 30), 366, 29)
    with pytest.raises(ValueError):
        periods.start_month("custom", 13)
    with pytest.raises(ValueError):
        periods.completeness(daily(spark, []), "water", 0)


def test_completeness_counts_empty_periods_and_days_once(spark):
    rows = [(d, 1.0) for d in days(dt.date(2000, 10, 1), 365)] + [(dt.date(2000, 10, 1), 2.0), (dt.date(2003, 1, 1), 1.0), (dt.date(2003, 1, 2), float("nan"))]
    got = {r.period: (r.observed_days, r.expected_days, r.is_complete) for r in periods.completeness(daily(spark, rows), "water").collect()}
    assert got == {2001: (365, 365, True), 2002: (0, 365, False), 2003: (1, 365, False)}


def test_calendar_without_leap_days(spark):
    rows = [(d, 1.0) for d in days(dt.date(2004, 1, 1), 365)]
    got = periods.completeness(daily(spark, rows), "calendar", 1.0, calendar="noleap").first()
    assert (got.observed_days, got.expected_days, got.is_complete) == (365, 365, True)


def test_empty_series(spark):
    assert periods.completeness(daily(spark, []), "month").count() == 0
    assert signatures.flow_stats(daily(spark, [])).count() == 0


def test_ramp_percentiles(spark):
    got = signatures.flow_stats(daily(spark, [(d, float(k + 1)) for k, d in enumerate(days(dt.date(2000, 1, 1), 1000))])).first()
    assert (got.q5, got.q95) == pytest.approx((50.95, 950.05))


def test_gap_splits_an_event(spark):
    rows = [(d, 1.0) for d in days(dt.date(2000, 1, 1), 30) if d.day not in (21, 22, 23)] + [(dt.date(2000, 1, 21), 100.0), (dt.date(2000, 1, 22), None), (dt.date(2000, 1, 23), 100.0)]
    got = signatures.event_stats(daily(spark, rows)).first()
    assert got.high_q_dur == 1.0 and got.low_q_dur == 13.5


def test_zero_heavy_slope(spark):
    import numpy as np

    q = [0.0] * 700 + list(np.linspace(1, 50, 300))
    got = signatures.fdc_slopes(daily(spark, list(zip(days(dt.date(2000, 1, 1), 1000), map(float, q))))).first()
    assert got.slope_fdc == 0.0 and got.slope_fdc_sawicz2011 > 0


def test_flood_record_years(spark):
    rows = [(d, 100.0 + 10 * (d.year - 2001) if (d.month, d.day) == (3, 10) else 5.0) for d in days(dt.date(2000, 7, 15), (dt.date(2015, 1, 3) - dt.date(2000, 7, 15)).days + 1)]
    got = {r.period: r.max_q for r in signatures.annual_maxima(daily(spark, rows)).collect()}
    assert got == {y: 100.0 + 10 * (y - 2001) for y in range(2001, 2015)}


def test_exact_runoff_ratio(spark):
    import numpy as np

    p = np.random.default_rng(0).gamma(0.5, 6, 15 * 366)
    d = days(dt.date(1989, 10, 1), len(p))
    q = daily(spark, [(x, float(v) / 2) for x, v in zip(d, p)])
    rain = spark.createDataFrame([("a", x, float(v)) for x, v in zip(d, p)], "basin_id string, d date, p double")
    got = signatures.water_balance(series.align(q, rain)).first()
    assert got.runoff_ratio == pytest.approx(0.5) and got.reason is None
    assert signatures.elasticity(series.align(q, rain)).first().stream_elas == pytest.approx(1.0)


def test_precipitation_reasons(spark):
    d = days(dt.date(2000, 1, 1), 400)
    cases = {"ok": [2.0] * 400, "negative": [2.0] * 399 + [-1.0], "effectively_zero": [0.0] * 400, "max_out_of_range": [2.0] * 399 + [5000.0], "not_finite": [2.0] * 399 + [float("inf")], "mean_out_of_range": [40.0] * 400, "too_few_days": [2.0] * 20}
    p = spark.createDataFrame([(k, x, v) for k, vs in cases.items() for x, v in zip(d, vs)], "basin_id string, d date, p double")
    got = {r.basin_id: r.reason for r in series.precipitation_problem(p, "mm/day").collect()}
    assert got == {k: (None if k == "ok" else k) for k in cases}
    assert {r.reason for r in series.precipitation_problem(p, "m/day").collect()} == {"unit"}


def test_seven_day_minima_straddle_the_year(spark):
    rows = []
    for d in days(dt.date(1999, 4, 1), (dt.date(2014, 3, 31) - dt.date(1999, 4, 1)).days + 1):
        rows.append((d, 1.0 if (d.month == 12 and d.day >= 28) or (d.month == 1 and d.day <= 5) else 9.0))
    got = {r.period: r.min_q for r in signatures.annual_minima(daily(spark, rows)).collect()}
    assert got == dict.fromkeys(range(1999, 2014), 1.0)
