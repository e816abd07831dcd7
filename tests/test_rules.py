"""Rules that a wrong reading would pass unnoticed through SQL of the same hand: values worked out by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.operators import baseflow, frequency, geodesy, network, periods, reliability, routing, series, signatures, terrain, uncertainty
from tarnflow.streaming import daily as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def days(n, start=dt.date(2000, 10, 1)):
    return [start + dt.timedelta(k) for k in range(n)]


@pytest.mark.parametrize(("unit", "ok"), [("mm/day", True), (" MM/Day ", True), ("kg/m^2/day", True), ("kg/m²/day", True), ("mm day^-1", True), ("mm.day-1", True), ("kg m-2 d-1", True), ("mmperday", False), ("m/day", False), ("mm/month", False)])
def test_units(spark, unit, ok):
    assert one(spark, series.unit_is_mm_per_day(F.lit(unit))) is ok


@pytest.mark.parametrize(("message", "status", "ok"), [("", 501, True), ("", 505, True), ("", 520, True), ("", 408, False), ("", 425, False), ("", 429, True), ("", 599, True), ("", 600, False), ("HTTP 503", None, True), ("http 404", None, False), ("Read timed out.", None, True), ("deadline exceeded", None, True), ("Service returned no features", None, True), ("temporarily odd", None, False)])
def test_failures_that_pass(spark, message, status, ok):
    assert one(spark, reliability.transient(F.lit(message), F.lit(status).cast("int"))) is ok


@pytest.mark.parametrize(("returned", "fraction", "line", "bad"), [(100.0, 0.0, 10.0, False), (100.0, 0.5, 10.0, False), (100.0, 0.9, 10.0, True), (100.0, 0.0, 301.0, True), (100.0, 0.0, None, True), (126.0, 0.0, 0.0, True)])
def test_outlets_that_were_not_snapped(spark, returned, fraction, line, bad):
    """Inflow 20, unit 80: half way up the reach 60 drain, so 100 is too much by 1.67."""
    want = bad or returned / (20 + (1 - fraction) * 80) > 1.25
    assert one(spark, reliability.unsnapped_unreliable(F.lit(returned), F.lit(80.0), F.lit(20.0), F.lit(line).cast("double"), F.lit(fraction))) is want


def test_an_estimate_of_nothing_is_unreliable(spark):
    assert one(spark, reliability.unsnapped_unreliable(F.lit(5.0), F.lit(80.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))) is True


def test_grid_anchor_guards_cell_edges(spark):
    step = 3 / 3600
    lon = 0.1 + 0.2 - 0.3 + 7 * step  # a hair off the edge
    assert one(spark, reliability.grid_anchor(F.lit(lon), F.lit(0.0), 90.0, "dem", F.lit("1"))) == f"grid_cell|dem|1|EPSG:4326|3as|{180 * 1200 + 7}|{90 * 1200}"
    assert one(spark, reliability.grid_anchor(F.lit(105.0), F.lit(-31.0), 30.0, "dem", None, "epsg:5070")) == "grid_cell|dem|unversioned|EPSG:5070|30m|3|-2"
    assert one(spark, reliability.gauge_anchor(F.lit("123"), F.lit("1"))) is None


def table(spark, rows):
    return spark.createDataFrame(rows, "basin_id string, d date, q double, p double")


def test_refused_rain_gives_no_balance(spark):
    """Negative rain, rain in another unit and good rain: only the last gives a runoff ratio and an elasticity."""
    rng = np.random.default_rng(0)
    rain, noise = rng.gamma(0.4, 8, 365 * 4 + 1), rng.random(365 * 4 + 1)
    rows = [(b, d, float(0.4 * r + n), float(r) - (20.0 if b == "bad" and k == 7 else 0.0)) for b in ("bad", "good") for k, (d, r, n) in enumerate(zip(days(len(rain)), rain, noise))]
    t = table(spark, rows)
    got = {r.basin_id: r for r in signatures.extract(t.select("basin_id", "d", "q"), t.select("basin_id", "d", "p"), "mm/day").collect()}
    assert got["bad"].runoff_ratio is None and got["bad"].stream_elas is None and got["bad"].water_balance_reason == "precipitation_negative"
    assert got["good"].runoff_ratio == pytest.approx(float((0.4 * rain + noise).mean() / rain.mean())) and got["good"].stream_elas is not None and got["good"].water_balance_years == 4
    wrong = signatures.extract(t.select("basin_id", "d", "q"), t.select("basin_id", "d", "p"), "m/day").collect()
    assert {r.water_balance_reason for r in wrong} == {"precipitation_unit"}


def test_intervals_are_refused_below_ten_whole_years(spark):
    rng = np.random.default_rng(1)
    n = 365 * 11
    rows = [("long", d, float(v), float(w)) for d, v, w in zip(days(n), rng.gamma(2, 1, n), rng.gamma(2, 2, n))] + [("short", d, 1.0 + k % 3, 2.0) for k, d in enumerate(days(365 * 9))]
    t = table(spark, rows)
    got = {r.basin_id: r for r in uncertainty.ratio_interval(t, "q", "p", "runoff_ratio", resamples=300).collect()}
    assert got["short"].refused and got["short"].ci_low is None and got["short"].n_valid == 0 and got["short"].value is not None and got["short"].reason
    assert not got["long"].refused and got["long"].ci_low < got["long"].value < got["long"].ci_high and got["long"].n_valid == 300
    e = {r.basin_id: r for r in uncertainty.elasticity_interval(t, resamples=300).collect()}
    assert e["short"].refused and e["short"].n_near_zero > 0 and e["long"].ci_low <= e["long"].value <= e["long"].ci_high
    r = {r.basin_id: r for r in uncertainty.resampled_ratio(t, "q", "p", 300).collect()}
    assert r["short"].ci_low is None and r["short"].reason == "too_few_complete_years" and r["long"].n_years >= 10
    b = {r.basin_id: r for r in uncertainty.baseflow_interval(t.select("basin_id", "d", "q"), resamples=200).collect()}
    assert 0 < b["long"].ci_low <= b["long"].value <= b["long"].ci_high < 1 and b["short"].refused


def test_drawn_years_are_drawn_evenly(spark):
    y = spark.createDataFrame([("a", 2000 + k, 365, 1.0, 1.0, True) for k in range(12)], "basin_id string, wy int, n long, a double, b double, whole boolean")
    n = [r["count"] for r in uncertainty.drawn_years(y, 2000).groupBy("y.wy").count().collect()]
    assert len(n) == 12 and min(n) > 0.9 * 2000 and max(n) < 1.1 * 2000


def plain_levels(z):
    """Repeated relaxation over a grid."""
    rows, cols = z.shape
    rim = lambda r, c: r in (0, rows - 1) or c in (0, cols - 1)
    w = {(r, c): (float(z[r, c]), 0) if rim(r, c) else (1e300, 0) for r in range(rows) for c in range(cols)}
    changed = True
    while changed:
        changed = False
        for (r, c), old in w.items():
            for dr, dc in network.D8.values():
                n = w.get((r + dr, c + dc))
                if n is not None and not rim(r, c):
                    new = (float(z[r, c]), 0) if z[r, c] > n[0] else (n[0], n[1] + 1)
                    if new < w[r, c]:
                        w[r, c], changed = new, True
    return w


@pytest.mark.parametrize("tile", [4, 64])
def test_filled_levels_against_relaxation(spark, tile):
    z = np.random.default_rng(3).integers(0, 30, (14, 17)).astype(float)
    cells = spark.createDataFrame([(1, r, c, float(z[r, c])) for r in range(14) for c in range(17)], "raster_id int, row int, col int, value double")
    levels = routing.filled(cells, tile)
    assert {(r.row, r.col): (r.level, r.steps) for r in levels.collect()} == {k: v for k, v in plain_levels(z).items()}
    flow = routing.directions(levels)
    acc = {(r.row, r.col): r.n_cells for r in routing.accumulation(flow).collect()}
    out = [(r.row, r.col) for r in flow.where("to_row IS NULL").collect()]
    assert sum(acc[p] for p in out) == 14 * 17 and min(acc.values()) == 1


def test_a_mesa_with_a_pit(spark):
    """A bowl inside a rim: all of it fills to the lowest gap and drains through it."""
    z = np.full((7, 7), 9.0)
    z[1:6, 1:6] = 2.0
    z[3, 0] = 5.0
    cells = spark.createDataFrame([(1, r, c, float(z[r, c])) for r in range(7) for c in range(7)], "raster_id int, row int, col int, value double")
    levels = routing.filled(cells)
    assert {r.level for r in levels.where("row BETWEEN 1 AND 5 AND col BETWEEN 1 AND 5").collect()} == {5.0}
    acc = {(r.row, r.col): r.n_cells for r in routing.accumulation(routing.directions(levels)).collect()}
    assert acc[3, 0] >= 26


def test_totals_of_a_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None, 1.0) for k in range(9)], "comid long, nextdown long, area_km2 double")
    assert {r.comid: r.n_upstream for r in network.upstream_totals(chain).collect()} == {k: 9 - k for k in range(9)}
    ring = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "comid long, nextdown long, area_km2 double")
    with pytest.raises(ValueError, match="cycle"):
        network.upstream_totals(ring, 5)


def test_rings_and_holes(spark):
    square = lambda ring, hole, a, z: [("b", ring, hole, k, float(x), float(y)) for k, (x, y) in enumerate(((a, a), (z, a), (z, z), (a, z), (a, a)))]
    v = spark.createDataFrame(square(0, False, 0, 10) + square(1, True, 2, 4)[::-1] + square(2, False, 20, 21), "basin_id string, ring int, hole boolean, seq int, x double, y double")
    m = terrain.polygon_measures(v).first()
    assert (m.area, m.perimeter) == (pytest.approx(100 - 4 + 1), pytest.approx(40 + 8 + 4))


def test_projections(spark):
    """Published coordinates of the two systems."""
    x, y = geodesy.albers(F.lit(-96.0), F.lit(23.0))
    assert (one(spark, x), one(spark, y)) == (pytest.approx(0, abs=1e-6), pytest.approx(0, abs=1e-6))
    x, y = geodesy.equal_area(F.lit(180.0), F.lit(85.0445664))
    assert (one(spark, x), one(spark, y)) == (pytest.approx(17367530.445, abs=0.01), pytest.approx(7314540.83, abs=0.05))
    assert one(spark, geodesy.metric_system(F.lit(179.99), F.lit(-10.0))) == "EPSG:32760" and one(spark, geodesy.metric_system(F.lit(-100.0), F.lit(40.0))) == "EPSG:5070"


@pytest.mark.parametrize("x", [0.0, 1.0, -2.5, 12.34, 0.001, 0.0001234, 1e-5, 123456789.125, 1e15, 1e16, 1.5e22, 98765432.0, 2.5e-300])
def test_shortest_numbers(spark, x):
    assert one(spark, series.python_repr(F.lit(x))) == repr(x)


def test_fits_and_moments(spark):
    rng = np.random.default_rng(7)
    x = rng.gamma(3, 2, 40)
    m = frequency.log_moments(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "basin_id string, period int, value double")).first()
    logs = np.log10(x)
    assert (m.mean, m.sd) == (pytest.approx(logs.mean()), pytest.approx(logs.std(ddof=1)))
    level = frequency.FITS["lp3", "mom"](x)
    assert level(0.99) > level(0.9) > level(0.5) > 0
    with pytest.raises(ValueError, match="unknown"):
        frequency.flood_frequency(None, "weibull")


def test_recursion_in_blocks():
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 400):
        steps, f = rng.normal(size=n), [2.0]
        for s in steps:
            f.append(0.9 * f[-1] + s)
        assert baseflow.recursion(2.0, steps, 0.9) == pytest.approx(f)


def test_listed_absent_days_are_not_expected(spark):
    d = days(365)
    daily = spark.createDataFrame([("a", x, 1.0) for x in d[:-20]], "basin_id string, d date, q double")
    listed = spark.createDataFrame([("a", x) for x in d[-20:]] + [("a", d[-1])], "basin_id string, d date")
    r = periods.completeness(daily, "water", known_absent=listed).first()
    assert (r.observed_days, r.expected_days, r.is_complete) == (345, 345, True)


def test_stream_without_events(spark, tmp_path):
    spark.createDataFrame([], "ts timestamp, event_type string, value double, event_id long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double, event_id long").parquet(f"{tmp_path}/in")
    assert streams.run_available(streams.daily_counts(stream), f"{tmp_path}/out").count() == 0


def test_legacy_filter_by_its_definition(spark):
    q = np.random.default_rng(4).gamma(1, 3, 90)
    want = q.copy()
    for k in range(3):
        data = want[::-1] if k % 2 else want
        out = [data[0]]
        for a, b in zip(data, data[1:]):
            out.append(min(0.925 * out[-1] + 0.075 / 2 * (b + a), b))
        want = np.array(out[::-1] if k % 2 else out)
    rows = [("a", d, float(v)) for d, v in zip(days(90), q)]
    got = [r.baseflow for r in baseflow.legacy_clamped(spark.createDataFrame(rows, "basin_id string, d date, q double")).orderBy("d").collect()]
    assert got == pytest.approx(list(np.minimum(want, q)))


def test_points_in_and_around_polygons(spark):
    """Inside, in a hole, on an edge, near and far."""
    ring = lambda unit, r, a, z: [(unit, r, k, float(x), float(y)) for k, (x, y) in enumerate(((a, a), (z, a), (z, z), (a, z)))]
    rings = spark.createDataFrame(ring(1, 0, 0, 4) + ring(1, 1, 1, 2) + ring(2, 0, 1, 2), "unit int, ring int, seq int, x double, y double")
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 4.03, 2.0), (4, 4.2, 2.0), (5, 4.0, 2.0)], "point_id int, x double, y double")
    got = {r.point_id: (r.unit, r.how) for r in network.locate_polygons(points, rings, spark.createDataFrame([(1, 9.0), (2, 1.0)], "unit int, uparea double")).collect()}
    assert got[1] == (1, "contains") and got[2] == (2, "contains") and got[3] == (1, "nearest") and 4 not in got and got[5][0] == 1


def test_equally_near_boxes_go_to_the_larger(spark):
    """0.49 lies midway between boxes that end at 0.48 and begin at 0.5, but not in binary."""
    boxes = [(k, k * 0.5, 0.0, k * 0.5 + 0.48, 1.0, float(k)) for k in range(44)]
    points = [(k, k * 0.5 + 0.49, 0.5) for k in range(43)]
    got = network.locate(spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame(boxes, "comid int, x0 double, y0 double, x1 double, y1 double, uparea double"))
    assert {r.point_id: r.comid for r in got.collect()} == {k: k + 1 for k in range(43)}
