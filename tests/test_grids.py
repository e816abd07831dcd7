"""Other grids, culverts, nearest lines: by value, by known answers and against plain definitions."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import culverts, grids, network, reliability, series
from tarnflow.streaming import daily as streams

N, M, DX = 100, 80, 10.0
TOP, BOTTOM, LEFT, RIGHT = 10, 69, 15, 65
CENTRE, SPILLWAY, CULVERT = (40, 40), (69, 40), (55, 40)


def walled(road=False, saddle=False):
    """A funnel behind a wall on a plain, drained by a channel through one gap; maybe a road across the channel and a low
    place in the wall beside it."""
    out = []
    for r in range(N):
        for c in range(M):
            z, inside = 10 + 0.02 * (N - 1 - r) * DX, TOP < r < BOTTOM and LEFT < c < RIGHT
            if inside:
                z = 100 + 0.1 * math.hypot(r - CENTRE[0], c - CENTRE[1]) * DX
            elif TOP <= r <= BOTTOM and LEFT <= c <= RIGHT:
                z = 300.0
            if c == CENTRE[1] and CENTRE[0] < r <= BOTTOM:
                z = 99.9 - 0.05 * (r - CENTRE[0])
            if road and inside and abs(r - CULVERT[0]) <= 1:
                z += 50
            if saddle and (r, c) == (30, LEFT):
                z = 140.0
            out.append((r, c, (c + 0.5) * DX, (r + 0.5) * DX, z))
    return out


def caught(spark, dem, at, **options):
    point = spark.createDataFrame([(k, (c + 0.5) * DX + dx, (r + 0.5) * DX) for k, (r, c, dx) in enumerate(at)], "outlet_id int, x double, y double")
    return culverts.catchments(point, spark.createDataFrame(dem, "row int, col int, x double, y double, value double"), DX, **{"halves": (2500.0,), **options}).orderBy("outlet_id").collect()


def test_walled_block(spark):
    (r,) = caught(spark, walled(), [(*SPILLWAY, 0.0)], notch=False, snap_m=5.0)
    assert (r.status, r.row, r.col, r.area_km2, r.flags) == ("ok", *SPILLWAY, pytest.approx((58 * 49 + 1) * 1e-4), "")


def test_notch_lets_water_through_a_road(spark):
    open_, moved = caught(spark, walled(), [(*CULVERT, 0.0), (*CULVERT, 25.0)], notch=False)
    (blocked,) = caught(spark, walled(True, True), [(*CULVERT, 0.0)], notch=False)
    (cut,) = caught(spark, walled(True, True), [(*CULVERT, 0.0)])
    assert blocked.area_km2 < 0.3 * open_.area_km2 and cut.area_km2 == open_.area_km2 and cut.flags == "EMBANKMENT_NOTCH_APPLIED"
    assert cut.notch_m == pytest.approx(99.9 - 0.05 * (CULVERT[0] + 6 - CENTRE[0])) and moved.col == 40 and moved.snap_m <= 40


def test_windows_of_culverts(spark):
    """Small windows first: the basin reaches them until one holds the wall; far from all heights there is none."""
    a, b = caught(spark, walled(), [(*SPILLWAY, 0.0), (5, 5, 1e5)], halves=(100.0, 250.0, 700.0))
    assert (a.status, a.n_windows, a.half_m) == ("ok", 3, 700.0) and a.area_km2 > 0.28 and (b.status, b.area_km2, b.flags) == ("no_dem", None, "")
    (c,) = caught(spark, walled(), [(*SPILLWAY, 0.0)], halves=(100.0,))
    assert (c.status, c.flags) == ("touches_max_window", "EMBANKMENT_NOTCH_APPLIED,BASIN_TOUCHES_MAX_WINDOW,LIKELY_DITCH_SNAP")


def test_zones_by_known_places(spark):
    """A tower in Paris, and a place on the equator at a zone's central meridian; the way back below a tenth of a millimetre."""
    places = [(2.2945, 48.8582), (9.0, 0.0), (177.3, -43.2), (-179.99, 65.0), (5.9, 79.9), (-68.4, -79.9)]
    p = spark.createDataFrame([(k, *xy) for k, xy in enumerate(places)], "k int, lon double, lat double").withColumn("zone", grids.zone_of(F.col("lon"))).withColumn("south", F.col("lat") < 0)
    x, y = grids.to_zone(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))
    p = p.withColumn("x", x).withColumn("y", y)
    lon, lat = grids.from_zone(F.col("x"), F.col("y"), F.col("zone"), F.col("south"))
    got = p.withColumn("lon2", lon).withColumn("lat2", lat).orderBy("k").collect()
    assert (got[0].zone, got[0].x, got[0].y) == (31, pytest.approx(448_251.8, abs=0.05), pytest.approx(5_411_932.68, abs=0.05))
    assert (got[1].zone, got[1].x, got[1].y) == (32, pytest.approx(500_000), pytest.approx(0, abs=1e-6)) and [r.zone for r in got[2:4]] == [60, 1]
    assert all(abs(r.lon2 - r.lon) < 1e-9 and abs(r.lat2 - r.lat) < 1e-9 for r in got)


def test_a_plane_stays_a_plane(spark):
    cells = spark.createDataFrame([(0, r, c, 3.0 * r - 2.0 * c + 7) for r in range(12) for c in range(9)], "raster_id int, row int, col int, value double")
    rng = random.Random(1)
    at = [(0, k, 0, rng.uniform(0.5, 11.5), rng.uniform(0.5, 8.5)) for k in range(200)] + [(0, 900, 0, -0.1, 3.0), (0, 901, 0, 0.1, 0.2), (0, 902, 0, 12.1, 3.0)]
    got = {r.row: r.value for r in grids.resampled(spark.createDataFrame(at, "raster_id int, row int, col int, r double, c double"), cells).collect()}
    assert all(got[k] == pytest.approx(3 * (r - 0.5) - 2 * (c - 0.5) + 7) for _, k, _, r, c in at[:200]) and got[900] is None and got[902] is None and got[901] == 7.0
    near = {r.row: r.value for r in grids.resampled(spark.createDataFrame(at, "raster_id int, row int, col int, r double, c double"), cells, bilinear=False).collect()}
    assert all(near[k] == 3 * int(r) - 2 * int(c) + 7 for _, k, _, r, c in at[:200])


def test_degrees_onto_a_zone(spark):
    """A raster of its own longitudes and latitudes, seen from the zone, tells where each target cell lies."""
    cells = spark.createDataFrame([(i, r, c, (9.0 + (c + 0.5) * 0.01, 46.0 - (r + 0.5) * 0.01)[i]) for i in (0, 1) for r in range(30) for c in range(30)], "raster_id int, row int, col int, value double")
    sources = spark.createDataFrame([(i, 9.0, 46.0, 0.01) for i in (0, 1)], "raster_id int, lon0 double, lat0 double, step double")
    grid = [(i, 32, False, 505_000.0, 5_090_000.0, 900.0, 12, 12) for i in (0, 1)]
    g = spark.createDataFrame(grid, "raster_id int, zone int, south boolean, x0 double, y0 double, size double, n_rows int, n_cols int")
    got = {(r.raster_id, r.row, r.col): r.value for r in grids.onto_zone(cells, sources, g).collect()}
    one = spark.createDataFrame([(r, c, got[0, r, c], got[1, r, c]) for r in range(12) for c in range(12)], "row int, col int, lon double, lat double")
    x, y = grids.to_zone(F.col("lon"), F.col("lat"), F.lit(32), F.lit(False))
    assert all(abs(r.x - (505_000 + (r.col + 0.5) * 900)) < 1e-2 and abs(r.y - (5_090_000 - (r.row + 0.5) * 900)) < 1e-2 for r in one.withColumn("x", x).withColumn("y", y).collect())


def test_spacing_and_levels(spark):
    rows = [(0, "EPSG:32631", "metre", 10.0, -10.0), (1, None, "metre", 1.0, 1.0), (2, "EPSG:4326", "degree", 0.1, 0.1), (3, "x", "US survey foot", 3.0, 3.0), (4, "x", "furlong", 1.0, 1.0), (5, "x", "m", 0.0, 1.0), (6, "x", "m", float("nan"), 1.0)]
    got = {r.raster_id: (r.dx, r.dy, r.reason) for r in grids.metric_spacing(spark.createDataFrame(rows, "raster_id int, system string, unit string, step_x double, step_y double")).collect()}
    assert got[0] == (10.0, 10.0, None) and [got[k][2] for k in range(7)] == [None, "no_system", "geographic", None, "unknown_unit", "no_spacing", "no_spacing"] and got[3][0] == pytest.approx(0.9144018)
    cells = spark.createDataFrame([(0, r, c, None if (r, c) == (0, 0) else float(r + c)) for r in range(4) for c in range(4)], "raster_id int, row int, col int, value double")
    assert {(r.row, r.col): r.value for r in grids.coarser(cells, 2).collect()} == {(0, 0): pytest.approx(4 / 3), (0, 1): 3.0, (1, 0): 3.0, (1, 1): 5.0}


def test_nearest_lines(spark):
    """Lines in one corner, points everywhere, some very far; equal distances go to the smaller line."""
    rng = random.Random(2)
    lines = [(k, s, x + rng.uniform(-5, 5) * s, y + rng.uniform(-5, 5) * s) for k in range(40) for x, y in [(rng.uniform(0, 100), rng.uniform(0, 100))] for s in range(4)]
    lines += [(90 + k, s, 10.0 * s, 500.0) for k in (1, 0) for s in range(3)] + [(99, 0, 1.0, 1.0)]
    points = [(k, rng.uniform(-50, 200), rng.uniform(-50, 200)) for k in range(150)] + [(500, 1e5, -3e4), (501, 5.0, 503.0), (502, None, 1.0)]
    segments = [(a[0], a[2:], b[2:]) for a, b in zip(lines, lines[1:]) if a[0] == b[0]]

    def nearest(px, py):
        out = []
        for line, (x1, y1), (x2, y2) in segments:
            dx, dy = x2 - x1, y2 - y1
            t = min(1, max(0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
            out.append((round(math.hypot(px - x1 - t * dx, py - y1 - t * dy), 9), line))
        return min(out)

    frame = spark.createDataFrame(lines, "line int, seq int, x double, y double")
    got = {r.point_id: (round(r.dist, 9), r.line) for r in network.nearest_lines(spark.createDataFrame(points, "point_id int, x double, y double"), frame).collect()}
    assert got == {k: nearest(x, y) for k, x, y in points if x is not None} and got[501] == (3.0, 90)
    assert network.nearest_lines(spark.createDataFrame(points, "point_id int, x double, y double"), frame.limit(0)).count() == 0


def test_digest_of_a_series(spark):
    rows = [("a", dt.date(2001, 1, 2), 1.5), ("a", dt.date(2001, 1, 1), 1e-7), ("a", dt.date(2001, 1, 3), None), ("a", dt.date(2001, 1, 4), 12345678.25), ("a", dt.date(2001, 1, 5), 1e22)]
    r = series.extent(spark.createDataFrame(rows, "basin_id string, d date, q double")).first()
    lines = "".join(f"{d:%Y-%m-%d}\t{float('nan') if q is None else q!r}\n" for _, d, q in sorted(rows, key=lambda x: x[1]))
    assert r.digest == "sha256:" + hashlib.sha256(lines.encode()).hexdigest() and (r.n_days, r.n_valid_days, r.units) == (5, 4, "m3/s")


@pytest.mark.parametrize(("message", "ok"), [("HTTP=503", False), ("HTTP\t503", True), ("http503", True), ("status code: 502", True), ("500 Server Error: x", True), ("502, message='Bad Gateway'", True), ("5021, x", False), ("a dns lookup", True), ("dnsmasq", False), ("connection refused", True), ("disconnection errors", False), ("read time-out", True), ("Too Many Requests", True)])
def test_messages_of_failures(spark, message, ok):
    assert spark.range(1).select(reliability.transient(F.lit(message), F.lit(None).cast("int"))).first()[0] is ok


@pytest.mark.parametrize(("causes", "ok"), [([], False), ([(["ValueError"], None), (["ReadTimeout", "Timeout"], None)], True), ([(["ValueError"], 503)], True), ([(["KeyError"], 404)], False), ([(["KeyError"], None)] * 4 + [(["TimeoutError"], None)], False)])
def test_causes_of_failures(spark, causes, ok):
    df = spark.createDataFrame([(causes,)], "causes array<struct<kinds:array<string>,status:int>>")
    assert df.select(reliability.transient(F.lit("odd"), F.lit(None).cast("int"), causes=F.col("causes"))).first()[0] is ok


def test_stream_restarted_without_new_events(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double, event_id long"
    spark.createDataFrame([(dt.datetime(2020, 1, 1, 5), "a", 2.0, 1)], schema).write.parquet(f"{tmp_path}/in")
    once = [sorted(map(tuple, streams.run_available(streams.daily_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out").collect())) for _ in range(2)]
    assert once[0] == once[1] == [(dt.date(2020, 1, 1), "a", 1, 2.0)]


def test_nearest_lines_sort_nothing_that_met(spark, monkeypatch):
    """Points go out once, and the rows of points and lines that meet are not sorted by point, which would write them all."""
    plans, saved = [], network.saved
    monkeypatch.setattr(network, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df))
    lines = spark.createDataFrame([(k, s, float(k), float(s)) for k in range(5) for s in range(2)], "line int, seq int, x double, y double")
    points = spark.createDataFrame([(k, k * 0.3 + 0.1, 0.5) for k in range(9)], "point_id int, x double, y double")
    got = {r.point_id: r.line for r in network.nearest_lines(points, lines, decimals=6).collect()}
    assert got == {k: round(k * 0.3 + 0.1) for k in range(9)}
    first = [p for p in plans if "SortMergeJoin" in p and "HashAggregate" in p]
    assert first and all("HashAggregate" in p and "SortAggregate" not in p for p in first)
    assert not any("-1, 0, 1" in p or "[-1,0,1]" in p for p in plans)
