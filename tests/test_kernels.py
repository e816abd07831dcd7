import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.functions import special
from tarnflow.operators import baseflow, drought, frequency, landsoil, network, reliability, runoff, terrain


def test_special_functions():
    assert special.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    assert special.gamma_cdf(2.0, 1.0) == pytest.approx(1 - math.exp(-2))
    assert special.gamma_ppf(0.5, 1.0) == pytest.approx(math.log(2))
    assert special.digamma(1.0) == pytest.approx(-special.EULER)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert special.pearson3_ppf(0.9, 0.0) == pytest.approx(1.2815515655446004)
    assert special.pearson3_ppf(0.9, 2.0) == pytest.approx(-math.log(0.1) - 1)
    x = np.random.default_rng(1).gamma(2.0, 3.0, 4000)
    assert special.gamma_fit(x) == pytest.approx((2.0, 3.0), rel=0.1)
    g = 5 - 2 * np.log(-np.log(np.random.default_rng(2).random(4000)))
    assert special.gumbel_mle(g) == pytest.approx((5.0, 2.0), rel=0.05)
    assert special.gev_mle(g)[0] == pytest.approx(0.0, abs=0.05)


def direct_filter(q, alpha=0.925):
    """The recursion written out step by step."""
    y = list(q[30:0:-1]) + list(q) + list(q[-2:-32:-1])
    for k in range(3):
        order = range(len(y)) if k % 2 == 0 else range(len(y) - 1, -1, -1)
        f, before = [0.0] * len(y), None
        for t in order:
            f[t] = y[t] if before is None else alpha * f[before] + (1 + alpha) / 2 * (y[t] - y[before])
            before = t
        y = [v - w if w > 0 else v for v, w in zip(y, f)]
    return [max(v, 0.0) for v in y[30:-30]]


def test_baseflow_against_the_recursion(spark):
    q = np.random.default_rng(0).gamma(2, 1, 400)
    gap = [float(v) if not 200 <= k <= 204 else None for k, v in enumerate(q)]
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(k), v) for k, v in enumerate(gap)]
    got = [r.baseflow for r in baseflow.lyne_hollick(spark.createDataFrame(rows, "basin_id string, d date, q double")).orderBy("d").collect()]
    assert [k for k, v in enumerate(got) if v is None] == list(range(200, 205))
    assert got[:200] == pytest.approx(direct_filter(q[:200]))
    assert got[205:] == pytest.approx(direct_filter(q[205:]))


def test_spi_is_standard(spark):
    rng = np.random.default_rng(1)
    rows = [("a", dt.date(1990, 1, 1) + dt.timedelta(k), float(v)) for k, v in enumerate(rng.gamma(0.5, 6, 365 * 30))]
    got = [r["index"] for r in drought.spi(spark.createDataFrame(rows, "basin_id string, d date, q double"), 3).collect()]
    there = [x for x in got if x is not None]
    assert len(there) > 300 and abs(np.mean(there)) < 0.1 and abs(np.std(there) - 1) < 0.1


def test_low_flow_quantile_with_zeros_and_constants():
    assert frequency.low_quantile(np.array([0.0, 1, 2, 3, 4, 5, 6, 7, 8])) == pytest.approx(0.0)
    assert frequency.low_quantile(np.array([2.0] * 12)) == pytest.approx(2.0)


def test_runoff_formulas(spark):
    r = spark.range(1).select(
        runoff.storage(F.lit(80.0)), runoff.curve_number_runoff(F.lit(100.0), F.lit(80.0)), runoff.storage(F.lit(0.0)), runoff.curve_number_runoff(F.lit(5.0), F.lit(80.0)),
        runoff.c_factor(F.lit("Deciduous Forest")), runoff.c_factor(F.lit("lava")), runoff.fournier(F.array(*[F.lit(10.0)] * 12)),
    ).first()
    assert tuple(r) == (63.5, pytest.approx((100 - 12.7) ** 2 / (100 + 50.8)), None, 0.0, 0.003, 0.1, pytest.approx(10.0))


def test_drainage_groups(spark):
    x = spark.createDataFrame([("A/D",), ("C",), ("",), (None,), (" b/d ",), ("X",)], "g string").select(landsoil.drainage_groups(F.col("g")).alias("s")).select("s.*")
    assert [tuple(r) for r in x.collect()] == [(1, 4, True), (3, 3, False), (None, None, False), (None, None, False), (2, 4, True), (None, None, False)]


def test_horn_on_a_plane(spark):
    rows = [(0, r, c, 3.0 * c + 4.0 * r) for r in range(4) for c in range(4)]
    got = {(r.row, r.col): r.slope_deg for r in terrain.slope_horn(spark.createDataFrame(rows, "raster_id int, row int, col int, value double"), 1.0).collect()}
    assert len(got) == 16 and got[0, 0] is None
    assert got[1, 1] == pytest.approx(math.degrees(math.atan(5)))


def test_square_polygon(spark):
    ring = [("a", k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])]
    got = terrain.polygon_measures(spark.createDataFrame(ring, "basin_id string, seq int, x double, y double")).first()
    assert tuple(got)[1:] == (4.0, 8.0, 1.0, 1.0)
    cells = spark.createDataFrame([("a", 0, 0, 1.0, 1.0), ("a", 0, 1, 3.0, 1.0)], "raster_id string, row int, col int, x double, y double")
    v = spark.createDataFrame(ring, "raster_id string, seq int, x double, y double")
    assert {r.col: r.inside for r in terrain.inside_ring(cells, v).collect()} == {0: True, 1: False}


def test_upstream_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (9, 3, 1.0)], "comid long, nextdown long, area_km2 double")
    got = {r.comid for r in network.upstream(e, spark.createDataFrame([(3,)], "comid long")).collect()}
    assert got == {1, 2, 3, 9}


def test_long_river_totals(spark):
    e = spark.createDataFrame([(k, k + 1 if k < 300 else 0, 1.0) for k in range(1, 301)], "comid long, nextdown long, area_km2 double")
    got = {r.comid: r.n_upstream for r in network.upstream_totals(e).collect()}
    assert got == {k: k for k in range(1, 301)}


def test_route_and_states(spark):
    rows = [(1, 1, "a", 10.0, False), (1, 2, "b", 20.0, True), (1, 3, "c", 30.0, True), (2, 1, "a", 10.0, False)]
    got = {r.outlet_id: (r.tier, r.area_km2, r.n_tried, r.disagrees, r.last_resort) for r in reliability.route(spark.createDataFrame(rows, "outlet_id int, tier_rank int, tier string, area_km2 double, ok boolean")).collect()}
    assert got == {1: ("b", 20.0, 2, True, False), 2: ("a", 10.0, 1, False, True)}


def test_all_fits_at_once_equal_one_by_one():
    from tarnflow.functions import special as sp

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.gumbel(1000, 300, (20, 12)), np.full((1, 12), 7.0), rng.lognormal(5, 1, (20, 12))])
    loc, scale = sp.gumbel_mles(x)
    for k in [*range(20), *range(21, 41)]:
        assert (loc[k], scale[k]) == pytest.approx(sp.gumbel_mle(x[k]), rel=1e-9)
    assert (loc[20], scale[20]) == (7.0, 0.0)
    chances, skews = np.array([0.01, 0.2, 0.5, 0.9, 0.99, 0.998]), np.array([0.0, 1e-6, 0.005, -0.005, 0.021, -0.03, 0.3, -0.7, 1.5, -2.2, 4.0])
    got = sp.pearson3_quantiles(chances, skews)
    for i, k in enumerate(skews):
        assert got[i] == pytest.approx([sp.pearson3_ppf(p, k) for p in chances], abs=1e-5 if abs(k) < 0.02 else 1e-9)


def test_drawn_quantiles_equal_those_of_drawn_days():
    from tarnflow.operators import uncertainty as u

    rng = np.random.default_rng(3)
    wy = np.sort(rng.integers(0, 6, 400))
    q = np.round(rng.gamma(1, 3, 400), 1)
    by = np.argsort(q, kind="stable")
    taken = u.draws(50, 6)
    times = np.stack([np.bincount(t, minlength=6) for t in taken])
    got = u._drawn_statistics(q[by], wy[by], 6, times)
    for r, t in enumerate(taken):
        days = np.concatenate([q[wy == k] for k in t])
        want = (days.mean(), np.median(days), np.quantile(days, 0.05), np.quantile(days, 0.95), days.std() / days.mean())
        assert [got[k][r] for k in ("q_mean", "q_median", "q5", "q95", "flow_variability")] == pytest.approx(want)
