"""Registered queries do the whole job: all units, the full number of draws."""

import os
from unittest.mock import MagicMock

import pytest

from tarnflow.operators import frequency, network, uncertainty
from tarnflow.plans import basins, hydro, more

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_closures_of_all_units(spark):
    units = {r.comid for r in hydro._edges(spark, SF).collect()}
    assert {r.outlet for r in hydro.QUERIES["upstream_closure_all"](spark, SF).collect()} == units


@pytest.mark.parametrize("name", ["flood_frequency_mle", "flood_frequency_lp3", "flow_intervals"])
def test_draws_are_the_default(monkeypatch, name):
    seen = []
    monkeypatch.setattr(hydro, "_maxima", lambda *a: None)
    monkeypatch.setattr(hydro, "_all_regions", lambda *a: None)
    monkeypatch.setattr(frequency, "flood_frequency", lambda df, *a, **k: seen.append(k.get("n_bootstrap", 500)) or MagicMock())
    monkeypatch.setattr(uncertainty, "flow_intervals", lambda df, **k: seen.append(k.get("resamples", 2000)) or MagicMock())
    hydro.QUERIES[name](None, "")
    assert seen in ([500], [2000])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["relief_metrics", "runoff_ratio_years", "elasticity_years", "locate_polygon", "nearest_reach", "adaptive_windows", "unit_drainage", "resampled_raster"])
def test_joins_have_keys(spark, name):
    df = (basins.QUERIES | more.QUERIES)[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["flow_routing", "small_catchments", "locate_polygon", "wetness_of_relief"])
def test_growing_tables_are_not_broadcast(spark, monkeypatch, name):
    """Spark finds the tables here small, and by their files it also does so where they are not."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, saved = [], network.saved
    monkeypatch.setattr(network, "saved", lambda df: plans.append(plan(df)) or saved(df))
    plans.append(plan((basins.QUERIES | more.QUERIES)[name](spark, SF)))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
