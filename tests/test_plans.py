"""Shape of the physical plans: what is pushed down, shuffled and never done."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import fixtures as X
from emberframe.operators import panel as P
from emberframe.operators import profile as R
from emberframe.operators.grid import Grid, each_month, each_year, regrid_nearest
from emberframe.operators.rasterize import rasterize
from emberframe.plans.panel_build import bucketed, build_panel

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """Plans as they are for tables too large to broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_panel_is_shuffled_once_per_key(large):
    """Cells, years and months are three keys; the many monthly joins reuse one shuffle."""
    inputs = X.panel_inputs(large, FOLDER)
    text = plan(build_panel(large, inputs, X.FIRST, X.LAST))
    joins = len(re.findall(r"SortMergeJoin .*Year", text))
    layers = len(re.findall(r"FileScan parquet .*m_|FileScan parquet", text))
    month = len(re.findall(r"Exchange hashpartitioning\(col#\d+, row#\d+, Year#\d+, Month#\d+", text))
    assert joins >= 24
    assert month <= 24 + 1  # one per monthly table, one for the panel itself
    assert layers >= 24
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_drop_missing_join_is_inner(large):
    text = plan(P.keep_known(X.base_grid(large, FOLDER), X.monthly(large, FOLDER, "TMax"), P.MONTH_KEY, "TMax"))
    assert "Inner" in text and "LeftOuter" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "panel")
    X.base_grid(spark, FOLDER).withColumn("v", F.rand(1)).withColumn("unused", F.lit("x")).write.partitionBy("Year").parquet(path)
    text = plan(P.stratum(spark.read.parquet(path), None, 2001).where("GFED_Regions = 3 AND Year = 1999").agg(F.sum("v")))
    assert "PartitionFilters: [isnotnull(Year" in text
    assert "EqualTo(GFED_Regions,3)" in text
    assert re.search(r"ReadSchema: struct<GFED_Regions:int,v:double>", text)


def test_grid_steps_need_no_shuffle(large):
    cells = X.regions(large, FOLDER)
    before = plan(cells).count("Exchange")
    panel = each_month(each_year(cells, 2003, 2016))
    moved = regrid_nearest(panel, X.GRID, Grid(-180.0, -174.0, 87.5, 90.0, 48, 20))
    assert plan(moved).count("Exchange") == before


def test_rasterize_is_not_a_range_join(large):
    rows = [(1, "a", [{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 0.0}, {"x": 1.0, "y": 2.0}])]
    df = large.createDataFrame(rows, "feature bigint, who string, ring array<struct<x: double, y: double>>")
    text = plan(rasterize(df, "who", X.GRID))
    assert "Join" not in text and "Cartesian" not in text


def test_profiles_are_single_passes(large):
    rows = X.observations(large, FOLDER)
    for df in (R.zero_counts(rows, ["qty", "tax"]), R.value_range(rows, ["qty", "tax"]), R.missing_counts(rows, ["qty", "tax"])):
        assert plan(df).count("FileScan") == 1
        assert "Join" not in plan(df)


@pytest.mark.parametrize("name", ["presence_rate", "monthly_left_join", "static_left_join", "region_lookup", "cells_by_month"])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_panel_from_buckets_shuffles_no_layer(large):
    """Layers dealt by cell once are never dealt again by month; the cells are, before the months exist."""
    inputs = bucketed(large, X.panel_inputs(large, FOLDER), "plan_layer", 4)
    panel = build_panel(large, inputs, X.FIRST, X.LAST)
    text = plan(panel)
    assert len(re.findall(r"SortMergeJoin .*Month", text)) >= 24
    assert not re.findall(r"Exchange hashpartitioning\([^)]*(Month|Year)#", text)
    assert "SelectedBucketsCount: 4 out of 4" in text
    plain = build_panel(large, X.panel_inputs(large, FOLDER), X.FIRST, X.LAST)
    assert panel.count() == plain.count() > 0


def test_dimensions_leave_the_facts_in_place(spark):
    """Small tables are broadcast: line items are not shuffled for a lookup."""
    text = plan(X.model_rows(spark, FOLDER))
    assert "Exchange hashpartitioning" not in text and text.count("BroadcastHashJoin") == 2
