"""Grid, panel and profile operators on small fixtures and edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberframe.functions import scalar as S
from emberframe.operators import grid as G
from emberframe.operators import panel as P
from emberframe.operators import profile as R
from emberframe.operators.ranks import order_statistics, quantiles
from emberframe.operators.rasterize import rasterize
from emberframe.sources import ascii_grid, polygons, tables

# --- quantiles ---------------------------------------------------------------


def test_quantiles_of_skewed_groups(spark):
    rng = np.random.default_rng(1)
    hot = rng.lognormal(0, 3, 5000)
    parts = {"hot": hot, "tied": np.repeat([1.0, 1.0, 2.0, 7.5], 50), "one": np.array([4.25]), "neg": -rng.random(77) * 1e-9, "wide": np.array([-1e300, 0.0, 1e300, 5.0])}
    pdf = pd.DataFrame([(k, v) for k, vs in parts.items() for v in vs], columns=["k", "v"])
    df = spark.createDataFrame(pdf).repartition(6)
    n = F.col("n")
    ranks = {"lo": F.lit(1), "mid": F.ceil(n / 2), "late": F.greatest(F.floor(n * 0.9), F.lit(1)), "hi": n}
    rows = {r["k"]: r for r in order_statistics(df, ["k"], ["v"], ranks, bins=16).collect()}
    for k, vs in parts.items():
        s, m = np.sort(vs), len(vs)
        assert rows[k]["n"] == m
        want = [s[0], s[-(-m // 2) - 1], s[max(int(np.floor(m * 0.9)), 1) - 1], s[-1]]
        assert [rows[k][c] for c in ("lo", "mid", "late", "hi")] == want


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,), (10.0,)], "v double")
    row = quantiles(df, [], ["v"], {"q1": 0.25, "median": 0.5}).first()
    assert (row["n"], row["q1"], row["median"]) == (3, 2.0, 3.0)


def test_a_missing_group_key_is_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 10.0), (None, 14.0)], "k string, v double")
    assert {r["k"]: r["median"] for r in quantiles(df, ["k"], ["v"], {"median": 0.5}).collect()} == {"a": 2.0, None: 12.0}
    assert R.standardise(df, ["v"], ["k"]).count() == 4
    assert R.box_stats(df, "v", ["k"]).count() == 2
    assert R.histogram(df, ["v"], ["k"]).agg(F.sum("N")).first()[0] == 4


# --- profiles ----------------------------------------------------------------


def test_box_stats_known_case(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [*range(1, 11), 50]], "k string, v double")
    r = R.box_stats(df, "v", ["k"]).first()
    assert (r.lower_whisker, r.lower_hinge, r.median, r.upper_hinge, r.upper_whisker, r.outliers) == (1, 3.5, 6, 8.5, 10, 1)


@pytest.mark.parametrize("span, bins, step", [(97.0, 5, 20.0), (9.0, 5, 2.0), (1.0, 5, 0.2), (4200.0, 8, 500.0), (0.0031, 6, 0.0005)])
def test_round_step(spark, span, bins, step):
    got = spark.range(1).select(R.round_step(F.lit(span), F.lit(float(bins)))).first()[0]
    assert got == pytest.approx(step, rel=1e-12)


def test_histogram_bins_are_right_closed_and_whole(spark):
    df = spark.createDataFrame([(float(v),) for v in range(0, 101)], "v double")
    rows = R.histogram(df, ["v"]).orderBy("bin").collect()
    assert sum(r["N"] for r in rows) == 101
    assert rows[0]["N"] == 11 and rows[0]["lower"] == 0 and rows[0]["upper"] == 10  # 0 joins the first bin
    assert all(r["N"] == 10 for r in rows[1:])


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) + 1e6
    x[:, 2] = x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=500)
    x[rng.random((500, 3)) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(k=3.0)
    got = {(r.a, r.b): r.r for r in R.correlation_matrix(spark.createDataFrame(pdf), ["a", "b", "c", "k"]).collect()}
    want = pdf.corr()
    for (a, b), r in got.items():
        assert r is None if "k" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_histogram_of_a_constant(spark):
    rows = R.histogram(spark.createDataFrame([(3.0,)] * 9, "v double"), ["v"]).collect()
    assert [r["N"] for r in rows] == [9] and rows[0]["lower"] <= 3.0 <= rows[0]["upper"]


def test_constant_column_cannot_be_scaled(spark):
    df = spark.createDataFrame([(1.0, "x"), (1.0, "x"), (2.0, "y"), (5.0, "y")], "v double, k string")
    R.standardise(df, ["v"]).collect()
    with pytest.raises(Exception, match="v is constant"):
        R.standardise(df, ["v"], ["k"]).collect()


def test_missing_counts_see_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "v double, k string")
    assert {r["column"]: r["missing"] for r in R.missing_counts(df).collect()} == {"v": 2, "k": 1}


# --- panel -------------------------------------------------------------------


def test_sum_of_all_missing_is_zero(spark):
    df = spark.createDataFrame([(None, float("nan")), (1.0, None), (1.5, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(P.row_sum("a", "b")).collect()] == [0.0, 1.0, 3.5]


def test_duplicate_keys_multiply(spark):
    left = spark.createDataFrame([(0, 0, 2000, 1)], "col int, row int, Year int, Month int")
    right = spark.createDataFrame([(0, 0, 2000, 1, 5.0), (0, 0, 2000, 1, 6.0)], "col int, row int, Year int, Month int, v double")
    assert P.join_monthly(left, right).count() == 2


def test_drop_incomplete_takes_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (2.0, None)], "v double, k string")
    assert [r["k"] for r in P.drop_incomplete(df).collect()] == ["a"]


def test_relabel_needs_both_levels(spark):
    df = spark.createDataFrame([("x",), ("x",)], "k string")
    with pytest.raises(ValueError, match="levels"):
        P.relabel(df, "k", ("IDL", "No_IDL"))
    three = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    with pytest.raises(ValueError, match="levels"):
        P.relabel(three, "k", ("IDL", "No_IDL"))


def test_strict_log_refuses_zero(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(S.strict_log("v")).collect()] == [0.0, None]
    with pytest.raises(Exception, match="not positive"):
        spark.createDataFrame([(0.0,)], "v double").select(S.strict_log("v")).collect()


def test_filters_drop_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (None, 1.0, 1.0), (0.0, 2.0, 2.0)], "Size double, Ignitions double, Duration double")
    assert P.fire_presence(df).count() == 1


# --- grid --------------------------------------------------------------------


def test_base_grid_rows_per_year(spark):
    cells = G.grid_cells(spark, G.Grid(0, 3, 0, 2, 3, 2))
    panel = G.grid_by_timeline(cells, 2003, 2005)
    assert {r["Year"]: r["N"] for r in R.count_by(panel, "Year").collect()} == {2003: 72, 2004: 72, 2005: 72}


def test_cell_centres_and_indices(spark):
    corner = G.grid_cells(spark).where("col = 0 AND row = 0").first()
    assert (corner.x, corner.y) == (-179.875, 89.875)
    assert G.grid_cells(spark).where("col = 1439 AND row = 719").select("x", "y").first() == (179.875, -89.875)
    g = G.GLOBAL
    got = spark.range(1).select(g.col_of(F.lit(180.0)), g.col_of(F.lit(180.01)), g.row_of(F.lit(-90.0)), g.row_of(F.lit(90.0))).first()
    assert tuple(got) == (1439, None, 719, 0)


def test_layers_past_the_timeline_are_dropped(spark):
    layers = G.layer_period(spark.range(200).withColumnRenamed("id", "layer"), 2003, 2016)
    assert layers.count() == 168
    assert layers.where("layer = 167").select("Year", "Month").first() == (2016, 12)
    assert G.timeline(spark, 2003, 2016, monthly=False).count() == 14


def test_regrid_brute_force(spark):
    rng = np.random.default_rng(5)
    source, target = G.Grid(-7.3, 11.1, -4.2, 8.8, 7, 5), G.Grid(-10, 12, -6, 9, 31, 23)
    values = {(c, r): float(rng.integers(0, 100)) for c in range(7) for r in range(5) if rng.random() < 0.8}
    df = spark.createDataFrame([(c, r, v) for (c, r), v in values.items()], "col int, row int, value double")
    got = {(r.col, r.row): r.value for r in G.regrid_nearest(df, source, target).collect()}
    want = {}
    for c in range(31):
        for r in range(23):
            x, y = -10 + (c + 0.5) * 22 / 31, 9 - (r + 0.5) * 15 / 23
            if -7.3 <= x <= 11.1 and -4.2 <= y <= 8.8:
                at = (min(int((x + 7.3) / source.xres), 6), min(int((8.8 - y) / source.yres), 4))
                if at in values:
                    want[c, r] = values[at]
    assert got == want


def test_extents():
    lon, lat = [0.5, 1.5, 2.5], [10.0, 12.0]
    assert G.extent_of(lon, lat) == G.Grid(0.0, 3.0, 9.0, 13.0, 3, 2)
    assert G.extent_of(lon, lat, "centres") == G.Grid(0.5, 2.5, 10.0, 12.0, 3, 2)


def inside(rings, x, y):
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
                hits += 1
    return hits % 2 == 1


def test_rasterize_brute_force(spark):
    grid = G.Grid(0, 10, 0, 10, 20, 20)
    features = {
        1: ("a", [[(0.25, 0.25), (9.75, 0.25), (9.75, 9.75), (0.25, 9.75)], [(3, 3), (7, 3.5), (6.2, 7)]]),  # corner on a centre, hole
        2: ("b", [[(-5, 4), (5, 12), (14, 5.1), (5, 5.0)]]),  # reaches outside the grid, concave
        3: ("c", [[(2.25, 2.25), (4.75, 2.25), (4.75, 2.75), (2.25, 2.75)]]),  # edges through centres
    }
    rows = [(f, a, [{"x": float(x), "y": float(y)} for x, y in ring]) for f, (a, rings) in features.items() for ring in rings]
    df = spark.createDataFrame(rows, "feature bigint, who string, ring array<struct<x: double, y: double>>")
    got = {(r.col, r.row): r.who for r in rasterize(df, "who", grid).collect()}
    want = {}
    for c in range(20):
        for r in range(20):
            x, y = (c + 0.5) * 0.5, 10 - (r + 0.5) * 0.5
            for f, (a, rings) in features.items():
                if inside(rings, x, y):
                    want[c, r] = a
    assert got == want


def test_closed_and_open_rings_agree(spark):
    ring = [(1.0, 1.0), (8.0, 2.0), (4.0, 9.0)]
    grid = G.Grid(0, 10, 0, 10, 20, 20)

    def cells(points):
        rows = [(1, "a", [{"x": x, "y": y} for x, y in points])]
        df = spark.createDataFrame(rows, "feature bigint, who string, ring array<struct<x: double, y: double>>")
        return {(r.col, r.row) for r in rasterize(df, "who", grid).collect()}

    assert cells(ring) == cells(ring + ring[:1]) != set()


# --- files -------------------------------------------------------------------


def test_ascii_grid_file(spark, tmp_path):
    (tmp_path / "p2003AD.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner -1\ncellsize 0.5\nNODATA_value -9999\n1 2.5 -9999\n-9999 4e1 0\n")
    rows = {(r.col, r.row): (r.x, r.y, r.value) for r in ascii_grid.ascii_grids(spark, str(tmp_path), "*.asc").collect()}
    assert rows == {(0, 0): (10.25, -0.25, 1.0), (1, 0): (10.75, -0.25, 2.5), (1, 1): (10.75, -0.75, 40.0), (2, 1): (11.25, -0.75, 0.0)}


def test_feature_collection_with_multipolygon(spark, tmp_path):
    (tmp_path / "f.json").write_text(
        '{"type": "FeatureCollection", "features": [\n {"type": "Feature", "properties": {"FID": 3, "NAME": "two"}, "geometry": {"type": "MultiPolygon",'
        ' "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},\n {"type": "Feature", "properties": {"FID": 4, "NAME": "one"},'
        ' "geometry": {"type": "Polygon", "coordinates": [[[2, 2], [3, 2], [3, 3], [2, 2]]]}}]}'
    )
    rings = polygons.polygon_rings(spark, str(tmp_path / "f.json"), {"FID": "bigint", "NAME": "string"}, "FID", collection=True)
    rows = sorted((r.feature, r.NAME, r.ring[0].x) for r in rings.collect())
    assert rows == [(3, "two", 0.0), (3, "two", 5.0), (4, "one", 2.0)]


def test_csv_missing_marks_and_absent_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a\n1.5,x\nNA,y\n,z\n")
    rows = tables.csv_table(spark, str(tmp_path / "t.csv"), {"a": "string", "b": "double"}).collect()
    assert [tuple(r) for r in rows] == [("x", 1.5), ("y", None), ("z", None)]
    with pytest.raises(ValueError, match="not in the header"):
        tables.csv_table(spark, str(tmp_path / "t.csv"), {"c": "int"})


def test_shared_folder_is_required_on_a_cluster():
    from emberframe.lineage import shared_folder

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default):
            return self.value or default

    class Fake:
        def __init__(self, master, value=None):
            self.conf = Conf(value)
            self.sparkContext = type("C", (), {"master": master})

    assert shared_folder(Fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Fake("yarn"))


def test_ascii_grid_over_several_splits(spark, tmp_path):
    """One file is many tasks; lines need not be rows; centres instead of corners; an empty grid."""
    rng = np.random.default_rng(2)
    grid = np.round(rng.normal(size=(60, 40)), 3)
    grid[rng.random(grid.shape) < 0.2] = -9999
    words = [repr(float(v)) for v in grid.ravel()]
    lines = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    header = "NCOLS 40\nNROWS 60\nXLLCENTER 10.25\nYLLCENTER -0.75\nCELLSIZE 0.5\nNODATA_VALUE -9999\n"
    (tmp_path / "a.asc").write_text(header + " \t" + "\r\n".join(lines) + "\n\n")
    (tmp_path / "b.asc").write_text("ncols 2\nnrows 1\nxllcorner 0\nyllcorner 0\ncellsize 1\n5 nan\n")
    (tmp_path / "c.asc").write_text("ncols 0\nnrows 0\nxllcorner 0\nyllcorner 0\ncellsize 1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert spark.read.text(str(tmp_path / "a.asc")).rdd.getNumPartitions() > 5
        rows = ascii_grid.ascii_grids(spark, str(tmp_path), "*.asc").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {(r.row, r.col): r for r in rows if r.path.endswith("a.asc")}
    assert {k: r.value for k, r in first.items()} == {(i, j): v for (i, j), v in np.ndenumerate(grid) if v != -9999}
    r = next(iter(first.values()))
    assert (r.xll, r.yll, r.x, r.y) == (10.0, -1.0, 10.0 + (r.col + 0.5) * 0.5, -1.0 + (60 - r.row - 0.5) * 0.5)
    assert [(r.col, r.row, r.value) for r in rows if r.path.endswith("b.asc")] == [(0, 0, 5.0)] and len(rows) == len(first) + 1
