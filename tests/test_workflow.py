"""The batch over biomes on a panel built from the mid-size tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.panels import full_panel
from emberframe.lineage import materialise
from emberframe.operators.ols import fit_ols
from emberframe.plans.models import MODELS
from emberframe.plans.workflow import model_table, run_response

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def panel(spark):
    return materialise(full_panel(spark, FOLDER), "panel")


def test_settings():
    assert len(MODELS) == 28
    assert {(m.biome, m.response) for m in MODELS} == {
        (b, r) for b in (1, 2, 4, 6, 7, 8, 13) for r in ("Fire", "Duration", "Ignitions", "Size")
    }
    widths = {m.biome: len(m.full()) for m in MODELS if m.response == "Size"}
    assert widths == {1: 54, 2: 50, 4: 50, 6: 50, 7: 46, 8: 50, 13: 46}
    for m in MODELS:
        assert m.final in m.fixed_parts()


def test_continuous_response(spark, panel, tmp_path):
    results = run_response(panel, "Size", biomes=(2, 7))
    assert results.skipped == {}
    kinds = {(f.stratum, f.kind) for f in results.fits}
    assert {k for _, k in kinds} == {"ols", "gls_reml", "lme_reml", "lme_ml"}
    table = model_table(panel, [m for m in MODELS if m.response == "Size" and m.biome in (2, 7)])
    model = next(m for m in MODELS if m.response == "Size" and m.biome == 7)
    alone = fit_ols(table.where("Biomes = 7"), "Size", {"full": model.full()})[0]
    batch = next(f for f in results.fits if f.stratum == "7" and f.label == "full" and f.kind == "ols")
    np.testing.assert_allclose(alone.beta, batch.beta, rtol=1e-6, atol=1e-8)
    equal = next(f for f in results.fits if f.stratum == "7" and f.label == "equal")
    np.testing.assert_allclose(equal.beta, batch.beta, rtol=1e-6, atol=1e-8)
    assert len(results.gams) == 2
    for _ in range(2):  # writing again replaces
        results.write(spark, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/quality")).count() == len(results.fits)


def test_presence(panel):
    results = run_response(panel, "Fire", biomes=(1, 6), gam=False)
    labels = {(f.stratum, f.label) for f in results.fits}
    assert {("1", "linear"), ("1", "full"), ("1", "reduced1"), ("6", "reduced2")} <= labels
    for f in results.fits:
        assert f.converged and f.extra["largest_score"] < 1e-4


def test_thin_strata_are_named(panel):
    results = run_response(panel.where("Biomes <> 4 OR (col = 2 AND Year = 1996)"), "Size", biomes=(4,), gam=False)
    assert list(results.skipped) == ["4"] and results.fits == []


def test_unfit_biomes_leave_the_others_alone(spark, panel):
    odd = panel.where("Biomes <> 6 OR (col = 3 AND row = 1 AND Year = 1996 AND Month = 5)")
    odd = odd.withColumn("LC_Crop", F.when(F.col("Biomes") == 1, F.lit(0.0)).otherwise(F.col("LC_Crop")))
    odd = odd.withColumn("IDL_Layer", F.when(F.col("Biomes") == 2, F.lit("Indigenous Land")).otherwise(F.col("IDL_Layer")))
    results = run_response(odd, "Fire", biomes=(1, 2, 6, 7), gam=False)
    reasons = {s: reason for s, (_, reason) in results.skipped.items()}
    assert reasons["1"] == "LC_Crop constant" and reasons["2"] == "IDL_Layer has one level"
    assert reasons["6"].startswith("too few rows")
    assert {f.stratum for f in results.fits} == {"7"}
    table = results.tables(spark)["quality"]
    assert {r["stratum"] for r in table.where("kind = 'skipped'").collect()} == {"1", "2", "6"}
