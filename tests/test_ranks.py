"""Exact order statistics: every path, and how often the data is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import ranks as R

PROBABILITIES = {f"p{i}": i / 20 for i in range(21)}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A hot group, ties, a wide range of magnitudes, a single value, a missing key, missing values."""
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in np.exp(rng.normal(scale=6, size=30_000))]
    rows += [("ties", float(v)) for v in rng.integers(0, 7, 4000)]
    rows += [("wide", v) for v in (-1e300, -1.0, 0.0, 5e-324, 1e300)] + [("one", 3.5), (None, 1.0), (None, 2.0), ("none", None), ("hot", float("nan"))]
    path = str(tmp_path_factory.mktemp("skewed") / "rows")
    spark.createDataFrame(rows, "k string, v double").withColumn("other", F.lit("x" * 50)).repartition(7).write.parquet(path)
    want = {}
    for k in ("hot", "ties", "wide", "one", None):
        x = np.array([v for g, v in rows if g == k and v is not None and v == v])
        want[k] = np.quantile(x, list(PROBABILITIES.values()))
    return spark.read.parquet(path), want


@pytest.mark.parametrize(("margin", "ordered", "sketch"), [(R.MARGIN, R.ORDERED, R.SKETCH), (0.0, R.ORDERED, 8), (R.MARGIN, 8, R.SKETCH), (0.0, 20, 8)])
def test_quantiles_are_exact_on_every_path(skewed, monkeypatch, margin, ordered, sketch):
    """With good sketches, with brackets that miss their rank, and with brackets narrowed by bins."""
    monkeypatch.setattr(R, "MARGIN", margin)
    monkeypatch.setattr(R, "ORDERED", ordered)
    monkeypatch.setattr(R, "SKETCH", sketch)
    df, want = skewed
    rows = R.quantiles(df, ["k"], ["v"], PROBABILITIES).collect()
    assert {r["k"] for r in rows} == set(want)
    for r in rows:
        np.testing.assert_allclose([r[p] for p in PROBABILITIES], want[r["k"]], rtol=1e-12)
        assert r["n"] == {"hot": 30_000, "ties": 4000, "wide": 5, "one": 1, None: 2}[r["k"]]


def test_the_data_is_read_twice(skewed, monkeypatch):
    df, _ = skewed
    source = df.inputFiles()[0].split("/")[-3]
    plan_of = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    reads, store = [], R.materialise

    def noted(frame, label="table", **more):
        reads.extend([label] * plan_of(frame).count(source))
        return store(frame, label, **more)

    monkeypatch.setattr(R, "materialise", noted)
    out = R.quantiles(df, ["k"], ["v"], {"q": 0.3, "r": 0.9})
    assert reads == ["sizes", "survivors"] and source not in plan_of(out)
    assert "other" not in plan_of(R.long_form(df, ["k"], ["v"])).split("ReadSchema")[1]


def test_empty_and_all_missing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert R.quantiles(df, ["k"], ["v"], {"q": 0.5}).collect() == []
    assert R.quantiles(df.limit(0), [], ["v"], {"q": 0.5}).collect() == []
