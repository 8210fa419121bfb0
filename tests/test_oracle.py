"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
BATCH = {"duration_models", "presence_models"}  # their panel is too thin at this size; see test_workflow


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert differences(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - BATCH))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_survey_entry_is_covered():
    from checks.registry import COVERS

    counts = {"SC": 7, "SK": 5, "GR": 12, "PF": 24, "JN": 7, "AG": 15, "SF": 10, "SL": 3, "SO": 1, "ML": 24}
    wanted = {f"{k}{i}" for k, n in counts.items() for i in range(1, n + 1)}
    assert wanted - {c for ids in COVERS.values() for c in ids} == set()
