"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from conftest import SF
from oracle_check import compare

from barlytics import catalog

# Queries without a SQL form; their operators are tested on fixtures.
NO_SQL = {
    "m03_fit_classifier", "m10_permutation_importance", "m11_model_promotable",
}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    _, problem = compare(spark, duck, SF, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_only_known_queries_lack_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == NO_SQL


def test_entry(spark):
    import __spark_entry__ as entry

    # 180 LONG and 158 SHORT rows.
    assert entry.entry(spark).count() == 338
