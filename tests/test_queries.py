"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from signalsift.catalog import ORACLES
from signalsift.catalog import QUERIES as OWN

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()
#: Fitting trees on all rows is covered by the model tests.
MODELS = {"t4_held_out_scores", "t6_final_model", "t19_feature_importance", "x4_alerts", "o1_parameter_search", "o5_refit_best"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in OWN if n not in MODELS])
def test_query(spark, con, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


def test_names():
    """Optional parts may add queries; those have their own tests."""
    assert set(SQL) <= set(QUERIES) and set(OWN) <= set(QUERIES)
    assert set(OWN) - set(ORACLES) == MODELS


def test_entry(spark):
    table = entry.entry(spark)
    assert len(table.columns) == 33 and table.count() > 0
