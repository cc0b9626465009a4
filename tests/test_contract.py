"""The stored contract of a design matrix."""

from __future__ import annotations

import pytest
from conftest import rows

from signalsift.operators import contract as ct
from signalsift.operators.prep import fit_preparation


@pytest.fixture
def table(spark):
    data = [(1, 1.0, 2, "b", "x"), (2, 3.0, 2, "a", None), (3, None, 2, "b", "é"), (4, 5.0, None, None, "x")]
    return spark.createDataFrame(data, "id int, a double, n int, c string, d string")


def test_round_trip_and_refusal(spark, table, tmp_path):
    made = ct.fitted_contract(table, ["a", "n"], ["c", "d"])
    path = ct.save_contract(made, str(tmp_path / "contract"))
    stored = ct.load_contract(spark, path, ct.fitted_contract(table, ["a", "n"], ["c", "d"]))
    assert [r["feature"] for r in stored.orderBy("position").collect()] == fit_preparation(table, ["a", "n"], ["c", "d"]).feature_order
    with pytest.raises(ValueError, match="moved"):
        ct.load_contract(spark, path, ct.fitted_contract(table, ["n", "a"], ["c", "d"]))
    with pytest.raises(ValueError, match="missing"):
        ct.load_contract(spark, path, ct.fitted_contract(table, ["a", "n"], ["c"]))
    # A category that comes in between takes another one's place.
    more = table.unionByName(spark.createDataFrame([(5, 1.0, 1, "aa", "x")], table.schema))
    found = ct.contract_differences(stored, ct.fitted_contract(more, ["a", "n"], ["c", "d"]))
    assert rows(found) == [("ohe_c_1", "changed"), ("ohe_c_2", "new"), ("ohe_d_0", "moved"), ("ohe_d_1", "moved")]


def test_applied(spark, table):
    stored = ct.fitted_contract(table, ["a"], ["c", "d"])
    new = table.unionByName(spark.createDataFrame([(5, 3.0, 1, "zz", "x")], table.schema))
    got = {r["id"]: (r["scaled"], r["ones"]) for r in ct.applied_contract(new, stored, ["id"]).collect()}
    assert got[1][1] == [2, 3] and got[2] == ([0.0], [1]) and got[3] == ([None], [2, 4]) and got[4][1] == [3] and got[5] == ([0.0], [3])


def test_empty(spark, table):
    empty = ct.fitted_contract(table.limit(0), ["a"], ["c"])
    assert rows(empty.select("feature", "mean")) == [("a", 0.0)]
    assert ct.applied_contract(table.limit(0), empty, ["id"]).count() == 0
    assert ct.fitted_contract(table, []).count() == 0
