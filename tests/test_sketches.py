"""Profiles kept per part and merged, against exact figures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from signalsift.operators import sketches as sk
from signalsift.operators.quantiles import exact_quantiles

NUMBERS = "part string, x double, y int"


def table(spark):
    """One part holds a third of all rows; x is skewed, y has few values."""
    n = F.col("id")
    part = F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (n % 17).cast("string")))
    return spark.range(60_000).select(
        part.alias("part"), F.pow(n % 9973, 2).alias("x"), F.when(n % 10 != 0, (n % 7).cast("int")).alias("y")
    )


def test_merged_parts_are_the_whole(spark):
    df = table(spark)
    stored = sk.sketched(df.where("part = 'hot'"), "part", ["x", "y"])
    stored = stored.unionByName(sk.sketched(sk.new_parts(df, "part", stored), "part", ["x", "y"]))
    assert stored.count() == 2 * df.select("part").distinct().count()
    got = {r["column"]: r for r in sk.merged_profile(stored, (0.0, 0.1, 0.5, 0.99, 1.0)).collect()}
    assert (got["x"]["n"], got["x"]["nulls"], got["x"]["low"], got["x"]["high"]) == (60_000, 0, 0.0, 9972.0**2)
    assert (got["y"]["n"], got["y"]["nulls"], got["y"]["distinct_values"]) == (54_000, 6_000, 7)
    assert abs(got["x"]["distinct_values"] - 9973) <= sk.DISTINCT_ERROR * 9973
    for p, q in zip((0.0, 0.1, 0.5, 0.99, 1.0), got["x"]["quantiles"]):
        below, upto = df.agg(F.avg((F.col("x") < q).cast("double")), F.avg((F.col("x") <= q).cast("double"))).first()
        assert below - sk.RANK_ERROR <= p <= upto + sk.RANK_ERROR


def test_merging_twice_and_in_groups(spark):
    stored = sk.sketched(table(spark), "part", ["x"])
    once = sk.merged(stored.withColumn("hot", F.col("part") == "hot"), ["hot"])
    assert {r["hot"]: r["n"] for r in sk.merged_profile(once, by=["hot"]).collect()} == {True: 20_000, False: 40_000}
    whole, again = sk.merged_profile(stored).first(), sk.merged_profile(once).first()
    assert whole["distinct_values"] == again["distinct_values"] and whole["n"] == again["n"]


def test_odd_values(spark):
    rows = [(None, 1.0, None), (None, math.nan, None), ("a", -0.0, None), ("a", 0.0, None), ("a", None, None), ("b", math.inf, None)]
    df = spark.createDataFrame(rows, NUMBERS)
    stored = sk.sketched(df, "part", ["x", "y"])
    assert stored.count() == 6
    got = {r["column"]: r for r in sk.merged_profile(stored, (0.5,)).collect()}
    assert (got["x"]["n"], got["x"]["nulls"], got["x"]["high"], got["x"]["distinct_values"]) == (4, 2, math.inf, 3)
    assert (got["y"]["n"], got["y"]["low"], got["y"]["distinct_values"], got["y"]["quantiles"]) == (0, None, 0, [None])
    assert sk.new_parts(df, "part", stored).count() == 0
    empty = df.limit(0)
    assert sk.merged_profile(sk.sketched(empty, "part", ["x"])).count() == 0
    assert sk.sketched_quantiles(empty, ["x"]) == {"x": [None]}


def test_near_exact_quantiles(spark):
    df = table(spark)
    (told,), (exact,) = sk.sketched_quantiles(df, ["x"])["x"], exact_quantiles(df, ["x"])["x"]
    assert abs(math.sqrt(told) - math.sqrt(exact)) <= 9973 * sk.RANK_ERROR
