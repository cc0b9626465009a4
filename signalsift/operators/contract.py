"""The contract of a design matrix as a table: which feature stands at which position, and how it is made.

One row per position, so any number of categories is a matter of rows: they are numbered,
compared and looked up by joins and never listed on the driver. Stored next to a model, it
tells at load whether a table was prepared in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsift.operators.prep import category_places, scaling_stats

SCHEMA = "position long, feature string, source string, category string, mean double, scale double"


def fitted_contract(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """``SCHEMA`` of the scaled columns, then the categories of each categorical column, sorted as text.

    NULL is no category. An empty numeric column has the mean 0, so that its rows scale to
    NULL; a categorical one without values has no rows.
    """
    spark = df.sparkSession
    order = spark.createDataFrame([(i, c) for i, c in enumerate(numeric)], "position long, source string")
    none = F.lit(None).cast("string")
    made = spark.createDataFrame([], SCHEMA)
    if numeric:
        stats = scaling_stats(df, numeric).withColumnRenamed("column", "source")
        scaled = order.join(stats, "source").select(
            "position", F.col("source").alias("feature"), "source", none.alias("category"), F.coalesce("mean", F.lit(0.0)).alias("mean"), "scale"
        )
        made = made.unionByName(scaled)
    before, nothing = len(numeric), F.lit(None).cast("double")
    for c in categorical:
        places = category_places(df, c)
        name = F.concat(F.lit(f"ohe_{c}_"), F.col("place").cast("string"))
        made = made.unionByName(
            places.select(
                (F.col("place") + F.lit(before)).alias("position"), name.alias("feature"), F.lit(c).alias("source"), "category",
                nothing.alias("mean"), nothing.alias("scale"),
            )
        )
        before += places.count()
    return made


def save_contract(contract: DataFrame, path: str) -> str:
    contract.write.mode("overwrite").parquet(path)
    return path


def load_contract(spark: SparkSession, path: str, given: DataFrame | None = None) -> DataFrame:
    """The stored contract; with ``given``, raise unless that one has the same features in the same order."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    if given is not None:
        wrong = contract_differences(stored, given).orderBy("feature").limit(10).collect()
        if wrong:
            raise ValueError("features differ from the stored contract: " + ", ".join(f"{r['feature']} ({r['what']})" for r in wrong))
    return stored


def contract_differences(stored: DataFrame, given: DataFrame) -> DataFrame:
    """``feature, what`` of the features that are ``missing``, ``new``, ``moved``, or made of something else (``changed``).

    Means and scales are not compared: those of the stored contract are the ones to use.
    """
    left = stored.select("feature", F.struct("position", "source", "category").alias("was"))
    right = given.select("feature", F.struct("position", "source", "category").alias("is"))
    same = F.col("was.source").eqNullSafe(F.col("is.source")) & F.col("was.category").eqNullSafe(F.col("is.category"))
    what = (
        F.when(F.col("is").isNull(), "missing")
        .when(F.col("was").isNull(), "new")
        .when(F.col("was.position") != F.col("is.position"), "moved")
        .when(~same, "changed")
    )
    return left.join(right, "feature", "full").select("feature", what.alias("what")).where("what is not null")


def applied_contract(df: DataFrame, contract: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``scaled`` (values in order, NULL stays NULL) and ``ones``: the positions of the row's categories.

    A category is looked up by a join, so its table may have any size; unknown and missing ones have no position.
    """
    numeric = contract.where("category is null").orderBy("position").collect()  # one row per numeric column
    coded = sorted(r["source"] for r in contract.where("category is not null").select("source").distinct().collect())
    scaled = [(F.col(r["source"]).cast("double") - F.lit(r["mean"])) / F.lit(r["scale"]) for r in numeric]
    scaled = F.array(*scaled) if scaled else F.array().cast("array<double>")
    out = df.select(*keep, scaled.alias("scaled"), *[F.col(c).cast("string").alias(f"__text{i}") for i, c in enumerate(coded)])
    for i, c in enumerate(coded):
        places = contract.where(F.col("source") == c).select(F.col("category").alias(f"__text{i}"), F.col("position").alias(f"__at{i}"))
        out = out.join(places, f"__text{i}", "left")
    ones = F.array(*[F.col(f"__at{i}") for i in range(len(coded))]) if coded else F.array().cast("array<long>")
    return out.select(*keep, "scaled", F.array_sort(F.array_compact(ones)).alias("ones"))
