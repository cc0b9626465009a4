"""Fit and apply scaling and one-hot encoding.

What is fitted is a mean and a scale per numeric column, a sorted list
of categories per categorical one. It is turned into ordinary Spark ML stages
(``SQLTransformer``, ``StringIndexerModel``, ``OneHotEncoderModel``,
``VectorAssembler``), so saving and loading is the ``PipelineModel`` format; the
vectors are sparse, so the number of categories costs a row nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.session import staged


@dataclass(frozen=True)
class Preparation:
    """Fitted parameters, and the column order they produce."""

    scale: Mapping[str, tuple[float, float]]
    categories: Mapping[str, Sequence[str]]

    @property
    def feature_order(self) -> list[str]:
        coded = [f"ohe_{c}_{i}" for c, values in self.categories.items() for i in range(len(values))]
        return [*self.scale, *coded]


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return row.asDict()


def fill_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers → mean of the column."""
    means = {c: v for c, v in column_means(df, columns).items() if v is not None}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in means.items()})


def scaling_stats(df: DataFrame, columns: Sequence[str] = cfg.NUMERIC_FEATURES) -> DataFrame:
    """Mean and scale per column as rows (column, mean, scale).

    The deviation is that of the mean-imputed column: filled values add
    nothing to the squared sum but count as rows. A constant column has scale 1.
    """
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"), F.count(v).alias(f"n{i}")]
    rows = []
    for i, c in enumerate(columns):
        spread = F.sqrt(F.col(f"v{i}") * F.col(f"n{i}") / F.col("__rows"))
        scale = F.when(spread > 0, spread).otherwise(1.0)
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), scale.alias("scale")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def category_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct categories as text. The list is part of the fitted model, as that of any string index."""
    found = df.select(F.col(column).cast("string").alias("c")).filter("c is not null").distinct().collect()
    return sorted(r["c"] for r in found)


def category_places(df: DataFrame, column: str) -> DataFrame:
    """(category, place): the sorted distinct categories as text, numbered from 0, for columns with any number of them.

    The sorted table is numbered by its parts; the driver sees one line for each part.
    """
    found = df.select(F.col(column).cast("string").alias("category")).filter("category is not null").distinct()
    ordered = staged(found.orderBy("category").withColumn("at", F.monotonically_increasing_id()), "categories")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    shifts, before = [], 0
    for part in ordered.groupBy("part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("k")).orderBy("part").collect():
        shifts.append((part["part"], before - part["low"]))
        before += part["k"]
    parts = df.sparkSession.createDataFrame(shifts, "part long, shift long")
    return ordered.join(F.broadcast(parts), "part").select("category", (F.col("at") + F.col("shift")).alias("place"))


def with_places(df: DataFrame, column: str, out: str = "place") -> DataFrame:
    """Add the place of each row's category; a missing category has the number after the last one, as in ``as_stages``."""
    places = category_places(df, column).select(F.col("category").alias("__category"), F.col("place").alias("__place"))
    last = places.count()
    met = df.join(places, F.col(column).cast("string") == F.col("__category"), "left")
    kept = [c for c in df.columns if c != out]
    return met.select(*kept, F.coalesce("__place", F.lit(last).cast("long")).alias(out))


def fit_preparation(
    df: DataFrame,
    numeric: Sequence[str] = cfg.NUMERIC_FEATURES,
    categorical: Sequence[str] = cfg.CATEGORICAL_FEATURES,
    fit_on: Column | None = None,
) -> Preparation:
    """Fit on all rows, or on the rows of ``fit_on`` to keep test rows out."""
    rows = df if fit_on is None else df.filter(fit_on)
    stats = scaling_stats(rows, numeric).collect() if numeric else []
    fitted = {r["column"]: (r["mean"], r["scale"]) for r in stats}
    scale = {c: (0.0 if fitted[c][0] is None else fitted[c][0], fitted[c][1]) for c in numeric}
    return Preparation(scale, {c: category_values(rows, c) for c in categorical})


def scaled_columns(prep: Preparation, impute: bool = False) -> dict[str, Column]:
    """(x - mean) / scale; NULL stays NULL unless ``impute`` (then 0, the mean)."""
    out = {}
    for c, (mean, scale) in prep.scale.items():
        value = (F.col(c).cast("double") - F.lit(mean)) / F.lit(scale)
        out[c] = F.coalesce(value, F.lit(0.0)) if impute else value
    return out


def encoded_columns(prep: Preparation) -> dict[str, Column]:
    """One 0/1 column per category; unknown and missing values give zeros. For wide tables; models take ``as_stages``."""
    return {
        f"ohe_{c}_{i}": F.coalesce((F.col(c).cast("string") == value).cast("double"), F.lit(0.0))
        for c, values in prep.categories.items()
        for i, value in enumerate(values)
    }


def transform(df: DataFrame, prep: Preparation, keep: Sequence[str] = (), impute: bool = False) -> DataFrame:
    """Scaled and encoded columns next to the kept ones."""
    made = {**scaled_columns(prep, impute), **encoded_columns(prep)}
    return df.select(*[F.col(k).alias(k) for k in keep if k not in made], *[c.alias(n) for n, c in made.items()])


def _coding(names: Sequence[str], prep: Preparation) -> list:
    """Category → number → sparse 0/1 vector. An unknown or missing category has the number after the last one and no 1."""
    coders = [
        StringIndexerModel.from_labels(list(prep.categories[c]), f"x_text_{c}", f"x_code_{c}", "keep") for c in names
    ]
    rows = SparkSession.active().createDataFrame([], ", ".join(f"`x_text_{c}` string" for c in names))
    for coder in coders:
        rows = coder.transform(rows)
    # The sizes stand in the columns' metadata, so nothing is read here.
    encoder = OneHotEncoder(inputCols=[f"x_code_{c}" for c in names], outputCols=[f"x_ohe_{c}" for c in names])
    return [*coders, encoder.fit(rows)]


def as_stages(prep: Preparation, impute: bool = True, out: str = "features") -> list:
    """The same transformation as ML stages that can be saved and loaded.

    Scaled columns get the prefix ``x_``, so the original ones stay readable
    next to the scores; a category's number is in ``x_code_`` and its column's name.
    """
    parts = []
    for c, (mean, scale) in prep.scale.items():
        value = f"(CAST(`{c}` AS DOUBLE) - CAST({mean!r} AS DOUBLE)) / CAST({scale!r} AS DOUBLE)"
        parts.append(f"COALESCE({value}, 0.0D) AS `x_{c}`" if impute else f"{value} AS `x_{c}`")
    coded = [c for c, values in prep.categories.items() if values]
    parts += [f"CAST(`{c}` AS STRING) AS `x_text_{c}`" for c in coded]
    sql = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    assemble = VectorAssembler(
        inputCols=[*[f"x_{c}" for c in prep.scale], *[f"x_ohe_{c}" for c in coded]], outputCol=out, handleInvalid="keep"
    )
    return [sql, *(_coding(coded, prep) if coded else []), assemble]


def design_matrix(
    df: DataFrame,
    prep: Preparation,
    keys: Sequence[str] = ("scenario_id", "ts_start_ns"),
    label: str = cfg.TARGET,
    impute: bool = False,
) -> DataFrame:
    """Keys, label and feature vector in one table, so nothing is aligned by position."""
    matrix = PipelineModel(as_stages(prep, impute)).transform(df)
    return matrix.select(*keys, F.col(label).cast("int").alias("label"), "features")


def same_contract(prep: Preparation, expected: Sequence[str]) -> None:
    """Raise unless the feature order is exactly the expected one."""
    if list(prep.feature_order) != list(expected):
        raise ValueError("feature order differs from the one the model was trained with")
