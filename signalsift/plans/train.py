"""Boosted-tree training, held-out scoring by scenario, and parameter search.

Everything after the model is a query over one long table of held-out
predictions; train once, store it (``sources.sinks``), ask often.
"""

from __future__ import annotations

import math
import random
import threading
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions.numeric import ratio
from signalsift.operators.folds import assign_folds, test_part, training_part
from signalsift.operators.metrics import LABEL, SCORE, rank_metrics
from signalsift.operators.prep import Preparation, as_stages, fit_preparation
from signalsift.session import shared_folder, staged

#: Parameters of the configured model that boosted trees in Spark ML do not have.
WITHOUT_EQUIVALENT = ("reg_alpha", "reg_lambda")
#: Training rows of a part: fewer make jobs of nothing but start-up.
ROWS_PER_PART = 20_000
POOL = "spark.scheduler.pool"


def model_parameters(params: Mapping[str, float] = cfg.BOOSTING) -> tuple[dict, dict]:
    """Configured parameters → (those of ``GBTClassifier``, ignored ones)."""
    per_node = params.get("colsample_bytree", 1.0) * params.get("colsample_bylevel", 1.0)
    mapped = {
        "maxIter": int(params["n_estimators"]),
        "maxDepth": int(params["max_depth"]),
        "stepSize": float(params["learning_rate"]),
        "subsamplingRate": float(params.get("subsample", 1.0)),
        "featureSubsetStrategy": "all" if per_node >= 1 else repr(round(per_node, 6)),
        "minInfoGain": float(params.get("gamma", 0.0)),
        "minInstancesPerNode": int(params.get("min_child_weight", 1)),
        "seed": int(params.get("random_state", 42)),
    }
    return mapped, {k: v for k, v in params.items() if k in WITHOUT_EQUIVALENT}


def positive_weight(df: DataFrame, label: str = cfg.TARGET) -> float:
    """Negatives per positive; 1 if there is no positive."""
    row = df.agg(ratio(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1))).first()
    return float(row[0]) if row[0] else 1.0


def classifier(params: Mapping[str, float], overrides: Mapping[str, object] | None = None) -> GBTClassifier:
    mapped, _ = model_parameters(params)
    mapped.update(overrides or {})
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", predictionCol="__prediction", **mapped
    )
    return trees.setRawPredictionCol("__raw").setProbabilityCol("__probability")


def fit_model(
    df: DataFrame,
    prep: Preparation,
    params: Mapping[str, float] = cfg.BOOSTING,
    overrides: Mapping[str, object] | None = None,
    label: str = cfg.TARGET,
) -> PipelineModel:
    """Preparation and trees as one model. Positives weigh negatives / positives."""
    weight = F.when(F.col(label) == 1, F.lit(positive_weight(df, label))).otherwise(F.lit(1.0))
    rows = df.withColumn("label", F.col(label).cast("double")).withColumn("weight", weight)
    return Pipeline(stages=[*as_stages(prep, impute=True), classifier(params, overrides)]).fit(rows)


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """The input columns and the score. Also works on a stream."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("__probability")[1].alias(SCORE))


@contextmanager
def _pool(spark: SparkSession, name: str):
    """Jobs of this thread go to a scheduler pool of their own."""
    context = spark.sparkContext
    before = context.getLocalProperty(POOL)
    context.setLocalProperty(POOL, name)
    try:
        yield
    finally:
        context.setLocalProperty(POOL, before)


def _few_parts(rows: DataFrame) -> DataFrame:
    """A staged table in as few parts as its rows need: trees make a job for every level, each of all parts."""
    wanted = max(1, -(-rows.count() // ROWS_PER_PART))
    return rows.coalesce(wanted) if wanted < rows.rdd.getNumPartitions() else rows


def train_all(
    features: DataFrame,
    params: Mapping[str, float] = cfg.BOOSTING,
    overrides: Mapping[str, object] | None = None,
    numeric: Sequence[str] = cfg.NUMERIC_FEATURES,
    categorical: Sequence[str] = cfg.CATEGORICAL_FEATURES,
) -> PipelineModel:
    """The model for production: fitted on all rows."""
    rows = _few_parts(staged(features, "features"))
    return fit_model(rows, fit_preparation(rows, numeric, categorical), params, overrides)


def held_out_scores(
    features: DataFrame,
    params: Mapping[str, float] = cfg.BOOSTING,
    overrides: Mapping[str, object] | None = None,
    folds: int = cfg.FOLDS,
    group: str = "scenario_id",
    numeric: Sequence[str] = cfg.NUMERIC_FEATURES,
    categorical: Sequence[str] = cfg.CATEGORICAL_FEATURES,
    leak_free: bool = False,
    parallel: int = 4,
) -> DataFrame:
    """Score every row with a model that has not seen its scenario.

    Rows keep their features and get ``fold``, ``y_true``, ``y_prob``. The
    preparation is fitted on all rows, as the stored contract wants, or on the
    training folds only with ``leak_free``. A table that has folds already is
    used as it is; otherwise it is staged with its folds, as every fold reads
    it many times. ``parallel`` folds are trained at a time.
    """
    rows = features if "fold" in features.columns else _few_parts(staged(assign_folds(features, group, folds), "folds"))
    prep = None if leak_free else fit_preparation(rows, numeric, categorical)

    def one(fold: int) -> DataFrame:
        train = training_part(rows, fold)
        fitted = prep or fit_preparation(train, numeric, categorical)
        return score(test_part(rows, fold), fit_model(train, fitted, params, overrides))

    spark = rows.sparkSession
    outer = spark.sparkContext.getLocalProperty(POOL)

    def pooled(fold: int) -> DataFrame:
        with _pool(spark, outer or f"fold-{fold}"):
            return one(fold)

    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(pooled, range(1, folds + 1)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn(LABEL, F.col(cfg.TARGET).cast("int"))


@dataclass(frozen=True)
class Importance:
    feature: str
    importance: float


def feature_importance(model: PipelineModel, feature_order: Sequence[str], top: int = cfg.TOP_FEATURES) -> list[Importance]:
    """The features the trees use most, under their names."""
    trees = next(s for s in model.stages if isinstance(s, GBTClassificationModel))
    named = [Importance(n, float(v)) for n, v in zip(feature_order, trees.featureImportances.toArray())]
    return sorted(named, key=lambda i: (-i.importance, i.feature))[:top]


# --- search ------------------------------------------------------------------


def draw(space: Mapping[str, tuple], trials: int, seed: int = 42) -> list[dict[str, float]]:
    """Seeded random parameter sets from the declared space."""
    source = random.Random(seed)
    out = []
    for _ in range(trials):
        one = {}
        for name, (kind, low, high, step) in space.items():
            if kind == "int":
                one[name] = low + step * source.randint(0, (high - low) // step)
            elif kind == "log":
                one[name] = math.exp(source.uniform(math.log(low), math.log(high)))
            else:
                one[name] = source.uniform(low, high)
        out.append(one)
    return out


def trial_scores(scored: DataFrame, by: Sequence[str] = ("trial",), fold: str = "fold") -> DataFrame:
    """Mean and population deviation of ROC-AUC over folds; folds with one
    class have no area and are left out."""
    areas = rank_metrics(scored, [*by, fold])
    return areas.groupBy(*by).agg(
        F.avg("roc_auc").alias("score"),
        F.stddev_pop("roc_auc").alias("fold_std"),
        F.count("roc_auc").alias("valid_folds"),
    )


TRIALS = "trial int, score double, fold_std double, params map<string,double>, problem string"


def trained_trial(
    rows: DataFrame,
    number: int,
    params: Mapping[str, float],
    seed: int,
    overrides: Mapping[str, object] | None = None,
    folds: int = cfg.FOLDS,
) -> tuple:
    """The row of one trial. Parameters or rows that do not make a model give a NULL score and the reason."""
    found, why = (None, None), None
    try:
        scored = held_out_scores(rows, {**params, "random_state": seed}, overrides, folds)
        row = trial_scores(scored.withColumn("trial", F.lit(number))).first()
        found = (row["score"], row["fold_std"])
    except (IllegalArgumentException, ValueError) as problem:
        why = str(problem)
    return (number, *found, {k: float(v) for k, v in params.items()}, why)


def stored_trials(spark: SparkSession, store: str) -> DataFrame:
    """The trials that are done; an interrupted search has fewer than were asked for."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], TRIALS)
    return spark.read.schema(TRIALS).parquet(store)


def search(
    features: DataFrame,
    trials: int = 20,
    seed: int = 42,
    space: Mapping[str, tuple] = cfg.SEARCH_SPACE,
    overrides: Mapping[str, object] | None = None,
    folds: int = cfg.FOLDS,
    store: str | None = None,
    parallel: int = 4,
) -> DataFrame:
    """Trial table (trial, score, fold_std, params, problem), kept in the folder ``store``.

    ``parallel`` trials are trained at a time, each in a scheduler pool of its own, so that with
    fair scheduling no trial waits for the jobs of another. A trial's row is appended when it
    ends, so a search that is started again with the same ``store`` goes on with the trials that
    are missing. A trial whose parameters or rows do not make a model has a NULL score and
    says why; anything else that fails stops the search, and so does a search without any score.
    """
    spark = features.sparkSession
    store = store or shared_folder(spark, "trials")
    done = {r["trial"] for r in stored_trials(spark, store).select("trial").collect()}
    left = [(n, p) for n, p in enumerate(draw(space, trials, seed)) if n not in done]
    if left:
        rows = _few_parts(staged(assign_folds(features, folds=folds), "folds"))
        writing, stopped = threading.Lock(), threading.Event()

        def one(job: tuple[int, Mapping[str, float]]) -> None:
            number, params = job
            if stopped.is_set():
                return
            try:
                with _pool(spark, f"trial-{number}"):
                    row = trained_trial(rows, number, params, seed, overrides, folds)
                    # One commit at a time: two appends to a folder share its temporary part.
                    with writing:
                        spark.createDataFrame([row], TRIALS).coalesce(1).write.mode("append").parquet(store)
            except BaseException:
                stopped.set()  # no other trial is started
                raise

        with ThreadPoolExecutor(parallel) as pool:
            list(pool.map(one, left))
    found = stored_trials(spark, store).where(F.col("trial") < trials)
    if found.where("score is not null").isEmpty():
        raise ValueError(f"no trial has a score: {[r['problem'] for r in found.orderBy('trial').collect()]}")
    return found


def top_trials(trials: DataFrame, k: int = 10) -> DataFrame:
    return trials.orderBy(F.col("score").desc_nulls_last(), F.col("trial").asc()).limit(k)


def refit_best(
    features: DataFrame, trials: DataFrame, overrides: Mapping[str, object] | None = None, seed: int = 42
) -> PipelineModel:
    """Model on all rows with the parameters of the best trial."""
    best = top_trials(trials, 1).first()
    if best is None or best["score"] is None:
        raise ValueError("no trial has a score")
    return train_all(features, {**best["params"], "random_state": seed}, overrides)
