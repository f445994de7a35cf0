"""Models on the panel with MLlib, in sample, held out and walk-forward."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.window import cs_zscore
from panelspark.operators.buckets import label_bins
from panelspark.operators.labels import fold_rows
from panelspark.sources.files import shared_folder


#: Penalties that are used where none is given.
ALPHAS = {"ridge": 1.0, "lasso": 0.001, "elastic_net": 0.001, "huber": 0.0001}


def regressor(kind: str, rows: int = 1, spread: float = 1.0, alpha: float | None = None, l1_share: float = 0.5, trees: int = 20, depth: int = 8, least_rows: int = 20):
    """A regressor by name; alpha: the penalty, see ALPHAS; trees, depth and least_rows (of a leaf) are those of the forest.

    Ridge takes alpha over the sum of squares, lasso and elastic net over half
    their mean. MLlib takes it over half the mean, and divides squared penalties
    by the label's standard deviation (`spread`), which is made up for here.
    """
    alpha, spread = ALPHAS.get(kind, 0.0) if alpha is None else alpha, spread or 1.0
    linear = {"featuresCol": "features", "labelCol": "label", "standardization": False}
    absolute, squared = alpha * l1_share, alpha * (1 - l1_share) * spread
    kinds = {
        "ols": lambda: LinearRegression(**linear),
        "ridge": lambda: LinearRegression(regParam=alpha / max(rows, 1) * spread, elasticNetParam=0.0, **linear),
        "lasso": lambda: LinearRegression(regParam=alpha, elasticNetParam=1.0, **linear),
        "elastic_net": lambda: LinearRegression(regParam=absolute + squared, elasticNetParam=absolute / ((absolute + squared) or 1.0), **linear),
        "huber": lambda: LinearRegression(loss="huber", epsilon=1.35, regParam=alpha, **linear),
        "forest": lambda: RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=least_rows, seed=7),
        "boosted": lambda: GBTRegressor(featuresCol="features", labelCol="label", maxIter=10, maxDepth=3, seed=7),
    }
    return kinds[kind]()


def computed_once(panel: DataFrame, *columns: str) -> DataFrame:
    """The columns of a panel, computed and laid down in the shared folder, for jobs that read it more than once."""
    shared_folder(panel.sparkSession)
    return panel.select(*columns).checkpoint(eager=True)


def training_rows(panel: DataFrame, features: tuple[str, ...], label: str) -> DataFrame:
    """Rows with all features and a label, as features vector and label."""
    whole = panel.dropna(subset=[*features, label]).withColumn("label", F.col(label))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(whole)


def fit_predict(train: DataFrame, test: DataFrame, features: tuple[str, ...], label: str, kind: str, **settings) -> DataFrame:
    """(instrument, date, score) of the test rows with all features; training needs 30 rows. settings: of `regressor`."""
    ready = train.dropna(subset=[*features, label]).withColumn("label", F.col(label))
    rows, spread = ready.agg(F.count("*"), F.stddev_pop("label")).first()
    if rows < 30:
        return test.select("instrument", "date", F.lit(None).cast("double").alias("score")).limit(0)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    fitted = Pipeline(stages=[assembler, regressor(kind, rows, spread, **settings)]).fit(ready)
    return fitted.transform(test.dropna(subset=list(features))).select("instrument", "date", F.col("prediction").alias("score"))


def coefficients(train: DataFrame, features: tuple[str, ...], label: str, kind: str, **settings) -> DataFrame:
    """(feature, value) of a fitted linear model, the intercept among them."""
    ready = train.dropna(subset=[*features, label]).withColumn("label", F.col(label))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    rows, spread = ready.agg(F.count("*"), F.stddev_pop("label")).first()
    model = Pipeline(stages=[assembler, regressor(kind, rows, spread, **settings)]).fit(ready).stages[-1]
    values = [*zip(features, map(float, model.coefficients), strict=True), ("intercept", float(model.intercept))]
    return train.sparkSession.createDataFrame(values, "feature string, value double")


def boosted_ranking(train: DataFrame, valid: DataFrame, test: DataFrame, features: tuple[str, ...], label: str, rounds: int = 20, depth: int = 3) -> DataFrame:
    """(instrument, date, score): boosted trees on the 20-bin label of each date, stopped early by the validation rows.

    Features are z-scores within their date, 0 where unknown, so that scores are comparable between dates.
    """
    def ready(panel: DataFrame) -> DataFrame:
        scaled = panel.withColumns({f: cs_zscore(F.col(f).cast("double")) for f in features})
        return scaled.fillna(0.0, list(features))

    marked = train.withColumn("held_", F.lit(False)).unionByName(valid.withColumn("held_", F.lit(True)))
    binned = label_bins(ready(marked), label).withColumn("label", F.col("bin").cast("double"))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=7, validationIndicatorCol="held_")
    return Pipeline(stages=[assembler, trees]).fit(binned).transform(ready(test)).select("instrument", "date", F.col("prediction").alias("score"))


def walk_forward(panel: DataFrame, folds: DataFrame, features: tuple[str, ...], label: str, kind: str, **settings) -> DataFrame:
    """(fold, instrument, date, score): a model for each fold, fitted up to its label cutoff. One fit a fold, on the cluster.

    No folds give no rows. The panel is computed once and read by all fits. Linear
    models but huber are fitted for all folds in one job by `gram.walk_forward`.
    """
    shared_folder(panel.sparkSession)
    parted = fold_rows(panel, folds).checkpoint(eager=True)
    scored = [panel.select(F.lit(0).alias("fold"), "instrument", "date", F.lit(None).cast("double").alias("score")).limit(0)]
    for row in folds.select("fold").orderBy("fold").collect():  # a row for each half-year or so
        own = parted.where(F.col("fold") == row["fold"])
        found = fit_predict(own.where(F.col("part") == "train"), own.where(F.col("part") == "test"), features, label, kind, **settings)
        scored.append(found.select(F.lit(row["fold"]).alias("fold"), "instrument", "date", "score"))
    return reduce(DataFrame.unionByName, scored)
