"""Gradient-boosted pair models: folds by reference record, out-of-fold scores, mean of fold models.

Boosting stops on a slice of the training folds, never on the fold that is scored, so out-of-fold scores
stay honest. Missing values become -1 beside an indicator.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import materialize

FOLDS = 5


def fold(folds: int = FOLDS):
    return F.pmod(F.xxhash64("s1_id"), F.lit(folds)).cast("int")


def with_fold(features: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Adds ``fold``; a table written by it is read fold by fold."""
    return features.withColumn("fold", fold(folds))


def training_rows(features: DataFrame, negative_share: float = 0.2, folds: int = FOLDS) -> DataFrame:
    """All positives and a share of the negatives by hash, weighted so that class sums are kept; adds ``weight`` and ``fold``."""
    keep = F.pmod(F.xxhash64("s1_id", "cand_id"), F.lit(10_000)) < int(negative_share * 10_000)
    rows = features.where(F.col("y") | keep)
    return rows.withColumn("weight", F.when(F.col("y"), 1.0).otherwise(1.0 / negative_share)).withColumn("fold", fold(folds))


def _prepared(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(-1.0)) for n in names})


def _assembler(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="features")


def assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    """Training rows with their numbers as one vector, ``features``."""
    return _assembler(names).transform(_prepared(rows, names)).select("s1_id", "y", "weight", "fold", "features")


def fit(rows: DataFrame, names: list[str], trees: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    """A model of ``y``; a hash slice of the reference records decides when boosting stops. ``rows`` may be ``assembled`` before."""
    data = rows if "features" in rows.columns else assembled(rows, names)
    data = data.withColumn("label", F.col("y").cast("double")).withColumn("holdout", F.pmod(F.xxhash64(F.lit(7), "s1_id"), F.lit(10)) == 0)
    trainer = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, validationIndicatorCol="holdout", validationTol=0.001)
    return PipelineModel([_assembler(names), trainer.fit(data)])


def apply(model: PipelineModel, rows: DataFrame, names: list[str]) -> DataFrame:
    """``(s1_id, cand_id, p)``."""
    scored = model.transform(_prepared(rows, names))
    return scored.select("s1_id", "cand_id", vector_to_array("probability")[1].alias("p"))


def out_of_fold(features: DataFrame, names: list[str], folds: int = FOLDS, negative_share: float = 0.2, **options) -> tuple[DataFrame, list[PipelineModel]]:
    """Each record scored by the model that has not seen its fold, and the models.

    The first stage learns from a share of the negatives; a second stage has few enough to learn from all.
    Features that bring ``fold`` (``with_fold`` of as many folds, written by it) are read once in all and not once a fold.
    """
    # written once, as vectors: each fold reads them several times, and not all pairs again
    rows = materialize(assembled(training_rows(features, negative_share, folds), names), "training")
    by_fold = features if "fold" in features.columns else with_fold(features, folds)
    models, scored = [], None
    for k in range(folds):
        m = fit(rows.where(F.col("fold") != k), names, **options)
        own = apply(m, by_fold.where(F.col("fold") == k), names)
        scored = own if scored is None else scored.unionByName(own)
        models.append(m)
    return scored, models


def mean_of(models: list[PipelineModel], rows: DataFrame, names: list[str]) -> DataFrame:
    """Mean probability over the fold models; checks that they were fitted on these features."""
    parts = None
    for m in models:
        used = m.stages[0].getInputCols()
        if list(used) != list(names):
            raise ValueError(f"the model was fitted on other features: {used}")
        own = apply(m, rows, names)
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("s1_id", "cand_id").agg(F.avg("p").alias("p"))


def area_under_curve(scored: DataFrame, truth_column: str = "y") -> float:
    data = scored.withColumn("label", F.col(truth_column).cast("double"))
    return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label").evaluate(data)


def save(models: list[PipelineModel], path: str) -> None:
    """Each fold's model under ``path/fold=k``; a model carries its feature list."""
    for k, m in enumerate(models):
        m.write().overwrite().save(f"{path}/fold={k}")


def load(path: str, folds: int = FOLDS) -> tuple[list[PipelineModel], list[str]]:
    """The fold models and the features they were fitted on, which must be the same for all."""
    models = [PipelineModel.load(f"{path}/fold={k}") for k in range(folds)]
    names = {tuple(m.stages[0].getInputCols()) for m in models}
    if len(names) != 1:
        raise ValueError("the fold models were fitted on different features")
    return models, list(names.pop())
