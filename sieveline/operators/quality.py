"""Score-based filtering and its extrapolation by a boosted-tree classifier."""

from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Classifier
from ..functions.text import features, seeded


def with_features(df: DataFrame, question: str, answer: str, c: Classifier, main_source: str, source: str = "source", stratum: str = "stratum") -> tuple[DataFrame, list[str]]:
    """Adds the 12 text and source features and a 0/1 column per stratum; returns them by name in order."""
    cols = features(F.col(question), F.col(answer))
    cols["is_main_source"] = F.coalesce((F.col(source) == main_source).cast("int"), F.lit(0))
    for name in [*(s.name for s in c.strata), c.fallback]:
        cols.setdefault(f"stratum_{name}", F.coalesce((F.col(stratum) == name).cast("int"), F.lit(0)))
    return df.withColumns(cols), sorted(cols)


def score_filter(df: DataFrame, scores: DataFrame, minimum: int, key: str, score: str = "score") -> DataFrame:
    """Rows less those that score below minimum; unscored ones stay."""
    return df.join(scores.where(F.col(score) < minimum).select(key).distinct(), key, "left_anti")


def content_anti(df: DataFrame, passed: DataFrame, question: str, answer: str, n: int = 200) -> DataFrame:
    """Rows of df whose first n characters of question and answer are not those of a row of passed."""
    key = lambda d: (F.substring(d[question], 1, n), F.substring(d[answer], 1, n))
    q, a = key(passed)
    known = passed.select(q.alias("_q"), a.alias("_a")).distinct()
    x, y = key(df)
    return df.join(known, x.eqNullSafe(known["_q"]) & y.eqNullSafe(known["_a"]), "left_anti")


#: Labelled rows of a partition of the training: every level of every tree is a job of its own, so that many small
#: tasks cost more than they share.
TRAIN_ROWS = 65_536


def booster(max_iter: int = 200, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol="_label", featuresCol="_features", predictionCol="_prediction", maxIter=max_iter, maxDepth=5, stepSize=0.1, minInstancesPerNode=20, seed=seed)


def train(labelled: DataFrame, names: list[str], label: str, max_iter: int = 200, seed: int = 42) -> GBTClassificationModel | None:
    """None where the rows have not two classes: the stage is then skipped."""
    return _fitted(lambda: booster(max_iter, seed), labelled, names, label)


def _fitted(made: Callable[[], GBTClassifier], labelled: DataFrame, names: list[str], label: str) -> GBTClassificationModel | None:
    """Rows are placed and ordered by their values, so the trees don't depend on the layout of the input."""
    rows = labelled.select(*names, F.col(label).cast("double").alias("_label")).persist()
    try:
        sizes = [r["count"] for r in rows.groupBy("_label").count().collect()]
        if len(sizes) < 2:
            return None
        parts = min(math.ceil(sum(sizes) / TRAIN_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
        placed = rows.repartition(parts, *names).sortWithinPartitions(*names, "_label")
        data = VectorAssembler(inputCols=names, outputCol="_features").transform(placed).select("_features", "_label").persist()
        try:
            return made().fit(data)
        finally:
            data.unpersist()
    finally:
        rows.unpersist()


def predict(model: GBTClassificationModel, df: DataFrame, names: list[str]) -> DataFrame:
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="_features").transform(df))
    return scored.withColumn("predicted", F.col("_prediction").cast("int")).drop("_features", "_prediction", "rawPrediction", "probability")


def cv_f1(labelled: DataFrame, names: list[str], label: str, id_col: str, folds: int = 5, max_iter: int = 200, seed: int = 42) -> DataFrame:
    """(fold, f1) of the passing class, by stratified folds of equal size. All folds are trained at the same time: a
    training is a long row of short jobs that leave most cores idle."""
    w = Window.partitionBy(label).orderBy(seeded(seed, F.col(id_col)))
    rows, spark, trees = labelled.withColumn("_fold", F.ntile(folds).over(w)).persist(), labelled.sparkSession, booster(max_iter, seed)

    def fold(k: int) -> tuple[int, float] | None:
        model = _fitted(lambda: trees, rows.where(F.col("_fold") != k), names, label)
        if model is None:
            return None
        y, p = F.col(label) == 1, F.col("predicted") == 1
        got = predict(model, rows.where(F.col("_fold") == k), names).agg(F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & p, 1)).alias("fp"), F.count(F.when(y & ~p, 1)).alias("fn")).first()
        d = 2 * got.tp + got.fp + got.fn
        return k, 2 * got.tp / d if d else 0.0

    rows.count()
    with ThreadPool(folds) as pool:
        out = pool.map(inheritable_thread_target(spark)(fold), range(1, folds + 1))
    rows.unpersist()
    return spark.createDataFrame([x for x in out if x is not None], "fold int, f1 double")


def importances(model: GBTClassificationModel, names: list[str], spark) -> DataFrame:
    rows = [(n, float(model.featureImportances[i])) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
