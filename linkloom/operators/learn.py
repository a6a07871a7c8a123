"""Sampling, splits, boosted trees, calibration, stacking on pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def drawn(key: Column, seed: int, out_of: int = 100) -> Column:
    """A number from 0 for a key, the same on every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(out_of)).cast("int")


def stratified(queries: DataFrame, truth: DataFrame, n: int, matched: float = 0.65, seed: int = 42) -> DataFrame:
    """n queries, that share of them with a match; first by hash."""
    some = truth.select("query_id").distinct().withColumn("matched", F.lit(True))
    own = queries.select("query_id").join(some, "query_id", "left").fillna(False, ["matched"])
    rank = F.row_number().over(W.partitionBy("matched", "bin").orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id"))
    first = own.withColumn("bin", drawn(F.col("query_id"), seed + 1, 64)).withColumn("r", rank).filter(F.col("r") <= n)
    pick = lambda flag, k: first.filter(F.col("matched") == flag).orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(k)
    return pick(True, int(n * matched)).unionByName(pick(False, n - int(n * matched))).select("query_id", "matched")


def distractors(targets: DataFrame, truth: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n targets that match nothing, first by hash."""
    return targets.join(truth.select("target_id").distinct(), "target_id", "left_anti").orderBy(F.xxhash64("target_id", F.lit(seed)), "target_id").limit(n)


def split(rows: DataFrame, seed: int = 42, share: int = 80) -> DataFrame:
    """The rows with is_validation; all rows of a query lie on one side."""
    return rows.withColumn("is_validation", drawn(F.col("query_id"), seed) >= share)


def folds(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return rows.withColumn("fold", drawn(F.col("query_id"), seed, k))


def weighted(rows: DataFrame, factor: float = 0.22) -> DataFrame:
    """The rows with a weight: positives get max(1, negatives / positives * factor)."""
    totals = rows.agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("all"))
    own = rows.crossJoin(F.broadcast(totals))  # one row
    return own.withColumn("weight", F.when(F.col("label") == 1, F.greatest(F.lit(1.0), (F.col("all") - F.col("pos")) / F.greatest(F.col("pos"), F.lit(1)) * factor)).otherwise(1.0)).drop("pos", "all")


def boosted(names: tuple[str, ...], trees: int = 20, rate: float = 0.1, depth: int = 5, early: bool = True) -> Pipeline:
    """Boosted trees with early stopping on the rows that is_validation marks."""
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, stepSize=rate, maxDepth=depth, seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features"), model.setValidationIndicatorCol("is_validation") if early else model])


def forest(names: tuple[str, ...], trees: int = 30, depth: int = 6) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features"), RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=42)])


def scored(model: PipelineModel, rows: DataFrame, keep: tuple[str, ...] = ("query_id", "target_id")) -> DataFrame:
    """The rows' keys with p, the probability of a match."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("p"))


def importance(model: PipelineModel, names: tuple[str, ...]) -> list[tuple[str, float]]:
    """Features by falling importance."""
    return sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def calibrated(probabilities: DataFrame) -> IsotonicRegressionModel:
    """Isotonic calibration of (p, label)."""
    return IsotonicRegression(featuresCol="x", labelCol="label").fit(probabilities.select(array_to_vector(F.array("p")).alias("x"), F.col("label").cast("double").alias("label")))


def recalibrated(model: IsotonicRegressionModel, rows: DataFrame) -> DataFrame:
    """The rows with p made to the calibrated probability, within (0, 1)."""
    out = model.transform(rows.withColumn("__x", array_to_vector(F.array("p"))).withColumnRenamed("__x", "x"))
    return out.withColumn("p", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prediction")))).drop("x", "prediction")


def stacker(names: tuple[str, ...], probabilities: tuple[str, ...] = ("p1", "p2"), hidden: tuple[int, ...] = (16, 8)) -> Pipeline:
    """A network over scaled features and the base models' probabilities."""
    cols = [*names, *probabilities]
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), MultilayerPerceptronClassifier(labelCol="label", layers=[len(cols), *hidden, 2], maxIter=40, seed=42)])


def stacked(rows: DataFrame, names: tuple[str, ...], weights: tuple[float, float, float] = (0.40, 0.35, 0.25)) -> DataFrame:
    """(query_id, target_id, p) of all rows by two tree models and stacker() over both, blended by weight and calibrated.

    Rows are weighted() and split(). The models learn from what is_validation doesn't mark, the calibration from what
    it marks; where it marks nothing, or only rows of one label, probabilities stay as blended.
    """
    learning = rows.filter("NOT is_validation")
    trees = [boosted(names).fit(rows), forest(names).fit(learning)]

    def with_trees(d: DataFrame) -> DataFrame:
        for i, model in enumerate(trees, 1):
            d = model.transform(d).withColumn(f"p{i}", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        return d

    third = stacker(names).fit(with_trees(learning))
    three = third.transform(with_trees(rows)).withColumn("p3", vector_to_array("probability")[1])
    p = sum((F.col(f"p{i}") * w for i, w in enumerate(weights, 1)), F.lit(0.0)) / sum(weights)
    blend = three.select("query_id", "target_id", "label", "is_validation", p.alias("p"))
    held = blend.filter("is_validation")
    if held.select("label").distinct().count() == 2:
        blend = recalibrated(calibrated(held), blend)
    return blend.select("query_id", "target_id", "p")
