"""MLlib models: candidates, choice, scoring, embedding."""

from __future__ import annotations

from statistics import mean, pstdev

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinflow.operators.forest import DeepForest
from clinflow.operators.learning import SEED, with_fold

MAX_DEPTH = 30
SHALLOW = 10


def indexer(label: str = "label") -> StringIndexer:
    """M1: classes in alphabetical order."""
    return StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip")


def with_vector(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)


def vector_from_array(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def forest(trees: int = 200, depth: int = MAX_DEPTH, seed: int = SEED) -> RandomForestClassifier | DeepForest:
    """M2. Trees end at depth 30, as those of MLlib, which grows them to their end up to a depth of 10."""
    trees = RandomForestClassifier(labelCol="label_index", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return trees if depth <= SHALLOW else DeepForest(trees)


def boosted(rounds: int = 300, depth: int = 6, rate: float = 0.1, share: float = 0.8, seed: int = SEED) -> OneVsRest:
    """M3: one boosted model per class, as MLlib boosting takes two classes only."""
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed)
    return OneVsRest(classifier=trees, labelCol="label_index", featuresCol="features", parallelism=4)


def fold_accuracy(rows: DataFrame, estimator, key: str, folds: int = 5) -> tuple[float, float]:
    """Mean and deviation of the accuracy over the folds; `rows` has label_index and features.

    Each fold is held out once; one model is fitted per fold, and none on all rows.
    """
    judge = MulticlassClassificationEvaluator(labelCol="label_index", metricName="accuracy")
    held = with_fold(rows, key, folds)
    rates = [
        judge.evaluate(estimator.fit(held.filter(F.col("fold") != fold)).transform(held.filter(F.col("fold") == fold)))
        for fold in range(folds)
    ]
    return mean(rates), pstdev(rates)


def choose(rows: DataFrame, candidates: dict, key: str, folds: int = 5) -> tuple[str, dict[str, tuple[float, float]]]:
    """M4: the later candidate wins unless its mean accuracy is lower."""
    rates = {name: fold_accuracy(rows, estimator, key, folds) for name, estimator in candidates.items()}
    best = None
    for name, (rate, _) in rates.items():
        if best is None or rate >= rates[best][0]:
            best = name
    return best, rates


def fit(rows: DataFrame, estimator, label: str = "label") -> PipelineModel:
    """Indexer and classifier as one model; the indexer carries the classes."""
    return Pipeline(stages=[indexer(label), estimator]).fit(rows)


def classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predictions(model: PipelineModel, rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, prediction) as class names."""
    scored = _classifier(model).transform(rows)
    named = F.get(F.lit(classes(model)), F.col("prediction").cast("int"))
    return scored.select(F.col(label).cast("string").alias("label"), named.alias("prediction"))


def _classifier(model: PipelineModel) -> PipelineModel:
    return PipelineModel(stages=model.stages[1:])


def probabilities(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """M5: (key, probability array) in class order; models without probabilities give shares of their raw scores."""
    scored = _classifier(model).transform(rows)
    if "probability" in scored.columns:
        return scored.select(key, vector_to_array("probability").alias("probability"))
    weights = F.transform(vector_to_array("rawPrediction"), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-2 * x)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return scored.select(key, F.transform(weights, lambda x: x / total).alias("probability"))


def text_embedder(size: int = 256) -> Pipeline:
    """M8: words to a normalised tf-idf vector of fixed size."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="content", outputCol="words", pattern=r"(?U)\W+", minTokenLength=1),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=size),
        IDF(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="unit"),
    ])


def embed(model: PipelineModel, chunks: DataFrame) -> DataFrame:
    """M8: adds `vector` to chunks and drops the steps on the way."""
    out = model.transform(chunks)
    return out.withColumn("vector", vector_to_array("unit", "float32")).drop("words", "counts", "weighted", "unit")
