"""Trained classifiers of sentences (Spark ML): on the emotion features, and on character n-grams."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import ngrams
from loomspark.operators.emotion import feature_vector, features
from loomspark.packs import EmotionRules


def with_features(df: DataFrame, rules: EmotionRules, text_col: str = "sentence") -> DataFrame:
    return df.withColumn("features", array_to_vector(feature_vector(features(F.col(text_col), rules))))


def with_grams(df: DataFrame, text_col: str = "sentence", sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    return df.withColumn("grams", F.concat(*(ngrams(F.col(text_col), n) for n in sizes)))


def feature_tree(df: DataFrame, rules: EmotionRules, label: str = "label", depth: int = 5) -> PipelineModel:
    """A decision tree on the emotion features."""
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip").fit(df)
    tree = DecisionTreeClassifier(labelCol="_y", featuresCol="features", maxDepth=depth, seed=1)
    return Pipeline(stages=[index, tree, IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)]).fit(with_features(df, rules))


def gram_classifier(df: DataFrame, label: str = "label", features_: int = 1 << 14, folds: int = 0) -> PipelineModel:
    """TF-IDF of character n-grams and logistic regression; with folds, regularisation is chosen by cross-validated F1."""
    rows = with_grams(df)
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip").fit(rows)
    lr = LogisticRegression(labelCol="_y", featuresCol="features", maxIter=30, regParam=0.01)
    plan = Pipeline(stages=[index, HashingTF(inputCol="grams", outputCol="_tf", numFeatures=features_), IDF(inputCol="_tf", outputCol="features"), lr, IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)])
    if not folds:
        return plan.fit(rows)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1]).build()
    return CrossValidator(estimator=plan, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="_y", metricName="f1"), numFolds=folds, seed=1).fit(rows).bestModel


def stratified_folds(df: DataFrame, label: str, by: str, folds: int = 5) -> DataFrame:
    """Adds fold (0 to folds - 1): the rank within the label, in order of a digest of the text column `by`, modulo folds; equal texts in any order.

    A label may hold most rows, so ranks are counted in 256 stretches of digests: what lies before a stretch is a sum of counts, and only a
    stretch is sorted.
    """
    rows = df.withColumn("_d", F.md5(F.coalesce(by, F.lit("")))).withColumn("_s", F.substring("_d", 1, 2))
    counts = rows.groupBy(label, "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(F.col(label).alias("_l"), F.col("_s").alias("_t"), before.alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(label, "_s").orderBy("_d")) - 1
    joined = rows.join(placed, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_s") == F.col("_t")))
    return joined.withColumn("fold", (rank % folds).cast("int")).drop("_d", "_s", "_l", "_t", "_before")


def macro_f1(predicted: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """(by, macro_f1): the mean F1 of the labels that are true or guessed anywhere in a group; a label that is only one of both counts 0."""
    pairs = predicted.groupBy(*by, truth, guess).agg(F.count(F.lit(1)).alias("n"))
    right = F.col(truth) == F.col(guess)
    side = lambda c: pairs.select(*by, F.col(c).alias("label"), F.when(right, F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("size"))
    per = side(truth).unionByName(side(guess)).groupBy(*by, "label").agg((F.sum("hit") / F.sum("size")).alias("f1"))  # hits count on both sides: 2 tp / (2 tp + fp + fn)
    return per.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def cross_validated(df: DataFrame, rules: EmotionRules, label: str = "label", text_col: str = "sentence", folds: int = 5, depth: int = 5) -> DataFrame:
    """(fold, macro_f1) of decision trees on the emotion features, each trained on the other stratified folds.

    Every fold's rows are judged by its own tree and all of them are scored together, in one plan over the k fitted models.
    """
    rows = stratified_folds(df.select(label, F.col(text_col).alias("sentence")), label, "sentence", folds)
    judged = [feature_tree(rows.where(F.col("fold") != k), rules, label, depth).transform(with_features(rows.where(F.col("fold") == k), rules)).select("fold", label, "predicted") for k in range(folds)]
    every = judged[0]
    for j in judged[1:]:
        every = every.unionByName(j)
    return macro_f1(every, label, "predicted", ["fold"])
