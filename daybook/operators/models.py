"""Learned models over feature frames, fitted by Spark's own ML library.

A frame's rows stay distributed; only fitted parameters (centres, trees, weights) reach the driver.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_rows(df: DataFrame, features: list[str], most: int = 4, seed: int = 7) -> DataFrame:
    """``cluster`` of each row without null features: k-means on scaled features, k by silhouette.

    Fewer than three rows, or rows that are all alike, form one cluster.
    """
    known = df.dropna(subset=features)
    vectors = VectorAssembler(inputCols=features, outputCol="_raw").transform(known)
    different = known.select(*features).distinct().limit(most + 1).count()
    if different < 3:
        return known.withColumn("cluster", F.lit(0))
    scaled = MinMaxScaler(inputCol="_raw", outputCol="_x").fit(vectors).transform(vectors)
    judge, best = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster"), None
    for k in range(2, min(most, different - 1) + 1):
        found = KMeans(k=k, featuresCol="_x", predictionCol="cluster", seed=seed).fit(scaled).transform(scaled)
        score = judge.evaluate(found)
        if best is None or score > best[0]:
            best = (score, found)
    return best[1].drop("_raw", "_x")


def smooth_states(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """A state that differs from two equal neighbours takes theirs."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(state).over(w), F.lead(state).over(w)
    return df.withColumn(state, F.when((before == after) & (F.col(state) != before), before).otherwise(F.col(state)))


def forest_forecast(df: DataFrame, features: list[str], target: str, train, trees: int = 20, seed: int = 7) -> DataFrame:
    """``forecast`` of the rows where ``train`` doesn't hold, by a forest fitted on those where it does."""
    known = df.dropna(subset=[*features, target])
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(known)
    forest = RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="forecast", numTrees=trees, maxDepth=4, seed=seed)
    return forest.fit(rows.where(train)).transform(rows.where(~train)).drop("_x")


def balanced_probability(df: DataFrame, features: list[str], label: str, train) -> DataFrame:
    """``probability`` of label 1 for every row, by a class-balanced logistic model of the ``train`` rows."""
    counts = df.where(train).agg(F.count_if(F.col(label) == 1).alias("ones"), F.count("*").alias("n")).first()
    if not 0 < counts["ones"] < counts["n"]:
        raise ValueError("training rows hold one class only")
    weight = F.when(F.col(label) == 1, counts["n"] / (2 * counts["ones"])).otherwise(counts["n"] / (2 * (counts["n"] - counts["ones"])))
    rows = df.dropna(subset=features).withColumn("_w", weight)
    steps = [
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y", regParam=0.01),
    ]
    scored = Pipeline(stages=steps).fit(rows.where(train)).transform(rows)
    return scored.withColumn("probability", vector_to_array("_p")[1]).drop("_raw", "_x", "_p", "_r", "_y", "_w")
