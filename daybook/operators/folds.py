"""Forecasts judged by time: each fold is fitted on what came before it and tested on what follows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.sources.shared import cut


def time_folds(df: DataFrame, day: str, folds: int = 4) -> DataFrame:
    """``fold`` of each row: 0 to ``folds`` by the place of its day among all days; fold 0 is only ever fitted on.

    Days are cut into ``folds`` + 1 stretches of equally many days, so a day is never in two.
    """
    days = df.select(day).distinct()  # a row a day
    numbered = days.withColumn("fold", F.ntile(folds + 1).over(Window.orderBy(day)) - 1)
    return df.join(numbered, day)


def lagged_features(df: DataFrame, keys: list[str], day: str, features: list[str], target: str) -> DataFrame:
    """Each row's target with the features of the calendar day before, as ``<feature>_before``; rows without such a day are gone."""
    before = df.select(*keys, F.date_add(day, 1).alias(day), *[F.col(f).alias(f"{f}_before") for f in features])
    return df.select(*keys, day, F.col(target).alias("target")).join(before, [*keys, day])


def _scores(rows: Column, predicted: str) -> list[Column]:
    """n, r2 and mean absolute error over the rows for which ``rows`` holds."""
    y, gap = F.when(rows, F.col("target")), F.when(rows, F.col("target") - F.col(predicted))
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return [F.count(y), 1 - F.sum(gap * gap) / F.when(spread > 0, spread), F.avg(F.abs(gap))]


def fold_scores(df: DataFrame, features: list[str], trees: int = 20, depth: int = 4, seed: int = 7, least: int = 30) -> DataFrame:
    """fold, model, n_train, n_test, r2_train, r2_test, mae_test of a linear fit and a forest, side by side.

    ``df`` has fold, target and the features. A fold's model sees rows of earlier folds only; a fold with fewer than ``least`` rows to fit
    on, or fewer than 5 to test, is left out.
    """
    rows = cut(VectorAssembler(inputCols=features, outputCol="_x").transform(df.dropna(subset=[*features, "target"])).select("fold", "target", "_x"))
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row a fold
    out = []
    for fold in sorted(sizes)[1:]:
        n_train = sum(n for f, n in sizes.items() if f < fold)
        if n_train < least or sizes[fold] < 5:
            continue
        past = rows.where(F.col("fold") < fold)
        models = {
            "linear": LinearRegression(featuresCol="_x", labelCol="target", predictionCol="_y"),
            "forest": RandomForestRegressor(featuresCol="_x", labelCol="target", predictionCol="_y", numTrees=trees, maxDepth=depth, seed=seed),
        }
        for name, model in models.items():
            seen = model.fit(past).transform(rows.where(F.col("fold") <= fold))
            before, then = _scores(F.col("fold") < fold, "_y"), _scores(F.col("fold") == fold, "_y")
            columns = [before[0].alias("n_train"), then[0].alias("n_test"), before[1].alias("r2_train"), then[1].alias("r2_test"), then[2].alias("mae_test")]
            out.append(seen.agg(*columns).select(F.lit(fold).alias("fold"), F.lit(name).alias("model"), "*"))
    if not out:
        return df.sparkSession.createDataFrame([], "fold int, model string, n_train long, n_test long, r2_train double, r2_test double, mae_test double")
    return reduce(DataFrame.unionByName, out)


def past_correlations(df: DataFrame, features: list[str], folds: list[int]) -> DataFrame:
    """fold, feature, n, r: each feature against the target over the rows before the fold, and none of it or after."""
    known = df.dropna(subset=[*features, "target"])
    # a row is in the past of every later fold
    past = known.withColumn("for", F.explode(F.array(*[F.lit(f) for f in folds]))).where(F.col("fold") < F.col("for"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    sums = past.select(F.col("for").alias("fold"), "target", each.alias("e")).groupBy("fold", F.col("e.feature").alias("feature"))
    return sums.agg(F.count("*").alias("n"), F.coalesce(F.corr("e.x", "target"), F.lit(0.0)).alias("r"))
