"""A ladder of models, each refitted on an expanding history and never shown what it predicts.

Linear models come from running sums over dates: a refit solves one k x k system and reads no row again. Trees are fitted by Spark's distributed learners, one fit
a refit or fold; the loop over refits is the only thing on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, xs: list[str], y: str, name: str) -> DataFrame:
    """(name, date, y, x) of the rows whose features and outcome are there."""
    return rows.dropna(subset=[y, *xs]).select(name, "date", F.col(y).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in xs]).alias("x"))


def _refit_dates(rows: DataFrame, least: int, every: int) -> DataFrame:
    """(date, fit): for each date with `least` dates before it, the date whose earlier rows its model is fitted on."""
    days = rows.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("_i") >= least)  # one row per date
    fit = F.when((F.col("_i") - least) % every == 0, F.col("date"))
    return days.select("date", F.last(fit, ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("fit"))


def expanding_linear(rows: DataFrame, xs: list[str], y: str, least: int, every: int, penalty: float = 0.0, name: str = "signalname") -> DataFrame:
    """(name, date, y, prediction): least squares with a constant, and the penalty on the squared slopes. Refitted every `every` dates on all earlier rows; with collinear features the slopes of least norm."""
    data = usable(rows, xs, y, name)
    k = len(xs)
    at = lambda i: F.get("x", F.lit(i))
    cells = {"n": F.count("*").cast("double"), "sy": F.sum("y")}
    cells |= {f"x{i}": F.sum(at(i)) for i in range(k)} | {f"v{i}": F.sum(at(i) * F.col("y")) for i in range(k)} | {f"m{i}_{j}": F.sum(at(i) * at(j)) for i in range(k) for j in range(k)}
    by_date = data.groupBy("date").agg(*[c.alias(n) for n, c in cells.items()])
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # one row per date
    sums = by_date.select("date", *[F.sum(n).over(before).alias(n) for n in cells])
    dates = _refit_dates(data, least, every)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n = pdf["n"].to_numpy()
            x = pdf[[f"x{i}" for i in range(k)]].to_numpy() / n[:, None]
            m = pdf[[f"m{i}_{j}" for i in range(k) for j in range(k)]].to_numpy().reshape(-1, k, k) - n[:, None, None] * x[:, :, None] * x[:, None, :]
            v = pdf[[f"v{i}" for i in range(k)]].to_numpy() - x * pdf["sy"].to_numpy()[:, None]
            b = np.einsum("nij,nj->ni", np.linalg.pinv(m + penalty * np.eye(k), rcond=1e-12, hermitian=True), v)
            yield pd.DataFrame({"fit": pdf["date"], "a": pdf["sy"].to_numpy() / n - (x * b).sum(axis=1), "b": list(b)})

    fits = sums.join(dates.select(F.col("fit").alias("date")).distinct(), "date", "left_semi").mapInPandas(solve, "fit date, a double, b array<double>")
    told = data.join(dates, "date").join(fits, "fit")
    return told.select(name, "date", "y", (F.col("a") + F.aggregate(F.zip_with("x", "b", lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v)).alias("prediction"))


def expanding_boosted(rows: DataFrame, xs: list[str], y: str, least: int, every: int, trees: int = 100, depth: int = 2, rate: float = 0.1, name: str = "signalname") -> DataFrame:
    """(name, date, y, prediction) of boosted regression trees, refitted every `every` dates on all earlier rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    data = usable(rows, xs, y, name)
    dates = _refit_dates(data, least, every)
    x = data.withColumn("features", array_to_vector("x"))
    told = x.join(dates, "date")
    out = data.where("false").select(name, "date", "y", F.lit(0.0).alias("prediction"))
    for fit in dates.select("fit").distinct().orderBy("fit").collect():  # a row per refit
        model = GBTRegressor(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=0).fit(x.where(F.col("date") < F.lit(fit["fit"])))
        out = out.unionByName(model.transform(told.where(F.col("fit") == F.lit(fit["fit"]))).select(name, "date", "y", "prediction"))
    return out


def logistic():  # noqa: ANN201
    """On features in units of their deviation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="y", regParam=0.01, maxIter=50)])


def forest(trees: int = 200, depth: int = 4):  # noqa: ANN201
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="raw", labelCol="y", numTrees=trees, maxDepth=depth, seed=0)


def boosted(trees: int = 120, depth: int = 3, rate: float = 0.05):  # noqa: ANN201
    """Each tree on four fifths of the rows and of the features."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(featuresCol="raw", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=0)


def walk_forward(features: DataFrame, models: dict[str, Callable], least: int, folds: int) -> DataFrame:
    """(model, fold, date, ticker, y, p): every model's out-of-fold probabilities.

    features: (date, ticker, y (0 or 1), known: the date from which y is known, x: array). Folds are equal stretches of the distinct dates; a fold's models are fitted on the rows whose
    outcome was known before its first date. A fold with fewer than `least` such rows or with one class is left out.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dates = features.select("date").distinct().withColumn("fold", F.ntile(folds).over(Window.orderBy("date")))  # one row per date
    x = features.join(dates, "date").withColumn("raw", array_to_vector("x"))
    out = x.where("false").select(F.lit("").alias("model"), "fold", "date", "ticker", "y", F.lit(0.0).alias("p"))
    for fold in dates.groupBy("fold").agg(F.min("date").alias("start")).orderBy("fold").collect():  # a row per fold
        train = x.where(F.col("known") < F.lit(fold["start"]))
        n, up = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        if n < least or up in (0, n):
            continue
        for name, make in models.items():
            told = make().fit(train).transform(x.where(F.col("fold") == fold["fold"]))
            out = out.unionByName(told.select(F.lit(name).alias("model"), "fold", "date", "ticker", "y", vector_to_array("probability")[1].alias("p")))
    return out
