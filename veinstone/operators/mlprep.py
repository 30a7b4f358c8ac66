"""Preparation of regression features, and a regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.sources.sinks import materialize


def factorize(df: DataFrame, value: str, order: str) -> DataFrame:
    """Numbers distinct values from 0 by where they first appear.

    Values are sorted by ranges; each range numbers its own and adds what the ranges before it hold, so no task has
    all of them. The sizes of the ranges are the only rows that come together.
    """
    first = df.groupBy(value).agg(F.min(order).alias("first"))
    ranged = materialize(first.repartitionByRange("first", value).withColumn("range", F.spark_partition_id()))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy("range").orderBy("first", value)) - 1
    return ranged.join(F.broadcast(sizes), "range").withColumn("code", (own + F.col("before")).cast("long")).select(value, "first", "code")


def allocate(df: DataFrame, by: list[str], change: str, weight: str) -> DataFrame:
    """A group's change dealt out in proportion to ``weight``; 0 where the weights sum to 0."""
    total = F.sum(weight).over(W.partitionBy(*by))
    return df.withColumn("allocated", F.coalesce(F.try_divide(F.col(change) * F.col(weight), total), F.lit(0.0)))


def standardize(df: DataFrame, value: str) -> DataFrame:
    """Value less mean over population deviation; both come from one aggregate that is joined to each row."""
    stats = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    return df.crossJoin(F.broadcast(stats)).withColumn("standardized", F.try_divide(F.col(value) - F.col("mean"), F.col("deviation"))).drop("mean", "deviation")


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "metric", "value")


def pivot(df: DataFrame, ids: list[str], names: list[str], value: str) -> DataFrame:
    """Columns ``name - metric`` from rows; names are given, so no pass over the data looks for them."""
    return df.groupBy(*ids).pivot("metric", names).agg(F.first(value))


def errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    d = F.col(truth) - F.col(guess)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"))


def held_out(*key: str) -> Column:
    """Whether a row is held out: 85 of 256 values of a byte of its key's hash, so the split is the same in every run."""
    return F.substring(F.md5(F.concat_ws("|", *key)), 1, 2) < "55"


def linear_fit(df: DataFrame, feature: str, label: str, key: list[str]) -> DataFrame:
    """Least squares of ``label`` by one feature on the rows that aren't held out, and its errors on those that are."""
    rows = df.na.drop(subset=[feature, label]).withColumn("held", held_out(*key))
    fit = rows.filter(~F.col("held")).agg(F.regr_slope(label, feature).alias("slope"), F.regr_intercept(label, feature).alias("intercept"), F.count("*").alias("n_train"))
    guessed = rows.filter("held").crossJoin(F.broadcast(fit)).withColumn("guess", F.col("slope") * F.col(feature) + F.col("intercept"))
    d = F.col(label) - F.col("guess")
    return guessed.agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("n_train").alias("n_train"), F.count("*").alias("n_test"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"))


def tune_regression(df: DataFrame, features: list[str], label: str, key: list[str], seed: int = 33) -> DataFrame:
    """``model, n_train, n_test, candidates, mae, mse, rmse``: boosted trees, tuned over a grid on part of the training rows, and
    a linear model. Spark has no dense network for regression: these stand in for it."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    rows = materialize(df.na.drop(subset=[*features, label]).select(*(F.col(c).cast("double").alias(c) for c in [*features, label]), held_out(*key).alias("held")))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", F.col(label).alias("label"), "held")
    train, test = rows.filter(~F.col("held")), rows.filter("held")
    sizes = train.count(), test.count()
    trees, linear = GBTRegressor(maxIter=5, seed=seed), LinearRegression()
    grids = {"trees": (trees, ParamGridBuilder().addGrid(trees.maxDepth, [2, 3]).addGrid(trees.stepSize, [0.1, 0.3]).build()), "linear": (linear, ParamGridBuilder().addGrid(linear.regParam, [0.01, 0.1]).build())}
    made = []
    for name, (model, grid) in grids.items():
        best = TrainValidationSplit(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="mae"), trainRatio=0.8, seed=seed).fit(train)
        about = [F.lit(name).alias("model"), *(F.lit(n).cast("long").alias(c) for n, c in zip((*sizes, len(grid)), ("n_train", "n_test", "candidates"), strict=True))]
        made.append(errors(best.transform(test), "label", "prediction").select(*about, "mae", "mse", "rmse"))
    return made[0].union(made[1])
