"""Regression, one-hot encoding and confusion matrices over tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression as SparkLinear
from pyspark.ml.classification import LogisticRegression as SparkLogistic
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compile import quoted
from ..schema import INT, REAL


def features(df: DataFrame, kinds: Mapping[str, str], names: Sequence[str], target: str | None = None) -> DataFrame:
    """``__x`` (vector of all feature columns as doubles) beside the columns of ``df``; null features are NaN."""
    for n in names:
        if kinds[n] not in (INT, REAL):
            raise TypeError(f"column '{n}' of type {kinds[n]} cannot be a feature")
    wide = df.withColumns({f"__f{i}": F.coalesce(quoted(n).cast("double"), F.lit(float("nan"))) for i, n in enumerate(names)})
    if target is not None:
        wide = wide.withColumn("__y", quoted(target).cast("double"))
    inputs = [f"__f{i}" for i in range(len(names))]
    return VectorAssembler(inputCols=inputs, outputCol="__x", handleInvalid="keep").transform(wide).drop(*inputs)


@dataclass(frozen=True)
class Fitted:
    model: Any
    names: tuple[str, ...]
    classes: bool

    def predictions(self, df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
        """``df`` with Predictions; null where a feature is missing."""
        wide = features(df, kinds, self.names)
        whole = F.lit(True)
        for n in self.names:
            whole = whole & quoted(n).isNotNull()
        out = self.model.setFeaturesCol("__x").setPredictionCol("__p").transform(wide)
        return out.withColumn("Predictions", F.when(whole & ~F.isnan("__p"), F.col("__p"))).drop("__x", "__p", "rawPrediction", "probability")

    def score(self, df: DataFrame, kinds: Mapping[str, str], target: str) -> float:
        """R squared of a linear model, share of right classes of a logistic one."""
        met = self.predictions(df, kinds).select(F.col("Predictions").alias("p"), quoted(target).cast("double").alias("y"))
        if self.classes:
            return met.agg(F.avg(F.when(F.col("p") == F.col("y"), 1.0).otherwise(0.0))).first()[0]
        miss, spread = met.agg(F.sum((F.col("p") - F.col("y")) ** 2), F.var_pop("y") * F.count("y")).first()
        return 1 - miss / spread if spread else float("nan")


@dataclass(frozen=True)
class LinearRegression:
    """Ordinary least squares."""

    def fit(self, df: DataFrame, kinds: Mapping[str, str], names: Sequence[str], target: str) -> Fitted:
        spark = SparkLinear(featuresCol="__x", labelCol="__y", regParam=0.0, solver="normal")
        return Fitted(spark.fit(features(df, kinds, names, target)), tuple(names), False)


@dataclass(frozen=True)
class LogisticRegression:
    """Logistic regression with an L2 penalty of inverse strength ``c``."""

    c: float = 1.0

    def set_c(self, c: float) -> LogisticRegression:
        return replace(self, c=c)

    def fit(self, df: DataFrame, kinds: Mapping[str, str], names: Sequence[str], target: str) -> Fitted:
        rows = df.count()
        spark = SparkLogistic(featuresCol="__x", labelCol="__y", regParam=1 / (self.c * max(1, rows)), elasticNetParam=0.0, standardization=False)
        return Fitted(spark.fit(features(df, kinds, names, target)), tuple(names), True)


#: Distinct values up to which a column can be one-hot encoded, as each becomes a column.
MOST_VALUES = 10_000


def one_hot(df: DataFrame, name: str, order: Column) -> dict[str, Column]:
    """``<name>: <value>`` -> 0/1 column, one per distinct value by first occurrence; null has zeros only."""
    seen = df.filter(quoted(name).isNotNull()).groupBy(quoted(name).alias("v")).agg(F.min(order).alias("first"))
    values = [r.v for r in seen.orderBy("first").limit(MOST_VALUES + 1).collect()]
    if len(values) > MOST_VALUES:
        raise ValueError(f"column '{name}' has more than {MOST_VALUES} distinct values")
    return {f"{name}: {v}": F.when(quoted(name) == F.lit(v), 1.0).otherwise(0.0) for v in values}


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """truth, guess, count of every pair that occurs."""
    return df.groupBy(quoted(truth).alias("truth"), quoted(guess).alias("guess")).agg(F.count(F.lit(1)).alias("count"))
