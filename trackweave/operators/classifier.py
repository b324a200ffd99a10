"""Random forests on detection features: training, and a probability as a new feature."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_vector(features: Column, names: list[str]) -> Column:
    """The named features, one after the other; missing ones are left out."""
    parts = [F.coalesce(features.getItem(n).cast("array<double>"), F.array().cast("array<double>")) for n in names]
    return F.flatten(F.array(*parts))


def train(rows: DataFrame, names: list[str], label: str = "label", trees: int = 20, seed: int = 7) -> RandomForestClassificationModel:
    ready = rows.select(array_to_vector(feature_vector(F.col("features"), names)).alias("v"), F.col(label).cast("double").alias("y"))
    return RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=trees, seed=seed).fit(ready)


def predict(rows: DataFrame, model: RandomForestClassificationModel, names: list[str], cls: int = 1, output: str = "cellness") -> DataFrame:
    """Add P(cls) as a feature of length one."""
    if not 0 <= cls < model.numClasses:
        raise IndexError("no such class")
    scored = model.setFeaturesCol("_v").transform(rows.withColumn("_v", array_to_vector(feature_vector(F.col("features"), names))))
    p = F.array(F.get(vector_to_array("probability"), F.lit(cls)).cast("float"))
    rest = F.map_filter("features", lambda k, _: k != output)
    return scored.withColumn("features", F.map_concat(rest, F.create_map(F.lit(output), p))).select(*rows.columns)


def count_above(rows: DataFrame, least: float = 0.5, name: str = "cellness") -> int:
    """How many rows have a predicted probability of at least ``least``."""
    return rows.where(F.get(F.col("features").getItem(name), F.lit(0)) >= least).count()
