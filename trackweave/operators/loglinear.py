"""Log-linear models as tables of weighted indicator features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weight ids of the trainable chaingraph model, in order.
WEIGHTS = ["move", "appearance", "disappearance", "division", "detection", "opportunity"]


def indicator(labels: Column, at: list[int], value: float, default: float = 0.0) -> Column:
    """``value`` at one configuration of labels, ``default`` elsewhere."""
    return F.when(labels == F.array(*map(F.lit, at)), value).otherwise(default)


def hamming(label: Column, truth: Column) -> Column:
    """Loss of a label in minimisation: 0 if it is right, else -1."""
    return F.when(label == truth, 0.0).otherwise(-1.0)


def weight_table(spark: SparkSession, values: list[float], names: list[str] | None = None) -> DataFrame:
    """weights(weight, w) of a value for each name; another number of values is an error."""
    names = WEIGHTS if names is None else names
    if len(values) != len(names):
        raise ValueError(f"{len(names)} weights, but {len(values)} values")
    return spark.createDataFrame(list(zip(names, map(float, values), strict=True)), "weight string, w double")


def with_feature(features: DataFrame, weights: DataFrame, weight: str, variable: str, label: int, value: float) -> DataFrame:
    """Features with one more, of a weight that is there."""
    if weights.where(F.col("weight") == weight).isEmpty():
        raise ValueError(f"no weight {weight}")
    return features.unionByName(features.sparkSession.createDataFrame([(weight, variable, label, float(value))], "weight string, variable string, label int, value double"))


def weighted_sums(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(weight, total) of features(weight, variable, label, value) at labels(variable, label)."""
    hit = features.join(labels, ["variable", "label"], "left_semi")
    return features.select("weight").distinct().join(hit.groupBy("weight").agg(F.sum("value").alias("t")), "weight", "left").select("weight", F.coalesce("t", F.lit(0.0)).alias("total"))


def energy(sums: DataFrame, weights: DataFrame) -> DataFrame:
    """The energy of a labelling: weights(weight, w) times feature sums."""
    known = sums.join(weights, "weight", "left")
    w = F.when(F.col("w").isNull(), F.raise_error(F.lit("a feature without a weight")).cast("double")).otherwise(F.col("w"))
    return known.agg(F.coalesce(F.sum(w * F.col("total")), F.lit(0.0)).alias("energy"))


def chaingraph_features(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(weight, total) of a labelled chaingraph: nodes(timestep, id, active), arcs(src_t, src, dst_t, dst, active)."""
    key = ["timestep", "id"]
    on = arcs.where("active")
    out = on.groupBy(F.col("src_t").alias("timestep"), F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    into = on.groupBy(F.col("dst_t").alias("timestep"), F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    rows = nodes.select(*key, "active").join(out, key, "left").join(into, key, "left").select("active", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"))
    a, o, i = F.col("active"), F.col("o"), F.col("i")
    cases = [a & (o == 1), a & (i == 0), a & (o == 0), a & (o == 2), a, ~a & (o == 0)]
    counted = rows.agg(*[F.count_if(c).cast("double").alias(n) for c, n in zip(cases, WEIGHTS, strict=True)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("weight"), F.col(n).alias("total")) for n in WEIGHTS])).alias("r")).select("r.*")
