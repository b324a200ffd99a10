"""Tables of detections: one row for each object in each frame.

detections(timestep, id, x, y, z[, x_corr, y_corr, z_corr], div_prob, count, det_prob, features).
The key is (timestep, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import COM, FieldOfView, Locator, corrected, point

KEY = ["timestep", "id"]


def add(store: DataFrame, more: DataFrame) -> DataFrame:
    """Insert rows; of equal keys the one that was there first stays."""
    both = store.withColumn("_n", F.lit(0)).unionByName(more.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    return first_wins(both, "_n").drop("_n")


def first_wins(rows: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_wins(rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    """One row for each id of a frame: the last one added."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def located(rows: DataFrame, locator: Locator = COM) -> DataFrame:
    """Add x, y, z and the corrected position from the feature map."""
    features = F.col("features")
    plain, other = locator.position(features), corrected(features, locator)
    return rows.withColumns(dict(zip("xyz", plain, strict=True)) | dict(zip(("x_corr", "y_corr", "z_corr"), other, strict=True)))


def set_feature(features: Column, key: str, index: int, value: float) -> Column:
    """Set one value of a feature; an unknown key or index is an error."""
    old = features.getItem(key)
    bad = old.isNull() | (F.size(old) <= index) | (F.lit(index) < 0)
    new = F.transform(old, lambda x, i: F.when(i == index, F.lit(value).cast("float")).otherwise(x))
    rest = F.map_filter(features, lambda k, _: k != key)
    return F.when(bad, F.raise_error(F.lit(f"no value {index} of feature {key}"))).otherwise(F.map_concat(rest, F.create_map(F.lit(key), new)))


def get_feature(features: Column, key: str, index: int) -> Column:
    value = F.get(features.getItem(key), F.lit(index))
    return F.when(value.isNull(), F.raise_error(F.lit(f"no value {index} of feature {key}"))).otherwise(value)


def add_feature(features: Column, key: str, size: int) -> Column:
    """A feature of zeros, in place of one that has the name."""
    rest = F.map_filter(features, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), F.array_repeat(F.lit(0.0).cast("float"), size)))


def bounding_box(rows: DataFrame) -> DataFrame:
    axes = ["timestep", "x", "y", "z"]
    low, high = ([f(F.col(a).cast("double")) for a in axes] for f in (F.min, F.max))
    return rows.agg(F.array(*low, *high).alias("box"))


def timesteps(rows: DataFrame) -> DataFrame:
    return rows.select("timestep").distinct()


def time_range(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("timestep").alias("earliest"), F.max("timestep").alias("latest"))


def frames(rows: DataFrame) -> DataFrame:
    """Every frame from the earliest to the latest with its ids; empty frames are kept."""
    every = time_range(rows).where("earliest IS NOT NULL").select(F.explode(F.sequence("earliest", "latest")).alias("timestep"))
    ids = rows.groupBy("timestep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return every.join(ids, "timestep", "left").select("timestep", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def in_view(rows: DataFrame, fov: FieldOfView) -> DataFrame:
    return rows.where(fov.contains(F.col("timestep"), point()))


def largest_id(rows: DataFrame) -> DataFrame:
    return rows.groupBy("timestep").agg(F.max("id").alias("max_id"))
