"""Detections, events, pixel lists, forests and factor tables on storage, as Parquet with checked schemas."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "slot int, type string, traxel_ids array<bigint>"
PIXELS = "timestep int, id bigint, pixel array<double>"
FEATURES = "timestep int, id bigint, alive boolean, name string, value array<float>"


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in schema.split(", ")]  # type: ignore[misc]


def _shaped(rows: DataFrame, schema: str) -> DataFrame:
    """The schema's columns, cast; a missing one is an error."""
    if missing := [c for c, _ in _columns(schema) if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*[F.col(c).cast(kind) for c, kind in _columns(schema)])


def write_detections(rows: DataFrame, path: str) -> None:
    """All columns, in files by frame, so that a range of frames reads no others."""
    if not {"timestep", "id"} <= set(rows.columns):
        raise ValueError("detections have timestep and id")
    rows.repartitionByRange("timestep").sortWithinPartitions("timestep", "id").write.mode("overwrite").parquet(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_events(found: DataFrame, path: str) -> None:
    _shaped(found, EVENTS).repartitionByRange("slot").sortWithinPartitions("slot", "type").write.mode("overwrite").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(path)


def write_pixels(pixels: DataFrame, path: str) -> None:
    _shaped(pixels, PIXELS).repartitionByRange("timestep", "id").write.mode("overwrite").parquet(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PIXELS).parquet(path)


def write_features(rows: DataFrame, path: str) -> None:
    """One row a detection and feature, from rows(timestep, id, features[, alive])."""
    alive = F.col("alive") if "alive" in rows.columns else F.lit(True)
    long = rows.select("timestep", "id", alive.alias("alive"), F.explode_outer("features").alias("name", "value"))
    _shaped(long, FEATURES).repartitionByRange("timestep").write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Detections (timestep, id, features) of the labels that are alive."""
    rows = spark.read.schema(FEATURES).parquet(path).where("alive")
    pairs = F.filter(F.collect_list(F.struct("name", "value")), lambda e: e["name"].isNotNull())
    return rows.groupBy("timestep", "id").agg(F.map_from_entries(pairs).alias("features"))


def save_forest(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_forest(path: str) -> RandomForestClassificationModel:
    """A saved forest; none at ``path`` is an error."""
    return RandomForestClassificationModel.load(path)


def write_model(variables: DataFrame, entries: DataFrame, path: str) -> None:
    variables.write.mode("overwrite").parquet(f"{path}/variables")
    entries.write.mode("overwrite").parquet(f"{path}/factors")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/variables"), spark.read.parquet(f"{path}/factors")
