"""The provided tables as detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames are hours from here.
ORIGIN = "2024-01-01 00:00:00"
SCALE = 100.0


def detections_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{ORIGIN}', cast(ts AS TIMESTAMP_NTZ))") / 3_600_000_000)
    return rows.select(
        hours.cast("int").alias("timestep"),
        F.col("event_id").alias("id"),
        F.col("user_id").cast("double").alias("x"),
        F.col("value").cast("double").alias("y"),
        F.lit(0.0).alias("z"),
        (F.col("event_id") * 37 % 100 / 100.0).alias("div_prob"),
        (1 + F.col("event_id") % 40).cast("double").alias("count"),
    )


def detections_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = [(SCALE * F.get("embedding", F.lit(k)).cast("double")).alias(a) for k, a in enumerate("xyz")]
    return rows.select(F.floor(F.col("vec_id") / 50).cast("int").alias("timestep"), F.col("vec_id").alias("id"), *at, F.create_map(F.lit("emb"), F.col("embedding")).alias("features"), "label")
