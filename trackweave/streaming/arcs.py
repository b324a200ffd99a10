"""Candidate arcs and frame statistics over streams of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.candidates import in_range


def stream_pairs(detections: DataFrame, again: DataFrame, radius: float) -> DataFrame:
    """Pairs in range in consecutive frames, as a stream-stream join on frame and grid cell.

    ``detections`` and ``again`` are two streams over one source, with corrected positions.
    """
    return in_range(detections, again, radius, 1)


def stream_counts(detections: DataFrame) -> DataFrame:
    """Detections by frame, for the update or complete output mode."""
    return detections.groupBy("timestep").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
