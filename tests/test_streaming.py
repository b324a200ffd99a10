"""Streams of detections give what the tables give."""

from pyspark.sql import functions as F

from trackweave.operators import candidates
from trackweave.streaming.arcs import stream_counts, stream_pairs

SCHEMA = "timestep int, id long, x double, y double, z double, x_corr double, y_corr double, z_corr double"


def collected(spark, stream, name, mode, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


def test_pairs_and_counts_of_a_stream(spark, tmp_path):
    rows = [(t, 10 * t + k, float(k), 0.5 * t, 0.0, float(k) + 0.25, 0.5 * t, 0.0) for t in range(4) for k in range(6)]
    det = spark.createDataFrame(rows, SCHEMA)
    # frames arrive in several files, out of order
    for n, frames in enumerate(([2, 0], [3], [1])):
        det.where(F.col("timestep").isin(frames)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert n < 3
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pairs = collected(spark, stream_pairs(source(), source(), 1.0), "pairs", "append", tmp_path)
    want = candidates.in_range(det, det, 1.0, 1).collect()
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, want)) and len(want) > 20
    counts = collected(spark, stream_counts(source()), "counts", "complete", tmp_path)
    assert sorted((r.timestep, r.n, r.mean_x, r.mean_y) for r in counts) == [(t, 6, 2.5, 0.5 * t) for t in range(4)]
