"""Label images as nested arrays: pixels of objects, and writing ids back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixel_rows(images: DataFrame, n_dim: int) -> DataFrame:
    """(image, pos, label), one row a pixel, of images(image, labels nested n_dim times)."""
    rows = images.select("image", F.posexplode("labels").alias("p0", "v"))
    for k in range(1, n_dim):
        rows = rows.select("image", *[f"p{j}" for j in range(k)], F.posexplode("v").alias(f"p{k}", "v"))
    return rows.select("image", F.array(*[f"p{k}" for k in range(n_dim)]).alias("pos"), F.col("v").cast("long").alias("label"))


def extract(rows: DataFrame, objects: DataFrame, offsets: list[int]) -> DataFrame:
    """(timestep, id, pixel) of objects(image, timestep, id, count); a wrong count is an error."""
    shift = F.array(*map(F.lit, offsets))
    hit = rows.join(objects, (rows["image"] == objects["image"]) & (rows["label"] == objects["id"])).select("timestep", "id", "count", F.zip_with("pos", shift, lambda a, b: a + b).alias("pixel"))
    lists = hit.groupBy("timestep", "id", "count").agg(F.collect_list("pixel").alias("pixels"))
    known = objects.select("timestep", "id", "count").join(lists, ["timestep", "id", "count"], "left")
    right = F.coalesce(F.size("pixels"), F.lit(0)) == F.col("count")
    checked = F.when(right, F.col("pixels")).otherwise(F.raise_error(F.lit("the number of pixels is not the count")).cast("array<array<int>>"))
    return known.select("timestep", "id", F.explode(checked).alias("pixel"))


def update(rows: DataFrame, pixels: DataFrame, offsets: list[int], id_: int) -> DataFrame:
    """Write an id at pixels(pixel) less the offsets; pixels outside of the image are dropped.

    Pixels with an ``image`` go into that one; without, into every image of ``rows``.
    """
    if "image" in pixels.columns:
        return update_many(rows, pixels.select("image", "pixel", F.lit(id_).alias("id")), offsets)
    shift = F.array(*map(F.lit, offsets))
    new = pixels.select(F.zip_with("pixel", shift, lambda a, b: (a - b).cast("int")).alias("pos")).distinct().withColumn("new", F.lit(id_).cast("long"))
    return rows.join(new, "pos", "left").select("image", "pos", F.coalesce("new", "label").alias("label"))


def update_many(rows: DataFrame, pixels: DataFrame, offsets: list[int]) -> DataFrame:
    """Write the ids of many objects, pixels(image, id, pixel), each into its own image; where two meet, the larger id."""
    shift = F.array(*map(F.lit, offsets))
    at = F.zip_with("pixel", shift, lambda a, b: (a - b).cast("int"))
    new = pixels.select("image", at.alias("pos"), F.col("id").cast("long").alias("new")).groupBy("image", "pos").agg(F.max("new").alias("new"))
    return rows.join(new, ["image", "pos"], "left").select("image", "pos", F.coalesce("new", "label").alias("label"))


def extract_one(rows: DataFrame, image: int, offsets: list[int], timestep: int, id_: int, count: int) -> DataFrame:
    """(timestep, id, pixel) of one object of an image, given its frame, id and number of pixels."""
    one = rows.sparkSession.createDataFrame([(image, timestep, id_, count)], "image long, timestep int, id long, count long")
    return extract(rows, one, offsets)


def update_one(rows: DataFrame, coordinates: DataFrame, offsets: list[int], timestep: int, id_: int) -> DataFrame:
    """Write an object's id at its pixels in coordinates(timestep, id, pixel); an unknown object is an error."""
    mine = coordinates.where((F.col("timestep") == timestep) & (F.col("id") == id_))
    if mine.isEmpty():
        raise KeyError(f"no object {id_} in frame {timestep}")
    return update(rows, mine.select("pixel"), offsets, id_)
