"""Seeded data sets for tests and examples, made by column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.boxes import BOX
from framewright.model import Dataset


def unit(seed: int, *salt: str | int, id_column: str = "id") -> Column:
    """A number in [0, 1) fixed by the row's id, the seed and the salt."""
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(seed), *(F.lit(str(s)) for s in salt)), F.lit(1 << 53)) / float(1 << 53)


def pick(values: list, seed: int, *salt: str | int) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.floor(unit(seed, *salt) * len(values)) + 1).cast("int"))


def dummy_dataset(spark: SparkSession, n_images: int = 10, n_annotations: int = 100, labels: list[str] | None = None, seed: int = 0, split_names: list[str] | None = None, keypoints_share: float = 0.0, confidence: bool = False, attributes: dict[str, list] | None = None, image_attributes: dict[str, list] | None = None) -> Dataset:
    """Images and boxes inside them. Same arguments, same rows, whatever the partitions."""
    labels = labels or ["person", "car", "boat"]
    images = spark.range(n_images).select("id", (F.lit(320) + F.floor(unit(seed, "w") * 1600)).cast("int").alias("width"), (F.lit(240) + F.floor(unit(seed, "h") * 840)).cast("int").alias("height"), F.format_string("image_%08d.jpg", "id").alias("relative_path"), *([pick(split_names, seed, "split").alias("split")] if split_names else []), *(pick(v, seed, "i", k).alias(k) for k, v in (image_attributes or {}).items()))
    notes = spark.range(n_annotations).select("id", F.floor(unit(seed, "image") * n_images).cast("bigint").alias("image_id"), F.floor(unit(seed, "class") * len(labels)).cast("int").alias("category_id"), *(unit(seed, c).alias(c) for c in "abcd"), (unit(seed, "point") < keypoints_share).alias("point"), *([unit(seed, "confidence").alias("confidence")] if confidence else []), *(pick(v, seed, "a", k).alias(k) for k, v in (attributes or {}).items()))
    sized = notes.join(images.select(F.col("id").alias("__i"), "width", "height"), F.col("image_id") == F.col("__i"))
    w, h = F.when(F.col("point"), F.lit(0.0)).otherwise((F.col("c") * 0.9 + 0.1) * F.col("width") / 2), F.when(F.col("point"), F.lit(0.0)).otherwise((F.col("d") * 0.9 + 0.1) * F.col("height") / 2)
    boxes = [F.col("a") * (F.col("width") - w), F.col("b") * (F.col("height") - h), w, h]
    keep = [c for c in notes.columns if c not in (*"abcd", "point")]
    return Dataset.build(images, sized.select(*(F.col(f"`{c}`") for c in keep), *(x.alias(n) for x, n in zip(boxes, BOX, strict=True))), dict(enumerate(labels)), ".", "dummy")


def as_predictions(ds: Dataset, seed: int = 1, jitter: float = 0.1) -> DataFrame:
    """Annotations moved a little and given a confidence."""
    move = lambda c, size: F.col(c) + (unit(seed, c) - 0.5) * 2 * jitter * F.col(size)
    return ds.annotations.withColumns({"box_x_min": move("box_x_min", "box_width"), "box_y_min": move("box_y_min", "box_height"), "confidence": unit(seed, "confidence")})
