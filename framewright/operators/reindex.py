"""New ids for images and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.model import ANNOTATION_TYPES, IMAGE_TYPES, Dataset, formatted
from framewright.operators.numbering import numbered


def _order(by: list[str] | str | None) -> list[Column]:
    by = [by] if isinstance(by, str) else list(by or [])
    return [*(F.col(f"`{c}`").asc_nulls_last() for c in by), F.col("id")]


def index_map(df: DataFrame, by: list[str] | str | None = None, start: int = 0) -> DataFrame:
    """``(old_id, new_id)``: consecutive ids from ``start`` in the order of ``by``, then id."""
    cols = ["id", *([by] if isinstance(by, str) else by or [])]
    return numbered(df.select(*dict.fromkeys(cols)), _order(by), "new_id").select(F.col("id").alias("old_id"), (F.col("new_id") + start).alias("new_id"))


def reset_index(ds: Dataset, start_image_id: int = 0, start_annotations_id: int = 0, sort_images_by: list[str] | str | None = None, sort_annotations_by: list[str] | str | None = None) -> Dataset:
    """Consecutive ids for both tables; references follow."""
    return apply_maps(ds, index_map(ds.images, sort_images_by, start_image_id), index_map(ds.annotations, sort_annotations_by, start_annotations_id), True)


def _completed(df: DataFrame, mapping: DataFrame | None, remove_unmapped: bool) -> DataFrame:
    """The mapping of every id of ``df``: ids without one get numbers after the greatest new id, in ascending order."""
    ids = df.select(F.col("id").alias("old_id"))
    if mapping is None:
        return ids.select("old_id", F.col("old_id").alias("new_id"))
    mapping = mapping.select(F.col("old_id").cast("bigint").alias("old_id"), F.col("new_id").cast("bigint").alias("new_id"))
    known = ids.join(mapping, "old_id")
    if remove_unmapped:
        return known
    rest = ids.join(mapping, "old_id", "left_anti")
    after = mapping.agg((F.coalesce(F.max("new_id"), F.lit(-1)) + 1).alias("after"))
    return known.unionByName(numbered(rest, [F.col("old_id")], "k").crossJoin(F.broadcast(after)).select("old_id", (F.col("after") + F.col("k")).alias("new_id")))


def apply_maps(ds: Dataset, images_map: DataFrame | None, annotations_map: DataFrame | None, remove_unmapped: bool = False) -> Dataset:
    """Ids replaced by maps ``(old_id, new_id)``; annotations of images that go are gone too."""
    im, an = _completed(ds.images, images_map, remove_unmapped), _completed(ds.annotations, annotations_map, remove_unmapped)
    images = ds.images.join(im, F.col("id") == F.col("old_id")).drop("id", "old_id").withColumnRenamed("new_id", "id")
    refs = im.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__image"))
    annotations = ds.annotations.join(an, F.col("id") == F.col("old_id")).drop("id", "old_id").withColumnRenamed("new_id", "id")
    annotations = annotations.join(refs, F.col("image_id") == F.col("__old")).drop("image_id", "__old").withColumnRenamed("__image", "image_id")
    return ds.with_(images=formatted(images, IMAGE_TYPES), annotations=formatted(annotations, ANNOTATION_TYPES))


def match_index(ds: Dataset, other_images: DataFrame, on: str = "relative_path", remove_unmatched: bool = False) -> Dataset:
    """Image ids taken from ``other_images`` where the column ``on`` is equal; repeated values on either side raise ValueError."""
    for side in (ds.images, other_images):
        if not side.groupBy(on).count().filter(f"count > 1 and `{on}` is not null").isEmpty():
            raise ValueError(f"values of {on} are not unique")
    mapping = ds.images.select(F.col("id").alias("old_id"), F.col(on).alias("__k")).join(other_images.select(F.col("id").alias("new_id"), F.col(on).alias("__k")), "__k").select("old_id", "new_id")
    return apply_maps(ds, mapping, None, False) if not remove_unmatched else apply_maps(ds, mapping, ds.annotations.select(F.col("id").alias("old_id"), F.col("id").alias("new_id")), True)
