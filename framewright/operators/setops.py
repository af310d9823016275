"""Union and difference of data sets."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.model import ANNOTATION_TYPES, IMAGE_TYPES, Dataset, formatted
from framewright.operators.labels import IncompatibleLabelMapsError, merge_label_maps, remap_from_other
from framewright.operators.onehot import align_bool_columns
from framewright.operators.reindex import reset_index


def _common_root(a: str, b: str) -> str:
    if os.path.isabs(a) or os.path.isabs(b):
        a, b = os.path.abspath(a), os.path.abspath(b)
    return os.path.commonpath([a, b]) or "."


def mark_origin(ds: Dataset, overwrite: bool = False) -> Dataset:
    """``origin`` and ``origin_id`` on both tables, where they are not there yet."""
    add = lambda df: df if "origin" in df.columns and not overwrite else df.withColumns({"origin": F.lit(ds.dataset_name), "origin_id": F.col("id")})
    return ds.with_(images=add(ds.images), annotations=add(ds.annotations))


def _differs(columns: list[str]):
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return out


def merge(a: Dataset, b: Dataset, allow_overlapping_image_ids: bool = True, realign_label_map: bool = False, ignore_index: bool = False, mark: bool = False) -> Dataset:
    """Both data sets in one.

    Images under one id must agree on common columns (AssertionError), the first's row wins and
    takes over the second's other columns; without ``allow_overlapping_image_ids`` a common id
    raises ValueError. Annotation ids of the second are shifted as a whole if any id is in both.
    ``ignore_index`` numbers both anew first. Columns of one side only are null on the other.
    """
    if realign_label_map:
        b = remap_from_other(b, a.label_map)
    labels = merge_label_maps(a.label_map, b.label_map, "outer")
    if mark:
        a, b = mark_origin(a), mark_origin(b)
    if ignore_index:
        a = reset_index(a)
        b = reset_index(b, a.images.count(), a.annotations.count())
    root = _common_root(a.images_root, b.images_root)
    a, b = a.reset_images_root(root), b.reset_images_root(root)
    tracked = {k: tuple(sorted(set(a.booleanized.get(k, ())) | set(b.booleanized.get(k, ())))) for k in {**a.booleanized, **b.booleanized}}
    frames = {}
    for side in ("images", "annotations"):
        l, r = getattr(a, side), getattr(b, side)  # noqa: E741
        here = {k: v for k, v in tracked.items() if any(c.startswith(k + ".") for c in [*l.columns, *r.columns])}
        frames[side] = align_bool_columns(l, r, here)
    li, ri = frames["images"]
    shared = [c for c in li.columns if c in ri.columns and c != "id"]
    both = li.alias("l").join(ri.alias("r"), F.col("l.id") == F.col("r.id"), "full_outer")
    mutual = both.filter("l.id is not null and r.id is not null")
    if not allow_overlapping_image_ids and not mutual.isEmpty():
        raise ValueError("image ids overlap")
    if not mutual.filter(_differs([c for c in shared if not c.startswith("origin")])).isEmpty():
        raise AssertionError("images of one id differ")
    columns = dict.fromkeys([*li.columns, *ri.columns])
    images = both.select(*(F.coalesce(*(F.col(f"{s}.`{c}`") for s, f in (("l", li), ("r", ri)) if c in f.columns)).alias(c) for c in columns))
    la, ra = frames["annotations"]
    if not la.join(ra, "id", "left_semi").isEmpty():
        top, low = la.agg(F.max("id")).first()[0], ra.agg(F.min("id")).first()[0]
        ra = ra.withColumn("id", F.col("id") + (top - low + 1))
    name = "+".join(n for n in (a.dataset_name, b.dataset_name) if n) or None
    return Dataset(formatted(images, IMAGE_TYPES), formatted(la.unionByName(ra, allowMissingColumns=True), ANNOTATION_TYPES), labels, root, a.dataset_name if a.dataset_name == b.dataset_name else name, tracked)


def add(a: Dataset, b: Dataset) -> Dataset:
    """``a + b``: classes aligned by name where the maps clash, ids numbered anew where they do."""
    try:
        merge_label_maps(a.label_map, b.label_map)
    except IncompatibleLabelMapsError:
        warnings.warn("label maps clash; the second is aligned by name", stacklevel=2)
        b = remap_from_other(b, a.label_map)
    try:
        return merge(a, b)
    except (ValueError, AssertionError):
        return merge(a, b, ignore_index=True)


def status(left: DataFrame, right: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``(id, status)``: left_only, right_only, changed or same, by null-safe comparison of the common columns."""
    cols = [c for c in left.columns if c in right.columns and c not in ("id", *exclude)]
    both = left.alias("l").join(right.alias("r"), F.col("l.id") == F.col("r.id"), "full_outer")
    kind = F.when(F.col("r.id").isNull(), "left_only").when(F.col("l.id").isNull(), "right_only").when(_differs(cols), "changed").otherwise("same")
    return both.select(F.coalesce("l.id", "r.id").alias("id"), kind.alias("status"))


def diff(left: Dataset, right: Dataset, exclude_image_columns: tuple[str, ...] = (), exclude_annotations_columns: tuple[str, ...] = ()) -> tuple[Dataset, Dataset, Dataset]:
    """(only left, only right, common).

    A side's data set has its own and the changed images with all their annotations, and the
    images of its own or changed annotations with those. Common are unchanged images with at
    least one unchanged annotation, and these annotations; all of it where the two are equal.
    Clashing labels or columns give (left, right, empty) and a warning.
    """
    try:
        merge_label_maps(left.label_map, right.label_map)
    except IncompatibleLabelMapsError:
        warnings.warn("label maps clash", stacklevel=2)
        return left, right, left.filter_images(F.lit(False))
    if set(left.images.columns) - set(exclude_image_columns) != set(right.images.columns) - set(exclude_image_columns) or set(left.annotations.columns) - set(exclude_annotations_columns) != set(right.annotations.columns) - set(exclude_annotations_columns):
        warnings.warn("columns differ", stacklevel=2)
        return left, right, left.filter_images(F.lit(False))
    images = status(left.images, right.images, exclude_image_columns)
    notes = status(left.annotations, right.annotations, exclude_annotations_columns)

    def only(ds: Dataset, own: str) -> Dataset:
        moved = images.filter(F.col("status").isin(own, "changed")).select(F.col("id").alias("__i"))
        stay = images.filter("status = 'same'").select(F.col("id").alias("__i"))
        news = notes.filter(F.col("status").isin(own, "changed")).select("id")
        whole = ds.annotations.join(moved, F.col("image_id") == F.col("__i"), "left_semi")
        part = ds.annotations.join(stay, F.col("image_id") == F.col("__i"), "left_semi").join(news, "id", "left_semi")
        ids = moved.unionByName(part.select(F.col("image_id").alias("__i"))).distinct()
        return ds.with_(images=ds.images.join(ids, F.col("id") == F.col("__i"), "left_semi"), annotations=whole.unionByName(part))

    same_images = images.filter("status = 'same'").select(F.col("id").alias("__i"))
    same_notes = left.annotations.join(notes.filter("status = 'same'").select("id"), "id", "left_semi").join(same_images, F.col("image_id") == F.col("__i"), "left_semi")
    equal = images.filter("status <> 'same'").isEmpty() and notes.filter("status <> 'same'").isEmpty()
    kept = left.images if equal else left.images.join(same_notes.select(F.col("image_id").alias("__i")), F.col("id") == F.col("__i"), "left_semi")
    return only(left, "left_only"), only(right, "right_only"), left.with_(images=kept, annotations=same_notes)
