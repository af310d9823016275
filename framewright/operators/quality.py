"""Checks of data sets."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from framewright.functions.boxes import BOX
from framewright.model import Dataset
from framewright.sources.common import image_files, relative_to


class InvalidImage(ValueError):
    """An image that can't be read or is not as told."""


class MissingImages(ValueError):
    """Images without a file, or files without an image."""


def invalid_images(ds: Dataset, check_exhaustive: bool = False, raise_if_error: bool = False, check_symlink: bool = False, load_images: bool = False) -> DataFrame:
    """``(id, relative_path, reason)`` of images whose path is absolute or no file, that can't be read, or are of another size than told.

    Sizes are read from the file headers by the executors; with ``load_images`` files are decoded
    (by Spark's image source), so that damaged ones are found, and a told width or height that is
    null or not above 0 is one reason of its own. With ``check_symlink`` files that are no symbolic
    links are reported, with ``check_exhaustive`` also files that no image refers to (id null).
    """
    spark = ds.images.sparkSession
    files = image_files(spark, ds.images_root).select(F.col("relative_path").alias("__p"), F.col("width").alias("__w"), F.col("height").alias("__h"))
    told = ds.images.select("id", "relative_path", "width", "height")
    joined = told.join(files, F.col("relative_path") == F.col("__p"), "left")
    size = [F.when(F.col("__w").isNull(), "unreadable file"), F.when((F.col("width") != F.col("__w")) | (F.col("height") != F.col("__h")), "other size")]
    if load_images:
        decoded = spark.read.format("image").option("recursiveFileLookup", True).load(ds.images_root).select(relative_to(F.col("image.origin"), ds.images_root).alias("__d"), F.col("image.width").alias("__dw"), F.col("image.height").alias("__dh"))
        joined = joined.join(decoded, F.col("relative_path") == F.col("__d"), "left")
        bad = lambda c: F.coalesce(F.col(c) <= 0, F.lit(True))
        size = [F.when(F.coalesce(F.col("__dw"), F.lit(-1)) <= 0, "corrupted file"), F.when(bad("width"), "invalid width"), F.when(bad("height"), "invalid height"), F.when((F.col("width") != F.col("__dw")) | (F.col("height") != F.col("__dh")), "other size")]
    link = []
    if check_symlink:
        joined = _with_links(joined, ds.images_root)
        link = [F.when(~F.col("__link"), "not a symlink")]
    reason = F.coalesce(F.when(F.startswith("relative_path", F.lit("/")), "absolute path"), *link, F.when(F.col("__p").isNull(), "missing file"), *size)
    out = joined.select("id", "relative_path", reason.alias("reason")).filter("reason is not null")
    if check_exhaustive:
        spare = files.join(ds.images, F.col("__p") == F.col("relative_path"), "left_anti")
        out = out.unionByName(spare.select(F.lit(None).cast("bigint").alias("id"), F.col("__p").alias("relative_path"), F.lit("not in the data set").alias("reason")))
    if raise_if_error:
        first = out.limit(1).collect()
        if first:
            kind = MissingImages if first[0]["reason"] in ("missing file", "not in the data set") else InvalidImage
            raise kind(f"{first[0]['relative_path']}: {first[0]['reason']}")
    return out


def _with_links(df: DataFrame, root: str) -> DataFrame:
    """``df`` and ``__link``: whether the file below ``root`` is a symbolic link, as the executors see it."""
    base = os.path.abspath(root)

    @F.arrow_udf("boolean")
    def is_link(paths: pa.Array) -> pa.Array:
        return pa.array([p is not None and os.path.islink(os.path.join(base, p)) for p in paths.to_pylist()], pa.bool_())

    return df.withColumn("__link", is_link(F.col("relative_path")))


def remove_invalid_images(ds: Dataset, check_symlink: bool = False, load_images: bool = False) -> Dataset:
    bad = invalid_images(ds, check_symlink=check_symlink, load_images=load_images).select(F.col("id").alias("__bad"))
    return ds._with_images(ds.images.join(bad, F.col("id") == F.col("__bad"), "left_anti"))


def assert_column(df: DataFrame, column: str, kind: str | None = None, unique: bool = False, nullable: bool = True) -> None:
    """AssertionError where a column is absent, of another kind (number, string, bool), repeats or has nulls."""
    if column not in df.columns:
        raise AssertionError(f"no column {column}")
    kinds = {"number": NumericType, "string": StringType, "bool": BooleanType}
    if kind and not isinstance(df.schema[column].dataType, kinds[kind]):
        raise AssertionError(f"{column} is {df.schema[column].dataType.simpleString()}, not {kind}")
    if not nullable and not df.filter(F.col(f"`{column}`").isNull()).isEmpty():
        raise AssertionError(f"{column} has nulls")
    if unique:
        twice = df.groupBy(F.col(f"`{column}`").alias("v")).count().filter("count > 1").limit(3).collect()
        if twice:
            raise AssertionError(f"{column} repeats {[r[0] for r in twice]}")


def assert_required_columns(ds: Dataset) -> None:
    for df, needed in ((ds.images, ("id", "width", "height", "relative_path")), (ds.annotations, ("id", "image_id", "category_id", *BOX))):
        gone = [c for c in needed if c not in df.columns]
        if gone:
            raise AssertionError(f"no columns {gone}")


def assert_names_normalized(df: DataFrame) -> None:
    """No name is both a column and the start of a dotted one."""
    clash = [c for c in df.columns if any(o.startswith(c + ".") for o in df.columns)]
    if clash:
        raise AssertionError(f"{clash} are columns and prefixes")


def assert_ids_well_formed(ds: Dataset) -> None:
    for df in (ds.images, ds.annotations):
        assert_column(df, "id", "number", unique=True, nullable=False)
    lost = ds.annotations.join(ds.images.select(F.col("id").alias("__i")), F.col("image_id") == F.col("__i"), "left_anti").limit(3).collect()
    if lost:
        raise AssertionError(f"unknown images {[r['image_id'] for r in lost]}")


def assert_label_map_well_formed(ds: Dataset) -> None:
    known = list(ds.label_map)
    rest = ds.annotations.filter(~F.col("category_id").isin(known)) if known else ds.annotations
    first = rest.limit(1).collect()
    if first:
        raise AssertionError(f"category {first[0]['category_id']} has no label")


def assert_boxes_well_formed(ds: Dataset, allow_keypoints: bool = False) -> None:
    bad = ds.malformed_boxes(allow_keypoints).limit(3).collect()
    if bad:
        raise AssertionError(f"malformed boxes of annotations {[r['id'] for r in bad]}")


def full_check(ds: Dataset, allow_keypoints: bool = False, check_images: bool = True, check_exhaustive: bool = False) -> None:
    """Every check in turn; the first failure raises."""
    assert_required_columns(ds)
    for df in (ds.images, ds.annotations):
        assert_names_normalized(df)
    assert_ids_well_formed(ds)
    assert_label_map_well_formed(ds)
    assert_boxes_well_formed(ds, allow_keypoints)
    if check_images:
        if not os.path.isdir(ds.images_root):
            raise AssertionError(f"no folder {ds.images_root}")
        invalid_images(ds, check_exhaustive, raise_if_error=True)


def assert_frame_intersections_equal(left: DataFrame, right: DataFrame, key: str = "id") -> None:
    """Rows of common keys must agree on common columns, nulls being equal."""
    cols = [c for c in left.columns if c in right.columns and c != key]
    both = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"))
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    bad = both.filter(differs).select(F.col(f"l.{key}")).limit(3).collect()
    if bad:
        raise AssertionError(f"rows {[r[0] for r in bad]} differ")


def assert_datasets_equal(a: Dataset, b: Dataset, ignore_index: bool = False, optional_columns: tuple[str, ...] = (), remove_na_columns: bool = False) -> None:
    """Same labels and rows; with ``ignore_index`` ids are compared by what they stand for (image paths)."""
    from framewright.sources.common import without_null_columns

    if a.label_map != b.label_map:
        raise AssertionError("label maps differ")

    def frames(ds: Dataset) -> list[DataFrame]:
        images, notes = ds.images, ds.annotations
        if ignore_index:
            paths = images.select(F.col("id").alias("__i"), F.col("relative_path").alias("image"))
            notes = notes.join(paths, F.col("image_id") == F.col("__i"), "left").drop("__i", "image_id", "id")
            images = images.drop("id")
        out = [images.drop(*optional_columns), notes.drop(*optional_columns)]
        return [without_null_columns(x, ()) if remove_na_columns else x for x in out]

    for what, x, y in zip(("images", "annotations"), frames(a), frames(b), strict=True):
        if sorted(x.columns) != sorted(y.columns):
            raise AssertionError(f"{what}: columns {sorted(set(x.columns) ^ set(y.columns))} are on one side only")
        y = y.select(*(F.col(f"`{c}`").cast(x.schema[c].dataType).alias(c) for c in x.columns))
        more, less = x.exceptAll(y), y.exceptAll(x)
        row = more.limit(1).collect() or less.limit(1).collect()
        if row:
            raise AssertionError(f"{what} differ, as {row[0]}")


def archive_check(ds: Dataset, folder: str, regenerate: bool = False, check_images: bool = False, **how) -> bool:  # noqa: ANN003
    """Compare with the data set stored in a folder; store it first where there is none or ``regenerate``. False if it was stored.

    With ``check_images`` the digests of the image files are stored and compared as well.
    """
    from framewright.sources.writers import from_parquet, to_parquet

    if check_images:
        ds = ds.with_(images=ds.images.join(image_digests(ds), "relative_path", "left"))
    if regenerate or not os.path.exists(os.path.join(folder, "metadata.yaml")):
        to_parquet(ds, folder, overwrite=True)
        return False
    assert_datasets_equal(from_parquet(ds.images.sparkSession, folder), ds, **how)
    return True


def image_digests(ds: Dataset) -> DataFrame:
    """``(relative_path, sha256)`` of the image files."""
    from framewright.sources.common import relative_to

    files = ds.images.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(ds.images_root)
    return files.select(relative_to(F.col("path"), ds.images_root).alias("relative_path"), F.sha2("content", 256).alias("sha256")).join(ds.images.select("relative_path"), "relative_path", "left_semi")
