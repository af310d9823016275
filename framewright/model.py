"""The data set: two linked lazy tables, images and annotations, and a label map."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from framewright.functions.boxes import BOX, capped, malformed
from framewright.operators.numbering import numbered

IMAGE_TYPES = {"id": "bigint", "width": "int", "height": "int", "relative_path": "string", "type": "string", "split": "string"}
ANNOTATION_TYPES = {"id": "bigint", "image_id": "bigint", "category_str": "string", "category_id": "int", "split": "string"} | dict.fromkeys(BOX, "double")


def q(name: str) -> str:
    """A column name quoted, as attribute names may hold dots."""
    return f"`{name}`"


def formatted(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Core columns first, cast with nulls kept; then the others by number of dots and name."""
    core = [F.col(q(c)).cast(t).alias(c) for c, t in types.items() if c in df.columns]
    rest = sorted((c for c in df.columns if c not in types), key=lambda c: (c.count("."), c))
    return df.select(*core, *(F.col(q(c)) for c in rest))


def label_column(label_map: dict[int, str], category: Column) -> Column:
    """Name of a category id; the id's digits where the map has none."""
    if not label_map:
        return category.cast("string")
    pairs = [F.lit(x) for k, v in label_map.items() for x in (int(k), v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category.cast("int")), category.cast("string"))


@dataclass(frozen=True)
class Dataset:
    """Images (unique ``id``) and annotations (``image_id`` refers to an image) with boxes in pixels.

    Every operation gives a new data set of lazy plans. Row order, where it counts, is ascending id.
    """

    images: DataFrame
    annotations: DataFrame
    label_map: dict[int, str] = field(default_factory=dict)
    images_root: str = "."
    dataset_name: str | None = None
    booleanized: dict[str, tuple[str, ...]] = field(default_factory=dict)

    # ------------------------------------------------------------ building
    @staticmethod
    def build(images: DataFrame, annotations: DataFrame | None = None, label_map: dict[int, str] | None = None, images_root: str = ".", dataset_name: str | None = None, validate: bool = False, booleanized: dict[str, tuple[str, ...]] | None = None) -> Dataset:
        """A data set with the core columns checked and derived ones added.

        ``type`` is the file suffix, ``category_str`` comes from the label map, ``split`` of an
        annotation from its image. With ``validate``, duplicate image ids and annotations of
        unknown images raise ValueError, and duplicate annotation ids are numbered anew.
        """
        for c in ("id", "width", "height", "relative_path"):
            if c not in images.columns:
                raise ValueError(f"images lack the column {c}")
        if "type" not in images.columns:
            images = images.withColumn("type", F.regexp_extract("relative_path", r"(\.[^./]+)$", 1))
        images = formatted(images, IMAGE_TYPES)
        if annotations is None:
            spark = images.sparkSession
            annotations = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ANNOTATION_TYPES.items() if c != "split"))
        for c in ("id", "image_id", "category_id", *BOX):
            if c not in annotations.columns:
                raise ValueError(f"annotations lack the column {c}")
        label_map = {int(k): str(v) for k, v in (label_map or {}).items()}
        annotations = annotations.withColumn("category_str", label_column(label_map, F.col("category_id")))
        if "split" in images.columns:
            splits = images.select(F.col("id").alias("__image"), F.col("split"))
            annotations = annotations.drop("split").join(splits, F.col("image_id") == F.col("__image"), "left").drop("__image")
        annotations = formatted(annotations, ANNOTATION_TYPES)
        ds = Dataset(images, annotations, label_map, images_root, dataset_name, booleanized or {})
        return ds.validated() if validate else ds

    def validated(self) -> Dataset:
        if not self.images.groupBy("id").count().filter("count > 1").isEmpty():
            raise ValueError("image ids are not unique")
        lost = self.annotations.join(self.images, F.col("image_id") == self.images["id"], "left_anti").select("image_id").distinct().limit(5).collect()
        if lost:
            raise ValueError(f"annotations refer to unknown images, as {', '.join(str(r[0]) for r in lost)}")
        if self.annotations.groupBy("id").count().filter("count > 1").isEmpty():
            return self
        warnings.warn("annotation ids are not unique; they are numbered anew", stacklevel=2)
        fresh = numbered(self.annotations, [F.col("id"), F.col("image_id"), *(F.col(b) for b in BOX)], "__new")
        return replace(self, annotations=formatted(fresh.drop("id").withColumnRenamed("__new", "id"), ANNOTATION_TYPES))

    def rename(self, name: str | None) -> Dataset:
        return replace(self, dataset_name=name)

    def with_(self, **overrides: Any) -> Dataset:
        """A copy with some fields changed; tracked one-hot columns that are gone are forgotten."""
        new = replace(self, **overrides)
        there = set(new.images.columns) | set(new.annotations.columns)
        return replace(new, booleanized={k: v for k, v in new.booleanized.items() if all(f"{k}.{x}" in there for x in v)})

    # ------------------------------------------------------------ looking
    def __len__(self) -> int:
        return self.images.count()

    def len_annot(self) -> int:
        return self.annotations.count()

    def __bool__(self) -> bool:
        return not self.images.isEmpty()

    def __add__(self, other: Dataset) -> Dataset:
        """The union with another data set; ids are given anew where they clash."""
        from framewright.operators.setops import add

        return add(self, other)

    def __radd__(self, other: Dataset | int) -> Dataset:
        """The start of ``sum`` of data sets."""
        return self if other == 0 else NotImplemented

    def __sub__(self, other: Dataset) -> Dataset:
        """What this data set has and the other lacks or has otherwise."""
        from framewright.operators.setops import diff

        return diff(self, other)[0]

    def __repr__(self) -> str:
        return f"Dataset({self.dataset_name!r}, root={self.images_root!r}, {len(self.label_map)} classes, images: {', '.join(self.images.columns)}; annotations: {', '.join(self.annotations.columns)})"

    def _repr_html_(self) -> str:
        return self.images.limit(10).toPandas().to_html() + self.annotations.limit(10).toPandas().to_html()

    def image_attributes(self) -> DataFrame:
        return self.images.select("id", *(F.col(q(c)) for c in self.images.columns if c not in IMAGE_TYPES))

    def annotation_attributes(self) -> DataFrame:
        return self.annotations.select("id", *(F.col(q(c)) for c in self.annotations.columns if c not in ANNOTATION_TYPES))

    # ------------------------------------------------------------ filters
    def _with_images(self, images: DataFrame) -> Dataset:
        ids = images.select(F.col("id").alias("__kept"))
        return self.with_(images=images, annotations=self.annotations.join(ids, F.col("image_id") == F.col("__kept"), "left_semi"))

    def filter_images(self, condition: Column | str | list[int]) -> Dataset:
        """Images that meet a condition (or whose ids are listed) and their annotations."""
        if isinstance(condition, list):
            condition = F.col("id").isin(condition)
        return self._with_images(self.images.filter(condition))

    def iloc_images(self, index: int | slice | list[int]) -> Dataset:
        """Images by place in ascending id, and their annotations."""
        places = numbered(self.images.select("id"), [F.col("id")])
        return self._with_images(self.images.join(places.filter(_at(index, places)).select("id"), "id", "left_semi"))

    __getitem__ = iloc_images

    def filter_annotations(self, condition: Column | str | list[int], remove_emptied_images: bool = False) -> Dataset:
        """Annotations that meet a condition; with ``remove_emptied_images``, images that lose all of theirs go (images that had none stay)."""
        if isinstance(condition, list):
            condition = F.col("id").isin(condition)
        return self._with_annotations(self.annotations.filter(condition), remove_emptied_images)

    def iloc_annotations(self, index: int | slice | list[int], remove_emptied_images: bool = False) -> Dataset:
        places = numbered(self.annotations.select("id"), [F.col("id")])
        return self._with_annotations(self.annotations.join(places.filter(_at(index, places)).select("id"), "id", "left_semi"), remove_emptied_images)

    def _with_annotations(self, kept: DataFrame, remove_emptied_images: bool) -> Dataset:
        if not remove_emptied_images:
            return self.with_(annotations=kept)
        had = self.annotations.groupBy(F.col("image_id").alias("__i")).agg(F.lit(1).alias("__had"))
        have = kept.groupBy(F.col("image_id").alias("__i")).agg(F.lit(1).alias("__have"))
        state = had.join(have, "__i", "left").filter("__have is null").select("__i")
        return self.with_(annotations=kept, images=self.images.join(state, F.col("id") == F.col("__i"), "left_anti"))

    def empty_annotations(self) -> Dataset:
        return self.with_(annotations=self.annotations.filter(F.lit(False)))

    def remove_empty_images(self) -> Dataset:
        has = self.annotations.select(F.col("image_id").alias("__i"))
        return self.with_(images=self.images.join(has, F.col("id") == F.col("__i"), "left_semi"))

    def get_split(self, split: str | None) -> Dataset:
        if "split" not in self.images.columns:
            warnings.warn("the images have no split", stacklevel=2)
            return self._with_images(self.images.filter(F.lit(False)))
        return self._with_images(self.images.filter(F.col("split").eqNullSafe(F.lit(split))))

    def iter_splits(self) -> Iterator[tuple[str | None, Dataset]]:
        if "split" not in self.images.columns:
            yield None, self
            return
        for (split,) in sorted(self.images.select("split").distinct().collect(), key=lambda r: (r[0] is None, r[0] or "")):
            yield split, self.get_split(split)

    def get_one_frame(self, n: int) -> tuple[Row, DataFrame]:
        """The n-th image and its annotations."""
        one = self.iloc_images(n)
        return one.images.first(), one.annotations

    def iter_images(self) -> Iterator[tuple[Row, list[Row]]]:
        """Images in ascending id with their annotations, streamed partition by partition."""
        rows = self.annotations.groupBy(F.col("image_id").alias("__i")).agg(F.sort_array(F.collect_list(F.struct("id", *(F.col(q(c)) for c in self.annotations.columns if c != "id")))).alias("__a"))
        joined = self.images.join(rows, F.col("id") == F.col("__i"), "left").drop("__i").orderBy("id")
        for row in joined.toLocalIterator():
            yield Row(**{c: row[c] for c in self.images.columns}), list(row["__a"] or [])

    def reset_images_root(self, root: str) -> Dataset:
        """The same files seen from another root folder."""
        prefix = os.path.relpath(self.images_root, root)
        if prefix == ".":
            return self.with_(images_root=root)
        path = F.concat(F.lit(prefix + "/"), F.col("relative_path"))
        steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
        fold = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, s)))
        return self.with_(images=self.images.withColumn("relative_path", F.array_join(fold, "/")), images_root=root)

    # ------------------------------------------------------------ boxes
    def _sized(self) -> DataFrame:
        sizes = self.images.select(F.col("id").alias("__image"), F.col("width").alias("__w"), F.col("height").alias("__h"))
        return self.annotations.join(sizes, F.col("image_id") == F.col("__image"), "left")

    def cap_boxes(self) -> Dataset:
        """Boxes cut to their images."""
        fixed = capped(F.col("__w"), F.col("__h"))
        return self.with_(annotations=self._sized().select(*(fixed[c].alias(c) if c in fixed else F.col(q(c)) for c in self.annotations.columns)))

    def malformed_boxes(self, allow_keypoints: bool = False) -> DataFrame:
        """``id`` and the named checks of annotations with a broken box."""
        checks = malformed(F.col("__w"), F.col("__h"), allow_keypoints)
        report = self._sized().select("id", *(c.alias(n) for n, c in checks.items()))
        any_ = F.lit(False)
        for n in checks:
            any_ = any_ | F.col(n)
        return report.filter(any_)

    def remove_invalid_annotations(self, allow_keypoints: bool = False, remove_related_images: bool = False, remove_emptied_images: bool = False) -> Dataset:
        bad = self.malformed_boxes(allow_keypoints).select("id")
        if remove_related_images:
            touched = self.annotations.join(bad, "id", "left_semi").select(F.col("image_id").alias("__i"))
            return self._with_images(self.images.join(touched, F.col("id") == F.col("__i"), "left_anti"))
        return self._with_annotations(self.annotations.join(bad, "id", "left_anti"), remove_emptied_images)


def _at(index: int | slice | list[int], places: DataFrame) -> Column:
    p = F.col("position")
    if isinstance(index, int) or isinstance(index, list):
        wanted = [index] if isinstance(index, int) else index
        if any(i < 0 for i in wanted):
            n = places.count()
            wanted = [i % n if n else i for i in wanted]
        return p.isin(wanted)
    if (index.start or 0) < 0 or (index.stop or 0) < 0 or (index.step or 1) < 1:
        start, stop, step = index.indices(places.count())
    else:
        start, stop, step = index.start or 0, index.stop, index.step or 1
    if step < 1:
        raise ValueError("a slice step must be positive")
    cond = (p >= start) & ((p - start) % step == 0)
    return cond if stop is None else cond & (p < stop)
