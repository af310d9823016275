"""New annotations for a data set."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import functions as F

from framewright.functions.boxes import BOX, box_format, import_columns
from framewright.model import ANNOTATION_TYPES, Dataset, formatted, label_column


def spread(image_id: Any, boxes: Any, category_id: Any, confidence: Any = None) -> dict[str, np.ndarray]:
    """Scalars, vectors and one box or point against many, brought to one length. Lengths that don't fit raise ValueError."""
    boxes = np.asarray(boxes, dtype=float)
    boxes = boxes.reshape(1, -1) if boxes.ndim == 1 else boxes
    parts = {"image_id": np.atleast_1d(image_id), "category_id": np.atleast_1d(category_id)}
    n = max([len(boxes), *(len(p) for p in parts.values())])
    if confidence is not None:
        parts["confidence"] = np.atleast_1d(np.asarray(confidence, dtype=float))
        if len(parts["confidence"]) != n:
            raise ValueError(f"{len(parts['confidence'])} confidences for {n} annotations")
    out = {"boxes": np.broadcast_to(boxes, (n, boxes.shape[1])) if len(boxes) == 1 else boxes}
    for k, v in parts.items():
        if len(v) not in (1, n):
            raise ValueError(f"{k} has {len(v)} values for {n} annotations")
        out[k] = np.broadcast_to(v, n) if len(v) == 1 else v
    if len(out["boxes"]) != n:
        raise ValueError(f"{len(boxes)} boxes for {n} annotations")
    return out


def add_annotations(ds: Dataset, image_id: Any, bbox_coordinates: Any, category_id: Any, format_string: str = "XYWH", label_map: dict[int, str] | None = None, category_ids_mapping: dict[int, int] | None = None, confidence: Any = None, **other: Any) -> Dataset:
    """Rows appended with ids after the greatest; boxes in any format, points too. Unknown images raise ValueError.

    ``area`` is filled where the data set has it; columns not given are null.
    """
    v = spread(image_id, bbox_coordinates, category_id, confidence)
    if v["boxes"].shape[1] != len(box_format(format_string).stems):
        raise ValueError(f"{format_string} boxes have {len(box_format(format_string).stems)} numbers")
    mapping = category_ids_mapping or {}
    spark = ds.images.sparkSession
    extra = {k: (list(x) if isinstance(x, (list, tuple, np.ndarray)) else [x] * len(v["boxes"])) for k, x in other.items()}
    rows = []
    for i, box in enumerate(v["boxes"].tolist()):
        c = int(v["category_id"][i])
        rows.append((i, int(v["image_id"][i]), mapping.get(c, c), box, float(v["confidence"][i]) if "confidence" in v else None))
    new = spark.createDataFrame(rows, "k bigint, image_id bigint, category_id int, box array<double>, confidence double")
    sizes = ds.images.select(F.col("id").alias("__i"), "width", "height")
    joined = new.join(sizes, F.col("image_id") == F.col("__i"), "left")
    if not joined.filter("__i is null").isEmpty():
        raise ValueError("annotations for unknown images")
    made = import_columns(format_string, [F.get("box", F.lit(i)) for i in range(v["boxes"].shape[1])], F.col("width"), F.col("height"))
    after = ds.annotations.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("after"))
    labels = dict(ds.label_map) | (label_map or {})
    out = joined.crossJoin(F.broadcast(after)).select(
        (F.col("after") + F.col("k")).alias("id"), "image_id", "category_id", label_column(labels, F.col("category_id")).alias("category_str"), *(c.alias(b) for c, b in zip(made, BOX, strict=True)),
        *(["confidence"] if "confidence" in v else []), *(F.element_at(F.array(*(F.lit(x) for x in values)), (F.col("k") + 1).cast("int")).alias(name) for name, values in extra.items()),
    )
    if "area" in ds.annotations.columns and "area" not in other:
        out = out.withColumn("area", F.col("box_width") * F.col("box_height"))
    return ds.with_(annotations=formatted(ds.annotations.unionByName(out, allowMissingColumns=True), ANNOTATION_TYPES), label_map=labels)


class AnnotationAppender:
    """Collects appends and makes one union of them on leaving the block; nothing appended changes nothing."""

    def __init__(self, ds: Dataset, format_string: str = "XYWH") -> None:
        self.dataset, self.format_string = ds, format_string
        self.buffer: list[tuple] = []

    def __enter__(self) -> AnnotationAppender:
        return self

    def append(self, image_id: Any, bbox_coordinates: Any, category_id: Any, confidence: Any = None) -> None:
        v = spread(image_id, bbox_coordinates, category_id, confidence)
        for i in range(len(v["boxes"])):
            self.buffer.append((int(v["image_id"][i]), v["boxes"][i], int(v["category_id"][i]), None if confidence is None else float(v["confidence"][i])))

    def reset(self) -> None:
        self.buffer = []

    def finish(self) -> Dataset:
        if self.buffer:
            images, boxes, categories, confidences = zip(*self.buffer, strict=True)
            some = None if any(c is None for c in confidences) else list(confidences)
            self.dataset = add_annotations(self.dataset, list(images), np.vstack(boxes), list(categories), self.format_string, confidence=some)
            self.reset()
        return self.dataset

    def __exit__(self, kind: type | None, *_: Any) -> None:
        if kind is None:
            self.finish()
