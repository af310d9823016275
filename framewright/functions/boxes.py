"""Bounding boxes: formats, conversion and overlap as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("box_x_min", "box_y_min", "box_width", "box_height")
#: Column stems of every layout, in the order of a box list. Lower-case names are shares of the image size.
LAYOUTS = {
    "XYWH": ("x_min", "y_min", "width", "height"),
    "XWYH": ("x_min", "width", "y_min", "height"),
    "XXYY": ("x_min", "x_max", "y_min", "y_max"),
    "XYXY": ("x_min", "y_min", "x_max", "y_max"),
    "CXWCYH": ("x_center", "width", "y_center", "height"),
    "CXCYWH": ("x_center", "y_center", "width", "height"),
    "XY": ("x_min", "y_min"),
}


@dataclass(frozen=True)
class BoxFormat:
    layout: str
    relative: bool

    @property
    def stems(self) -> tuple[str, ...]:
        return LAYOUTS[self.layout]

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(f"box_{s}" + ("_relative" if self.relative else "") for s in self.stems)


def box_format(name: str) -> BoxFormat:
    """Format of a name such as ``XYWH`` (pixels) or ``cxcywh`` (shares)."""
    if name.upper() not in LAYOUTS or name not in (name.upper(), name.lower()):
        raise ValueError(f"unknown box format {name!r}")
    return BoxFormat(name.upper(), name.islower())


def _is_x(stem: str) -> bool:
    return stem in ("x_min", "x_max", "x_center", "width")


def export_columns(fmt: str, width: Column, height: Column) -> dict[str, Column]:
    """Canonical pixel boxes (x, y, width, height) written in ``fmt``; a zero image size gives null shares."""
    f = box_format(fmt)
    x, y, w, h = (F.col(c) for c in BOX)
    value = {"x_min": x, "y_min": y, "width": w, "height": h, "x_max": x + w, "y_max": y + h, "x_center": x + w / 2, "y_center": y + h / 2}
    if f.layout == "XY":
        value |= {"x_min": x + w / 2, "y_min": y + h / 2}
    return {c: F.try_divide(value[s], width if _is_x(s) else height) if f.relative else value[s] for c, s in zip(f.columns, f.stems, strict=True)}


def import_columns(fmt: str, values: list[Column], width: Column, height: Column) -> list[Column]:
    """Pixel x, y, width, height from the values of a box in ``fmt``."""
    f = box_format(fmt)
    if len(values) != len(f.stems):
        raise ValueError(f"{fmt} has {len(f.stems)} values, not {len(values)}")
    v = {s: c.cast("double") * ((width if _is_x(s) else height) if f.relative else F.lit(1.0)) for s, c in zip(f.stems, values, strict=True)}
    if f.layout == "XY":
        return [v["x_min"], v["y_min"], F.lit(0.0), F.lit(0.0)]
    w = v["width"] if "width" in v else v["x_max"] - v["x_min"]
    h = v["height"] if "height" in v else v["y_max"] - v["y_min"]
    x = v["x_min"] if "x_min" in v else v["x_center"] - w / 2
    y = v["y_min"] if "y_min" in v else v["y_center"] - h / 2
    return [x, y, w, h]


def import_array(fmt: str, box: Column, width: Column, height: Column) -> list[Column]:
    n = len(box_format(fmt).stems)
    return import_columns(fmt, [F.get(box, F.lit(i)) for i in range(n)], width, height)


def capped(width: Column, height: Column) -> dict[str, Column]:
    """Boxes cut to the image: corners first, then sizes to what is left of the image."""
    x0, y0, w0, h0 = (F.col(c) for c in BOX)
    x, y = F.greatest(F.lit(0.0), F.least(x0, width)), F.greatest(F.lit(0.0), F.least(y0, height))
    fit = lambda size, room: F.greatest(F.lit(0.0), F.least(size, room))
    return dict(zip(BOX, (x, y, fit(w0, width - x), fit(h0, height - y)), strict=True))


def iou(a: str, b: str) -> Column:
    """Overlap of the boxes with column prefixes ``a`` and ``b``: shared over joint area; 0 where both areas are 0."""
    ax, ay, aw, ah = (F.col(f"{a}{c}") for c in BOX)
    bx, by, bw, bh = (F.col(f"{b}{c}") for c in BOX)
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return F.coalesce(F.try_divide(w * h, aw * ah + bw * bh - w * h), F.lit(0.0))


def overlaps(a: str, b: str) -> Column:
    """Whether the boxes share a point; cheaper than ``iou`` as a join condition."""
    ax, ay, aw, ah = (F.col(f"{a}{c}") for c in BOX)
    bx, by, bw, bh = (F.col(f"{b}{c}") for c in BOX)
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def malformed(width: Column, height: Column, allow_keypoints: bool = False) -> dict[str, Column]:
    """Named checks of a box against its image; true means broken. Nulls count as broken."""
    x, y, w, h = (F.col(c) for c in BOX)
    low = (lambda c: c < 0) if allow_keypoints else (lambda c: c <= 0)
    checks = {
        "x_min_below_0": x < 0, "y_min_below_0": y < 0, "x_min_above_width": x > width, "y_min_above_height": y > height,
        "x_max_above_width": x + w > width, "y_max_above_height": y + h > height, "bad_width": low(w), "bad_height": low(h),
    }
    return {k: F.coalesce(c, F.lit(True)) for k, c in checks.items()}


def with_format(annotations: DataFrame, images: DataFrame, fmt: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the boxes in ``fmt``; images give the sizes through ``image_id``, only where they are needed."""
    if not box_format(fmt).relative:
        cols = export_columns(fmt, F.lit(1.0), F.lit(1.0))
        return annotations.select(*keep, *(c.alias(n) for n, c in cols.items()))
    sizes = images.select(F.col("id").alias("__image"), F.col("width").alias("__w"), F.col("height").alias("__h"))
    cols = export_columns(fmt, F.col("__w"), F.col("__h"))
    return annotations.join(sizes, F.col("image_id") == F.col("__image"), "left").select(*keep, *(c.alias(n) for n, c in cols.items()))


def convert(annotations: DataFrame, images: DataFrame, source: str, target: str, keep: list[str]) -> DataFrame:
    """Boxes written in ``source`` columns rewritten in ``target`` columns."""
    sizes = images.select(F.col("id").alias("__image"), F.col("width").alias("__w"), F.col("height").alias("__h"))
    joined = annotations.join(sizes, F.col("image_id") == F.col("__image"), "left")
    made = import_columns(source, [F.col(c) for c in box_format(source).columns], F.col("__w"), F.col("__h"))
    flat = joined.select(*keep, "__w", "__h", *(c.alias(n) for c, n in zip(made, BOX, strict=True)))
    return flat.select(*keep, *(c.alias(n) for n, c in export_columns(target, F.col("__w"), F.col("__h")).items()))
