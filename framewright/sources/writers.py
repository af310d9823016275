"""Writers of annotation formats."""

from __future__ import annotations

import datetime
import importlib.util
import json
import os
import shutil
import uuid
import warnings
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from framewright.functions.boxes import BOX, box_format, with_format
from framewright.functions.json_schema import SchemaError, flat_schema, invalid_rows, load_schema, nested_struct, renest
from framewright.model import Dataset
from framewright.operators.onehot import debooleanize_dataset
from framewright.session import kept
from framewright.sources.common import spread

_DARKNET_SPLIT = {"valid": "val", "eval": "test"}


def _files_from(rows: DataFrame, folder: str, keep: bool = False) -> None:
    """Write ``(path, content)`` rows as files below a folder that executors share; a file is one row. ``keep``: files that are there stay.

    A file is first written in a hidden folder that its task has for itself and then moved, as tasks that
    make files in one folder wait for each other. Rows are dealt out over tasks evenly, as it is files that count and not bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, made, own = 0, set(), os.path.join(folder, f".{uuid.uuid4().hex}")
        part = os.path.join(own, "part")
        os.makedirs(own)
        try:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    full = os.path.join(folder, path)
                    if keep and os.path.exists(full):
                        continue
                    if os.path.dirname(full) not in made:
                        os.makedirs(os.path.dirname(full), exist_ok=True)
                        made.add(os.path.dirname(full))
                    with open(part, "wb") as f:
                        f.write((content or "").encode())
                    os.replace(part, full)
                    n += 1
        finally:
            shutil.rmtree(own, ignore_errors=True)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    spread(rows.select("path", "content")).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def _stream(f: Any, rows: DataFrame) -> None:
    """JSON rows into an open file, one partition at a time."""
    first = True
    for r in rows.toLocalIterator(prefetchPartitions=True):
        f.write(("" if first else ",\n") + r[0])
        first = False


def _copy_images(ds: Dataset, target: str, mode: str | None, to_jpg: bool = False, overwrite: bool = True, place: Column | None = None) -> None:
    """Images copied or linked by the executors, to their own path or ``place``; mode None does nothing.

    With ``to_jpg`` pictures of other kinds are encoded anew, for which Pillow has to be there.
    Without ``overwrite`` files that exist stay.
    """
    if mode is None:
        return
    root = os.path.abspath(ds.images_root)
    if to_jpg and importlib.util.find_spec("PIL") is None and not ds.images.filter(~F.lower("relative_path").rlike(r"\.jpe?g$")).isEmpty():
        raise RuntimeError("to_jpg needs Pillow")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, place in zip(pdf["relative_path"], pdf["place"], strict=True):
                to, source = os.path.join(target, place), os.path.join(root, path)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                if os.path.lexists(to):
                    if not overwrite:
                        continue
                    os.unlink(to)
                if to_jpg and not path.lower().endswith((".jpg", ".jpeg")):
                    from PIL import Image

                    with Image.open(source) as image:
                        image.convert("RGB").save(to, "JPEG")
                elif mode == "link":
                    os.symlink(os.path.relpath(source, os.path.dirname(to)), to)
                else:
                    shutil.copyfile(source, to)
            yield pdf[["relative_path"]].head(0)

    ds.images.select("relative_path", (place if place is not None else F.col("relative_path")).alias("place")).mapInPandas(run, "relative_path string").collect()


def _as_jpg(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", ".jpg")


# ---------------------------------------------------------------- COCO
def coco_rows(ds: Dataset, fmt: str = "XYWH") -> tuple[DataFrame, DataFrame]:
    """Image and annotation rows as they stand in a COCO file, as structs of columns."""
    images = ds.images.drop("type").withColumnRenamed("relative_path", "file_name")
    cols = [c for c in ds.annotations.columns if c not in (*BOX, "category_str", "iscrowd")]
    boxes = with_format(ds.annotations, ds.images, fmt, [f"`{c}`" for c in cols])
    notes = boxes.select(*(F.col(f"`{c}`").alias("score" if c == "confidence" else c) for c in cols), F.array(*(F.col(c) for c in box_format(fmt).columns)).alias("bbox"), F.lit(0).alias("iscrowd"))
    return images, notes


def to_coco(ds: Dataset, output: str, copy_images: str | None = None, add_split_suffix: bool | None = None, fmt: str = "XYWH", overwrite: bool = False, to_jpg: bool = False, overwrite_images: bool = True) -> list[str]:
    """One JSON file per split; its name has the split where there are several. Images are copied or linked to ``data`` if asked, as JPEG with ``to_jpg``. Rows are streamed into the file partition by partition."""
    output, name = (os.path.dirname(output), os.path.splitext(os.path.basename(output))[0]) if output.endswith(".json") else (output, "annotations")
    os.makedirs(output, exist_ok=True)
    splits = [r[0] for r in ds.images.select("split").distinct().collect()] if "split" in ds.images.columns else [None]
    suffix = len(splits) > 1 if add_split_suffix is None else add_split_suffix
    if not suffix and len(splits) > 1:
        raise ValueError("several splits need a suffix")
    own = ds
    if to_jpg:
        ds = ds.with_(images=ds.images.withColumn("relative_path", _as_jpg(F.col("relative_path"))))
    images, notes = coco_rows(ds, fmt)
    written = []
    for s in sorted(splits, key=lambda x: (x is None, x or "")):
        path = os.path.join(output, f"{name}_{s}.json" if suffix and s is not None else f"{name}.json")
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        mine = (lambda df: df.filter(F.col("split").eqNullSafe(F.lit(s)))) if "split" in ds.images.columns else (lambda df: df)  # noqa: B023
        with open(path, "w", encoding="utf-8") as f:
            info = {"description": ds.dataset_name or "", "version": "0", "year": datetime.date.today().year}
            categories = [{"id": k, "name": v, "supercategory": ""} for k, v in sorted(ds.label_map.items())]
            f.write('{"info": ' + json.dumps(info) + ',\n"categories": ' + json.dumps(categories) + ',\n"images": [')
            _stream(f, mine(images).orderBy("id").select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in images.columns)))))
            f.write('],\n"annotations": [')
            _stream(f, mine(notes).orderBy("id").select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in notes.columns)))))
            f.write("]}\n")
        written.append(path)
    _copy_images(own, os.path.join(output, "data"), copy_images, to_jpg, overwrite_images, _as_jpg(F.col("relative_path")) if to_jpg else None)
    return written


# ---------------------------------------------------------------- one JSON file per image
def image_json_rows(ds: Dataset, schema: dict | None = None) -> DataFrame:
    """``(relative_path, split, content)``: the JSON text of every image, dotted names nested again, nulls and empty sets left out.

    With a schema, attributes that it does not name are left out, with a warning.
    """
    ds = debooleanize_dataset(ds)
    if schema is not None:
        ds = _named_by(ds, schema)
    empty_gone = lambda df: df.select(*(F.when(F.size(F.col(f"`{f.name}`")) > 0, F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields))
    notes = empty_gone(ds.annotations.select("*", F.array(*(F.col(b) for b in BOX)).alias("bbox")).drop(*BOX, "split"))
    tree = renest([c for c in notes.columns if c != "image_id"])
    packed = notes.select("image_id", F.struct(*nested_struct(tree)).alias("a")).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("a.id").alias("k"), "a"))).alias("list"))
    images = empty_gone(ds.images)
    shown = images.drop("type", "split").withColumn("file_name", F.regexp_extract("relative_path", r"([^/]*)$", 1)).drop("relative_path")
    image = nested_struct(renest(shown.columns))
    base = images.withColumn("file_name", F.regexp_extract("relative_path", r"([^/]*)$", 1)).select("id", "relative_path", F.col("split") if "split" in images.columns else F.lit(None).cast("string").alias("split"), F.struct(*image).alias("image"))
    joined = base.join(packed, F.col("id") == F.col("image_id"), "left")
    kind = packed.schema["list"].dataType.elementType["a"].dataType
    content = F.to_json(F.struct("image", F.lit("instances").alias("type"), F.coalesce(F.transform("list", lambda x: x["a"]), F.array().cast(ArrayType(kind))).alias("annotations")))
    return joined.select("relative_path", "split", content.alias("content"))


def _named_by(ds: Dataset, schema: dict) -> Dataset:
    known = set(flat_schema(schema))
    core = {"images": {"id", "width", "height", "relative_path", "type", "split"}, "annotations": {"id", "image_id", "category_id", "category_str", "split", *BOX}}
    frames = {}
    for side, prefix in (("images", "image."), ("annotations", "annotations.")):
        df = getattr(ds, side)
        lost = [c for c in df.columns if c not in core[side] and prefix + c not in known]
        if lost:
            warnings.warn(f"{side}: {', '.join(lost)} are not in the schema and are left out", RuntimeWarning, stacklevel=3)
        frames[side] = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in lost))
    return ds.with_(**frames)


def to_image_json(ds: Dataset, output: str, copy_images: str | None = None, use_schema: bool = False, json_schema: str | dict | None = "default", overwrite: bool = False, to_jpg: bool = False, overwrite_images: bool = True, overwrite_labels: bool = True, flatten_paths: bool = False) -> None:
    """``Annotations/<split>/<path>.json`` per image, and the images below ``Images`` if asked, as JPEG with ``to_jpg``.

    ``flatten_paths``: folders of a path become parts of the file name. ``overwrite`` allows a folder
    that is not empty; without ``overwrite_labels`` files that are there stay. Images with and without split together raise AssertionError; with a schema
    attributes that it does not name are left out with a warning, and invalid documents raise SchemaError.
    """
    if "split" in ds.images.columns:
        k = ds.images.agg(F.count("split"), F.count(F.lit(1))).first()
        if k[0] not in (0, k[1]):
            raise AssertionError("some images have a split and some have none")
    target = os.path.join(output, "Annotations")
    if os.path.isdir(target) and os.listdir(target) and not overwrite:
        raise FileExistsError(target)
    schema = load_schema(json_schema) if use_schema else None
    own = F.regexp_replace("relative_path", "^(train|valid|eval)/", "") if flatten_paths else F.col("relative_path")
    flat = F.replace(own, F.lit("/"), F.lit("_")) if flatten_paths else own
    placed = _as_jpg(flat) if to_jpg else flat
    moved = ds.with_(images=ds.images.withColumn("__from", F.col("relative_path")).withColumn("relative_path", placed)) if flatten_paths or to_jpg else ds
    rows = image_json_rows(moved.with_(images=moved.images.drop("__from")), schema)
    if schema is not None:
        bad = invalid_rows(rows, "content", schema).limit(1).collect()
        if bad:
            raise SchemaError(f"{bad[0]['relative_path']}: {bad[0]['error']}")
    split = F.col("split") if "split" in ds.images.columns else F.lit(None).cast("string")
    below = lambda path, split: F.when(split.isNull() | F.startswith(path, F.concat(split, F.lit("/"))), path).otherwise(F.concat_ws("/", split, path))
    files = rows.select(F.concat(F.regexp_replace(below(F.col("relative_path"), F.col("split")), r"\.[^./]+$", ""), F.lit(".json")).alias("path"), "content")
    _files_from(files, target, keep=not overwrite_labels)
    _copy_images(ds, os.path.join(output, "Images"), copy_images, to_jpg, overwrite_images, below(placed, split))


# ---------------------------------------------------------------- Darknet and YOLO
def darknet_lines(ds: Dataset) -> tuple[DataFrame, dict[int, int]]:
    """``(relative_path, split, content)`` with lines ``class cx cy w h [confidence]`` of dense class ids, and old id -> dense id."""
    used = sorted({r[0] for r in ds.annotations.select("category_id").distinct().collect()} | set(ds.label_map))
    dense = {c: i for i, c in enumerate(used)}
    extra = ["confidence"] if "confidence" in ds.annotations.columns else []
    boxes = with_format(ds.annotations, ds.images, "cxcywh", ["id", "image_id", "category_id", *extra])
    number = F.try_element_at(F.create_map(*(F.lit(x) for kv in dense.items() for x in kv)), F.col("category_id")) if dense else F.col("category_id")
    line = F.concat_ws(" ", number.cast("string"), *(F.col(c).cast("string") for c in box_format("cxcywh").columns), *(F.col(c).cast("string") for c in extra))
    per = boxes.select("image_id", "id", line.alias("line")).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    split = F.col("split") if "split" in ds.images.columns else F.lit(None).cast("string").alias("split")
    return ds.images.join(per, F.col("id") == F.col("image_id"), "left").select("relative_path", split, F.coalesce(text, F.lit("")).alias("content")), dense


def to_darknet(ds: Dataset, output: str, yolo_version: int = 4, copy_images: str | None = "link") -> None:
    """Label files, image lists per split, class names and the id maps; a ``.data`` file below version 5, ``data.yaml`` from there. Version 7 lists absolute paths."""
    os.makedirs(output, exist_ok=True)
    ds = ds.with_(images=kept(ds.images, "images"), annotations=kept(ds.annotations, "annotations"))
    rows, dense = darknet_lines(ds)
    modern = yolo_version >= 5
    stem = F.regexp_replace("relative_path", r"\.[^./]+$", "")
    place = F.concat(F.lit("labels/"), stem, F.lit(".txt")) if modern else F.concat(F.lit("data/"), stem, F.lit(".txt"))
    _files_from(rows.select(place.alias("path"), "content"), output)
    folder = "images" if modern else "data"
    names = [ds.label_map.get(c, str(c)) for c in dense]
    with open(os.path.join(output, "classes.names"), "w") as f:
        f.write("\n".join(names) + "\n")
    with open(os.path.join(output, "ids_map.json"), "w") as f:
        json.dump({i: {"id": c, "name": ds.label_map.get(c, str(c))} for c, i in dense.items()}, f)
    with open(os.path.join(output, "label_map.json"), "w") as f:
        json.dump({str(i): ds.label_map.get(c, str(c)) for c, i in dense.items()}, f)
    lists: dict[str, str] = {}
    splits = sorted(r[0] for r in ds.images.select("split").distinct().collect() if r[0] is not None) if "split" in ds.images.columns else []
    splits = splits or [None]
    for s in splits:
        name = _DARKNET_SPLIT.get(s, s) or "train"
        lists[name] = f"{name}.txt"
        with open(os.path.join(output, lists[name]), "w") as f:
            mine = (ds.images.filter(F.col("split").eqNullSafe(F.lit(s))) if "split" in ds.images.columns else ds.images).select("relative_path").orderBy("relative_path")
            for r in mine.toLocalIterator(prefetchPartitions=True):
                f.write((os.path.abspath(output) + "/" if yolo_version == 7 else "./" if modern else "") + f"{folder}/{r[0]}\n")
    if modern:
        with open(os.path.join(output, "data.yaml"), "w") as f:
            yaml.safe_dump({"path": os.path.abspath(output) if yolo_version == 7 else "", **lists, "nc": len(names), "names": names}, f, sort_keys=False)
    else:
        keys = {"train": "train", "val": "valid", "test": "eval"}
        write_data_file(os.path.join(output, "train.data"), {"classes": len(names), **{keys.get(k, k): v for k, v in lists.items() if k != "test"}, "names": "classes.names", "backup": ""})
        if "test" in lists:
            write_data_file(os.path.join(output, "eval.data"), {"classes": len(names), "valid": lists["test"], "names": "classes.names", "backup": ""})
    _copy_images(ds, os.path.join(output, folder), copy_images)


def write_data_file(path: str, data: dict[str, Any]) -> None:
    with open(path, "w") as f:
        f.writelines(f"{k} = {v}\n" for k, v in data.items())


# ---------------------------------------------------------------- documents for a viewer
def sample_documents(ds: Dataset, predictions: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(relative_path, content)``: one JSON document per image as a dataset viewer takes it.

    Boxes are shares of the image, points are keypoints; dots in names become ``->`` and
    ``attributes`` is shortened to ``attr``. Predictions go in fields of their names.
    """
    fields = {"groundtruth": ds.annotations} | (predictions or {})
    short = lambda c: c.replace("attributes", "attr").replace(".", "->")
    out = ds.images.select("id", "relative_path", *(F.col(f"`{c}`").alias(short(c)) for c in ds.images.columns if c not in ("id", "relative_path", "type")))
    names = []
    for name, notes in fields.items():
        attrs = [c for c in notes.columns if c not in ("id", "image_id", "category_id", "category_str", "split", *BOX)]
        rel = with_format(notes, ds.images, "xywh", ["id", "image_id", "category_str", "box_width", "box_height", *(f"`{c}`" for c in attrs)])
        r = [F.col(c) for c in box_format("xywh").columns]
        point = (F.col("box_width") == 0) & (F.col("box_height") == 0)
        item = F.struct("id", F.col("category_str").alias("label"), F.when(~point, F.array(*r)).alias("bounding_box"), F.when(point, F.array(F.array(r[0], r[1]))).alias("points"), *(F.col(f"`{c}`").alias(short(c)) for c in attrs))
        per = rel.select("image_id", item.alias("x")).groupBy(F.col("image_id").alias("__i")).agg(F.sort_array(F.collect_list("x")).alias(name))
        out = out.join(per, F.col("id") == F.col("__i"), "left").drop("__i")
        names.append(name)
    return out.select("relative_path", F.to_json(F.struct(*(F.col(f"`{c}`") for c in out.columns))).alias("content"))


# ---------------------------------------------------------------- archive
def dict_to_parquet(content: dict[str, Any], folder: str, overwrite: bool = False) -> None:
    """A dict whose DataFrames become parquet tables ``<key>.pq`` (of nested dicts ``a.b.pq``) and whose rest becomes ``metadata.yaml``."""
    if os.path.isdir(folder) and os.listdir(folder) and not overwrite:
        raise OSError(f"{folder} is not empty")
    os.makedirs(folder, exist_ok=True)

    def walk(x: dict[str, Any], prefix: str) -> dict[str, Any]:
        meta: dict[str, Any] = {}
        for k, v in x.items():
            name = f"{prefix}{k}"
            if isinstance(v, DataFrame):
                v.write.mode("overwrite" if overwrite else "error").parquet(os.path.join(folder, f"{name}.pq"))
                meta[k] = {"__table__": f"{name}.pq"}
            else:
                meta[k] = walk(v, name + ".") if isinstance(v, dict) else list(v) if isinstance(v, tuple) else v
        return meta

    meta = walk(content, "")
    with open(os.path.join(folder, "metadata.yaml"), "w") as f:
        yaml.safe_dump(meta, f, sort_keys=False)


def dict_from_parquet(spark: SparkSession, folder: str) -> dict[str, Any]:
    with open(os.path.join(folder, "metadata.yaml")) as f:
        meta = yaml.safe_load(f)

    def walk(x: Any) -> Any:
        if isinstance(x, dict):
            return spark.read.parquet(os.path.join(folder, x["__table__"])) if "__table__" in x else {k: walk(v) for k, v in x.items()}
        return x

    return walk(meta)


def to_parquet(ds: Dataset, folder: str, overwrite: bool = False) -> None:
    dict_to_parquet({"__name__": "Dataset", "dataset_name": ds.dataset_name, "images_root": ds.images_root, "label_map": dict(ds.label_map), "booleanized": dict(ds.booleanized), "images": ds.images, "annotations": ds.annotations}, folder, overwrite)


def from_parquet(spark: SparkSession, folder: str) -> Dataset:
    x = dict_from_parquet(spark, folder)
    if x.get("__name__") != "Dataset":
        raise ValueError(f"{folder} holds a {x.get('__name__')}")
    return Dataset(x["images"], x["annotations"], {int(k): v for k, v in (x["label_map"] or {}).items()}, x["images_root"], x["dataset_name"], {k: tuple(v) for k, v in (x["booleanized"] or {}).items()})
