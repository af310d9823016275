"""Queries of the writers' row forms, the viewer documents, the event windows and the synthetic data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.json_schema import DEFAULT_SCHEMA, invalid_rows
from framewright.model import Dataset
from framewright.operators import curves, onehot
from framewright.operators.matching import greedy_match
from framewright.functions.boxes import BOX
from framewright.plans.view import annotated, images_of, predicted, registrar
from framewright.session import kept, scratch_path, table
from framewright.sources import readers, writers
from framewright.streaming.watch import windowed_counts
from framewright.synthetic import as_predictions, dummy_dataset

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


@query("select id, relative_path as file_name, width, height, split from imgs")
def coco_image_rows(spark: SparkSession, d: str) -> DataFrame:
    return writers.coco_rows(annotated(spark, d))[0].select("id", "file_name", "width", "height", "split")


@query("select id, image_id, category_id, [box_x_min, box_y_min, box_x_min + box_width, box_y_min + box_height] as bbox, 0 as iscrowd from anns")
def coco_annotation_rows(spark: SparkSession, d: str) -> DataFrame:
    return writers.coco_rows(annotated(spark, d), "XYXY")[1].select("id", "image_id", "category_id", "bbox", "iscrowd")


@query("select id, confidence as score from preds")
def coco_prediction_rows(spark: SparkSession, d: str) -> DataFrame:
    return writers.coco_rows(predicted(spark, d))[1].select("id", "score")


@query("select i.relative_path, i.split, count(a.id) as n_lines from imgs i left join anns a on a.image_id = i.id group by i.id, i.relative_path, i.split")
def darknet_label_files(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = writers.darknet_lines(annotated(spark, d))
    return rows.select("relative_path", "split", F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n"))).cast("bigint").alias("n_lines"))


def _json_ready(spark: SparkSession, d: str) -> Dataset:
    ds = annotated(spark, d)
    tags = F.struct(F.col("tags_time").alias("tags.time"))
    return ds.with_(images=ds.images.select("id", "width", "height", "relative_path", "split", tags["tags.time"].alias("tags.time"), F.col("tags_weather").alias("tags.weather")), annotations=ds.annotations.drop("area", "iscrowd"))


@query("select i.relative_path, i.id as image_id, i.tags_time as time, count(a.id) as n_annotations from imgs i left join anns a on a.image_id = i.id group by i.id, i.relative_path, i.tags_time")
def image_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents written, and read again by a parser."""
    docs = writers.image_json_rows(_json_ready(spark, d))
    doc = F.from_json("content", "image struct<id:bigint,tags:struct<time:string>>, annotations array<struct<id:bigint>>")
    return docs.select("relative_path", doc["image"]["id"].alias("image_id"), doc["image"]["tags"]["time"].alias("time"), F.size(doc["annotations"]).cast("bigint").alias("n_annotations"))


@query("""select i.relative_path from imgs i where i.width is null or i.height is null or exists (select 1 from anns a where a.image_id = i.id and (box_x_min < 0 or box_y_min < 0 or box_width < 0 or box_height < 0 or category_id < 0))
  or i.tags_weather not in ('rainy', 'sunny', 'snowy', 'foggy', 'cloudy', 'clear')""")
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    return invalid_rows(writers.image_json_rows(_json_ready(spark, d)), "content", DEFAULT_SCHEMA).select("relative_path")


@query("select i.relative_path, i.id as image_id, count(a.id) as n_groundtruth, count(a.id) filter (where box_width = 0 and box_height = 0) as n_points from imgs i left join anns a on a.image_id = i.id group by i.id, i.relative_path")
def viewer_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = writers.sample_documents(annotated(spark, d))
    doc = F.from_json("content", "id bigint, groundtruth array<struct<id:bigint,points:array<array<double>>>>")
    items = F.coalesce(doc["groundtruth"], F.array().cast("array<struct<id:bigint,points:array<array<double>>>>"))
    return docs.select("relative_path", doc["id"].alias("image_id"), F.size(items).cast("bigint").alias("n_groundtruth"), F.size(F.filter(items, lambda x: x["points"].isNotNull())).cast("bigint").alias("n_points"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by all", raw=True)
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("select word as value, count(*) as n from (select doc_id, unnest(list_distinct([lower(trim(source)), lower(lang)])) as word from documents) where word is not null group by 1", raw=True)
def set_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """A set column of two attributes made boolean, and the columns counted."""
    docs = table(spark, d, "documents").select("doc_id", F.array(F.lower(F.trim("source")), F.lower("lang")).alias("s"))
    wide, made = onehot.booleanize(docs, {"s": None})
    counted = wide.agg(*(F.count_if(F.col(f"`s.{v}`")).alias(v) for v in made["s"]))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"`{v}`").alias("n")) for v in made["s"])))).filter("n > 0")


@query(None)
def synthetic_annotations(spark: SparkSession, d: str) -> DataFrame:
    return dummy_dataset(spark, 1000, 20000, split_names=["train", "valid"]).annotations


@query(None)
def synthetic_average_precision(spark: SparkSession, d: str) -> DataFrame:
    ds = dummy_dataset(spark, 100, 5000)
    pred = as_predictions(ds)
    rows = curves.detections(greedy_match(ds.annotations, pred), ds.annotations, pred, ["category_id"])
    return curves.average_precision(curves.precision_recall(rows, ["category_id"], [0.5, 0.75]), ["category_id"])


@query("select id, width, height from imgs where width is null or height is null")
def images_without_size(spark: SparkSession, d: str) -> DataFrame:
    return images_of(spark, d).filter("width is null or height is null").select("id", "width", "height")


# ---------------------------------------------------------------- contents of what is written
@query("""select i.id as image_id, row_number() over (partition by i.id order by a.id) - 1 as line, dense_rank() over (order by a.category_id) - 1 as number_of_used,
  round(box_x_min + box_width / 2, 4) as cx, round(box_y_min + box_height / 2, 4) as cy, round(box_width, 3) as w, round(box_height, 3) as h
  from imgs i join anns a on a.image_id = i.id where width > 0 and height > 0 and box_x_min is not null and box_y_min is not null and box_width is not null and box_height is not null""")
def darknet_line_contents(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the label files, read again and put in pixels; class numbers as dense ranks of the classes that occur."""
    ds = _own_paths(_whole_boxes(annotated(spark, d)))
    rows, _ = writers.darknet_lines(ds.with_(label_map={}))
    lines = rows.select("relative_path", F.posexplode(F.split("content", "\n")).alias("line", "text")).filter("text <> ''").withColumn("w_", F.split("text", " "))
    sized = lines.join(ds.images.select("relative_path", F.col("id").alias("image_id"), "width", "height"), "relative_path")
    pixels = [F.round(F.col("w_")[i + 1].cast("double") * F.col(size), 4 if i < 2 else 3).alias(c) for i, (c, size) in enumerate((("cx", "width"), ("cy", "height"), ("w", "width"), ("h", "height")))]
    return sized.select("image_id", F.col("line").cast("bigint").alias("line"), F.col("w_")[0].cast("bigint").alias("number_of_used"), *pixels)


def _whole_boxes(ds: Dataset) -> Dataset:
    """Images with a size, and their annotations with four numbers; the formats have no word for others."""
    sized = ds.filter_images("width > 0 and height > 0")
    return sized.filter_annotations(" and ".join(f"{b} is not null" for b in BOX))


_WHOLE = "width > 0 and height > 0 and box_x_min is not null and box_y_min is not null and box_width is not null and box_height is not null"


@query(f"select i.relative_path, i.id as image_id, a.id, a.category_id, a.category_str, {', '.join(BOX)} from anns a join imgs i on a.image_id = i.id where {_WHOLE}", rounded=list(BOX))
def image_json_contents(spark: SparkSession, d: str) -> DataFrame:
    ready = _whole_boxes(_json_ready(spark, d))
    doc = F.from_json("content", "image struct<id:bigint>, annotations array<struct<id:bigint,category_id:int,category_str:string,bbox:array<double>>>")
    notes = writers.image_json_rows(ready).select("relative_path", doc.alias("d")).select("relative_path", F.col("d.image.id").alias("image_id"), F.inline("d.annotations"))
    return notes.select("relative_path", "image_id", "id", "category_id", "category_str", *(F.col("bbox")[i].alias(b) for i, b in enumerate(BOX)))


@query(f"select i.id as image_id, a.id, a.category_str as label, box_width = 0 and box_height = 0 as is_point, round(box_x_min, 3) as x, round(box_y_min, 3) as y, case when box_width <> 0 or box_height <> 0 then round(box_width, 3) end as w from anns a join imgs i on a.image_id = i.id where {_WHOLE}")
def viewer_contents(spark: SparkSession, d: str) -> DataFrame:
    """The ground truth in the documents, read again and put in pixels."""
    doc = F.from_json("content", "id bigint, width double, height double, groundtruth array<struct<id:bigint,label:string,bounding_box:array<double>,points:array<array<double>>>>")
    items = writers.sample_documents(_whole_boxes(annotated(spark, d))).select(doc.alias("d")).select(F.col("d.id").alias("image_id"), F.col("d.width").alias("width"), F.col("d.height").alias("height"), F.inline("d.groundtruth"))
    at = F.coalesce("bounding_box", F.col("points")[0])
    return items.select("image_id", "id", "label", F.col("points").isNotNull().alias("is_point"), F.round(at[0] * F.col("width"), 3).alias("x"), F.round(at[1] * F.col("height"), 3).alias("y"), F.round(F.get("bounding_box", F.lit(2)) * F.col("width"), 3).alias("w"))


# ---------------------------------------------------------------- written and read again
def _own_paths(ds: Dataset) -> Dataset:
    """File names of their own, as several given images share one."""
    return ds.with_(images=ds.images.withColumn("relative_path", F.concat(F.col("id").cast("string"), F.lit(".jpg"))))


def _kept(ds: Dataset) -> Dataset:
    """Both tables made once, as a round trip reads them many times."""
    return ds.with_(images=kept(ds.images, "images"), annotations=kept(ds.annotations, "annotations"))


def _folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name).removeprefix("file://").removeprefix("file:")


def _rounded(ds: Dataset, *columns: str) -> DataFrame:
    return ds.annotations.select(*columns, *(F.round(b, 3).alias(b) for b in BOX))


_BACK = ", ".join(f"round({b}, 3) as {b}" for b in BOX)


@query(f"select a.id, a.image_id, a.category_id, a.category_str, a.split, {_BACK} from anns a join imgs i on a.image_id = i.id where {_WHOLE}")
def roundtrip_coco(spark: SparkSession, d: str) -> DataFrame:
    """A COCO file per split, written and read (from_coco)."""
    from framewright.operators.setops import add

    files = writers.to_coco(_own_paths(_whole_boxes(annotated(spark, d))), _folder(spark, "coco"), fmt="XYXY")
    parts = [readers.from_coco(spark, f, split=None if f.endswith("annotations.json") else f.rsplit("_", 1)[1][:-5], box_format="XYXY") for f in files]
    out = parts[0]
    for p in parts[1:]:
        out = add(out, p)
    return _rounded(out, "id", "image_id", "category_id", "category_str", "split")


@query("select i.id, i.id || '.jpg' as relative_path, width, height from imgs i where width > 0 and height > 0")
def roundtrip_coco_keypoints(spark: SparkSession, d: str) -> DataFrame:
    """The images of COCO files whose annotations are points of one class (from_coco_keypoints)."""
    ds = _own_paths(_whole_boxes(annotated(spark, d)))
    path = writers.to_coco(ds.with_(images=ds.images.drop("split"), annotations=ds.annotations.drop("split").withColumn("category_id", F.lit(0))), _folder(spark, "points"), fmt="XY")[0]
    return readers.from_coco_keypoints(spark, path).images.select("id", "relative_path", "width", "height")


@query(f"select a.id, a.image_id, a.category_id, a.split, {_BACK} from anns a join imgs i on a.image_id = i.id where {_WHOLE} and i.split is not null")
def roundtrip_image_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON file per image in folders of splits, written and read (from_image_json)."""
    folder = _folder(spark, "json")
    writers.to_image_json(_own_paths(_whole_boxes(_json_ready(spark, d)).filter_images("split is not null")), folder)
    return _rounded(readers.from_image_json(spark, folder), "id", "image_id", "category_id", "split")


def _darknet(spark: SparkSession, d: str, version: int) -> DataFrame:
    ds = _kept(_own_paths(_whole_boxes(annotated(spark, d)).filter_images("split is not null")))
    folder = _folder(spark, "darknet")
    writers.to_darknet(ds, folder, version, copy_images=None)
    below = "images/" if version >= 5 else "data/"
    info = ds.images.select("id", "width", "height", F.concat(F.lit(below), "relative_path").alias("relative_path"))
    read = readers.from_yolo if version >= 5 else readers.from_darknet
    return _rounded(read(spark, folder, ids_map=f"{folder}/ids_map.json", image_info=info), "image_id", "category_id", "category_str", "split")


_DARKNET = f"select a.image_id, a.category_id, a.category_str, a.split, {_BACK} from anns a join imgs i on a.image_id = i.id where {_WHOLE} and i.split is not null"


@query(_DARKNET)
def roundtrip_darknet(spark: SparkSession, d: str) -> DataFrame:
    return _darknet(spark, d, 4)


@query(_DARKNET)
def roundtrip_yolo(spark: SparkSession, d: str) -> DataFrame:
    return _darknet(spark, d, 5)


@query("select id, image_id, category_id, split, area from anns")
def roundtrip_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "archive")
    writers.to_parquet(annotated(spark, d), path)
    return writers.from_parquet(spark, path).annotations.select("id", "image_id", "category_id", "split", "area")


@query(f"select a.image_id, a.id as object_id, 1 as category_id, 'person' as category_str, {_BACK} from anns a join imgs i on a.image_id = i.id where {_WHOLE}")
def read_mot(spark: SparkSession, d: str) -> DataFrame:
    """Tracking rows made of the annotations (from_mot)."""
    ds = _own_paths(_whole_boxes(annotated(spark, d)))
    path = scratch_path(spark, "mot")
    ds.annotations.select("image_id", "id", *BOX, F.lit(1), F.lit(-1), F.lit(-1)).write.csv(path)
    return _rounded(readers.from_mot(spark, path, image_info=ds.images), "image_id", "object_id", "category_id", "category_str")


@query("""select a.image_id, case when a.iscrowd = 1 then 1 else 0 end as category_id, a.id as box_id, round(greatest(0, least(box_x_min, width)), 3) as box_x_min, round(greatest(0, least(box_width, width - greatest(0, least(box_x_min, width)))), 3) as box_width
  from anns a join imgs i on a.image_id = i.id where """ + _WHOLE)
def read_crowd_human(spark: SparkSession, d: str) -> DataFrame:
    """Lines of people and heads made of the annotations (from_crowd_human)."""
    ds = _own_paths(_whole_boxes(annotated(spark, d)))
    box, head = F.array(*(F.col(b) for b in BOX)), F.col("iscrowd") == 1
    one = F.struct(F.when(~head, box).alias("fbox"), F.when(~head, box).alias("vbox"), F.when(head, box).alias("hbox"), F.lit("person").alias("tag"), F.struct(F.col("id").alias("box_id"), F.lit(0).alias("occ"), F.when(head, 1).otherwise(0).alias("ignore")).alias("extra"), F.struct(F.lit(0).alias("ignore")).alias("head_attr"))
    own = ds.annotations.withColumn("iscrowd", F.coalesce("iscrowd", F.lit(0)))
    per = own.select("image_id", one.alias("x")).groupBy("image_id").agg(F.collect_list("x").alias("gtboxes"))
    path = scratch_path(spark, "crowd")
    per.select(F.to_json(F.struct(F.col("image_id").cast("string").alias("ID"), "gtboxes"))).write.text(path)
    out = readers.from_crowd_human(spark, path, "data", image_info=ds.images)
    return out.annotations.select("image_id", "category_id", "box_id", F.round("box_x_min", 3).alias("box_x_min"), F.round("box_width", 3).alias("box_width"))


@query(f"select i.id || '.jpg' as relative_path, a.category_str, a.iscrowd = 1 as difficult, {_BACK} from anns a join imgs i on a.image_id = i.id where {_WHOLE}")
def read_pascal_voc(spark: SparkSession, d: str) -> DataFrame:
    """XML files made of the annotations (from_pascal_voc_generic)."""
    ds = _own_paths(_whole_boxes(annotated(spark, d)))
    text = lambda c: F.col(c).cast("string")
    x, y, w, h = (F.col(b) for b in BOX)
    one = F.concat(F.lit("<object><name>"), F.col("category_str"), F.lit("</name><difficult>"), F.when(F.col("iscrowd") == 1, "1").otherwise("0"), F.lit("</difficult><bndbox><xmin>"), x.cast("string"), F.lit("</xmin><ymin>"), y.cast("string"), F.lit("</ymin><xmax>"), (x + w).cast("string"), F.lit("</xmax><ymax>"), (y + h).cast("string"), F.lit("</ymax></bndbox></object>"))
    per = ds.annotations.select("image_id", one.alias("o")).groupBy("image_id").agg(F.array_join(F.collect_list("o"), "").alias("objects"))
    xml = F.concat(F.lit("<annotation><filename>"), F.col("relative_path"), F.lit("</filename><size><width>"), text("width"), F.lit("</width><height>"), text("height"), F.lit("</height><depth>3</depth></size><segmented>0</segmented>"), F.coalesce("objects", F.lit("")), F.lit("</annotation>"))
    folder = _folder(spark, "voc")
    writers._files_from(ds.images.join(per, F.col("id") == F.col("image_id"), "left").select(F.concat(F.col("id").cast("string"), F.lit(".xml")).alias("path"), xml.alias("content")), folder)
    out = readers.from_pascal_voc_generic(spark, folder, "images")
    names = out.images.select(F.col("id").alias("__i"), "relative_path")
    return out.annotations.join(names, F.col("image_id") == F.col("__i")).select("relative_path", "category_str", "difficult", *(F.round(b, 3).alias(b) for b in BOX))


@query(f"select p.image_id, p.category_id, p.confidence, {_BACK.replace('box_', 'p.box_').replace('as p.', 'as ')} from preds p join imgs i on p.image_id = i.id where {_WHOLE}")
def read_darknet_json(spark: SparkSession, d: str) -> DataFrame:
    """A detector's frames made of the predictions (from_darknet_json)."""
    ds = _own_paths(_whole_boxes(predicted(spark, d)))
    sized = ds.annotations.join(ds.images.select(F.col("id").alias("__i"), "width", "height", "relative_path"), F.col("image_id") == F.col("__i"))
    x, y, w, h = (F.col(b) for b in BOX)
    rel = F.struct(((x + w / 2) / F.col("width")).alias("center_x"), ((y + h / 2) / F.col("height")).alias("center_y"), (w / F.col("width")).alias("width"), (h / F.col("height")).alias("height"))
    one = F.struct(F.col("category_id").alias("class_id"), F.col("category_str").alias("name"), rel.alias("relative_coordinates"), "confidence")
    per = sized.select("relative_path", one.alias("o")).groupBy("relative_path").agg(F.collect_list("o").alias("objects"))
    path = _folder(spark, "frames")
    frame = F.struct(F.concat(F.lit("/data/"), "relative_path").alias("filename"), "objects")
    batches = per.groupBy(F.pmod(F.xxhash64("relative_path"), F.lit(8)).alias("k")).agg(F.to_json(F.collect_list(frame)).alias("content"))
    writers._files_from(batches.select(F.concat(F.col("k").cast("string"), F.lit(".json")).alias("path"), "content"), path)
    return _rounded(readers.from_darknet_json(spark, "/data", path, image_info=ds.images), "image_id", "category_id", "confidence")
