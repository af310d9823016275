"""The given tables as data sets, in Spark and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.model import Dataset
from framewright.operators.latest import latest_rows
from framewright.session import few_rows, table

_BOXES = ["box_x_min", "box_y_min", "box_width", "box_height"]


def label_map(spark: SparkSession, d: str) -> dict[int, str]:
    rows = few_rows(table(spark, d, "categories").select("id", "name"), "categories")
    return {r[0]: r[1] for r in sorted(rows)}


def split_column(c: str = "split"):  # noqa: ANN201
    s = F.trim(F.lower(c))
    return F.when(s == "val", "valid").when(s == "test", "eval").otherwise(s)


def images_of(spark: SparkSession, d: str) -> DataFrame:
    t = latest_rows(table(spark, d, "images"), "id", "ingested_at", ["id", "width", "height", "file_name", "split", "source", "tags_weather", "tags_time"])
    return t.select("id", "width", "height", F.col("file_name").alias("relative_path"), split_column().alias("split"), "source", "tags_weather", "tags_time")


def boxes_of(spark: SparkSession, d: str, name: str, extra: list[str], of_images: bool = True) -> DataFrame:
    """Latest rows of annotations or predictions that have a class and, with ``of_images``, refer to an image there is."""
    t = latest_rows(table(spark, d, name), "id", "ingested_at", ["id", "image_id", "category_id", *_BOXES, *extra])
    t = t.filter("category_id is not null")
    if not of_images:
        return t
    known = table(spark, d, "images").select(F.col("id").alias("__i")).distinct()
    return t.join(known, F.col("image_id") == F.col("__i"), "left_semi")


def scored(predictions: DataFrame) -> DataFrame:
    return predictions.filter("confidence is not null and not isnan(confidence)")


def annotated(spark: SparkSession, d: str) -> Dataset:
    return Dataset.build(images_of(spark, d), boxes_of(spark, d, "annotations", ["area", "iscrowd"]), label_map(spark, d), "data", "annotated")


def predicted(spark: SparkSession, d: str, model: str | None = None) -> Dataset:
    rows = scored(boxes_of(spark, d, "predictions", ["confidence", "model"]))
    return Dataset.build(images_of(spark, d), rows.filter(F.col("model") == model) if model else rows, label_map(spark, d), "data", "predicted")


#: The same tables for the oracle: imgs, anns, preds.
CTE = """
imgs as (select id, cast(width as int) as width, cast(height as int) as height, file_name as relative_path, regexp_extract(file_name, '(\\.[^./]+)$', 1) as type,
    case lower(trim(split)) when 'val' then 'valid' when 'test' then 'eval' else lower(trim(split)) end as split, source, tags_time, tags_weather
  from images where id is not null qualify row_number() over (partition by id order by ingested_at desc) = 1),
anns as (select a.id, a.image_id, coalesce(c.name, cast(a.category_id as varchar)) as category_str, a.category_id, i.split, a.box_x_min, a.box_y_min, a.box_width, a.box_height, a.area, a.iscrowd
  from (select * from annotations where id is not null qualify row_number() over (partition by id order by ingested_at desc) = 1) a join imgs i on a.image_id = i.id left join categories c on c.id = a.category_id where a.category_id is not null),
preds as (select a.id, a.image_id, coalesce(c.name, cast(a.category_id as varchar)) as category_str, a.category_id, i.split, a.box_x_min, a.box_y_min, a.box_width, a.box_height, a.confidence, a.model
  from (select * from predictions where id is not null qualify row_number() over (partition by id order by ingested_at desc) = 1) a join imgs i on a.image_id = i.id left join categories c on c.id = a.category_id
  where a.category_id is not null and a.confidence is not null and not isnan(a.confidence))
"""


def registrar(queries: dict, sqls: dict[str, str]):  # noqa: ANN201
    """A decorator that files a query and its SQL; ``rounded`` columns get six decimals on both sides, as sums of doubles depend on their order."""

    def query(sql: str | None = None, raw: bool = False, rounded: list[str] = []):  # noqa: ANN202, B006
        def add(f):  # noqa: ANN001, ANN202
            def run(spark: SparkSession, d: str) -> DataFrame:
                return f(spark, d).withColumns({c: F.round(c, 6) for c in rounded})

            queries[f.__name__] = run if rounded else f
            if sql is not None:
                text = sql if raw else f"with recursive {CTE} {sql}"
                sqls[f.__name__] = f"select * replace ({', '.join(f'round({c}, 6) as {c}' for c in rounded)}) from ({text})" if rounded else text
            return f

        return add

    return query
