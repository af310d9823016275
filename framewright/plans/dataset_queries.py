"""Queries of the data set operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import groups as G
from framewright.functions.boxes import BOX, LAYOUTS, box_format, convert, with_format
from framewright.model import Dataset
from framewright.operators import append, histograms, labels, onehot, reindex, setops, splitting
from framewright.operators.latest import latest_rows
from framewright.operators.numbering import numbered
from framewright.plans.view import annotated, boxes_of, images_of, label_map, predicted, registrar
from framewright.session import scratch_path, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


query = registrar(QUERIES, SQL)


_B = ", ".join(BOX)
_ANN = ["id", "image_id", "category_id", "category_str", "split", *BOX]


# ---------------------------------------------------------------- model and filters
@query("select id, width, height, relative_path, type, split, source, tags_time, tags_weather from imgs")
def images_table(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).images


@query("select id, image_id, category_str, category_id, split, box_x_min, box_y_min, box_width, box_height, area, iscrowd from anns")
def annotations_table(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).annotations


@query("select a.id, a.image_id from anns a join imgs i on a.image_id = i.id where i.width >= 1000 and i.tags_time = 'day'")
def filter_images_loc(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).filter_images("width >= 1000 and tags_time = 'day'").annotations.select("id", "image_id")


@query(", o as (select id, row_number() over (order by id) - 1 as p from imgs) select id from o where p >= 10 and (p - 10) % 7 = 0 and p < 100000")
def filter_images_iloc(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d)[10:100000:7].images.select("id")


@query(f"select id, image_id, {_B} from anns where box_width * box_height > 10000 and category_id < 120")
def filter_annotations(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).filter_annotations("box_width * box_height > 10000 and category_id < 120").annotations.select("id", "image_id", *BOX)


@query(", o as (select id, row_number() over (order by id) - 1 as p from anns) select id from o where p % 3 = 0")
def filter_annotations_iloc(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).iloc_annotations(slice(0, None, 3)).annotations.select("id")


@query("select id from imgs where id in (select image_id from anns where category_id = 87) or id not in (select image_id from anns)")
def remove_emptied_images(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).filter_annotations("category_id = 87", remove_emptied_images=True).images.select("id")


@query("select id, split from imgs where id in (select image_id from anns)")
def remove_empty_images(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).remove_empty_images().images.select("id", "split")


@query("select id, 0 as n_annotations from imgs")
def empty_annotations(spark: SparkSession, d: str) -> DataFrame:
    ds = annotated(spark, d).empty_annotations()
    per = ds.annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return ds.images.join(per, F.col("id") == F.col("image_id"), "left").select("id", F.coalesce("n", F.lit(0)).cast("int").alias("n_annotations"))


@query("select id, image_id from anns where split = 'valid'")
def get_split(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).get_split("valid").annotations.select("id", "image_id")


@query("select id from imgs where split is null")
def get_split_null(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).get_split(None).images.select("id")


@query("select split, (select count(*) from imgs j where j.split is not distinct from i.split) as n_images, (select count(*) from anns a where a.split is not distinct from i.split) as n_annotations from imgs i group by split")
def iter_splits(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, part in annotated(spark, d).iter_splits():
        one = part.images.agg(F.count(F.lit(1)).alias("n_images")).crossJoin(part.annotations.agg(F.count(F.lit(1)).alias("n_annotations"))).select(F.lit(name).cast("string").alias("split"), "n_images", "n_annotations")
        out = one if out is None else out.unionByName(one)
    return out


@query("select id, category_id from anns where image_id = (select id from imgs order by id limit 1 offset 5)")
def get_one_frame(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).get_one_frame(5)[1].select("id", "category_id")


@query("select id, source, tags_time, tags_weather from imgs")
def image_attributes(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).image_attributes()


@query("select id, area, iscrowd from anns")
def annotation_attributes(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).annotation_attributes()


# ---------------------------------------------------------------- boxes
def _export_sql(fmt: str) -> str:
    f = box_format(fmt)
    center = f.layout == "XY"
    value = {"x_min": "box_x_min" + (" + box_width / 2" if center else ""), "y_min": "box_y_min" + (" + box_height / 2" if center else ""), "width": "box_width", "height": "box_height", "x_max": "box_x_min + box_width", "y_max": "box_y_min + box_height", "x_center": "box_x_min + box_width / 2", "y_center": "box_y_min + box_height / 2"}
    cols = []
    for c, s in zip(f.columns, f.stems, strict=True):
        size = "i.width" if s in ("x_min", "x_max", "x_center", "width") else "i.height"
        cols.append(f"({value[s]}) / {size} as {c}" if f.relative else f"{value[s]} as {c}")
    return f"select a.id, {', '.join(cols)} from anns a join imgs i on a.image_id = i.id"


def _exporter(fmt: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        return with_format(boxes_of(spark, d, "annotations", []), images_of(spark, d), fmt, ["id"])

    run.__name__ = f"bbox_export_{fmt}" if fmt.isupper() else f"bbox_export_{fmt}_relative"
    return run


for _layout in LAYOUTS:
    for _fmt in (_layout, _layout.lower()):
        query(_export_sql(_fmt))(_exporter(_fmt))


@query(f"select a.id, {_B} from anns a join imgs i on a.image_id = i.id where width is not null and height is not null")
def bbox_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    images = images_of(spark, d)
    boxes = boxes_of(spark, d, "annotations", [])
    out = with_format(boxes, images, "cxcywh", ["id", "image_id"])
    back = convert(out, images, "cxcywh", "XYWH", ["id"])
    return back.dropna(subset=["box_x_min", "box_y_min"]).select("id", *(F.round(c, 6).alias(c) for c in BOX))


@query("""select a.id, greatest(0, least(box_x_min, width)) as box_x_min, greatest(0, least(box_y_min, height)) as box_y_min,
  greatest(0, least(box_width, width - greatest(0, least(box_x_min, width)))) as box_width, greatest(0, least(box_height, height - greatest(0, least(box_y_min, height)))) as box_height
  from anns a join imgs i on a.image_id = i.id""")
def cap_boxes(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).cap_boxes().annotations.select("id", *BOX)


_BAD = """select a.id, coalesce(box_x_min < 0, true) as x_min_below_0, coalesce(box_y_min < 0, true) as y_min_below_0, coalesce(box_x_min > width, true) as x_min_above_width, coalesce(box_y_min > height, true) as y_min_above_height,
  coalesce(box_x_min + box_width > width, true) as x_max_above_width, coalesce(box_y_min + box_height > height, true) as y_max_above_height, coalesce(box_width <= 0, true) as bad_width, coalesce(box_height <= 0, true) as bad_height
  from anns a join imgs i on a.image_id = i.id"""
_ANY_BAD = "x_min_below_0 or y_min_below_0 or x_min_above_width or y_min_above_height or x_max_above_width or y_max_above_height or bad_width or bad_height"


@query(f"select * from ({_BAD}) where {_ANY_BAD}")
def malformed_boxes(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).malformed_boxes()


@query(f"select id, image_id from anns where id not in (select id from ({_BAD}) where {_ANY_BAD})")
def remove_invalid_annotations(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).remove_invalid_annotations().annotations.select("id", "image_id")


@query(f"select id from imgs where id not in (select image_id from anns where id in (select id from ({_BAD}) where {_ANY_BAD}))")
def remove_invalid_related_images(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).remove_invalid_annotations(remove_related_images=True).images.select("id")


# ---------------------------------------------------------------- ids
@query("""select row_number() over (order by a.category_id, a.id) + 99 as id, n.new_id as image_id, category_id from anns a
  join (select id, row_number() over (order by width nulls last, id) + 9 as new_id from imgs) n on n.id = a.image_id""")
def reset_index(spark: SparkSession, d: str) -> DataFrame:
    return reindex.reset_index(annotated(spark, d), 10, 100, ["width"], ["category_id"]).annotations.select("id", "image_id", "category_id")


@query("""select case when i.id % 2 = 0 then i.id * 10 else m.top + row_number() over (partition by i.id % 2 order by i.id) end as id, relative_path
  from imgs i cross join (select max(id * 10) filter (where id % 2 = 0) as top from imgs) m""")
def reset_index_from_mapping(spark: SparkSession, d: str) -> DataFrame:
    ds = annotated(spark, d)
    mapping = ds.images.filter("id % 2 = 0").select(F.col("id").alias("old_id"), (F.col("id") * 10).alias("new_id"))
    return reindex.apply_maps(ds, mapping, None).images.select("id", "relative_path")


@query("select id + 5000000 as id, image_id + 1000000 as image_id from anns where image_id % 2 = 0")
def reset_index_remove_unmapped(spark: SparkSession, d: str) -> DataFrame:
    ds = annotated(spark, d)
    images = ds.images.filter("id % 2 = 0").select(F.col("id").alias("old_id"), (F.col("id") + 1000000).alias("new_id"))
    notes = ds.annotations.select(F.col("id").alias("old_id"), (F.col("id") + 5000000).alias("new_id"))
    return reindex.apply_maps(ds, images, notes, True).annotations.select("id", "image_id")


@query("""select a.id, coalesce(p.new_id, m.top + row_number() over (partition by p.new_id is null order by i.id)) as new_image_id from imgs i
  join (select id, id as image_id from imgs) a on a.id = i.id left join (select 'x' || id as k, id + 7000000 as new_id from imgs where width = 640) p on p.k = 'x' || i.id cross join (select max(id + 7000000) as top from imgs where width = 640) m""")
def match_index(spark: SparkSession, d: str) -> DataFrame:
    ds = annotated(spark, d)
    ds = ds.with_(images=ds.images.withColumn("key", F.concat(F.lit("x"), F.col("id"))).withColumn("was", F.col("id")))
    other = ds.images.filter("width = 640").select((F.col("id") + 7000000).alias("id"), "key")
    out = reindex.match_index(ds, other, on="key")
    return out.images.select(F.col("was").alias("id"), F.col("id").alias("new_image_id"))


# ---------------------------------------------------------------- union and difference
def _halves(spark: SparkSession, d: str) -> tuple[Dataset, Dataset]:
    ds = annotated(spark, d)
    return ds.filter_images("id % 2 = 0").rename("even"), ds.filter_images("id % 2 = 1").rename("odd")


@query("select id, image_id, category_id, split from anns")
def merge_disjoint(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    return setops.merge(a, b).annotations.select("id", "image_id", "category_id", "split")


@query("""select id, image_id from anns where image_id % 2 = 0 union all
  select a.id + (select max(id) from anns where image_id % 2 = 0) - (select min(id) from anns where image_id % 3 = 0) + 1, image_id from anns a where image_id % 3 = 0""")
def merge_overlap(spark: SparkSession, d: str) -> DataFrame:
    ds = annotated(spark, d)
    return setops.merge(ds.filter_images("id % 2 = 0"), ds.filter_images("id % 3 = 0")).annotations.select("id", "image_id")


@query("""select row_number() over (order by id) - 1 as id, relative_path, 'even' as origin, id as origin_id from imgs where id % 2 = 0 union all
  select (select count(*) from imgs where id % 2 = 0) + row_number() over (order by id) - 1, relative_path, 'third', id from imgs where id % 3 = 0""")
def merge_ignore_index(spark: SparkSession, d: str) -> DataFrame:
    ds = annotated(spark, d)
    out = setops.merge(ds.filter_images("id % 2 = 0").rename("even"), ds.filter_images("id % 3 = 0").rename("third"), ignore_index=True, mark=True)
    return out.images.select("id", "relative_path", "origin", "origin_id")


def _changed(spark: SparkSession, d: str) -> tuple[Dataset, Dataset]:
    ds = annotated(spark, d)
    left = ds.filter_images("id % 10 <> 0")
    right = ds.filter_images("id % 10 <> 1").filter_annotations("id % 11 <> 0")
    images = right.images.withColumn("width", F.when(F.col("id") % 10 == 2, F.col("width") + 1).otherwise(F.col("width")))
    notes = right.annotations.withColumn("box_width", F.when(F.col("id") % 13 == 0, F.col("box_width") + 1).otherwise(F.col("box_width")))
    return left, right.with_(images=images, annotations=notes)


_WIDE = "(i.id % 10 = 2 and i.width is not null)"


@query(f"""select a.id, a.image_id from anns a join imgs i on a.image_id = i.id where i.id % 10 <> 0 and (i.id % 10 = 1 or {_WIDE} or a.id % 11 = 0 or (a.id % 13 = 0 and box_width is not null))""")
def dataset_diff_left(spark: SparkSession, d: str) -> DataFrame:
    return setops.diff(*_changed(spark, d))[0].annotations.select("id", "image_id")


@query(f"""select i.id, i.width + case when i.id % 10 = 2 then 1 else 0 end as width from imgs i where i.id % 10 <> 1 and (i.id % 10 = 0 or {_WIDE} or exists (select 1 from anns a where a.image_id = i.id and a.id % 13 = 0 and a.id % 11 <> 0 and box_width is not null))""")
def dataset_diff_right(spark: SparkSession, d: str) -> DataFrame:
    return setops.diff(*_changed(spark, d))[1].images.select("id", "width")


@query(f"""select a.id, a.image_id from anns a join imgs i on a.image_id = i.id where i.id % 10 not in (0, 1) and not {_WIDE} and a.id % 11 <> 0 and (a.id % 13 <> 0 or box_width is null)""")
def dataset_diff_common(spark: SparkSession, d: str) -> DataFrame:
    return setops.diff(*_changed(spark, d))[2].annotations.select("id", "image_id")


# ---------------------------------------------------------------- labels
_MAP = {87: 1, 155: 1, 98: 2, 161: 2, 72: 3}


@query("""select id, case when category_id in (87, 155) then 1 when category_id in (98, 161) then 2 else 3 end as category_id,
  case when category_id in (87, 155) then (select name from categories where id = 155) when category_id in (98, 161) then (select name from categories where id = 161) else 'third' end as category_str
  from anns where category_id in (87, 155, 98, 161, 72)""")
def remap_classes(spark: SparkSession, d: str) -> DataFrame:
    return labels.remap_classes(annotated(spark, d), _MAP, {3: "third"}).annotations.select("id", "category_id", "category_str")


@query("""select id, case when category_id in (87, 155) then 1 when category_id in (98, 161) then 2 when category_id = 72 then 3 else category_id end as category_id from anns""")
def remap_keep_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return labels.remap_classes(annotated(spark, d), _MAP, remove_not_mapped=False).annotations.select("id", "category_id")


@query("""select a.id, s.k as category_id from anns a join (values (1, 1, 1), (2, 9, 2), (10, 15, 3), (16, 25, 4), (26, 33, 5), (34, 43, 6), (44, 51, 7), (52, 61, 8), (62, 71, 9), (72, 77, 10), (78, 83, 11), (84, 91, 12)) s(lo, hi, k) on a.category_id between s.lo and s.hi""")
def remap_preset(spark: SparkSession, d: str) -> DataFrame:
    return labels.remap_from_preset(annotated(spark, d), "coco", "supercategory").annotations.select("id", "category_id")


@query("select a.id, coalesce(c.id + 1000, a.category_id) as category_id from anns a left join categories c on c.id = a.category_id and c.id % 2 = 0")
def remap_from_other(spark: SparkSession, d: str) -> DataFrame:
    ds = annotated(spark, d)
    other = {k + 1000: v for k, v in ds.label_map.items() if k % 2 == 0}
    own = {r[0] for r in ds.annotations.select("category_id").distinct().collect()}
    ds = ds.with_(label_map=ds.label_map | {k: str(k) for k in own if k not in ds.label_map})
    return labels.remap_from_other(ds, other).annotations.select("id", "category_id")


@query("select id, category_id from anns where category_id in (87, 98)")
def keep_classes(spark: SparkSession, d: str) -> DataFrame:
    return labels.keep_classes(annotated(spark, d), [87, 98]).annotations.select("id", "category_id")


@query("select id, category_id from anns where category_id not in (87, 98)")
def remove_classes(spark: SparkSession, d: str) -> DataFrame:
    return labels.remove_classes(annotated(spark, d), [87, 98]).annotations.select("id", "category_id")


@query("select category_id, count(distinct category_str) as n_names from annotations group by 1 having count(distinct category_str) > 1", raw=True)
def label_map_check(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_conflicts(table(spark, d, "annotations"))


@query("select distinct category_id, category_str from anns")
def construct_label_map(spark: SparkSession, d: str) -> DataFrame:
    found = labels.construct_label_map(annotated(spark, d).annotations)
    return spark.createDataFrame(sorted(found.items()), "category_id int, category_str string")


# ---------------------------------------------------------------- sets
def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return images_of(spark, d).select("id", F.when(F.col("tags_time").isNotNull() | F.col("tags_weather").isNotNull(), F.array_compact(F.array("tags_time", "tags_weather"))).alias("tags"))


_TAGS = ["cloudy", "day", "night", "rainy", "snowy", "sunny"]


@query("select id, " + ", ".join(f"coalesce(tags_time = '{t}', false) or coalesce(tags_weather = '{t}', false) as \"tags.{t}\"" for t in _TAGS) + " from imgs")
def booleanize(spark: SparkSession, d: str) -> DataFrame:
    return onehot.booleanize(_tagged(spark, d), {"tags": _TAGS})[0]


@query("select id, list_sort(list_filter([tags_time, tags_weather], lambda x: x is not null)) as tags from imgs")
def debooleanize(spark: SparkSession, d: str) -> DataFrame:
    wide, made = onehot.booleanize(_tagged(spark, d), {"tags": None})
    return onehot.debooleanize(wide, made).select("id", F.sort_array("tags").alias("tags"))


# ---------------------------------------------------------------- append
@query("""select id, image_id, category_id, box_x_min, box_width, area from anns union all
  select m.top + k + 1, i.id, 87, case k when 0 then 10.0 else 0.25 * i.width end, case k when 0 then 30.0 else 0.5 * i.width end, case k when 0 then 1200.0 else 0.5 * i.width * 0.5 * i.height end
  from (select max(id) as top from anns) m, (select id, width, height from imgs where width is not null and height is not null order by id limit 1) i, (values (0), (1)) v(k)""")
def append_annotations(spark: SparkSession, d: str) -> DataFrame:
    ds = annotated(spark, d)
    first = ds.images.filter("width is not null and height is not null").orderBy("id").first()["id"]
    ds = append.add_annotations(ds, first, [10, 20, 30, 40], 87)
    ds = append.add_annotations(ds, [first], [[0.25, 0.25, 0.5, 0.5]], 87, "xywh")
    return ds.annotations.select("id", "image_id", "category_id", "box_x_min", "box_width", "area")


# ---------------------------------------------------------------- bins and histograms
_EDGES = (0.0, 16.0, 64.0, 256.0, 1024.0)


@query("""select id, case when box_height > 0 and box_height <= 16 then 8.0 when box_height > 16 and box_height <= 64 then 40.0 when box_height > 64 and box_height <= 256 then 160.0 when box_height > 256 and box_height <= 1024 then 640.0 end as box_height from anns""")
def explicit_bins(spark: SparkSession, d: str) -> DataFrame:
    return G.cut_group(annotated(spark, d).annotations, G.ContinuousGroup("box_height", _EDGES, label_type="mid")).select("id", "box_height")


@query("""select a.id, case when box_width is not null then least(5, greatest(1, cast(ceil((box_width - lo) / (hi - lo) * 5) as int))) - 1 end as bin from anns a cross join (select min(box_width) as lo, max(box_width) as hi from anns)""")
def cut_bins(spark: SparkSession, d: str) -> DataFrame:
    ann = annotated(spark, d).annotations
    edges = G.bin_edges(ann, G.ContinuousGroup("box_width", 5))
    return ann.select("id", G.bin_column(F.col("box_width"), edges).alias("bin"))


@query("""select id, case when box_width <= q[2] then 0 when box_width <= q[3] then 1 when box_width <= q[4] then 2 when box_width is not null then 3 end as bin from anns cross join (select quantile_cont(box_width, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from anns)""")
def qcut_bins(spark: SparkSession, d: str) -> DataFrame:
    ann = annotated(spark, d).annotations
    edges = G.bin_edges(ann, G.ContinuousGroup("box_width", 4, qcut=True))
    return ann.select("id", G.bin_column(F.col("box_width"), edges).alias("bin"))


@query("""select a.id, least(4, greatest(1, cast(ceil((ln(confidence) - lo) / (hi - lo) * 4) as int))) - 1 as bin from preds a cross join (select min(ln(confidence)) as lo, max(ln(confidence)) as hi from preds where confidence > 0) where confidence > 0""")
def log_bins(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d).annotations.filter("confidence > 0")
    edges = G.bin_edges(p, G.ContinuousGroup("confidence", 4, log=True))
    edges[-1] = edges[-1] * (1 + 1e-12)
    return p.select("id", G.bin_column(F.col("confidence"), edges).alias("bin"))


@query("""select id, median(box_height) over (partition by b) as box_height from (select id, box_height, case when box_height > 0 and box_height <= 16 then 0 when box_height > 16 and box_height <= 64 then 1 when box_height > 64 and box_height <= 256 then 2 when box_height > 256 and box_height <= 1024 then 3 end as b from anns)""")
def bin_medians(spark: SparkSession, d: str) -> DataFrame:
    return G.cut_group(annotated(spark, d).annotations, G.ContinuousGroup("box_height", _EDGES, label_type="median")).select("id", "box_height")


@query("""select c.category_id, s.split, count(a.id) as n, count(a.id) / sum(count(a.id)) over () as share from (select distinct category_id from anns where split is not null) c cross join (select distinct split from anns where split is not null) s
  left join anns a on a.category_id = c.category_id and a.split = s.split group by 1, 2""", rounded=["share"])
def histogram_full(spark: SparkSession, d: str) -> DataFrame:
    ann = annotated(spark, d).annotations
    return histograms.full_histogram(ann.filter("split is not null"), ["category_id", "split"])


_SIDES = "l as (select category_id as k, count(*) as n from anns where split = 'train' group by 1), r as (select category_id as k, count(*) as n from anns where split = 'valid' group by 1)"


def _sides(spark: SparkSession, d: str, key: str = "category_id") -> tuple[DataFrame, DataFrame]:
    ann = annotated(spark, d).annotations
    return tuple(ann.filter(F.col("split") == s).groupBy(key).agg(F.count(F.lit(1)).alias("n")) for s in ("train", "valid"))


@query(f""", {_SIDES} select 1 - sum(least(a, b)) / sum(greatest(a, b)) as distance from (select coalesce(l.n / (select sum(n) from l), 0) as a, coalesce(r.n / (select sum(n) from r), 0) as b from l full join r using (k))""", rounded=["distance"])
def share_distance(spark: SparkSession, d: str) -> DataFrame:
    return histograms.share_distance_frames(*_sides(spark, d), "category_id")


@query(f""", {_SIDES} select sum(case when q > 0 then p * ln(p / q) else 'infinity'::double end) as divergence from (select l.n / (select sum(n) from l) as p, coalesce(r.n, 0) / (select sum(n) from r) as q from l left join r using (k))""", rounded=["divergence"])
def kl_marginal(spark: SparkSession, d: str) -> DataFrame:
    return histograms.divergence_frames(*_sides(spark, d), "category_id")


@query(f""", {_SIDES}, b as (select k, coalesce(l.n, 0) as a, coalesce(r.n, 0) as b from l full join r using (k)),
  c as (select k, abs(sum(a) over (order by k) / sum(a) over () - sum(b) over (order by k) / sum(b) over ()) * (lead(k) over (order by k) - k) as area from b) select sum(area) / (max(k) - min(k)) as distance from c""", rounded=["distance"])
def emd_1d(spark: SparkSession, d: str) -> DataFrame:
    return histograms.earth_mover_1d_frames(*_sides(spark, d), "category_id")


# ---------------------------------------------------------------- splits
@query(None)
def simple_split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.simple_split(images_of(spark, d).drop("split"), ["train", "valid"], [0.8, 0.2], 3).select("id", "split")


_CHUNK_SRC = "c as (select id, lower(trim(uploader)) as person, tags_weather || width || height || source as scene from images where id is not null qualify row_number() over (partition by id order by ingested_at desc) = 1)"


@query(f"""with recursive {_CHUNK_SRC}, pl as (select person, min(id) as m from c where person is not null group by 1)
  select c.id, coalesce(pl.m, c.id) as chunk from c left join pl on c.person = pl.person""", raw=True)
def atomic_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = latest_rows(table(spark, d, "images"), "id", "ingested_at", ["id", "uploader"]).select("id", F.lower(F.trim("uploader")).alias("person"))
    return splitting.atomic_chunks(rows, ["person"])


@query(f"""with recursive {_CHUNK_SRC}, edges as (select a.id as a, b.m as b from c a join (select person, min(id) as m from c where person is not null group by 1) b using (person)
    union select a.id, b.m from c a join (select scene, min(id) as m from c where scene is not null group by 1) b using (scene)),
  sym as (select a, b from edges union select b, a from edges),
  reach as (select id as a, id as b from c union select r.a, s.b from reach r join sym s on s.a = r.b)
  select a as id, min(b) as chunk from reach group by a""", raw=True)
def atomic_chunks_chained(spark: SparkSession, d: str) -> DataFrame:
    rows = latest_rows(table(spark, d, "images"), "id", "ingested_at", ["id", "uploader", "tags_weather", "width", "height", "source"])
    person = F.lower(F.trim("uploader"))
    return splitting.atomic_chunks(rows.select("id", person.alias("person"), F.concat("tags_weather", F.col("width").cast("string"), F.col("height").cast("string"), "source").alias("scene")), ["person", "scene"])


def _own_images(spark: SparkSession, d: str) -> Dataset:
    """The images, annotated or not, without their splits, and with who sent them."""
    ds = annotated(spark, d)
    who = latest_rows(table(spark, d, "images"), "id", "ingested_at", ["id", "uploader"]).select("id", F.lower(F.trim("uploader")).alias("person"))
    return ds.with_(images=ds.images.drop("split").join(who, "id"), annotations=ds.annotations.drop("split"))


@query(f"with {_CHUNK_SRC} select person, count(*) as n_images, 1::bigint as n_splits from c where person is not null group by 1", raw=True)
def split_dataset_leaks(spark: SparkSession, d: str) -> DataFrame:
    """In how many splits the images of a person are: one, whether they have annotations or not."""
    out = splitting.split_dataset(_own_images(spark, d), ["train", "valid"], [0.8, 0.2], ["person"], ["category_id"], 3)
    return out.images.filter("person is not null").groupBy("person").agg(F.count(F.lit(1)).alias("n_images"), F.count_distinct("split").alias("n_splits"))


@query("select name, true as within from (values ('every image has a split'), ('train share'), ('classes in train')) v(name)", raw=True)
def split_dataset_shares(spark: SparkSession, d: str) -> DataFrame:
    """The train share of the images is within a hundredth of the one asked for; those of the large classes are off by a tenth or less on average."""
    out = splitting.split_dataset(_own_images(spark, d), ["train", "valid"], [0.8, 0.2], [], ["category_id"], 3)
    one = out.images.agg((F.count("split") == F.count(F.lit(1))).alias("all"), (F.abs(F.avg((F.col("split") == "train").cast("int")) - 0.8) <= 0.01).alias("share"))
    per = out.annotations.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("split") == "train").cast("int")).alias("p"), F.max("image_id").alias("i")).filter("n >= 500")
    # one image holds a tenth of all rows, so no class by itself can be held to much
    fine = per.agg((F.coalesce(F.sum(F.abs(F.col("p") - 0.8) * F.col("n")) / F.sum("n"), F.lit(0.0)) <= 0.1).alias("classes"))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("within")) for n, c in (("every image has a split", "all"), ("train share", "share"), ("classes in train", "classes"))))
    return one.crossJoin(fine).select(F.inline(rows))


@query(None)
def split_balanced(spark: SparkSession, d: str) -> DataFrame:
    ds = annotated(spark, d)
    rows = splitting.balanced_split(ds.annotations.drop("split").withColumn("image_key", F.col("image_id")), ["train", "valid"], [0.8, 0.2], ["image_key"], [G.ContinuousGroup("box_height", (0.0, 64.0, 256.0, 1e9), label_type="mid")], ds.images, "image_id", 5)
    return rows.join(ds.annotations.select("id", "image_id"), "id").select("image_id", "split").distinct()


@query("select 'train' as split, count(*) as n, true as within from imgs union all select 'all', count(*), true from imgs")
def simple_split_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every image has a split, and the drawn share is within four standard deviations of the asked one."""
    out = splitting.simple_split(images_of(spark, d).drop("split"), ["train", "valid"], [0.8, 0.2], 3)
    one = out.agg(F.count("split").alias("n"), F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split").isin("train", "valid")).alias("known"))
    near = F.abs(F.col("t") - 0.8 * F.col("n")) <= 4 * F.sqrt(0.16 * F.col("n"))
    return one.select(F.inline(F.array(F.struct(F.lit("train").alias("split"), F.col("n"), near.alias("within")), F.struct(F.lit("all").alias("split"), F.col("n"), (F.col("known") == F.col("n")).alias("within")))))


@query("select count(distinct image_id) as n_images, 1::bigint as splits_of_an_image, true as shares_met from anns")
def split_balanced_shares(spark: SparkSession, d: str) -> DataFrame:
    """Images are whole in the split of ``split_balanced``, and its shares within a hundredth of those asked for."""
    per = split_balanced(spark, d).groupBy("image_id").agg(F.count_distinct("split").alias("k"), F.max("split").alias("split"))
    return per.agg(F.count(F.lit(1)).alias("n_images"), F.max("k").alias("splits_of_an_image"), (F.abs(F.avg((F.col("split") == "train").cast("int")) - 0.8) <= 0.01).alias("shares_met"))


@query(f"""select id, image_id, category_id, width_class, note from (
  select a.id, a.image_id, a.category_id, 'wide' as width_class, null as note from anns a where a.image_id % 2 = 0
  union all select a.id + (select max(id) from anns where image_id % 2 = 0) - (select min(id) from anns where image_id % 2 = 1) + 1, a.image_id, a.category_id, null, 'n' || a.id from anns a where a.image_id % 2 = 1)""")
def merge_extra_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of one side only stay, null on the other; ids are moved where they clash."""
    a, b = _halves(spark, d)
    a = a.with_(annotations=a.annotations.withColumn("width_class", F.lit("wide")))
    low = b.annotations.agg(F.min("id")).first()[0]
    b = b.with_(annotations=b.annotations.withColumn("note", F.concat(F.lit("n"), F.col("id"))))
    top = a.annotations.agg(F.max("id")).first()[0]
    b = b.with_(annotations=b.annotations.withColumn("id", F.col("id") + (top - low + 1)))
    return setops.merge(a, b).annotations.select("id", "image_id", "category_id", "width_class", "note")


@query("select id, 'sub/' || relative_path as relative_path from imgs where relative_path is not null and relative_path not like '%..%' and relative_path not like '%//%' and relative_path not like '/%' and relative_path not like '%./%'")
def reset_images_root(spark: SparkSession, d: str) -> DataFrame:
    ds = annotated(spark, d).filter_images(r"relative_path is not null and relative_path not like '%..%' and relative_path not like '%//%' and relative_path not like '/%' and relative_path not like '%./%'").with_(images_root="data/sub")
    return ds.reset_images_root("data").images.select("id", "relative_path")


@query("""select id, case when category_id in (87, 155) then 1 else 2 end as category_id, case when category_id in (87, 155) then 'walker' else 'rider, slow' end as category_str from anns where category_id in (87, 155, 98)""")
def remap_from_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "remap")
    rows = [(0, 87, "a", 1, "walker"), (1, 155, "b", 1, "walker"), (2, 98, "c", 2, "rider, slow")]
    spark.createDataFrame(rows, "n int, input_category_id int, input_category_name string, output_category_id int, output_category_name string").coalesce(1).write.option("header", True).csv(path)
    return labels.remap_from_csv(annotated(spark, d), path).annotations.select("id", "category_id", "category_str")


_HIST = """, b as (select category_id as c, split as s, case when box_height <= 16 then 8.0 when box_height <= 64 then 40.0 when box_height <= 256 then 160.0 else 640.0 end as x from anns where category_id in (87, 98, 155) and split in ('train', 'valid') and box_height > 0 and box_height <= 1024),
h as (select c, x, count(*) filter (where s = 'train') as l, count(*) filter (where s = 'valid') as r from b group by 1, 2),
m as (select c, sum(l) / (select sum(l) from h) as p, sum(r) / (select sum(r) from h) as q, sum(l) as w from h group by 1),
cum as (select c, x, sum(l) over (partition by c order by x) / sum(l) over (partition by c) as a, sum(r) over (partition by c order by x) / sum(r) over (partition by c) as b, lead(x) over (partition by c order by x) - x as gap from h),
far as (select c, greatest(max(x) filter (where l > 0) - min(x) filter (where r > 0), max(x) filter (where r > 0) - min(x) filter (where l > 0)) as most from h group by 1),
e as (select cum.c, sum(abs(a - b) * gap) / max(most) as emd from cum join far using (c) group by 1)"""


@query(_HIST + " select (select sum(p * ln(p / q)) from m) as kl, (select sum(emd * w) / sum(w) from e join m using (c)) as emd, (select sum(p * ln(p / q)) from m) + (select sum(emd * w) / sum(w) from e join m using (c)) as distance", rounded=["kl", "emd", "distance"])
def histogram_distance(spark: SparkSession, d: str) -> DataFrame:
    """The distance of the train and valid histograms of three classes and box heights, as splits are judged by it."""
    ann = annotated(spark, d).annotations.filter("category_id in (87, 98, 155) and split in ('train', 'valid')")
    binned = G.cut_group(ann, G.ContinuousGroup("box_height", _EDGES, label_type="mid")).filter("box_height is not null")
    cells = sorted((tuple(r) for r in binned.groupBy("category_id", "box_height").agg(F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "valid")).collect()))
    l, r = ([c[i] for c in cells] for i in (2, 3))  # noqa: E741
    at = [c[:2] for c in cells]
    whole = float(histograms.histogram_distance(l, r, at, ["category_id", "box_height"], {"category_id": 1.0}, {"box_height": 1.0}))
    kl = _category_part(l, r, at)
    return spark.createDataFrame([(kl, whole - kl, whole)], "kl double, emd double, distance double")


def _category_part(l: list[int], r: list[int], cells: list[tuple]) -> float:  # noqa: E741
    """The part of the categories alone: the same distance with all heights in one bin."""
    one = sorted({c[0] for c in cells})
    sums = [[sum(n for n, c in zip(x, cells, strict=True) if c[0] == k) for k in one] for x in (l, r)]
    return float(histograms.histogram_distance(*sums, [(k,) for k in one], ["category_id"], {"category_id": 1.0}, {}))


@query("select id, row_number() over (order by width nulls last, id) - 1 as position from imgs")
def numbering(spark: SparkSession, d: str) -> DataFrame:
    return numbered(images_of(spark, d).select("id", "width"), [F.col("width").asc_nulls_last(), F.col("id")]).select("id", "position")


@query("select id as category_id, name as category_str from categories", raw=True)
def label_map_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(sorted(label_map(spark, d).items()), "category_id int, category_str string")
