"""Queries of the general training-data problems (4, 5, 6) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.balance import balanced_key_stats, heavy_keys, long_keys
from framewright.operators.orphans import OrphanLedger, current_orphans, orphan_report, orphan_rows
from framewright.operators.shred import leaf_levels, nested_table
from framewright.session import table

FIELDS = ["image_id", "category_id"]


def _referring(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("annotations", "predictions")}


def _targets(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"image_id": table(spark, d, "images"), "category_id": table(spark, d, "categories")}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_referring(spark, d), ["category_id", "image_id"]).select("table_name", "field_name", "key_id")


def p4_key_stats(spark: SparkSession, d: str) -> DataFrame:
    long, names = long_keys(_referring(spark, d), ["category_id", "image_id"], "ingested_at")
    labels = F.create_map(*(F.lit(x) for i, (t, f) in enumerate(names) for x in (i, f"{t}.{f}")))
    return balanced_key_stats(long).select(labels[F.col("family")].alias("key_column"), "key_id", "n", "first_at", "last_at", "max_gap_us")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_rows(_referring(spark, d), _targets(spark, d)).select("table_name", "row_id", "field_name", "state")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_referring(spark, d), _targets(spark, d))


def p5_current(spark: SparkSession, d: str) -> DataFrame:
    return current_orphans(_referring(spark, d), _targets(spark, d))


def p5_maintained(spark: SparkSession, d: str) -> DataFrame:
    """The current orphans from counts kept over two batches: all that came up to a moment in the middle, then all that came later."""
    refs, targets = _referring(spark, d), _targets(spark, d)
    middle = refs["annotations"].agg(F.percentile_approx("ingested_at", 0.5)).first()[0]
    ledger = OrphanLedger(spark, FIELDS)
    early = F.lit(True) if middle is None else F.coalesce(F.col("ingested_at") <= F.lit(middle), F.lit(True))
    for part in (early, ~early):
        ledger.apply({t: df.filter(part) for t, df in refs.items()}, {f: df.filter(part) for f, df in targets.items()})
    return ledger.orphans()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    items = nested_table(table(spark, d, "raw_records"), "items")
    return items.filter("annotation_id is not null").select("record_id", "annotation_id", "field_name", "pos", "item_value")


def p6_images(spark: SparkSession, d: str) -> DataFrame:
    return nested_table(table(spark, d, "raw_records"), "images")


def p6_annotations(spark: SparkSession, d: str) -> DataFrame:
    return nested_table(table(spark, d, "raw_records"), "annotations")


def p6_levels(spark: SparkSession, d: str) -> DataFrame:
    return leaf_levels(table(spark, d, "raw_records"))


QUERIES = {f.__name__: f for f in (p4_found, p4_key_stats, p5_found, p5_report, p5_current, p5_maintained, p6_found, p6_images, p6_annotations, p6_levels)}

_KEYS = " union all ".join(f"select '{t}' as table_name, '{f}' as field_name, cast({f} as bigint) as key_id, ingested_at from {t}" for t in ("annotations", "predictions") for f in ("category_id", "image_id"))

_STATES = f"""
with born as (
  select 'image_id' as field_name, id as key_id, min(ingested_at) as born, arg_max(deleted_at, ingested_at) filter (where deleted_at is not null) as gone from images where id is not null group by id
  union all
  select 'category_id', id, min(ingested_at), arg_max(deleted_at, ingested_at) filter (where deleted_at is not null) from categories where id is not null group by id),
refs as ({" union all ".join(f"select '{t}' as table_name, '{f}' as field_name, id as row_id, min(ingested_at) as ref_at, max(cast({f} as bigint)) as key_id from {t} where id is not null group by id" for t in ("annotations", "predictions") for f in FIELDS)}),
states as (
  select table_name, row_id, r.field_name, r.key_id, ref_at,
    case when b.key_id is null then 'missing' when born > ref_at then 'late' when gone <= ref_at then 'deleted' end as state
  from refs r left join born b on b.field_name = r.field_name and b.key_id = r.key_id where r.key_id is not null)
"""

SQL = {
    "p4_found": f"select table_name, field_name, key_id from ({_KEYS}) k group by table_name, field_name, key_id having key_id is not null and count(*) > 0.03 * (case table_name when 'annotations' then (select count(*) from annotations) else (select count(*) from predictions) end)",
    "p4_key_stats": f"""
        with k as ({_KEYS}), g as (select *, epoch_us(ingested_at) - lag(epoch_us(ingested_at)) over (partition by table_name, field_name, key_id order by ingested_at) as gap from k where key_id is not null)
        select table_name || '.' || field_name as key_column, key_id, count(*) as n, min(epoch_us(ingested_at)) as first_at, max(epoch_us(ingested_at)) as last_at, coalesce(max(gap), 0) as max_gap_us from g group by all""",
    "p5_found": _STATES + "select table_name, row_id, field_name, state from states where state is not null",
    "p5_report": _STATES + "select table_name, field_name, state, strftime(ref_at, '%Y-%m') as period, count(*) as n from states where state is not null group by all",
    "p5_current": " union all ".join(
        f"""select '{t}' as table_name, '{f}' as field_name, key_id, count(*) as refs from (select max(cast({f} as bigint)) as key_id from {t} where id is not null group by id) r
        where key_id is not null and key_id not in (select id from {x} where id is not null group by id having count(deleted_at) = 0) group by key_id"""
        for t in ("annotations", "predictions") for f, x in (("image_id", "images"), ("category_id", "categories"))
    ),
}

SQL["p5_maintained"] = SQL["p5_current"]

_CLEAN = r"regexp_replace(regexp_replace({x}, '^[\x{FEFF}\s]+', ''), '[\x{FEFF}\s]+$', '')"
_INT = "try_cast(try_cast({x} as double) as bigint)"


def _list_items(field: str, path: str, value: str) -> str:
    """Items of a list leaf, or of the single value in its place."""
    return f"""select record_id, annotation_id, '{field}' as field_name, cast(pos as int) as pos, {value} as item_value from (
      select record_id, annotation_id, unnest(case json_type(node, '{path}') when 'ARRAY' then json_extract(node, '{path}[*]') else [json_extract(node, '{path}')] end) as item,
        generate_subscripts(case json_type(node, '{path}') when 'ARRAY' then json_extract(node, '{path}[*]') else [json_extract(node, '{path}')] end, 1) - 1 as pos
      from notes where json_type(node, '{path}') is not null and json_type(node, '{path}') <> 'NULL')"""


_HUNDREDTHS = "cast(cast(round(try_cast(item->>'$' as decimal(18, 4)) * 100) as bigint) as varchar)"
SQL["p6_found"] = f"""
with recursive one as (select record_id, {_CLEAN.replace('{x}', 'payload')} as t from raw_records where payload is not null),
unpacked as (select record_id, case when json_valid(t) and json_type(t) = 'VARCHAR' then {_CLEAN.replace('{x}', "(t::json->>'$')")} else t end as t from one where t <> ''),
docs as (select record_id, t::json as doc from unpacked where json_valid(t) and json_type(t) = 'OBJECT'),
walk as (
  select record_id, unnest(json_extract(doc, '$.annotations[*]')) as node, cast(null as bigint) as above from docs
  union all
  select record_id, unnest(json_extract(node, '$.parts[*]')), {_INT.replace('{x}', "node->>'$.id'")} from walk where json_type(node) = 'OBJECT'),
notes as (select record_id, node, above, {_INT.replace('{x}', "node->>'$.id'")} as annotation_id from walk where json_type(node) = 'OBJECT'),
boxes as (select record_id, annotation_id, unnest([0, 1, 2, 3]) as pos, unnest([json_extract(node, '$.bbox.x_min'), json_extract(node, '$.bbox.y_min'), json_extract(node, '$.bbox.width'), json_extract(node, '$.bbox.height')]) as item from notes where json_type(node, '$.bbox') = 'OBJECT'),
items as (
  {_list_items('attributes.colors', '$.attributes.colors', "item->>'$'")} union all {_list_items('attributes.position', '$.attributes.position', "item->>'$'")}
  union all {_list_items('children_ids', '$.children_ids', f"cast({_INT.replace('{x}', "item->>'$'")} as varchar)")}
  union all select * from ({_list_items('bbox', '$.bbox', _HUNDREDTHS)}) where true
  union all select record_id, annotation_id, 'bbox', pos, {_HUNDREDTHS} from boxes
  union all select record_id, annotation_id, 'parent_id', 0, cast(coalesce(above, {_INT.replace('{x}', "node->>'$.parent_id'")}) as varchar) from notes)
select record_id, annotation_id, field_name, pos, item_value from items where annotation_id is not null and item_value is not null"""
SQL["p6_images"] = f"""
with one as (select record_id, {_CLEAN.replace('{x}', 'payload')} as t from raw_records where payload is not null),
unpacked as (select record_id, case when json_valid(t) and json_type(t) = 'VARCHAR' then {_CLEAN.replace('{x}', "(t::json->>'$')")} else t end as t from one where t <> ''),
docs as (select record_id, t::json as doc from unpacked where json_valid(t) and json_type(t) = 'OBJECT')
select record_id, {_INT.replace('{x}', "doc->>'$.image.id'")} as image_id, doc->>'$.image.file_name' as file_name, {_INT.replace('{x}', "doc->>'$.image.width'")} as width, {_INT.replace('{x}', "doc->>'$.image.height'")} as height,
  doc->>'$.image.tags.weather' as tags_weather, doc->>'$.image.tags.time' as tags_time from docs"""

_TREE = f"""
with recursive one as (select record_id, {_CLEAN.replace('{x}', 'payload')} as t from raw_records where payload is not null),
unpacked as (select record_id, case when json_valid(t) and json_type(t) = 'VARCHAR' then {_CLEAN.replace('{x}', "(t::json->>'$')")} else t end as t from one where t <> ''),
docs as (select record_id, t::json as doc from unpacked where json_valid(t) and json_type(t) = 'OBJECT'),
walk as (
  select record_id, unnest(json_extract(doc, '$.annotations[*]')) as item, cast(generate_subscripts(json_extract(doc, '$.annotations[*]'), 1) - 1 as varchar) as node, 0 as depth, cast(null as bigint) as above from docs
  union all
  select record_id, unnest(json_extract(item, '$.parts[*]')), node || '/' || cast(generate_subscripts(json_extract(item, '$.parts[*]'), 1) - 1 as varchar), depth + 1, {_INT.replace('{x}', "item->>'$.id'")} from walk where json_type(item) = 'OBJECT')
"""
SQL["p6_annotations"] = _TREE + f"""
select record_id, node, depth, {_INT.replace('{x}', "item->>'$.id'")} as annotation_id, {_INT.replace('{x}', "item->>'$.category_id'")} as category_id, item->>'$.category_str' as category_str,
  try_cast(item->>'$.confidence' as double) as confidence, try_cast(item->>'$.attributes.occluded' as boolean) as occluded, coalesce(above, {_INT.replace('{x}', "item->>'$.parent_id'")}) as parent_id from walk where json_type(item) = 'OBJECT'"""
