"""Queries of the evaluation operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.boxes import BOX
from framewright.model import label_column
from framewright.operators import curves
from framewright.operators.confusion import confusion_counts, named_cells
from framewright.operators.matching import greedy_match, iou_pairs, matched_rows
from framewright.plans.view import annotated, boxes_of, images_of, label_map, predicted, registrar, scored
from framewright.session import kept, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

IOUS = [0.0, 0.5, 0.75]
CONFIDENCES = [0.0, 0.25, 0.5, 0.75]

_PAIRS = """, w as (select p.image_id, p.category_id, p.id as pid, g.id as gid, p.confidence, p.box_width * p.box_height as pa, g.box_width * g.box_height as ga,
    greatest(0, least(g.box_x_min + g.box_width, p.box_x_min + p.box_width) - greatest(g.box_x_min, p.box_x_min)) as iw,
    greatest(0, least(g.box_y_min + g.box_height, p.box_y_min + p.box_height) - greatest(g.box_y_min, p.box_y_min)) as ih
  from preds p join anns g on g.image_id = p.image_id {same} where g.box_x_min < p.box_x_min + p.box_width and p.box_x_min < g.box_x_min + g.box_width and g.box_y_min < p.box_y_min + p.box_height and p.box_y_min < g.box_y_min + g.box_height),
pairs as (select image_id, category_id, pid, gid, confidence, coalesce(iw * ih / nullif(ga + pa - iw * ih, 0), 0) as iou from w where iw * ih / nullif(ga + pa - iw * ih, 0) > 0)"""
_SAME = "and g.category_id = p.category_id"


def _match_sql(agnostic: bool) -> str:
    """Greedy matching as a recursion over the rank of a prediction in its image (and class)."""
    key = "image_id, 0 as category_id" if agnostic else "image_id, category_id"
    return _PAIRS.format(same="" if agnostic else _SAME) + f""",
cand as (select {key}, pid, confidence, list(gid order by iou desc, gid) as gs from pairs group by all),
ranked as (select image_id, category_id, pid, gs, row_number() over (partition by image_id, category_id order by confidence desc, pid) as rk from cand),
walk as (select image_id, category_id, rk, pid, gs[1] as pick, [gs[1]] as used from ranked where rk = 1
  union all select r.image_id, r.category_id, r.rk, r.pid, list_filter(r.gs, lambda e: not list_contains(w.used, e))[1],
    case when len(list_filter(r.gs, lambda e: not list_contains(w.used, e))) = 0 then w.used else list_append(w.used, list_filter(r.gs, lambda e: not list_contains(w.used, e))[1]) end
  from walk w join ranked r on r.image_id = w.image_id and r.category_id = w.category_id and r.rk = w.rk + 1),
hits as (select w.pid, w.pick as gid, p.iou from walk w join pairs p on p.pid = w.pid and p.gid = w.pick),
matches as (select p.id as prediction_id, coalesce(h.iou, 0) as iou, h.gid as groundtruth_id from preds p left join hits h on h.pid = p.id
  union all select null, 0, id from anns where id not in (select gid from hits))"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return annotated(spark, d).annotations, predicted(spark, d).annotations


def _kept_sides(spark: SparkSession, d: str, *extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides written once with what is read of them, as matching and the lookups after it each read them."""
    return tuple(kept(df.select("id", "image_id", "category_id", "category_str", *BOX, *more), "side") for df, more in zip(_sides(spark, d), extra, strict=True))


@query(_PAIRS.format(same=_SAME) + " select image_id, category_id, pid as prediction_id, gid as groundtruth_id, iou from pairs where iou > 0.3", rounded=["iou"])
def iou_join(spark: SparkSession, d: str) -> DataFrame:
    return iou_pairs(*_sides(spark, d), min_iou=0.3).select("image_id", "category_id", "prediction_id", "groundtruth_id", "iou")


@query(_match_sql(False) + " select prediction_id, iou, groundtruth_id from matches", rounded=["iou"])
def iou_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return greedy_match(*_sides(spark, d))


@query(_match_sql(True) + " select prediction_id, iou, groundtruth_id from matches", rounded=["iou"])
def iou_greedy_match_agnostic(spark: SparkSession, d: str) -> DataFrame:
    return greedy_match(*_sides(spark, d), category_agnostic=True)


_DET = """, det as (select g.id is not null as is_gt, m.iou, coalesce(p.confidence, 0) as confidence, coalesce(g.category_id, p.category_id) as category_id, coalesce(g.split, p.split) as split
  from matches m left join anns g on g.id = m.groundtruth_id left join preds p on p.id = m.prediction_id)"""


def _curve_sql(by: str) -> str:
    k = f"{by}, iou_threshold" if by else "iou_threshold"
    g = f"partition by {k}"
    return f""", each as (select *, unnest({IOUS}) as iou_threshold from det),
pts as (select {k}, confidence, count(*) filter (where is_gt and iou > iou_threshold) as tp, count(*) as n, count(*) filter (where is_gt) as gt from each group by all),
c0 as (select {k}, confidence as c, sum(tp) over ({g} order by confidence desc) / sum(n) over ({g} order by confidence desc) as p,
  coalesce(sum(tp) over ({g} order by confidence desc) / nullif(sum(gt) over ({g}), 0), 0) as r, row_number() over ({g} order by confidence desc) as pos from pts),
ends as (select {k}, arg_min(p, pos) as p0, arg_max(r, pos) as r1, max(pos) as m from c0 group by all),
c1 as (select {k}, c, p, r, pos from c0 union all select {k}, 1, 1, 0, -2 from ends union all select {k}, 1, p0, 0, -1 from ends union all select {k}, 0, 0, r1, m + 1 from ends union all select {k}, 0, 0, 1, m + 2 from ends),
c2 as (select {k}, c, r, pos, max(p) over ({g} order by pos rows between current row and unbounded following) as p from c1),
c3 as (select * from c2 qualify not coalesce(lag(p) over ({g} order by pos) = p and lead(p) over ({g} order by pos) = p, false)),
curve as (select * from c3 qualify not coalesce(lag(r) over ({g} order by pos) = r and lead(r) over ({g} order by pos) = r, false))"""


def _grid_sql(by: str) -> str:
    k = f"{by}, iou_threshold" if by else "iou_threshold"
    on = " and ".join(f"t.{x.strip()} is not distinct from g.{x.strip()}" for x in k.split(","))
    cols = ", ".join(f"g.{x.strip()}" for x in k.split(","))
    return _curve_sql(by) + f""", marks as (select distinct {k}, unnest(list_transform(range(101), lambda i: i / 100.0)) as x from curve),
at_grid as (select {cols}, g.x as recall, arg_max(t.p, t.pos) as precision, arg_max(t.c, t.pos) as confidence_threshold, max(t.pos) as position from marks g join curve t on {on} and t.r <= g.x group by all)"""


def _detections(spark: SparkSession, d: str) -> DataFrame:
    return curves.detected(matched_rows(*_sides(spark, d), ["category_id", "split"]), ["category_id", "split"])


@query(_match_sql(False) + _DET + _curve_sql("category_id") + " select category_id, iou_threshold, p as precision, r as recall, c as confidence_threshold, (1 + 1) * p * r / (1 * p + r + 1e-5) as f1_score, (1 + 0.25) * p * r / (0.25 * p + r + 1e-5) as \"f0.5_score\" from curve", rounded=["precision", "recall", "f1_score"])
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    out = curves.precision_recall(_detections(spark, d), ["category_id"], IOUS, [1, 0.5], None)
    return out.drop("position").withColumn("f0.5_score", F.col("`f0.5_score`"))


@query(_match_sql(False) + _DET + _grid_sql("category_id") + " select category_id, iou_threshold, recall, precision, confidence_threshold from at_grid", rounded=["precision", "recall"])
def pr_curve_on_grid(spark: SparkSession, d: str) -> DataFrame:
    return curves.precision_recall(_detections(spark, d), ["category_id"], IOUS).select("category_id", "iou_threshold", "recall", "precision", "confidence_threshold")


_AP = "select {by} iou_threshold, coalesce(sum(a), 0) as \"AP\" from (select *, precision * (recall - lag(recall) over (partition by {by} iou_threshold order by recall, position)) as a from at_grid) group by all"


@query(_match_sql(False) + _DET + _grid_sql("category_id") + _AP.format(by="category_id,"), rounded=["AP"])
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return curves.average_precision(curves.precision_recall(_detections(spark, d), ["category_id"], IOUS), ["category_id"])


@query(_match_sql(False) + _DET + _grid_sql("split") + _AP.format(by="split,"), rounded=["AP"])
def average_precision_by_split(spark: SparkSession, d: str) -> DataFrame:
    return curves.average_precision(curves.precision_recall(_detections(spark, d), ["split"], IOUS), ["split"])


@query(_match_sql(False) + _DET + _grid_sql("") + _AP.format(by=""), rounded=["AP"])
def average_precision_overall(spark: SparkSession, d: str) -> DataFrame:
    return curves.average_precision(curves.precision_recall(_detections(spark, d), [], IOUS), [])


_CONF = """, j as (select g.category_str as gl, p.category_str as pl, p.confidence, m.iou, coalesce(g.split, p.split) as split, m.groundtruth_id is not null and m.prediction_id is not null and m.iou <= 0.3 as weak
    from matches m left join anns g on g.id = m.groundtruth_id left join preds p on p.id = m.prediction_id),
prs as (select gl as a, case when confidence > 0.2 then pl end as b, split from j where not weak union all select gl, null, split from j where weak union all select null, case when confidence > 0.2 then pl end, split from j where weak),
cells as (select {by} coalesce(a, 'None') as groundtruth, coalesce(b, 'None') as prediction, count(*) as n from prs where a is not null or b is not null group by all)
select *, n / sum(n) over (partition by {by} groundtruth) as share from cells"""


def _confusion(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    g, p = _sides(spark, d)
    return curves.confused_rows(matched_rows(g, p, ["category_str", *by], category_agnostic=True, carried={"predicted": "category_str"}), 0.3, 0.2, by)


@query(_match_sql(True) + _CONF.format(by=""), rounded=["share"])
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return curves.confusion_cells(_confusion(spark, d, []))


@query(_match_sql(True) + _CONF.format(by=""), rounded=["share"])
def confusion_matrix_of_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same from kept matches, as the evaluator makes it: attributes of both sides are looked up, in tables that are made once."""
    g, p = _kept_sides(spark, d, [], ["confidence"])
    return curves.confusion_cells(curves.confusion_pairs(greedy_match(g, p, category_agnostic=True), g, p, 0.3, 0.2))


@query(_match_sql(False) + _DET + _grid_sql("category_id") + _AP.format(by="category_id,"), rounded=["AP"])
def average_precision_of_matches(spark: SparkSession, d: str) -> DataFrame:
    g, p = _sides(spark, d)
    rows = curves.detections(greedy_match(g, p), g, p, ["category_id"])
    return curves.average_precision(curves.precision_recall(rows, ["category_id"], IOUS), ["category_id"])


@query(_match_sql(True) + _CONF.format(by="split,"), rounded=["share"])
def confusion_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Counted where boxes are matched: they go through one shuffle together with their images."""
    g, p = boxes_of(spark, d, "annotations", [], False), scored(boxes_of(spark, d, "predictions", ["confidence"], False))
    names = label_map(spark, d)
    counts = confusion_counts(g, p, images_of(spark, d), 0.3, 0.2, ["split"], within=(table(spark, d, "annotations"), table(spark, d, "predictions")))
    return named_cells(counts, lambda c: label_column(names, c), ["split"])


_COUNTS = f""", cnt as (select category_id, image_id, t as confidence, count(*) filter (where p.confidence >= t) as n_pred from preds p, (select unnest({CONFIDENCES}) as t) group by all),
truth as (select category_id, image_id, count(*) as n_gt from anns group by all),
detail as (select c.category_id, c.image_id, c.confidence, n_pred, coalesce(n_gt, 0) as n_gt, n_pred - coalesce(n_gt, 0) as error,
  case when coalesce(n_gt, 0) > 0 then (n_pred - n_gt) / n_gt when n_pred > 0 then 'infinity'::double end as rel_error from cnt c left join truth t on t.category_id = c.category_id and t.image_id = c.image_id)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return curves.count_error_detail(*_sides(spark, d), ["category_id"], CONFIDENCES)


@query(_COUNTS + " select * from detail", rounded=["rel_error"])
def count_error_detail(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


_STATS = ["absolute_MAE", "absolute_RMSE", "absolute_std"]


@query(_COUNTS + """ select category_id, confidence, avg(abs(error)) as "absolute_MAE", sqrt(avg(error * error)) as "absolute_RMSE", stddev_samp(error) as absolute_std, quantile_cont(error, 0.25) as "absolute_q0.25", quantile_cont(error, 0.5) as "absolute_q0.5", quantile_cont(error, 0.75) as "absolute_q0.75",
  avg(abs(rel_error)) as "relative_MRE" from detail group by all""", rounded=_STATS)
def count_error(spark: SparkSession, d: str) -> DataFrame:
    out = curves.count_error(_counts(spark, d), ["category_id"])
    return out.select("category_id", "confidence", *_STATS, *(F.col(f"`absolute_q{x}`") for x in (0.25, 0.5, 0.75)), "relative_MRE")


@query(_match_sql(True) + _CONF.format(by="").replace("select *, n / sum(n)", ", shares as (select *, n / sum(n)").replace("groundtruth) as share from cells", "groundtruth) as share from cells), names as (select groundtruth as label from cells union select prediction from cells) select a.label, b.label as prediction, coalesce(s.share, 0) as share from names a cross join names b left join shares s on s.groundtruth = a.label and s.prediction = b.label"), rounded=["share"])
def confusion_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    """The matrix with a column per class, read off cell by cell."""
    wide = curves.confusion_matrix(_confusion(spark, d, []))
    names = [c for c in wide.columns if c != "label"]
    return wide.select("label", F.inline(F.array(*(F.struct(F.lit(c).alias("prediction"), F.col(f"`{c}`").alias("share")) for c in names))))


_SPREAD = ["relative_MRE", "relative_RMSRE", "relative_std"]


@query(_COUNTS + """ select category_id, confidence, avg(abs(rel_error)) as "relative_MRE", sqrt(avg(rel_error * rel_error)) as "relative_RMSRE", stddev_samp(rel_error) as relative_std,
  quantile_cont(rel_error, 0.25) as "relative_q0.25", quantile_cont(rel_error, 0.5) as "relative_q0.5", quantile_cont(rel_error, 0.75) as "relative_q0.75" from detail where n_gt > 0 group by all""", rounded=_SPREAD)
def count_error_relative(spark: SparkSession, d: str) -> DataFrame:
    out = curves.count_error(_counts(spark, d).filter("n_gt > 0"), ["category_id"])
    return out.select("category_id", "confidence", *_SPREAD, *(F.col(f"`relative_q{x}`") for x in (0.25, 0.5, 0.75)))
