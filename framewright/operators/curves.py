"""Precision and recall, average precision, confusion matrices and count errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut, few_rows

_EPS = 1e-5


def detections(matches: DataFrame, groundtruth: DataFrame, predictions: DataFrame, columns: list[str]) -> DataFrame:
    """One row per ground truth (with its prediction's confidence, or 0) and per unmatched prediction: ``is_gt, iou, confidence, columns...``.

    Attributes are the ground truth's, of an unmatched prediction its own.
    """
    g = groundtruth.select(F.col("id").alias("gid"), *(F.col(f"`{c}`").alias(f"g_{i}") for i, c in enumerate(columns)))
    p = predictions.select(F.col("id").alias("pid"), "confidence", *(F.col(f"`{c}`").alias(f"p_{i}") for i, c in enumerate(columns)))
    joined = matches.join(g, F.col("groundtruth_id") == F.col("gid"), "left").join(p, F.col("prediction_id") == F.col("pid"), "left")
    is_gt = F.col("gid").isNotNull()
    return joined.select(is_gt.alias("is_gt"), "iou", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *(F.when(is_gt, F.col(f"g_{i}")).otherwise(F.col(f"p_{i}")).alias(c) for i, c in enumerate(columns)))


def detected(matched: DataFrame, columns: list[str]) -> DataFrame:
    """``detections`` of ``matching.matched_rows`` that carry the columns: no join is needed."""
    return matched.select("is_gt", "iou", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *(F.col(f"`{c}`") for c in columns))


def precision_recall(rows: DataFrame, by: list[str], ious: list[float], betas: list[float] = [1], index_column: str | None = "recall", grid: list[float] | None = None) -> DataFrame:  # noqa: B006
    """``by..., iou_threshold, position, precision, recall, confidence_threshold, f<beta>_score...``.

    All thresholds share one plan. A point per distinct confidence is counted by an aggregation;
    running sums, end points, the envelope (greatest precision at this or a greater recall)
    and dropping points inside straight runs (of equal precision, then of equal recall) are
    windows over points. With ``index_column`` the curve is read at the grid values (0, 0.01 to 1 by
    default): the last point at or before the value, for falling columns the last at or above it.
    A group without ground truth has recall 0.
    """
    keys = [*by, "iou_threshold"]
    # thresholds are few: every row adds to one count for each, and rows are multiplied only once they are points
    counted = rows.groupBy(*by, "confidence").agg(*(F.count_if(F.col("is_gt") & (F.col("iou") > float(x))).alias(f"tp{i}") for i, x in enumerate(ious)), F.count(F.lit(1)).alias("k"), F.count_if("is_gt").alias("gt"))
    each = F.inline(F.array(*(F.struct(F.lit(float(x)).alias("iou_threshold"), F.col(f"tp{i}").alias("tp")) for i, x in enumerate(ious))))
    points = counted.select(*by, "confidence", "k", "gt", each)
    g = Window.partitionBy(*keys)
    run = g.orderBy(F.col("confidence").desc()).rowsBetween(Window.unboundedPreceding, 0)
    recall = F.coalesce(F.try_divide(F.sum("tp").over(run), F.sum("gt").over(g)), F.lit(0.0))
    curve = points.select(*keys, F.col("confidence").alias("c"), (F.sum("tp").over(run) / F.sum("k").over(run)).alias("p"), recall.alias("r"), F.row_number().over(g.orderBy(F.col("confidence").desc())).alias("pos"))
    one, zero = F.lit(1.0), F.lit(0.0)
    pt = lambda p, r, c, pos: F.struct(p.alias("p"), r.alias("r"), c.alias("c"), pos.cast("int").alias("pos"))
    # the end points hang on the first and last point, so that the curve is made in one pass over it
    p, r, pos = F.col("p"), F.col("r"), F.col("pos")
    front = F.when(pos == 1, F.array(pt(one, zero, one, F.lit(-2)), pt(p, zero, one, F.lit(-1)))).otherwise(F.array().cast("array<struct<p:double,r:double,c:double,pos:int>>"))
    back = F.when(pos == F.col("points"), F.array(pt(zero, r, zero, pos + 1), pt(zero, one, zero, pos + 2))).otherwise(F.array().cast("array<struct<p:double,r:double,c:double,pos:int>>"))
    all_ = curve.withColumn("points", F.count(F.lit(1)).over(g)).select(*keys, F.inline(F.concat(front, F.array(pt(p, r, F.col("c"), pos)), back)))
    ordered = g.orderBy("pos")
    # from the far end: a frame that grows is linear, one that shrinks towards its end is quadratic
    env = all_.withColumn("p", F.max("p").over(g.orderBy(pos.desc()).rowsBetween(Window.unboundedPreceding, 0)))
    inside = lambda c: F.coalesce((F.lag(c).over(ordered) == F.col(c)) & (F.lead(c).over(ordered) == F.col(c)), F.lit(False))
    thin = env.withColumn("drop", inside("p")).filter("not drop").withColumn("drop", inside("r")).filter("not drop").drop("drop")
    score = lambda b: F.try_divide((1 + b * b) * F.col("p") * F.col("r"), b * b * F.col("p") + F.col("r") + _EPS)
    full = thin.select(*keys, F.col("pos").alias("position"), F.col("p").alias("precision"), F.col("r").alias("recall"), F.col("c").alias("confidence_threshold"), *(score(b).alias(f"f{b}_score") for b in betas))
    if index_column is None:
        return full
    # along the curve recall only rises and precision and confidence only fall, so a point stands for the grid values from its own up to the next point's
    values = F.array(*(F.lit(float(v)) for v in (grid if grid is not None else [i / 100 for i in range(101)])))
    x, after = F.col(index_column), F.lead(index_column).over(g.orderBy("position"))
    rising = index_column == "recall"
    spans = full.withColumn("__next", after).filter(F.col("__next").isNull() | (F.col("__next") != x))
    mine = F.filter(values, lambda v: ((v >= x) if rising else (v <= x)) & (F.col("__next").isNull() | ((v < F.col("__next")) if rising else (v > F.col("__next")))))
    return spans.withColumn("__v", F.explode(mine)).select(*(F.col("__v").alias(c) if c == index_column else F.col(f"`{c}`") for c in full.columns))


def average_precision(curve: DataFrame, by: list[str]) -> DataFrame:
    """Sum of precision times step in recall, in the order of recall and position; the first point adds nothing."""
    w = Window.partitionBy(*by, "iou_threshold").orderBy("recall", "position")
    area = F.col("precision") * (F.col("recall") - F.lag("recall").over(w))
    return curve.select(*by, "iou_threshold", area.alias("area")).groupBy(*by, "iou_threshold").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("AP"))


def confusion_pairs(matches: DataFrame, groundtruth: DataFrame, predictions: DataFrame, min_iou: float = 0.0, min_confidence: float = 0.0, by: list[str] = [], label: str = "category_str") -> DataFrame:  # noqa: B006
    """``(by..., groundtruth, prediction)`` labels, "None" where there is none.

    A match of iou at most ``min_iou`` counts as a missed ground truth and a false prediction; a
    prediction of confidence at most ``min_confidence`` counts as none.
    """
    g = groundtruth.select(F.col("id").alias("gid"), F.col(label).alias("gl"), *(F.col(f"`{c}`").alias(f"g_{i}") for i, c in enumerate(by)))
    p = predictions.select(F.col("id").alias("pid"), F.col(label).alias("pl"), F.col("confidence").alias("conf"), *(F.col(f"`{c}`").alias(f"p_{i}") for i, c in enumerate(by)))
    j = matches.join(g, F.col("groundtruth_id") == F.col("gid"), "left").join(p, F.col("prediction_id") == F.col("pid"), "left")
    return _confused(j, min_iou, min_confidence, by)


def confused_rows(matched: DataFrame, min_iou: float = 0.0, min_confidence: float = 0.0, by: list[str] = [], label: str = "category_str", predicted: str = "predicted") -> DataFrame:  # noqa: B006
    """``confusion_pairs`` of ``matching.matched_rows`` that carry ``by``, the label, and as ``predicted`` the label of a ground truth's prediction: no join is needed.

    ``by`` is the ground truth's; of a false prediction beside a missed ground truth too, as both lie in one image.
    """
    lone = ~F.col("is_gt")
    none = F.lit(None).cast("bigint")
    own = F.col(f"`{label}`")
    j = matched.select(
        F.when(F.col("is_gt"), F.col("groundtruth_id")).otherwise(none).alias("gid"), F.col("prediction_id").alias("pid"), "iou", F.when(F.col("is_gt"), own).alias("gl"),
        F.when(lone, own).otherwise(F.col(f"`{predicted}`")).alias("pl"), F.col("confidence").alias("conf"), *(F.col(f"`{c}`").alias(f"{side}_{i}") for i, c in enumerate(by) for side in "gp"),
    )
    return _confused(j, min_iou, min_confidence, by)


def _confused(j: DataFrame, min_iou: float, min_confidence: float, by: list[str]) -> DataFrame:
    none = F.lit(None).cast("string")
    sure = F.when(F.col("conf") > min_confidence, F.col("pl"))
    weak = F.col("gid").isNotNull() & F.col("pid").isNotNull() & (F.col("iou") <= min_iou)
    pair = lambda a, b, mine: F.struct(a.alias("a"), b.alias("b"), *(F.col(f"{mine}_{i}").alias(f"k{i}") if mine else F.coalesce(f"g_{i}", f"p_{i}").alias(f"k{i}") for i in range(len(by))))
    rows = F.when(weak, F.array(pair(F.col("gl"), none, "g"), pair(none, sure, "p"))).otherwise(F.array(pair(F.col("gl"), sure, "")))
    flat = j.select(F.inline(rows)).filter("a is not null or b is not null")
    return flat.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(by)), F.coalesce("a", F.lit("None")).alias("groundtruth"), F.coalesce("b", F.lit("None")).alias("prediction"))


def confusion_cells(pairs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The row-normalised matrix in long form: ``by..., groundtruth, prediction, n, share``, cells with rows only."""
    cells = pairs.groupBy(*by, "groundtruth", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return shares(cells, by)


def shares(cells: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counted cells with their ``share`` of their ground truth's row."""
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "groundtruth")))


def confusion_matrix(pairs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The matrix: ``by..., label`` and a column per class, classes sorted, "None" last; rows of classes without ground truth are 0."""
    # one pass over the pairs: cells are few, and everything else is made of them
    cells = cut(confusion_cells(pairs, by))
    seen = {r[0] for r in few_rows(cells.select(F.explode(F.array("groundtruth", "prediction")).alias("c")).distinct(), "classes", 10_000)}
    classes = sorted(seen - {"None"}) + (["None"] if "None" in seen else [])
    labels = pairs.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    base = cells.select(*by).distinct().crossJoin(F.broadcast(labels)) if by else labels
    wide = cells.groupBy(*by, F.col("groundtruth").alias("label")).pivot("prediction", classes).agg(F.first("share"))
    return base.join(wide, [*by, "label"], "left").select(*by, "label", *(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in classes))


def count_error_detail(groundtruth: DataFrame, predictions: DataFrame, by: list[str], thresholds: list[float], include_unpredicted: bool = False) -> DataFrame:
    """``by..., image_id, confidence, n_pred, n_gt, error, rel_error`` for every group and image with predictions and every threshold.

    n_pred counts predictions of confidence at or above the threshold. rel_error is infinite for
    predictions without ground truth and null for neither. ``include_unpredicted`` adds the groups
    and images with ground truth only.
    """
    keys = [*by, "image_id"]
    # thresholds are few: every prediction adds to a small array of counts, so no row is multiplied before the aggregation
    counts = predictions.groupBy(*keys).agg(*(F.count_if(F.col("confidence") >= float(t)).alias(f"t{i}") for i, t in enumerate(thresholds)))
    truth = groundtruth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    how = "full_outer" if include_unpredicted else "left"
    joined = counts.join(truth, keys, how)
    each = F.array(*(F.struct(F.lit(float(t)).alias("confidence"), F.coalesce(f"t{i}", F.lit(0)).alias("n_pred")) for i, t in enumerate(thresholds)))
    flat = joined.select(*keys, F.coalesce("n_gt", F.lit(0)).alias("n_gt"), F.inline(each)).withColumn("error", F.col("n_pred") - F.col("n_gt"))
    rel = F.when(F.col("n_gt") > 0, F.col("error") / F.col("n_gt")).when(F.col("error") > 0, F.lit(float("inf")))
    return flat.select(*keys, "confidence", "n_pred", "n_gt", "error", rel.alias("rel_error"))


def count_error(detail: DataFrame, by: list[str], quantiles: list[float] = [0.25, 0.5, 0.75]) -> DataFrame:  # noqa: B006
    """Per group and threshold: mean absolute and root mean square error, deviation and quantiles, absolute and relative."""

    def stats(x: Column, prefix: str, names: tuple[str, str]) -> list[Column]:
        return [F.avg(F.abs(x)).alias(f"{prefix}_{names[0]}"), F.sqrt(F.avg(x * x)).alias(f"{prefix}_{names[1]}"), F.stddev_samp(x).alias(f"{prefix}_std"), *(F.percentile(x, F.lit(q)).alias(f"{prefix}_q{q}") for q in quantiles)]

    e, r = F.col("error").cast("double"), F.col("rel_error")
    return detail.groupBy(*by, "confidence").agg(*stats(e, "absolute", ("MAE", "RMSE")), *stats(r, "relative", ("MRE", "RMSRE")))
