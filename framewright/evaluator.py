"""Evaluation of named predictions against one ground truth."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.groups import Group, group_name, with_groups
from framewright.model import Dataset
from framewright.operators import curves
from framewright.operators.labels import merge_label_maps
from framewright.operators.matching import greedy_match
from framewright.operators.quality import assert_frame_intersections_equal
from framewright.sources.writers import dict_from_parquet, dict_to_parquet, sample_documents


class Evaluator:
    """Ground truth and predictions by name; matches are made once per (model, classes, threshold) and kept."""

    def __init__(self, groundtruth: Dataset, **predictions: Dataset) -> None:
        self.images, self.groundtruth, self.label_map = groundtruth.images, groundtruth.annotations, dict(groundtruth.label_map)
        self.dataset_name, self.images_root = groundtruth.dataset_name, groundtruth.images_root
        self.predictions: dict[str, DataFrame] = {}
        self._matches: dict[tuple[str, bool, float], DataFrame] = {}
        for name, ds in predictions.items():
            self.add_predictions_dataset(name, ds)

    def add_predictions_dataset(self, name: str, ds: Dataset) -> None:
        """Labels are merged, images must be known and agree with the ground truth's."""
        merged = merge_label_maps(self.label_map, ds.label_map)
        if merged != self.label_map:
            warnings.warn(f"{name} has labels that the ground truth lacks", stacklevel=2)
        if not ds.images.join(self.images, "id", "left_anti").isEmpty():
            raise ValueError(f"{name} has images that the ground truth lacks")
        cols = ["id", "width", "height", "relative_path"]
        assert_frame_intersections_equal(self.images.select(*cols), ds.images.select(*cols))
        self.label_map = merged
        self.add_predictions(name, ds.annotations)

    def add_predictions(self, name: str, annotations: DataFrame) -> None:
        if "confidence" not in annotations.columns:
            raise ValueError("predictions have no confidence")
        self.predictions[name] = annotations

    def image_attributes(self) -> list[str]:
        return [c for c in self.images.columns if c not in ("id", "width", "height", "relative_path", "type", "split")]

    def annotation_attributes(self, name: str | None = None) -> list[str]:
        df = self.groundtruth if name is None else self.predictions[name]
        return [c for c in df.columns if c not in ("id", "image_id", "category_id", "category_str", "split") and not c.startswith("box_")]

    def _names(self, names: list[str] | str | None) -> list[str]:
        return list(self.predictions) if names is None else [names] if isinstance(names, str) else list(names)

    def compute_matches(self, names: list[str] | str | None = None, min_iou: float = 0.0, category_agnostic: bool = False) -> dict[str, DataFrame]:
        out = {}
        for n in self._names(names):
            key = (n, category_agnostic, min_iou)
            if key not in self._matches:
                self._matches[key] = greedy_match(self.groundtruth, self.predictions[n], min_iou, category_agnostic).persist()
            out[n] = self._matches[key]
        return out

    def release(self) -> None:
        """Forget the kept matches."""
        for df in self._matches.values():
            df.unpersist()
        self._matches = {}

    def _grouped(self, name: str, groups: list[Group]) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides with the group columns; bins have common edges, and are named by their middle."""
        by = [group_name(g) for g in groups]
        both = self.groundtruth.withColumn("__gt", F.lit(True)).unionByName(self.predictions[name].withColumn("__gt", F.lit(False)), allowMissingColumns=True)
        both = with_groups(both, groups, self.images)
        return both.filter("__gt").drop("__gt"), both.filter("not __gt").drop("__gt"), by

    def compute_precision_recall(self, names: list[str] | str | None = None, groups: list[Group] = ["category_id"], ious: list[float] = [0.0], index_column: str | None = "recall", index_values: list[float] | None = None, f_scores_betas: list[float] = [1]) -> tuple[DataFrame, DataFrame]:  # noqa: B006
        """(curves, average precisions), both with ``model``; with ``category_str`` where grouped by category."""
        pr, ap = None, None
        for n, m in self.compute_matches(names).items():
            g, p, by = self._grouped(n, groups)
            rows = curves.detections(m, g, p, by)
            one = curves.precision_recall(rows, by, ious, f_scores_betas, index_column, index_values)
            area = curves.average_precision(one, by)
            one, area = one.withColumn("model", F.lit(n)), area.withColumn("model", F.lit(n))
            pr, ap = (one, area) if pr is None else (pr.unionByName(one), ap.unionByName(area))
        if "category_id" in [group_name(g) for g in groups]:
            labels = self.images.sparkSession.createDataFrame(sorted(self.label_map.items()), "category_id int, category_str string")
            pr, ap = (x.join(F.broadcast(labels), "category_id", "left") for x in (pr, ap))
        return pr, ap

    def compute_confusion_matrix(self, names: list[str] | str | None = None, groups: list[Group] = [], min_iou: float = 0.0, min_confidence: float = 0.0) -> DataFrame:  # noqa: B006
        out = None
        for n, m in self.compute_matches(names, category_agnostic=True).items():
            g, p, by = self._grouped(n, groups)
            one = curves.confusion_matrix(curves.confusion_pairs(m, g, p, min_iou, min_confidence, by), by).withColumn("model", F.lit(n))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def compute_count_error(self, names: list[str] | str | None = None, groups: list[Group] = ["category_id"], thresholds: list[float] | None = None, quantiles: list[float] = [0.25, 0.5, 0.75]) -> tuple[DataFrame, DataFrame]:  # noqa: B006
        """(errors per group and threshold, detail per image), with ``model``."""
        thresholds = [i / 20 for i in range(21)] if thresholds is None else thresholds
        err, det = None, None
        for n in self._names(names):
            g, p, by = self._grouped(n, groups)
            d = curves.count_error_detail(g, p, by, thresholds)
            e = curves.count_error(d, by, quantiles).withColumn("model", F.lit(n))
            d = d.withColumn("model", F.lit(n))
            err, det = (e, d) if err is None else (err.unionByName(e), det.unionByName(d))
        return err, det

    def documents(self) -> DataFrame:
        """Viewer documents with ground truth and every model's predictions."""
        return sample_documents(Dataset(self.images, self.groundtruth, self.label_map, self.images_root, self.dataset_name), self.predictions)

    def to_parquet(self, folder: str, overwrite: bool = False) -> None:
        matches = {n: {f"{'any' if a else 'own'}_{i}": df for (m, a, i), df in self._matches.items() if m == n} for n in self.predictions}
        dict_to_parquet({"__name__": type(self).__name__, "dataset_name": self.dataset_name, "images_root": self.images_root, "label_map": dict(self.label_map), "images": self.images, "groundtruth": self.groundtruth, "predictions": dict(self.predictions), "matches": matches}, folder, overwrite)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Evaluator:
        x = dict_from_parquet(spark, folder)
        if x.get("__name__") != cls.__name__:
            raise ValueError(f"{folder} holds a {x.get('__name__')}")
        labels = {int(k): v for k, v in (x["label_map"] or {}).items()}
        out = cls(Dataset(x["images"], x["groundtruth"], labels, x["images_root"], x["dataset_name"]))
        for n, df in (x["predictions"] or {}).items():
            out.add_predictions(n, df)
        for n, kept in (x["matches"] or {}).items():
            for k, df in (kept or {}).items():
                kind, _, iou = k.partition("_")
                out._matches[n, kind == "any", float(iou)] = df
        return out
