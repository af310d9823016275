import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.evaluator import Evaluator
from framewright.functions.groups import ContinuousGroup, bin_edges
from framewright.functions.presets import load_preset
from framewright.model import Dataset
from framewright.operators import append, histograms, labels, onehot, quality, reindex, setops, splitting
from framewright.operators.matching import greedy_match
from framewright.streaming.watch import watch, windowed_counts
from framewright.synthetic import as_predictions, dummy_dataset


@pytest.fixture(scope="module")
def ds(spark):
    return dummy_dataset(spark, 12, 60, split_names=["train", "valid"], confidence=False)


def test_build_checks(spark):
    images = spark.createDataFrame([(1, 10, 10, "a/b.jpg")], "id bigint, width int, height int, relative_path string")
    ann = spark.createDataFrame([(0, 2, 7, 0.0, 0.0, 1.0, 1.0)], "id bigint, image_id bigint, category_id int, box_x_min double, box_y_min double, box_width double, box_height double")
    with pytest.raises(ValueError, match="unknown images"):
        Dataset.build(images, ann, validate=True)
    with pytest.raises(ValueError, match="not unique"):
        Dataset.build(images.union(images), None, validate=True)
    twice = ann.withColumn("image_id", F.lit(1).cast("bigint"))
    with pytest.warns(UserWarning):
        fixed = Dataset.build(images, twice.union(twice), validate=True)
    assert sorted(r["id"] for r in fixed.annotations.collect()) == [0, 1]
    assert fixed.images.first()["type"] == ".jpg" and fixed.annotations.first()["category_str"] == "7"
    assert not Dataset.build(images.limit(0))


def test_filters(ds):
    assert len(ds[0]) == 1 and len(ds[-2:]) == 2 and len(ds[::5]) == 3
    frame, notes = ds.get_one_frame(3)
    assert frame["id"] == 3 and {r["image_id"] for r in notes.collect()} <= {3}
    seen = list(ds.iter_images())
    assert [r["id"] for r, _ in seen] == list(range(12)) and sum(len(a) for _, a in seen) == 60
    assert sum(len(p) for _, p in ds.iter_splits()) == 12
    moved = ds.with_(images_root="/data/x").reset_images_root("/data/y")
    assert moved.images.first()["relative_path"].startswith("../x/image_")


def test_merge_properties(ds):
    a, b = ds.filter_images("id % 2 = 0"), ds.filter_images("id % 2 = 1")
    quality.assert_datasets_equal(setops.merge(a, b), ds)
    quality.assert_datasets_equal(setops.merge(b, a), ds)
    with pytest.raises(ValueError):
        setops.merge(a, a, allow_overlapping_image_ids=False)
    both = setops.merge(a, a)
    assert len(both) == len(a) and both.len_annot() == 2 * a.len_annot()
    with pytest.raises(AssertionError):
        setops.merge(a, a.with_(images=a.images.withColumn("width", F.col("width") + 1)))
    only_l, only_r, common = setops.diff(ds, a)
    assert len(only_r) == 0
    quality.assert_datasets_equal(setops.merge(only_l, common), ds)
    assert len(setops.diff(ds, ds)[2]) == len(ds)


def test_labels(ds):
    with pytest.raises(labels.IncompatibleLabelMapsError):
        labels.merge_label_maps({1: "a"}, {1: "b"})
    assert labels.merge_label_maps({1: "a"}, {1: "a", 2: "b"}, "inner") == {1: "a"}
    assert labels.lowest_free_id({1, 2, 4}) == 3 and labels.lowest_free_id({2, 3}) == 4
    assert labels.mapping_to_names({0: "x", 1: "y"}, {0: "y"})[0] == {1: 0, 0: 1}
    swapped = labels.remap_classes(ds, {0: 1, 1: 0})
    assert swapped.label_map == {0: "car", 1: "person"}
    voc, names = load_preset("coco", "pascalvoc")
    assert len(voc) == 20 and names[15] == "person" and load_preset("pascalvoc", "coco")[0][15] == 1
    assert len(load_preset("coco", "supercategory")[0]) == 91
    with pytest.raises(ValueError):
        load_preset("supercategory", "coco")


def test_tables_that_are_too_long_raise(spark, ds):
    table = spark.range(100_001).select(F.col("id").alias("input_category_id"), F.lit(1).alias("output_category_id"), F.lit("x").alias("output_category_name"))
    with pytest.raises(ValueError, match="remap table"):
        labels.remap_from_table(ds, table)


def test_reindex(ds):
    out = reindex.reset_index(ds.filter_images("id >= 4"), 100, 500)
    assert sorted(r["id"] for r in out.images.collect()) == list(range(100, 108))
    assert out.annotations.join(out.images.select(F.col("id").alias("i")), F.col("image_id") == F.col("i"), "left_anti").isEmpty()
    with pytest.raises(ValueError):
        reindex.match_index(ds, ds.images.withColumn("type", F.lit("x")), on="type")


def test_onehot(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [None, "b"])], "id int, tags array<string>")
    wide, made = onehot.booleanize(df, {"tags": None})
    assert made == {"tags": ("a", "b")}
    assert sorted(tuple(r) for r in wide.collect()) == [(1, True, True), (2, False, False), (3, False, True)]
    assert sorted(tuple(r) for r in onehot.debooleanize(wide, made).collect()) == [(1, ["a", "b"]), (2, []), (3, ["b"])]
    with pytest.raises(TypeError):
        onehot.booleanize(df, {"id": None})


def test_append(ds):
    with append.AnnotationAppender(ds) as a:
        a.append(0, [1, 2, 3, 4], 1)
        a.append([1, 2], [[1, 2, 3, 4], [5, 6, 7, 8]], 2)
    assert a.dataset.len_annot() == 63
    points = append.add_annotations(ds, [0, 1], [[1, 2], [3, 4]], 0, "XY")
    assert points.annotations.filter("box_width = 0").count() == 2
    with pytest.raises(ValueError):
        append.add_annotations(ds, 999, [1, 2, 3, 4], 0)
    with pytest.raises(ValueError):
        append.spread([0, 1], [1, 2, 3, 4], 0, [0.5])


def test_distances():
    assert histograms.share_distance(np.arange(10), np.arange(10)[::-1]) == pytest.approx(5 / 7)
    # two bins with 20 and 1 of 21 rows against the same, halved and doubled
    left = np.array([20 / 21, 1 / 21])
    assert histograms.earth_mover(left, left, [0, 1], [1], 1e-2) == pytest.approx(0, abs=1e-6)
    right = left * [0.5, 2]
    assert histograms.earth_mover(left, right, [0, 1], [1]) == pytest.approx(abs(left[0] - right[0] / right.sum()))
    assert histograms.earth_mover(left, right, [0, 1], [1], 1e-2) == pytest.approx(histograms.earth_mover(left, right, [0, 1], [1]), abs=1e-3)
    rng = np.random.default_rng(0)
    p, q = rng.random(7), rng.random(7)
    x = np.sort(rng.random(7))
    cum = np.abs(np.cumsum(p / p.sum()) - np.cumsum(q / q.sum()))[:-1]
    assert histograms.earth_mover(p, q, x, [1]) == pytest.approx((cum * np.diff(x)).sum() / (x[-1] - x[0]))
    cells = [("a", 0.0), ("a", 1.0), ("b", 0.0)]
    assert histograms.histogram_distance(p[:3], p[:3], cells, ["c", "x"], {"c": 1}, {"x": 1}) == pytest.approx(0, abs=1e-9)
    assert math.isinf(histograms.histogram_distance(p[:3], np.array([1, 1, 0]), cells, ["c", "x"], {"c": 1}, {"x": 1}))


def test_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    assert bin_edges(df, ContinuousGroup("v", 2)) == pytest.approx([-0.01, 5, 10])
    with pytest.raises(ValueError):
        bin_edges(spark.createDataFrame([(-1.0,)], "v double"), ContinuousGroup("v", 2, log=True))


def test_interval_names_and_quantiles(spark):
    import pandas as pd

    from framewright.functions.groups import cut_group, exact_quantiles, grouped_quantiles, label_edges

    rng = np.random.default_rng(0)
    for values in (rng.random(50) * 1000, rng.random(50), rng.random(50) / 1000, rng.normal(size=60) * 3.7):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        want = sorted(set(pd.cut(pd.Series(values), 7)), key=lambda x: x.left)
        got = sorted({(r["v"]["left"], r["v"]["right"]) for r in cut_group(df, ContinuousGroup("v", 7)).collect()})
        assert [(pytest.approx(x.left), pytest.approx(x.right)) for x in want] == got
        shares = [0, 0.1, 0.25, 0.5, 0.77, 1]
        assert exact_quantiles(df.withColumn("v", F.round("v", 1)), "v", shares) == pytest.approx(np.quantile(values.round(1), shares))
    assert label_edges([0.12344, 0.12347, 7.0]) == [0.1234, 0.1235, 7.0]
    same = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double")
    with pytest.raises(ValueError, match="equal"):
        bin_edges(same, ContinuousGroup("v", 4, qcut=True))
    assert exact_quantiles(same.limit(0), "v", [0.5]) == []
    data = [(None if i % 11 == 0 else i % 3, None if i % 7 == 0 else float(rng.integers(0, 40))) for i in range(400)]
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in grouped_quantiles(spark.createDataFrame(data, "g int, v double"), "g", "v", [0.0, 0.3, 0.5]).collect()}
    assert got == {g: tuple(pytest.approx(x) for x in np.quantile([v for k, v in data if k == g and v is not None], [0, 0.3, 0.5])) for g in (None, 0, 1, 2)}


def test_sum_and_difference(ds):
    both = sum([ds.filter_images("id < 4"), ds.filter_images("id >= 4")])
    assert len(both) == 12 and both.len_annot() == ds.len_annot()
    assert len(ds - ds) == 0 and sorted(r["id"] for r in (ds - ds.filter_images("id < 4")).images.collect()) == list(range(4, 12))


def test_anchors_of_distances():
    """Known values: two bins, the right side times (0.5, 2)."""
    left, at = np.array([7.0, 15.0]), np.array([[0.0], [1.0]])
    exact = histograms.earth_mover(left, left * [0.5, 2], at, [1.0])
    soft = histograms.earth_mover(left, left * [0.5, 2], at, [1.0], sinkhorn=1e-2)
    share = left / left.sum() - left * [0.5, 2] / (left * [0.5, 2]).sum()
    assert exact == pytest.approx(abs(share[0])) and soft == pytest.approx(exact, abs=1e-3)


def test_chunks_and_splits(spark, ds):
    df = spark.createDataFrame([(0, 1, 1, None), (1, 1, 2, "valid"), (2, 2, 2, None), (3, 3, 3, "train"), (4, 3, 4, "valid"), (5, None, None, None)], "id bigint, a int, b int, split string")
    got = {r["id"]: (r["chunk"], r["wanted"]) for r in splitting.atomic_chunks(df, ["a", "b"], "split", ["train", "valid"]).collect()}
    assert got == {0: (0, "valid"), 1: (0, "valid"), 2: (0, "valid"), 3: (3, None), 4: (3, None), 5: (5, None)}
    with pytest.raises(ValueError):
        splitting.check_target(["a", "b"], [0.5, 0.6])
    plain = splitting.simple_split(spark.range(20000), ["train", "valid"], [0.7, 0.3])
    assert plain.filter("split = 'train'").count() / 20000 == pytest.approx(0.7, abs=0.01)
    bare = Dataset.build(ds.images.drop("split"), ds.annotations.drop("split"), ds.label_map)
    out = splitting.split_dataset(bare, ["train", "valid"], [0.5, 0.5], keep_balanced=["category_id"])
    assert len(out) == 12 and {r[0] for r in out.images.select("split").distinct().collect()} == {"train", "valid"}


def test_split_dataset_keeps_groups_of_images_without_annotations(spark, monkeypatch):
    images = spark.createDataFrame([(i, 10, 10, f"{i}.jpg", f"s{i % 20}", "valid" if i == 3 else None) for i in range(80)], "id bigint, width int, height int, relative_path string, source string, split string")
    notes = spark.createDataFrame([(i, i * 2 % 80, i % 3, 1.0, 1.0, float(i % 7), 2.0, f"t{i}" if i < 196 else "same") for i in range(200)], "id bigint, image_id bigint, category_id int, box_x_min double, box_y_min double, box_width double, box_height double, track string")
    ds = Dataset.build(images, notes, {0: "a", 1: "b", 2: "c"})
    for profiles in (1000, 2):
        monkeypatch.setattr(splitting, "MAX_PROFILES", profiles)
        out = splitting.split_dataset(ds, ["train", "valid"], [0.8, 0.2], ["source", "track"], ["category_id", ContinuousGroup("box_width", (-1.0, 3.0, 7.0), label_type="mid")], weights=[1, 2])
        at = {r["id"]: (r["source"], r["split"]) for r in out.images.collect()}
        assert len(set(at.values())) == 20 and at[3][1] == "valid" and {x[1] for x in at.values()} == {"train", "valid"}
        assert len({at[i * 2 % 80][1] for i in range(196, 200)}) == 1
        assert sum(x[1] == "train" for x in at.values()) / 80 == pytest.approx(0.8, abs=0.11)
    empty = splitting.split_dataset(Dataset.build(images.limit(0), notes.limit(0)), ["train", "valid"], [0.8, 0.2], ["source"], ["category_id"])
    assert len(empty) == 0


def test_hot_values_are_joined_apart(spark, rows, monkeypatch):
    from framewright.operators import components

    df = spark.createDataFrame([(i, "hot" if i % 2 else f"v{i // 6}") for i in range(300)] + [(999, None)], "id bigint, v string")
    want = rows(components.value_edges(df, "v"))
    monkeypatch.setattr(components, "HOT_ROWS", 10)
    assert rows(components.value_edges(df, "v")) == want and len(want) == 300
    star = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(199, 300)], "src bigint, dst bigint")
    assert {r["component"] for r in components.connected_components(star).collect()} == {0}


def greedy_by_hand(g, p, min_iou):
    def iou(a, b):
        w = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        h = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        u = a[4] * a[5] + b[4] * b[5] - w * h
        return w * h / u if u else 0
    used, out = set(), set()
    for x in sorted(p, key=lambda r: (-r[6], r[0])):
        best = max(((iou(x, y), -y[0]) for y in g if y[1] == x[1] and y[7] == x[7] and y[0] not in used and iou(x, y) > min_iou), default=None)
        if best:
            used.add(-best[1])
            out.add((x[0], -best[1]))
    return out


@pytest.mark.parametrize("split_pairs", [200_000, 10])
def test_matching(spark, ds, monkeypatch, split_pairs):
    from framewright.operators import matching

    monkeypatch.setattr(matching, "SPLIT_PAIRS", split_pairs)
    monkeypatch.setattr(matching, "GRID_PAIRS", 4 if split_pairs == 10 else 50_000)
    pred = as_predictions(ds, jitter=0.6)
    if split_pairs == 10:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # groups go over many batches
    got = {(r[0], r[2]) for r in greedy_match(ds.annotations, pred, 0.1).collect() if r[0] is not None and r[2] is not None}
    cols = ["id", "image_id", "box_x_min", "box_y_min", "box_width", "box_height"]
    g = [(*[r[c] for c in cols], 0, r["category_id"]) for r in ds.annotations.collect()]
    p = [(*[r[c] for c in cols], r["confidence"], r["category_id"]) for r in pred.collect()]
    assert got == greedy_by_hand(g, p, 0.1)
    every = matching.matched_rows(ds.annotations, pred, ["category_id", "box_width"], 0.1, carried={"theirs": "box_width", "who": "id"}).collect()
    theirs = {r["id"]: r["box_width"] for r in pred.collect()}
    assert all((r["who"], r["theirs"]) == ((r["prediction_id"], theirs[r["prediction_id"]]) if r["is_gt"] and r["prediction_id"] is not None else (None, None)) for r in every)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["groundtruth_id"] for r in every if r["is_gt"]) == sorted(x[0] for x in g)
    assert sorted(r["prediction_id"] for r in every if r["prediction_id"] is not None) == sorted(x[0] for x in p)
    width, sure = {x[0]: x[4] for x in g}, {x[0]: x[6] for x in p}
    assert all(r["box_width"] == width[r["groundtruth_id"]] for r in every if r["is_gt"]) and all(r["confidence"] == sure[r["prediction_id"]] for r in every if r["prediction_id"] is not None)
    lost = pred.limit(3).withColumn("image_id", F.lit(None).cast("bigint"))
    alone = matching.matched_rows(ds.annotations.limit(0), lost).collect()
    assert len(alone) == lost.count() and all(r["groundtruth_id"] is None and r["iou"] == 0 for r in alone)


@pytest.mark.parametrize("tile_boxes", [8_000, 25])
def test_matching_of_a_crowd_by_tiles(spark, monkeypatch, tile_boxes):
    """One image of boxes that all hang together is settled without its pairs or components going through Spark."""
    import random

    from framewright.operators import matching

    monkeypatch.setattr(matching, "GRID_PAIRS", 100)
    monkeypatch.setattr(matching, "SPLIT_PAIRS", 100)
    monkeypatch.setattr(matching, "TILE_BOXES", tile_boxes)
    monkeypatch.setattr(matching, "connected_components", lambda *_: pytest.fail("one component of the whole image"))
    rand = random.Random(3)
    side = [[(1000 * s + i, i % 2, rand.randint(0, 180), rand.randint(0, 90), *((190, 80) if i == 7 else (rand.randint(-1, 25), rand.randint(0, 25))), rand.randint(0, 9) / 10, 0) for i in range(240)] for s in (1, 2)]
    shape = "id bigint, image_id bigint, box_x_min double, box_y_min double, box_width double, box_height double, confidence double, category_id int"
    g, p = (spark.createDataFrame([(*r[:2], *map(float, r[2:7]), r[7]) for r in rows], shape) for rows in side)
    nowhere = spark.createDataFrame([(5000, 1, None, 1.0, 1.0, 1.0, 0.5, 0)], shape)
    for min_iou in (0.0, 0.2):
        got = matching.matched_rows(g, p.unionByName(nowhere), ["category_id"], min_iou, True, {"who": "id"}).collect()
        assert {(r["prediction_id"], r["groundtruth_id"]) for r in got if r["is_gt"] and r["prediction_id"] is not None} == greedy_by_hand(*side, min_iou)
        assert all(r["who"] == (r["prediction_id"] if r["is_gt"] else None) for r in got)
        assert sorted(r["groundtruth_id"] for r in got if r["is_gt"]) == [x[0] for x in side[0]]
        assert sorted(r["prediction_id"] for r in got if r["prediction_id"] is not None) == [*(x[0] for x in side[1]), 5000]


def test_groups_are_matched_where_they_lie(spark, ds, monkeypatch):
    """Ordinary groups are settled in one shuffle of boxes; their pairs never go through Spark. Odd coordinates still do."""
    from framewright.operators import matching

    pairs, cols = matching._pairs, ["id", "image_id", "box_x_min", "box_y_min", "box_width", "box_height"]
    monkeypatch.setattr(matching, "_pairs", lambda *_: pytest.fail("pairs of ordinary groups are shuffled"))
    pred = as_predictions(ds, jitter=0.6)
    g = [(*[r[c] for c in cols], 0, r["category_id"]) for r in ds.annotations.collect()]
    p = [(*[r[c] for c in cols], r["confidence"], r["category_id"]) for r in pred.collect()]
    found = lambda df: {(r[0], r[2]) for r in df.collect() if r[0] is not None and r[2] is not None}
    want = greedy_by_hand(g, p, 0.1)
    try:
        for rows in (3, 10_000):  # groups go over many batches, and many groups into one
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert found(greedy_match(ds.annotations, pred, 0.1)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(matching, "GROUP_BOXES", 1)
    assert found(greedy_match(ds.annotations, pred, 0.1)) == want
    monkeypatch.setattr(matching, "_pairs", pairs)
    one = ds.annotations.limit(1).withColumns({"id": F.lit(10**6), "box_x_min": F.lit(float("-inf")), "box_width": F.lit(float("inf"))})
    odd = greedy_match(ds.annotations.unionByName(one), pred, 0.1).collect()
    assert {(r[0], r[2]) for r in odd if r[0] is not None and r[2] is not None} == want and len([r for r in odd if r[2] == 10**6 and r[0] is None]) == 1


def test_sides_of_kept_matches_are_made_once(spark):
    """The lookups after matching read the tables that matching read, not the given ones again."""
    from framewright.plans import evaluation_queries

    d = "/root/testdata/sf0.001"
    out = evaluation_queries.confusion_matrix_of_matches(spark, d)
    assert out.inputFiles() and not [f for f in out.inputFiles() if d in f]


def test_confusion_by_split_shuffles_no_pairs(spark, monkeypatch):
    from framewright.operators import matching
    from framewright.plans import evaluation_queries

    monkeypatch.setattr(matching, "_pairs", lambda *_: pytest.fail("pairs are shuffled"))
    cells = evaluation_queries.confusion_by_split(spark, "/root/testdata/sf0.001").collect()
    assert cells and len({r["split"] for r in cells}) > 1


def test_confusion_by_split_joins_and_writes_no_boxes(spark, monkeypatch):
    """Boxes meet their images in the shuffle they are matched in, and counts leave it."""
    from framewright.plans import evaluation_queries

    monkeypatch.setattr(evaluation_queries, "matched_rows", lambda *_, **__: pytest.fail("boxes are joined and written before they are matched"))
    cells = evaluation_queries.confusion_by_split(spark, "/root/testdata/sf0.001").collect()
    assert cells and all(r["n"] > 0 for r in cells)


@pytest.mark.parametrize(("grid_pairs", "tile_boxes", "odd"), [(50_000, 8_000, False), (100, 25, False), (0, 8_000, True)])
def test_confusion_counts(spark, monkeypatch, grid_pairs, tile_boxes, odd):
    """As the rows of matching counted one by one: ordinary images, crowds in tiles, odd and null coordinates, images there are not."""
    import random
    from collections import Counter

    from framewright.operators import confusion, curves, matching

    monkeypatch.setattr(matching, "GRID_PAIRS", grid_pairs)
    monkeypatch.setattr(matching, "TILE_BOXES", tile_boxes)
    monkeypatch.setattr(matching, "ROUND_PAIRS", 3)
    monkeypatch.setattr(confusion, "HELD_ROWS", 5)
    rand = random.Random(5)
    box = lambda: (rand.randint(0, 180) / 1, rand.randint(0, 90) / 1, rand.randint(-1, 25) / 1, rand.randint(0, 25) / 1)
    side = [[(1000 * s + i, rand.choice([0, 1, 1, 1, 2, 3, None]), *(box() if i % 29 else (None, 1.0, 1.0, 1.0)), rand.choice([None, *range(10)]) if i % 31 == 0 else rand.randint(0, 9) / 10, i % 3) for i in range(400)] for s in (1, 2)]
    shape = "id bigint, image_id bigint, box_x_min double, box_y_min double, box_width double, box_height double, confidence double, category_id int"
    g, p = (spark.createDataFrame([(*r[:6], None if r[6] is None else float(r[6]), r[7]) for r in rows], shape) for rows in side)
    if odd:
        g = g.unionByName(spark.createDataFrame([(5000, 1, float("-inf"), 1.0, float("inf"), 1.0, None, 1)], shape))
    images = spark.createDataFrame([(0, "train"), (1, "valid"), (2, None), (9, "train")], "id bigint, split string")
    got = Counter({tuple(r)[:3]: r["n"] for r in confusion.confusion_counts(g, p, images, 0.1, 0.3, ["split"]).collect()})
    here = [df.join(images.withColumnRenamed("id", "i"), F.col("image_id") == F.col("i")).withColumn("category_str", F.col("category_id").cast("string")) for df in (g, p)]
    want = curves.confused_rows(matching.matched_rows(*here, ["category_str", "split"], 0.0, True, {"predicted": "category_str"}), 0.1, 0.3, ["split"])
    number = lambda x: None if x == "None" else int(x)
    assert got == Counter((r[0], number(r[1]), number(r[2])) for r in want.collect())
    assert len({k[0] for k in got}) == 3
    if not odd:  # all groups under one sorting key
        monkeypatch.setattr(confusion.F, "xxhash64", lambda *_: F.lit(7).cast("bigint"))
        assert got == Counter({tuple(r)[:3]: r["n"] for r in confusion.confusion_counts(g, p, images, 0.1, 0.3, ["split"]).collect()})


def test_boxes_meet_by_strips():
    """As all pairs of boxes compared: with negative, zero, huge and missing sizes, ties, and each pair once; liked in lexsort's order."""
    from framewright.operators.matching import _by_liking, _meeting, _overlapping

    rng = np.random.default_rng(2)
    for t in range(300):
        n = int(rng.integers(0, 60))
        box = np.stack([rng.integers(-50, 150, n), rng.integers(-5, 90, n), rng.integers(-3, 25, n), rng.integers(-3, 25, n)]) + (rng.random((4, n)) if t % 3 == 0 else 0.0)
        box[3] *= rng.choice([0, 0.01, 1, 4] if t % 2 else [1], n)
        box *= [1, 1e-3, 1e15, 1e306][t % 4]
        if n and t % 5 == 0:
            box[:, rng.integers(0, n)] = np.nan
        order = rng.permutation(n)
        p, g = order[: n // 2], order[n // 2 :]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(p)), np.arange(len(g)), indexing="ij"))
        with np.errstate(all="ignore"):
            want, (i, j, overlap) = _overlapping(box, p, g, i, j, 0.1), _meeting(box, p, g, 0.1)
        assert sorted(zip(*(x.tolist() for x in want))) == sorted(zip(i.tolist(), j.tolist(), overlap.tolist()))
        overlap = np.round(overlap, 1)
        assert (_by_liking(i, overlap, g[j]) == np.lexsort((g[j], -overlap, i))).all()


def test_evaluator(spark, ds, tmp_path):
    ev = Evaluator(ds)
    ev.add_predictions("same", ds.annotations.withColumn("confidence", F.lit(0.9)))
    pr, ap = ev.compute_precision_recall(ious=[0.5], groups=["category_id"])
    # the closing point (precision 0, recall 1) is the last one at recall 1, so the last step of the grid adds nothing
    assert all(r["AP"] == pytest.approx(0.99) for r in ap.collect()) and "category_str" in ap.columns
    cm = ev.compute_confusion_matrix()
    assert all(r[r["label"]] == 1.0 for r in cm.collect())
    err, detail = ev.compute_count_error(thresholds=[0.5])
    assert all(r["absolute_MAE"] == 0 for r in err.collect())
    with pytest.raises(ValueError):
        ev.add_predictions("none", ds.annotations)
    ev.to_parquet(str(tmp_path / "e"))
    back = Evaluator.from_parquet(spark, str(tmp_path / "e"))
    assert set(back._matches) == set(ev._matches)
    ev.compute_precision_recall(groups=[ContinuousGroup("box_width", 2, label_type="mid")])[1].collect()
    ev.release()


def test_watch_sees_added_changed_and_deleted_files(spark, tmp_path):
    import json

    from framewright.sources import readers

    root = tmp_path / "data"
    (root / "Annotations/train").mkdir(parents=True)
    (root / "Annotations/valid").mkdir()

    def put(i, width=10.0, split="train"):
        doc = {"image": {"id": i, "file_name": f"{i}.jpg", "width": 100, "height": 50}, "type": "instances", "annotations": [{"id": 10 * i + k, "bbox": [1.0, 1.0, width + k, 5.0], "category_id": 1, "category_str": "a"} for k in range(2)]}
        (root / f"Annotations/{split}/{i}.json").write_text(json.dumps(doc))

    seen, asked = [], []

    def read(files):
        asked.append(None if files is None else sorted(f.rsplit("/", 1)[1] for f in files))
        return readers.from_image_json(spark, str(root), files=files)

    def push(new, gone):
        seen.append((sorted(r["id"] for r in new.images.collect()), sorted(r["id"] for r in gone.images.collect()), new.len_annot(), gone.len_annot()))

    put(1), put(2), put(7, split="valid")
    w = watch(spark, str(root / "Annotations"), read, push, str(tmp_path / "state"), once=True)
    assert seen == [([1, 2, 7], [], 6, 0)] and asked == [None]
    w.processAllAvailable()
    assert len(seen) == 1
    put(3)
    w.processAllAvailable()
    put(1, width=20.0), put(4)
    w.processAllAvailable()
    os.remove(root / "Annotations/train/2.json")
    w.processAllAvailable()
    assert seen[1:] == [([3], [], 2, 0), ([1, 4], [1], 4, 2), ([], [2], 0, 2)]
    assert asked == [None, ["3.json"], ["1.json", "4.json"]]
    # a later process goes on where this one stopped; the stream looks by itself
    put(1, width=30.0)
    os.remove(root / "Annotations/valid/7.json")
    q = watch(spark, str(root / "Annotations"), read, push, str(tmp_path / "state"), cooldown="1 second")
    assert seen[-1] == ([1], [1, 7], 2, 4) and asked[-1] == ["1.json"]
    os.remove(root / "Annotations/train/4.json")
    for _ in range(60):
        time.sleep(0.5)
        if seen[-1] == ([], [4], 0, 2):
            break
    assert q.exception() is None and q.isActive
    q.stop()
    assert seen[-1] == ([], [4], 0, 2)


def test_windows(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 01:10:00", "a")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in windowed_counts(events).collect()) == [1, 2]
