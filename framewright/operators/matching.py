"""Predictions matched to ground truth by overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from framewright.functions.boxes import BOX, iou, overlaps
from framewright.operators.components import connected_components
from framewright.session import kept

#: Pairs (boxes of one side times the other) of an image and class beyond which a grid is laid over it.
GRID_PAIRS = 50_000
#: Overlapping pairs of an image and class beyond which it is matched by connected components.
SPLIT_PAIRS = 200_000
#: Cells along a side of the grid of a crowded image.
GRID = 64
#: Boxes of a group that a task holds at once; larger groups are matched by tiles.
GROUP_BOXES = 50_000
#: Boxes of both sides that a tile of a crowded group holds, about.
TILE_BOXES = 8_000
#: Tiles along an axis that a round before the first would have had.
FIRST_ROUND = 1 << 30
#: Pairs whose x ranges may meet that a tile holds at once, about.
TILE_PAIRS = 20_000_000
#: Pairs left of a batch of groups from which on they are taken one by one.
ROUND_PAIRS = 200
#: Crowded groups (about 60 bytes each) that are broadcast; they are counted first, and more are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def _named(df: DataFrame, prefix: str, extra: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in ("id", "image_id", "category_id", *BOX, *extra)))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table that was counted and is small enough."""
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df


def iou_pairs(groundtruth: DataFrame, predictions: DataFrame, min_iou: float = 0.0, category_agnostic: bool = False) -> DataFrame:
    """``(image_id, category_id, prediction_id, groundtruth_id, confidence, iou)`` of the pairs in one image (and class) with iou > ``min_iou``.

    Boxes meet by image (and class) and the overlap test. Where an image holds so many that all
    pairs would be too many, a grid is laid over it and boxes meet by cell; a pair is reported in
    the one cell that has its overlap's upper left corner. Boxes with null coordinates meet nothing.
    Each side is read once and kept as a written table of the columns needed.
    """
    g = kept(_named(groundtruth, "g_", []), "groundtruth")
    p = kept(_named(predictions, "p_", ["confidence"]), "predictions")
    return _pairs(g, p, min_iou, category_agnostic)


def _crowded(g: DataFrame, p: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than GRID_PAIRS pairs with the bounds of their ground truths."""
    ng = g.groupBy(*(F.col(f"g_{k}").alias(k) for k in keys)).agg(F.count(F.lit(1)).alias("ng"), *(F.min(f"g_{c}").alias(f"lo_{c}") for c in BOX[:2]), F.max(F.col("g_box_x_min") + F.col("g_box_width")).alias("hi_x"), F.max(F.col("g_box_y_min") + F.col("g_box_height")).alias("hi_y"))
    np_ = p.groupBy(*(F.col(f"p_{k}").alias(k) for k in keys)).agg(F.count(F.lit(1)).alias("np"))
    return kept(ng.join(np_, keys).filter(F.col("ng") * F.col("np") > GRID_PAIRS).drop("ng", "np"), "crowded")


def _pairs(g: DataFrame, p: DataFrame, min_iou: float, category_agnostic: bool) -> DataFrame:
    keys = ["image_id"] if category_agnostic else ["image_id", "category_id"]
    crowded = _crowded(g, p, keys)
    on = [F.col(f"g_{k}") == F.col(f"p_{k}") for k in keys]
    is_in = lambda df, s: [df[f"{s}_{k}"] == F.col(k) for k in keys]
    hit = overlaps("g_", "p_")
    many = crowded.count()
    plain = (g.join(small(crowded.select(*keys), many), is_in(g, "g"), "left_anti") if many else g).join(p, [*on, hit])
    cols = [*g.columns, *p.columns]
    both = plain.select(*cols)

    def cells(df: DataFrame, s: str) -> DataFrame:
        j = df.join(small(crowded, many), is_in(df, s))
        x, y, w, h = (F.col(f"{s}_{c}") for c in BOX)
        at = lambda v, lo, hi: F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor(F.coalesce(F.try_divide((v - F.col(lo)) * GRID, F.col(hi) - F.col(lo)), F.lit(0))))).cast("int")
        span = lambda v, size, lo, hi: F.sequence(at(v, lo, hi), F.greatest(at(v, lo, hi), at(v + size, lo, hi)))
        j = j.filter(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull())
        j = j.withColumn("cx", F.explode(span(x, w, "lo_box_x_min", "hi_x"))).withColumn("cy", F.explode(span(y, h, "lo_box_y_min", "hi_y")))
        first = F.struct(at(x, "lo_box_x_min", "hi_x").alias("x"), at(y, "lo_box_y_min", "hi_y").alias("y"))
        return j.select(*(c for c in df.columns), F.col("cx").alias(f"{s}_cx"), F.col("cy").alias(f"{s}_cy"), first.alias(f"{s}_first"))

    if many:
        corner = (F.col("g_cx") == F.greatest("g_first.x", "p_first.x")) & (F.col("g_cy") == F.greatest("g_first.y", "p_first.y"))
        grid = cells(g, "g").join(cells(p, "p"), [*on, F.col("g_cx") == F.col("p_cx"), F.col("g_cy") == F.col("p_cy"), hit, corner])
        both = both.unionByName(grid.select(*cols))
    met = both.withColumn("iou", iou("g_", "p_")).filter(F.col("iou") > min_iou)
    carried = [c for c in p.columns if c.startswith("m")]
    return met.select(F.col("p_image_id").alias("image_id"), F.col("p_category_id").alias("category_id"), F.col("p_id").alias("prediction_id"), F.col("g_id").alias("groundtruth_id"), F.col("p_confidence").alias("confidence"), "iou", *carried)


_PAIR, _PREDICTION, _TRUTH = 0, 1, 2


def first_free(prediction: np.ndarray, truth: np.ndarray, used: set[int], done: int | None) -> list[int]:
    """Places of the hits of pairs in order: every prediction takes the first ground truth that is not used; ``done`` has one already."""
    out = []
    for i, (p, g) in enumerate(zip(prediction.tolist(), truth.tolist(), strict=True)):
        if p != done and g not in used:
            used.add(g)
            done = p
            out.append(i)
    return out


def _greedy(names: list[str], carried: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over a partition sorted by group; in it by pairs and predictions in falling confidence, then ground truths.

    In a group where no two predictions like the same ground truth best, all get it: those are
    settled for a whole batch at once. The others, and a group that goes on in another batch, take
    the pairs in order; of an open group only its hits are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group: int | None = None
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))  # prediction, ground truth, iou, confidence of the open group's hits
        held_more: list[pa.Array] = []  # and the columns carried with them
        last: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda n, fill: batch.column(names.index(n)).fill_null(fill).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            grp, kind, p, g, overlap = col("grp", 0), col("kind", 0), col("prediction_id", -1), col("groundtruth_id", -1), col("iou", 0.0)
            sure = col("confidence", np.nan)
            goes_on = open_group is not None and grp[0] == open_group
            pair = np.flatnonzero(kind == _PAIR)
            hits = np.zeros(0, np.int64)
            if len(pair):
                pp, pg, pgrp = p[pair], g[pair], grp[pair]
                best = np.r_[True, pp[1:] != pp[:-1]]
                liked, times = np.unique(pg[best], return_counts=True)
                clash = np.isin(pg, liked[times > 1]) & best
                slow = np.isin(pgrp, np.r_[pgrp[clash], grp[-1:], grp[:1] if goes_on else grp[:0]])
                hits = pair[best & ~slow]
                at = np.flatnonzero(slow)
                if len(at):
                    used = set(held[1].tolist()) if goes_on else set()
                    done = last if goes_on else None
                    hits = np.r_[hits, pair[at[first_free(pp[at], pg[at], used, done)]]]
            h = [p[hits], g[hits], overlap[hits], sure[hits]]
            more = [batch.column(names.index(n)).take(pa.array(hits)) for n in carried]
            if goes_on:
                h = [np.r_[a, b] for a, b in zip(held, h, strict=True)]
                more = [pa.concat_arrays([a, b]) for a, b in zip(held_more, more, strict=True)]
            by_truth = np.argsort(h[1], kind="stable")
            lone = (kind == _PREDICTION) & ~np.isin(p, h[0])
            rows = np.flatnonzero(lone | (kind == _TRUTH))
            truth = kind[rows] == _TRUTH
            found = np.zeros(len(rows), bool)
            where = np.zeros(len(rows), np.int64)
            if len(by_truth):
                place = np.minimum(np.searchsorted(h[1][by_truth], g[rows]), len(by_truth) - 1)
                where = by_truth[place]
                found = truth & (h[1][where] == g[rows])
            if len(rows):
                yield _emitted(batch, names, carried, rows, truth, found, where, h, more, p, g, sure)
            mine = np.zeros(len(h[0]), bool)
            n_old = len(held[0]) if goes_on else 0
            mine[n_old:] = grp[hits] == grp[-1]
            if goes_on and grp[-1] == open_group:
                mine[:n_old] = True
            held = tuple(x[mine] for x in h)
            held_more = [x.take(pa.array(np.flatnonzero(mine))) for x in more]
            open_group = int(grp[-1])
            last = int(p[-1]) if kind[-1] != _TRUTH and p[-1] in held[0] else None

    return run


def _emitted(batch: pa.RecordBatch, names: list[str], carried: list[str], rows: np.ndarray, truth: np.ndarray, found: np.ndarray, where: np.ndarray, h: list[np.ndarray], more: list[pa.Array], p: np.ndarray, g: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
    """A row per ground truth, with its prediction if it has one, and per prediction without."""
    pick = lambda x, other: np.where(found, x[where], other) if len(x) else other
    confidence = pick(h[3], np.where(truth, np.nan, sure[rows]))
    made = [
        pa.array(pick(h[0], p[rows]), mask=truth & ~found), pa.array(np.asarray(pick(h[2], np.zeros(len(rows))), np.float64)), pa.array(g[rows], mask=~truth),
        pa.array(np.asarray(confidence, np.float64), mask=np.isnan(confidence)), pa.array(truth),
    ]
    rest = [n for n in names[names.index("iou") + 1 :] if n not in carried]
    taken = batch.take(pa.array(rows))
    at_hit = pa.array(where, mask=~found)  # null where there is no hit, and so is what is taken there
    return pa.RecordBatch.from_arrays(made + [taken.column(names.index(n)) for n in rest] + [x.take(at_hit) for x in more], names=["prediction_id", "iou", "groundtruth_id", "confidence", "is_gt", *rest, *carried])


_FREE, _OPEN, _USED = 0, 1, 2


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i, and the numbers lo[i] up to hi[i], for every i."""
    n = np.maximum(hi - lo, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _meeting(box: np.ndarray, p: np.ndarray, g: np.ndarray, min_iou: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``p`` and ``g`` (places of ``box``, whose rows are x, y, width, height) of the pairs with iou > ``min_iou``, and it. As ``boxes.iou`` computes it.

    Boxes lie in all strips of y they reach into and meet by x within a strip; a pair counts in the first that both are in.
    """
    known = ~np.isnan(box.sum(axis=0))
    at_p, at_g = np.flatnonzero(known[p]), np.flatnonzero(known[g])
    if not len(at_p) or not len(at_g):
        return _overlapping(box, p, g, at_p[:0], at_g[:0], min_iou)
    left, right = box[0], box[0] + box[2]
    low, high = np.minimum(box[1], box[1] + box[3]), np.maximum(box[1], box[1] + box[3])
    both = np.r_[p[at_p], g[at_g]]
    x0, y0 = min(left[both].min(), right[both].min()), low[both].min()
    deep, tall = high[both].max() - y0, 2 * np.abs(box[3, both]).mean()
    wide = (max(left[both].max(), right[both].max()) - x0) * (1 + 1e-6) + 1
    strips = int(max(1, min(deep / tall, len(both)))) if tall > 0 and np.isfinite(deep) and np.isfinite(wide * len(both)) else 1
    nth = lambda v: np.clip(((v - y0) / (deep / strips)).astype(np.int64), 0, strips - 1) if strips > 1 else np.zeros(len(v), np.int64)

    def laid(at: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places by strip and x: them, their strips and first strips, and where they begin and end."""
        since = nth(low[mine])
        k, strip = _spread(since, nth(high[mine]) + 1)
        at_strip = strip * wide if strips > 1 else 0.0
        begins = at_strip + (left[mine][k] - x0)
        order = np.argsort(begins, kind="stable")
        return tuple(v[order] for v in (at[k], strip, since[k], begins, at_strip + (right[mine][k] - x0)))

    place_p, strip_p, since_p, xp, end_p = laid(at_p, p[at_p])
    place_g, strip_g, since_g, xg, end_g = laid(at_g, g[at_g])
    i, j = _spread(np.searchsorted(xg, xp, "left"), np.searchsorted(xg, end_p, "right"))  # ground truths that begin in a prediction
    l, k = _spread(np.searchsorted(xp, xg, "right"), np.searchsorted(xp, end_g, "right"))  # and the other way round
    i, j = np.r_[i, k], np.r_[j, l]
    keep = np.flatnonzero((strip_p[i] == strip_g[j]) & (strip_p[i] == np.maximum(since_p[i], since_g[j])))
    return _overlapping(box, p, g, place_p[i[keep]], place_g[j[keep]], min_iou)


def _overlapping(box: np.ndarray, p: np.ndarray, g: np.ndarray, i: np.ndarray, j: np.ndarray, min_iou: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs of places ``i`` in ``p`` and ``j`` in ``g`` with iou > ``min_iou``, and it."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = box[:, g], box[:, p]
    keep = np.flatnonzero((ay[j] < (by + bh)[i]) & (by[i] < (ay + ah)[j]))
    i, j = i[keep], j[keep]
    keep = np.flatnonzero((ax[j] < (bx + bw)[i]) & (bx[i] < (ax + aw)[j]))
    i, j = i[keep], j[keep]
    w = np.maximum(0.0, np.minimum((ax + aw)[j], (bx + bw)[i]) - np.maximum(ax[j], bx[i]))
    h = np.maximum(0.0, np.minimum((ay + ah)[j], (by + bh)[i]) - np.maximum(ay[j], by[i]))
    joint = (aw * ah)[j] + (bw * bh)[i] - w * h
    overlap = np.divide(w * h, joint, out=np.zeros(len(i)), where=joint != 0)
    met = overlap > min_iou
    return i[met], j[met], overlap[met]


PLACE = ["grp", "cls", "x", "y", "w", "h", "t"]
PLACED = "grp bigint, cls bigint, x double, y double, w double, h double, t int"
BOXES = ["grp", "cls", "is_truth", "id", "x", "y", "w", "h", "confidence"]
ROW = "prediction_id bigint, iou double, groundtruth_id bigint, confidence double, is_gt boolean"


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which are ground truths, ids, boxes (NaN for null), confidences, and where there is none."""
    confidence = table.column("confidence")
    number = lambda c: c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)
    return number(table.column("is_truth")), number(table.column("id")), np.stack([number(table.column(c)) for c in "xywh"]), number(confidence.fill_null(0.0)), number(confidence.is_null())


def _in_turn(p: np.ndarray, ids: np.ndarray, sure: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """Predictions in falling confidence (NaN first, null last), then by id."""
    return p[np.lexsort((ids[p], -sure[p], ~np.isnan(sure[p]), absent[p]))]


def _outcome(table: pa.Table, extra: list[str], more: list[str], hit_p: np.ndarray, hit_g: np.ndarray, hit_iou: np.ndarray, lone: np.ndarray, left: np.ndarray) -> list[pa.Array]:
    """Columns of ``ROW``, ``extra`` and ``more`` of the hits, of boxes without one, and of ``left``, whose iou is null."""
    truth, ids, _, sure, absent = _columns(table)
    own = np.r_[hit_g, lone, left]
    is_truth = truth[own]
    hit, is_left = np.arange(len(own)) < len(hit_g), np.arange(len(own)) >= len(hit_g) + len(lone)
    by = np.r_[hit_p, lone, left]  # whose confidence it is
    whose = np.where(hit | is_left, by, 0)
    at = pa.array(whose, pa.int64(), mask=~(hit | is_left))
    taken = lambda c, index: table.column(c).take(index)
    made = [
        pa.array(ids[by], pa.int64(), mask=is_truth & ~hit), pa.array(np.r_[hit_iou, np.zeros(len(lone) + len(left))], pa.float64(), mask=is_left), pa.array(ids[own], pa.int64(), mask=~is_truth),
        pa.array(sure[by], pa.float64(), mask=absent[by] | (np.isnan(sure[by]) & ~is_left)), pa.array(is_truth, pa.bool_()),
    ]
    return made + [taken(c, pa.array(own, pa.int64())) for c in extra] + [taken(c, at) for c in more]


def _by_liking(i: np.ndarray, overlap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order of pairs by ``i``, falling ``overlap`` and ``ids``: as np.lexsort has it, but ids are compared in ties only."""
    order = np.argsort(-overlap)
    n = i.max(initial=0)
    order = order[np.argsort(i[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]  # short numbers are sorted by their digits
    a, b = i[order], overlap[order]
    tied = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
    if tied.any():
        run = np.cumsum(~tied)
        at = np.flatnonzero(tied | np.r_[tied[1:], False])
        order[at] = order[at][np.lexsort((ids[order[at]], run[at]))]
    return order


def taken_in_turn(prediction: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Places that ``first_free`` finds, for many groups at once; predictions are numbered in their turn.

    A prediction gets its first ground truth where none before it, that is still without one, meets that. The first
    of a group always does, so each round settles some of every group.
    """
    at, hits = np.arange(len(prediction)), []
    used_p, used_g = np.zeros(prediction.max(initial=-1) + 1, bool), np.zeros(truth.max(initial=-1) + 1, bool)
    first = np.zeros(len(used_g), np.int64)
    while len(at) > ROUND_PAIRS:
        p, g = prediction[at], truth[at]
        first[g[::-1]] = p[::-1]  # of equal places the last is kept, which is the first in turn
        hit = at[np.r_[True, p[1:] != p[:-1]] & (first[g] == p)]
        used_p[prediction[hit]] = used_g[truth[hit]] = True
        hits.append(hit)
        at = at[~(used_p[p] | used_g[g])]
    hits.append(at[np.array(first_free(prediction[at], truth[at], set(), None), np.int64)])
    return np.sort(np.concatenate(hits))


def settled_groups(table: pa.Table, group: np.ndarray, min_iou: float, extra: list[str], more: list[str]) -> list[pa.Array]:
    """Columns of ``_outcome`` of whole groups, whose numbers rise; their pairs are made here."""
    truth, ids, box, sure, absent = _columns(table)
    p, g = _in_turn(np.flatnonzero(~truth), ids, sure, absent), np.flatnonzero(truth)
    p = p[np.argsort(group[p], kind="stable")]
    i, j = _spread(np.searchsorted(group[g], group[p], "left"), np.searchsorted(group[g], group[p], "right"))
    i, j, overlap = _overlapping(box, p, g, i, j, min_iou)
    order = _by_liking(i, overlap, ids[g[j]])
    i, j, overlap = i[order], j[order], overlap[order]
    hits = taken_in_turn(i, j)
    free = np.ones(len(truth), bool)
    free[p[i[hits]]] = free[g[j[hits]]] = False
    return _outcome(table, extra, more, p[i[hits]], g[j[hits]], overlap[hits], np.flatnonzero(free), np.zeros(0, np.int64))


def _whole_groups(min_iou: float, extra: list[str], more: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``settled_groups`` of boxes sorted by group, of as many groups at once as a batch has whole."""

    def settled(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_flat(settled_groups(table, group, min_iou, extra, more)), names=names)

    names = [*(c.split()[0] for c in ROW.split(", ")), *extra, *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            group = numbers(table)
            done = int(np.searchsorted(group, group[-1], "left"))
            if done:
                yield settled(table.slice(0, done), group[:done])
            held = table.slice(done).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield settled(table, numbers(table))

    return run


def _flat(columns: list) -> list[pa.Array]:
    return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]


def numbers(table: pa.Table, keys: tuple[str, ...] = ("grp", "cls")) -> np.ndarray:
    """Numbers of the groups of sorted rows, from 0."""
    new = np.zeros(table.num_rows, bool)
    for c in keys:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def tile(min_iou: float, extra: list[str], more: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Greedy matching in a tile, as far as it can be settled there: rows of ``_outcome`` with the boxes that are left open, and the place of these.

    All that meets a box that lies whole in the tile is in the tile. A prediction that sticks out may
    take any of its ground truths, so they are open for those after it; a ground truth that sticks out is
    open from the start. A whole prediction whose first unused ground truth is free takes it, as in the
    whole group; else it is left open, and so is the first free one that it would take.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        truth, ids, box, sure, absent = _columns(table)
        whole, first = table.column("whole").to_numpy(), table.column("first").to_numpy()
        p, g = _in_turn(np.flatnonzero(~truth), ids, sure, absent), np.flatnonzero(truth)
        state = np.where(whole, _FREE, _OPEN).tolist()
        hit_p, hit_g, hit_iou, left = [], [], [], []
        step = max(256, TILE_PAIRS // max(1, len(g)))
        for start in range(0, len(p), step):
            block = p[start : start + step]
            if start:
                g = g[np.array(state)[g] != _USED]
            i, j, overlap = _meeting(box, block, g, min_iou)
            order = _by_liking(i, overlap, ids[g[j]])
            liked, overlap = g[j[order]].tolist(), overlap[order]
            ends = np.cumsum(np.bincount(i, minlength=len(block))).tolist()
            a = 0
            for mine, b, entire in zip(block.tolist(), ends, whole[block].tolist(), strict=True):
                is_open = not entire
                for at in range(a, b):
                    x = liked[at]
                    if state[x] == _FREE:
                        if is_open:
                            state[x] = _OPEN
                            if entire:
                                break
                        else:
                            state[x] = _USED
                            hit_p.append(mine)
                            hit_g.append(x)
                            hit_iou.append(overlap[at])
                            break
                    elif state[x] == _OPEN:
                        is_open = True
                if is_open:
                    left.append(mine)
                a = b
        state, hit_p, hit_g, left = np.array(state), np.array(hit_p, np.int64), np.array(hit_g, np.int64), np.array(left, np.int64)
        free = np.where(truth, state == _FREE, True)
        free[hit_p] = free[left] = False
        still = np.r_[left, np.flatnonzero(truth & (state == _OPEN))]
        still = still[first[still]]
        lone = np.flatnonzero(free)
        made = _outcome(table, extra, more, hit_p, hit_g, np.array(hit_iou, np.float64), lone, still)
        at = pa.array(np.r_[np.zeros(len(hit_p) + len(lone), np.int64), still], mask=np.arange(len(hit_p) + len(lone) + len(still)) < len(hit_p) + len(lone))
        names = [*(c.split()[0] for c in ROW.split(", ")), *extra, *more, *PLACE]
        return pa.Table.from_arrays([*made, *(table.column(c).take(at) for c in PLACE)], names=names)

    return run


def outline() -> list[Column]:
    """Number, bounds and mean sizes of a group's boxes, of which its tiles are made."""
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return [
        F.count(F.lit(1)).alias("n"), F.min(F.least("x", right)).alias("lo_x"), F.max(F.greatest("x", right)).alias("hi_x"), F.min(F.least("y", bottom)).alias("lo_y"), F.max(F.greatest("y", bottom)).alias("hi_y"),
        F.avg(F.abs("w")).alias("mean_w"), F.avg(F.abs("h")).alias("mean_h"),
    ]


def tiling(sizes: DataFrame) -> DataFrame:
    """``outline`` with ``__k``, at most half of ``was``, and the numbers of tiles ``k_x``, ``k_y``: no more than ``__k`` nor than boxes of mean size fit in.

    What earlier rounds have left of a group is one tile as soon as a task may hold it.
    """
    k = F.when((F.col("was") < FIRST_ROUND) & (F.col("n") <= GROUP_BOXES), 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.ceil(F.sqrt(F.col("n") / TILE_BOXES)).cast("double"), F.floor(F.col("was") / 2).cast("double"))))
    along = lambda c, s: F.greatest(F.lit(1.0), F.least("__k", F.floor(F.coalesce(F.try_divide(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.col(f"mean_{s}")), F.lit(1.0))).cast("double")))
    return sizes.withColumn("__k", k).withColumn("k_x", along("x", "w")).withColumn("k_y", along("y", "h"))


def spanned(boxes: DataFrame) -> DataFrame:
    """Boxes beside their group's ``tiling`` with the tiles they touch, ``from_x`` to ``to_x`` and ``from_y`` to ``to_y``."""
    at = lambda v, c: F.greatest(F.lit(0.0), F.least(F.col(f"k_{c}") - 1, F.coalesce(F.try_divide((v - F.col(f"lo_{c}")) * F.col(f"k_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)))).cast("int")
    for c, end in (("x", F.col("x") + F.col("w")), ("y", F.col("y") + F.col("h"))):
        boxes = boxes.withColumn(f"from_{c}", F.least(at(F.col(c), c), at(end, c))).withColumn(f"to_{c}", F.greatest(at(F.col(c), c), at(end, c)))
    return boxes


def settled_by_tiles(boxes: DataFrame, min_iou: float, extra: list[str], more: list[str], shape: StructType) -> DataFrame:
    """The rows (``shape``) of groups of very many ``boxes`` with finite coordinates, exactly as one pass over a group's pairs finds them.

    A round lays tiles over every group and settles what can be settled in a tile; boxes that are
    left open, about those across the tiles' borders, go on to a round of fewer tiles, the last of
    one. Only boxes are moved, pairs never leave a tile, and a row is made where it is settled, so that nothing is
    joined afterwards. A group has no more tiles along an axis than its boxes are wide on average. Boxes with ``t``
    have been through a round of ``t`` tiles along an axis.
    """
    own = [*BOXES, "t", *extra, *more]
    placed = StructType([*shape.fields, *spark_fields(PLACED)])
    left, settled = boxes if "t" in boxes.columns else boxes.withColumn("t", F.lit(FIRST_ROUND)), None
    while True:
        sizes = kept(tiling(left.groupBy(F.col("grp").alias("__g"), F.col("cls").alias("__c")).agg(F.min("t").alias("was"), *outline())), "tiles")
        many = sizes.count()
        if not many:
            return settled
        cells = spanned(left.join(small(sizes, many), (F.col("grp") == F.col("__g")) & (F.col("cls") == F.col("__c"))))
        whole = (F.col("from_x") == F.col("to_x")) & (F.col("from_y") == F.col("to_y"))
        cells = cells.withColumn("t", F.col("__k").cast("int")).withColumn("whole", whole).withColumn("cx", F.explode(F.sequence("from_x", "to_x"))).withColumn("cy", F.explode(F.sequence("from_y", "to_y")))
        first = (F.col("cx") == F.col("from_x")) & (F.col("cy") == F.col("from_y"))
        tiles = cells.select("cx", "cy", *own, "whole", first.alias("first"))
        found = kept(tiles.groupBy("grp", "cls", "cx", "cy").applyInArrow(tile(min_iou, extra, more), placed), "settled")
        rows = found.filter("iou is not null").drop(*PLACE)
        settled = rows if settled is None else settled.unionByName(rows)
        left = left_open(found, own)


def left_open(found: DataFrame, own: list[str]) -> DataFrame:
    """Boxes that ``tile`` left open, as it takes them."""
    return found.filter("iou is null").withColumn("is_truth", F.col("is_gt")).withColumn("id", F.when(F.col("is_gt"), F.col("groundtruth_id")).otherwise(F.col("prediction_id"))).select(*own)


def matched_rows(groundtruth: DataFrame, predictions: DataFrame, columns: list[str] = [], min_iou: float = 0.0, category_agnostic: bool = False, carried: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """``prediction_id, iou, groundtruth_id, confidence, is_gt, columns..., carried...``: a row per ground truth, and per prediction without one.

    In falling confidence (ties: smaller id first; null last) every prediction takes the ground
    truth of greatest iou (ties: smaller id) that is still free in its image (and class). A ground
    truth without a prediction has a null id and confidence, and iou 0; a prediction without a ground
    truth has iou 0. ``columns`` are the ground truth's, of a lone prediction its own; ``carried``
    (name: column of the predictions) are those of a ground truth's prediction, else null.

    Boxes of both sides are written once as one table and go through one shuffle by image (and class); a task makes
    the pairs of its groups, settles them and emits the rows, so no pair is shuffled and nothing is
    joined afterwards. Groups of very many pairs or boxes are settled by tiles; those with infinite or NaN coordinates
    go through ``_rows_of_pairs``. Boxes with a null image, class or coordinate are alone and are spread by their ids.
    """
    keys = ["image_id"] if category_agnostic else ["image_id", "category_id"]
    extra, more = [f"c{i}" for i in range(len(columns))], [f"m{i}" for i in range(len(carried))]
    whole = {"tinyint", "smallint", "int", "bigint"}

    def side(df: DataFrame, truth: bool) -> DataFrame:
        known = F.lit(True)
        for c in (*keys, *BOX):
            known = known & F.col(f"`{c}`").isNotNull()
        exact = all(dict(x.dtypes)[k] in whole for k in keys for x in (groundtruth, predictions))
        part = lambda k: F.col(f"`{k}`").cast("bigint") if exact else F.xxhash64(F.col(f"`{k}`").cast("string"))
        grp = F.when(known, part(keys[0])).otherwise(F.xxhash64(F.lit("g" if truth else "p"), "id")).alias("grp")
        cls = F.when(known, part(keys[1]) if len(keys) > 1 else F.lit(0)).otherwise(F.lit(-1)).cast("bigint").alias("cls")
        place = [F.when(known, F.col(f"`{c}`").cast("double")).alias(n) for c, n in zip(BOX, "xywh", strict=True)]
        confidence = (F.lit(None) if truth else F.col("confidence")).cast("double").alias("confidence")
        theirs = [(F.lit(None).cast(predictions.schema[c].dataType) if truth else F.col(f"`{c}`")).alias(n) for n, c in zip(more, carried.values(), strict=True)]
        return df.select(grp, cls, F.lit(truth).alias("is_truth"), F.col("id").cast("bigint").alias("id"), *place, confidence, *(F.col(f"`{c}`").alias(n) for n, c in zip(extra, columns, strict=True)), *theirs)

    boxes = kept(side(groundtruth, True).unionByName(side(predictions, False)), "boxes")
    shape = StructType([*spark_fields(ROW), *(StructField(n, boxes.schema[n].dataType) for n in (*extra, *more))])
    odd = F.max(~(F.abs(F.col("x") + F.col("w")) + F.abs(F.col("y") + F.col("h")) < float("inf")))
    ng, np_ = F.count_if("is_truth"), F.count_if(~F.col("is_truth"))
    groups = boxes.groupBy(F.col("grp").alias("__g"), F.col("cls").alias("__c")).agg(ng.alias("ng"), np_.alias("np"), F.coalesce(odd, F.lit(False)).alias("odd"))
    groups = kept(groups.filter(F.col("odd") | (F.col("ng") * F.col("np") > GRID_PAIRS) | (F.col("ng") + F.col("np") > GROUP_BOXES)).select("__g", "__c", "odd"), "crowded")
    kinds = {r[0]: r[1] for r in groups.groupBy("odd").count().collect()}
    here = lambda which, how: boxes.join(small(which, sum(kinds.values())), (F.col("grp") == F.col("__g")) & (F.col("cls") == F.col("__c")), how)
    ranked = (here(groups.select("__g", "__c"), "left_anti") if kinds else boxes).repartition("grp", "cls").sortWithinPartitions("grp", "cls")
    out = ranked.mapInArrow(_whole_groups(min_iou, extra, more), shape)
    if kinds.get(False):
        out = out.unionByName(settled_by_tiles(here(groups.filter("not odd").select("__g", "__c"), "left_semi"), min_iou, extra, more, shape))
    if kinds.get(True):
        apart = here(groups.filter("odd").withColumn("group", F.xxhash64("__g", "__c")), "inner")
        named = lambda s: [F.col("id").alias(f"{s}_id"), F.col("group").alias(f"{s}_image_id"), F.lit(0).alias(f"{s}_category_id"), *(F.col(n).alias(f"{s}_{c}") for c, n in zip(BOX, "xywh", strict=True)), *extra]
        g = apart.filter("is_truth").select(*named("g"))
        p = apart.filter("not is_truth").select(*named("p"), F.col("confidence").alias("p_confidence"), *more)
        out = out.unionByName(_rows_of_pairs(g, p, extra, more, min_iou))
    return out.select("prediction_id", "iou", "groundtruth_id", "confidence", "is_gt", *(F.col(n).alias(c) for n, c in zip(extra, columns, strict=True)), *(F.col(n).alias(c) for n, c in zip(more, carried, strict=True)))


def _rows_of_pairs(g: DataFrame, p: DataFrame, extra: list[str], more: list[str], min_iou: float) -> DataFrame:
    """The same for groups with infinite or NaN coordinates, which Spark compares: pairs, predictions and ground truths are sorted together and settled in one pass.

    Groups of very many pairs are parted into connected components of the overlap graph, which can't take from each other.
    """
    keys = ["image_id"]
    no_extra = lambda df: df.drop(*extra)
    pairs = _pairs(no_extra(g), no_extra(p), min_iou, True)

    def group(of: str) -> tuple[Column, Column]:
        known = F.lit(True)
        for k in keys:
            known = known & F.col(f"{of}{k}").isNotNull()
        return known, F.xxhash64(*(F.col(f"{of}{k}") for k in keys))

    pairs = kept(pairs.select(group("")[1].alias("grp"), F.col("prediction_id").cast("bigint").alias("prediction_id"), F.col("groundtruth_id").cast("bigint").alias("groundtruth_id"), F.col("confidence").cast("double").alias("confidence"), "iou", *more), "pairs")
    counts = kept(pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > SPLIT_PAIRS).select(F.col("grp").alias("big")), "big")
    many = counts.count()
    null = lambda t: F.lit(None).cast(t)
    unknown = [null(p.schema[n].dataType).alias(n) for n in more]
    known, hashed = group("p_")
    lone_p = p.select(F.when(known, hashed).otherwise(F.xxhash64(F.lit("p"), "p_id")).alias("grp"), F.lit(_PREDICTION).alias("kind"), F.col("p_id").cast("bigint").alias("prediction_id"), null("bigint").alias("groundtruth_id"), F.col("p_confidence").cast("double").alias("confidence"), null("double").alias("iou"), *extra, *unknown)
    known, hashed = group("g_")
    lone_g = g.select(F.when(known, hashed).otherwise(F.xxhash64(F.lit("g"), "g_id")).alias("grp"), F.lit(_TRUTH).alias("kind"), null("bigint").alias("prediction_id"), F.col("g_id").cast("bigint").alias("groundtruth_id"), null("double").alias("confidence"), null("double").alias("iou"), *extra, *unknown)
    if many:
        big = small(counts, many)
        node_p, node_g = F.col("prediction_id") * 2, F.col("groundtruth_id") * 2 + 1
        crowd = pairs.join(big, F.col("grp") == F.col("big"), "left_semi")
        parts = connected_components(crowd.select(node_p.alias("src"), node_g.alias("dst")))

        def parted(df: DataFrame, node: Column) -> DataFrame:
            """Boxes of big groups by component; those that meet nothing are alone."""
            there = df.join(big, F.col("grp") == F.col("big"), "left_semi").withColumn("__n", node)
            named = there.join(parts, F.col("__n") == F.col("node"), "left").withColumn("grp", F.xxhash64("grp", F.coalesce("component", F.col("__n")))).drop("__n", "node", "component")
            return df.join(big, F.col("grp") == F.col("big"), "left_anti").unionByName(named)

        pairs, lone_p, lone_g = parted(pairs, node_p), parted(lone_p, node_p), parted(lone_g, node_g)
    blank = [null(g.schema[n].dataType).alias(n) for n in extra]
    rows = pairs.select("grp", F.lit(_PAIR).alias("kind"), "prediction_id", "groundtruth_id", "confidence", "iou", *blank, *more).unionByName(lone_p).unionByName(lone_g)
    is_truth = F.col("kind") == _TRUTH
    order = ["grp", is_truth, F.col("confidence").desc_nulls_last(), "prediction_id", "kind", F.col("iou").desc(), "groundtruth_id"]
    ranked = rows.repartition("grp").sortWithinPartitions(*order)
    shape = StructType([*spark_fields(ROW), *(StructField(n, rows.schema[n].dataType) for n in (*extra, *more))])
    return ranked.mapInArrow(_greedy(rows.columns, more), shape)


def spark_fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def greedy_match(groundtruth: DataFrame, predictions: DataFrame, min_iou: float = 0.0, category_agnostic: bool = False) -> DataFrame:
    """``(prediction_id, iou, groundtruth_id)``: every prediction and every ground truth once, as ``matched_rows`` settles them."""
    return matched_rows(groundtruth, predictions, [], min_iou, category_agnostic).select("prediction_id", "iou", "groundtruth_id")
