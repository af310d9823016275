"""Confusion matrices counted where boxes are matched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framewright.functions.boxes import BOX
from framewright.operators import curves, matching
from framewright.session import kept

#: Counted rows that a task holds before it sums them up.
HELD_ROWS = 1_000_000
#: Bits of a row's kind: a box that lies whole in its tile, the first of its tiles, a ground truth, an image.
_WHOLE, _FIRST, _TRUTH, _IMAGE = 1, 2, 4, 8
#: A tile is named by the number of tiles along an axis and its own along both, in so many bits each.
_BITS = 20


def confusion_counts(groundtruth: DataFrame, predictions: DataFrame, images: DataFrame, min_iou: float = 0.0, min_confidence: float = 0.0, by: list[str] = [], label: str = "category_id", within: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:  # noqa: B006
    """``by..., groundtruth, prediction, n``: the rows of ``curves.confused_rows`` of class-agnostic matching, counted, with null where there is no box.

    Boxes and ``images`` (one row per ``id``, with the columns ``by``) go through one shuffle by image; a task matches its images
    and counts, so that boxes are neither joined nor written. Boxes of no image are left out. Groups of very many boxes are laid
    out in tiles before the shuffle, and what a tile leaves open goes on as in ``matching.settled_by_tiles``; those
    with infinite or NaN coordinates go through ``matching.matched_rows``. Which groups these are is read from ``within``:
    tables that hold at least the boxes of both sides (``image_id`` and coordinates), by default the sides themselves.
    """
    names = [f"c{i + 1}" for i in range(len(by))]
    extra, more = ["c0", *names], ["m0"]
    box = ["x", "y", "w", "h"]

    def coordinates(df: DataFrame) -> list:
        known = F.lit(True)
        for c in BOX:
            known = known & df[c].isNotNull()
        return [F.when(known, df[c].cast("double")).alias(n) for c, n in zip(BOX, box, strict=True)]

    keys = images.select(F.col("id").cast("bigint").alias("grp"), *(F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True))).filter("grp is not null")
    there = [df.select(F.col("image_id").cast("bigint").alias("grp"), F.lit(truth).alias("is_truth"), *coordinates(df)) for df, truth in zip(within or (groundtruth, predictions), (True, False), strict=True)]
    odd = F.max(~(F.abs(F.col("x") + F.col("w")) + F.abs(F.col("y") + F.col("h")) < float("inf")))
    ng, np_ = F.count_if("is_truth").alias("ng"), F.count_if(~F.col("is_truth")).alias("np")
    sizes = there[0].unionByName(there[1]).filter("grp is not null").groupBy("grp").agg(ng, np_, F.coalesce(odd, F.lit(False)).alias("odd"), F.lit(matching.FIRST_ROUND).alias("was"), *matching.outline())
    sizes = sizes.filter(F.col("odd") | (F.col("ng") * F.col("np") > matching.GRID_PAIRS) | (F.col("ng") + F.col("np") > matching.GROUP_BOXES))
    sizes = matching.tiling(sizes).join(keys.withColumn("there", F.lit(True)), "grp", "left").withColumnRenamed("grp", "__g")
    crowded = kept(sizes.select("__g", "odd", "__k", "k_x", "k_y", "lo_x", "hi_x", "lo_y", "hi_y", F.coalesce("there", F.lit(False)).alias("there"), *names), "crowded")
    kinds = {r[:2]: r[2] for r in crowded.groupBy("odd", "there").count().collect()}
    few = matching.small(crowded, sum(kinds.values()))

    def side(df: DataFrame, truth: bool) -> DataFrame:
        confidence = (F.lit(None) if truth else F.col("confidence")).cast("double").alias("confidence")
        return df.filter("image_id is not null").select(F.col("image_id").cast("bigint").alias("grp"), F.lit(truth).alias("is_truth"), F.col("id").cast("bigint").alias("id"), *coordinates(df), confidence, F.col(f"`{label}`").alias("c0"))

    placed = side(groundtruth, True).unionByName(side(predictions, False)).join(few, F.col("grp") == F.col("__g"), "left").filter("__g is null or (there and not odd)")
    # a box with null coordinates meets nothing and may be in any tile
    lost = F.col("__g").isNotNull() & F.col("x").isNull()
    placed = matching.spanned(placed)
    for c in "xy":
        any_ = F.pmod(F.xxhash64("id", F.lit(c)), F.col(f"k_{c}").cast("bigint")).cast("int")
        placed = placed.withColumns({f"{e}_{c}": F.when(lost, any_).when(F.col("__g").isNotNull(), F.col(f"{e}_{c}")).otherwise(0) for e in ("from", "to")})
    wide, last = F.col("to_x") - F.col("from_x") + 1, F.col("last")
    placed = placed.withColumn("last", wide * (F.col("to_y") - F.col("from_y") + 1) - 1).withColumn("nth", F.explode(F.sequence(F.lit(0), last)))
    bit = lambda c, value: F.when(c, value).otherwise(0)
    kind = bit(last == 0, _WHOLE) + bit(F.col("nth") == 0, _FIRST) + bit(F.col("is_truth"), _TRUTH)
    in_row = F.pmod(F.col("nth"), wide)
    numbers = [F.col("__k"), F.col("from_x") + in_row, F.col("from_y") + (F.col("nth") - in_row) / wide]
    in_tile = sum(F.shiftleft(v.cast("bigint"), _BITS * (2 - i)) for i, v in enumerate(numbers))
    boxes = placed.select("grp", F.when(F.col("__g").isNull(), F.lit(-1)).otherwise(in_tile).cast("bigint").alias("tile"), kind.alias("kind"), "id", *box, "confidence", "c0", *names)
    null = lambda n: F.lit(None).cast(boxes.schema[n].dataType).alias(n)
    marks = keys.select("grp", F.lit(-1).cast("bigint").alias("tile"), F.lit(_IMAGE).alias("kind"), *(null(n) for n in ("id", *box, "confidence", "c0")), *names)
    label_type = boxes.schema["c0"].dataType
    cells = [StructField("a", label_type), StructField("b", label_type), StructField("n", LongType())]
    shape = StructType([*matching.spark_fields(matching.ROW), *(boxes.schema[n] for n in extra), StructField("m0", label_type)])
    out = StructType([*(StructField(f.name, f.dataType) for f in (*shape.fields, *matching.spark_fields(matching.PLACED))), *cells])
    # one number is sorted faster than two columns; should two groups share it, the task tells them apart
    keyed = boxes.unionByName(marks).withColumn("key", F.xxhash64("grp", "tile"))
    found = kept(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_counts(min_iou, min_confidence, names, out), out), "counts")
    counts = [found.filter("n is not null").select(*names, "a", "b", "n")]

    def counted(rows: DataFrame) -> DataFrame:
        """Of rows as ``matching.matched_rows`` gives them."""
        weak = F.col("is_gt") & F.col("prediction_id").isNotNull() & (F.col("iou") <= min_iou)
        sure = F.col("confidence") > min_confidence
        theirs = F.when(sure, F.when(F.col("is_gt"), F.col("m0")).otherwise(F.col("c0")))
        pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        own, none = F.when(F.col("is_gt"), F.col("c0")), F.lit(None).cast(label_type)
        pairs = F.when(weak, F.array(pair(own, none), pair(none, theirs))).otherwise(F.array(pair(own, theirs)))
        return rows.select(*names, F.inline(pairs)).filter("a is not null or b is not null").withColumn("n", F.lit(1).cast("bigint"))

    if (False, True) in kinds:
        rows = matching.settled_by_tiles(matching.left_open(found.filter("n is null"), [*matching.BOXES, "t", *extra, *more]), 0.0, extra, more, shape)
        counts += [counted(rows)] if rows is not None else []
    if (True, True) in kinds:
        which = matching.small(crowded.filter("odd and there").select("__g", *names), kinds[True, True])
        g, p = (df.withColumn("c0", F.col(f"`{label}`")).join(which, F.col("image_id") == F.col("__g")) for df in (groundtruth, predictions))
        counts.append(counted(matching.matched_rows(g, p, extra, 0.0, True, {"m0": "c0"})))
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total.groupBy(*names, "a", "b").agg(F.sum("n").alias("n")).select(*(F.col(n).alias(c) for n, c in zip(names, by, strict=True)), F.col("a").alias("groundtruth"), F.col("b").alias("prediction"), "n")


def named_cells(counts: DataFrame, names: Callable, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``curves.confusion_cells`` of ``confusion_counts`` whose labels ``names`` turns into class names."""
    name = lambda c: F.coalesce(names(F.col(c)), F.lit("None")).alias(c)
    cells = counts.select(*by, name("groundtruth"), name("prediction"), "n").groupBy(*by, "groundtruth", "prediction").agg(F.sum("n").alias("n"))
    return curves.shares(cells, by)


def _counts(min_iou: float, min_confidence: float, names: list[str], out: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts (with ``n``) of images and tiles, which are sorted by ``key``, and the boxes that tiles leave open."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    extra = ["c0", *names]
    rows = [*(c.split()[0] for c in matching.ROW.split(", ")), *extra, "m0"]
    in_tile = matching.tile(0.0, extra, ["m0"])

    def cells(matched: pa.Table) -> pa.Table:
        """A row for every cell that a row of matching counts in."""
        is_gt, own, theirs = (matched.column(c) for c in ("is_gt", "c0", "m0"))
        none = pa.scalar(None, own.type)
        met = pc.and_(is_gt, pc.is_valid(matched.column("prediction_id")))
        weak = pc.and_(met, pc.less_equal(matched.column("iou"), min_iou))
        sure = pc.fill_null(pc.greater(matched.column("confidence"), min_confidence), False)
        theirs = pc.if_else(sure, pc.if_else(is_gt, theirs, own), none)
        a, b = pc.if_else(is_gt, own, none), pc.if_else(weak, none, theirs)
        keys = [matched.column(n) for n in names]
        one = pa.table([*keys, a, b], names=[*names, "a", "b"])
        apart = pa.table([*keys, pa.nulls(len(is_gt), own.type), theirs], names=[*names, "a", "b"]).filter(weak)
        both = pa.concat_tables([one, apart])
        both = both.filter(pc.or_(pc.is_valid(both.column("a")), pc.is_valid(both.column("b"))))
        return both.append_column("n", pa.array(np.ones(both.num_rows, np.int64)))

    def summed(held: list[pa.Table]) -> pa.Table:
        total = pa.concat_tables(held).group_by([*names, "a", "b"], use_threads=False).aggregate([("n", "sum")])
        return total.rename_columns([c.removesuffix("_sum") for c in total.column_names]).select([*names, "a", "b", "n"])

    def shaped(table: pa.Table) -> list[pa.RecordBatch]:
        columns = [table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in schema]
        return pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()

    def grouped(table: pa.Table, keys: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        """Rows of equal keys by group, and the numbers of the groups."""
        group = matching.numbers(table, ("grp", "tile"))
        if group[-1] != keys[-1]:
            table = table.take(pa.array(np.lexsort((table.column("tile").to_numpy(), table.column("grp").to_numpy(), keys)))).combine_chunks()
            group = matching.numbers(table, ("grp", "tile"))
        return table, group

    def settled(table: pa.Table, group: np.ndarray) -> tuple[list[pa.Table], list[pa.Table]]:
        """Cells, and boxes left open, of whole images and tiles."""
        kind, tile = table.column("kind").to_numpy(), table.column("tile").to_numpy()
        is_box, tiled = kind & _IMAGE == 0, tile >= 0
        table = table.append_column("is_truth", pa.array(kind & _TRUTH > 0)).append_column("m0", table.column("c0"))
        image = np.full(group[-1] + 1, -1)
        image[group[~is_box]] = np.flatnonzero(~is_box)
        at = np.flatnonzero(is_box & ~tiled & (image[group] >= 0))
        counted, left = [], []
        if len(at):
            mine = table.take(pa.array(at))
            for n in names:
                mine = mine.set_column(mine.column_names.index(n), n, table.column(n).take(pa.array(image[group[at]])))
            mine = mine.combine_chunks()
            counted.append(cells(pa.table(matching.settled_groups(mine, group[at], 0.0, extra, ["m0"]), names=rows)))
        at = np.flatnonzero(tiled)
        for start, length in zip(*(x.tolist() for x in np.unique(group[at], return_index=True, return_counts=True)[1:]), strict=True):
            here = slice(int(at[start]), int(at[start]) + length)
            mine = table.slice(here.start, length)
            more = {"cls": np.zeros(length, np.int64), "t": (tile[here] >> 2 * _BITS).astype(np.int32), "whole": kind[here] & _WHOLE > 0, "first": kind[here] & _FIRST > 0}
            for n, v in more.items():
                mine = mine.append_column(n, pa.array(v))
            done = in_tile(mine)
            open_ = pc.is_null(done.column("iou"))
            counted.append(cells(done.filter(pc.invert(open_))))
            left.append(done.filter(open_))
        return counted, left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        sums: list[pa.Table] = []
        n = 0
        for batch in _ended(batches):
            last = batch is None
            if not last:
                held.append(batch)
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = matching.numbers(table, ("key",))
            done = len(keys) if last else int(np.searchsorted(keys, keys[-1], "left"))
            if done:
                counted, left = settled(*grouped(table.slice(0, done), keys[:done]))
                sums += counted
                n += sum(x.num_rows for x in counted)
                if n > HELD_ROWS:
                    sums = [summed(sums)]
                    n = 0
                for x in left:
                    yield from shaped(x)
            held = table.slice(done).combine_chunks().to_batches()
        if sums:
            yield from shaped(summed(sums))

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches with rows, and None at their end."""
    yield from (b for b in batches if b.num_rows)
    yield None
