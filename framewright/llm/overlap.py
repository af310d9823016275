"""Same or near-same records across splits, by content-defined chunks of their object lists and names."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.picture_names import caption_of, frame_key, split_name
from framewright.operators.components import connected_components, join_one
from framewright.operators.latest import latest_rows
from framewright.session import few_rows, scratch_path

#: What makes two object lists one picture: so many objects at least, this share of the longer list, boxes this near.
MIN_OBJECTS, SHARE, NEAR = 5, 0.75, 0.01
#: Lists longer than this are compared by single objects instead of windows of two.
LONG_LIST = 256
#: Rows at which the grid of a window is GRID wide; more rows make it finer, so that chance meetings grow with the rows only.
GRID, GRID_ROWS = 0.1, 2_400_000
#: An image with more than this share of all objects is joined apart; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.005
_SLACK = 1e-9
_BOX = ("fx", "fy", "fw", "fh")


# ---------------------------------------------------------------- chunks of object lists (numpy, whole batches)
def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cell_hash(dim: int, cell: np.ndarray) -> np.ndarray:
    return _mix(cell.astype(np.int64).view(np.uint64) * np.uint64(8) + np.uint64(dim + 1))


def _digests(cat: np.ndarray, boxes: list[np.ndarray], grid: float, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(owner, digest) of single objects: of the cell of their box, and for probes of every cell a box within NEAR could lie in."""
    owner = np.arange(len(cat))
    h = _mix(cat.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    alts = []
    for d, f in enumerate(boxes):
        cell = np.floor(f / grid)
        base = _cell_hash(d, cell)
        h = h + base
        if probe:
            low, high = np.floor((f - NEAR - _SLACK) / grid), np.floor((f + NEAR + _SLACK) / grid)
            other = np.where(low != cell, low, high)
            alts.append((other != cell, _cell_hash(d, other) - base))
    for has, delta in alts:
        more = has[owner]
        extra = owner[more]
        owner, h = np.r_[owner, extra], np.r_[h, h[more] + delta[extra]]
    if probe:
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    return owner, _mix(h)


def window_chunks(image: np.ndarray, cat: np.ndarray, boxes: list[np.ndarray], grid: float, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first object, digest) of the windows of two objects that follow each other in an image.

    Objects come sorted by (image, category, left edge). A build side has the windows as they
    stand. A probe side has every two objects that can follow each other once each box has moved
    by NEAR (none surely lies between them), in every cell the boxes can then lie in.
    """
    n = len(image)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    new_image = np.r_[True, image[1:] != image[:-1]]
    block = np.cumsum(new_image | np.r_[True, cat[1:] != cat[:-1]])
    ends = np.r_[np.flatnonzero(new_image)[1:], n]
    end = ends[np.cumsum(new_image) - 1]
    index = np.arange(n)
    if not probe:
        first = index[index + 1 < end]
        _, h = _digests(cat, boxes, grid, False)
        return first, _mix(h[first] + h[first + 1])
    place = block * 4.0 + np.clip(boxes[0], -1, 2) + 1
    sure = np.r_[np.searchsorted(place, place + 2 * NEAR + 2 * _SLACK, side="right"), n]
    stop = np.minimum(sure[sure[:-1]], end)
    count = np.maximum(stop - index - 1, 0)
    first = np.repeat(index, count)
    second = first + 1 + (np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count))
    owner, h = _digests(cat, boxes, grid, True)
    per = np.bincount(owner, minlength=n)
    start = np.cumsum(per) - per
    ways = per[first] * per[second]
    pair = np.repeat(np.arange(len(first)), ways)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(ways) - ways, ways)
    a, b = first[pair], second[pair]
    return a, _mix(h[start[a] + k // per[b]] + h[start[b] + k % per[b]])


def content_chunks(image: np.ndarray, cat: np.ndarray, boxes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of an object of the image, digest, length) of the content-defined chunks of normalised records.

    A record is the sequence of an image's objects, as category and cells of NEAR of its box, in
    their own order. A hash rolls over every two objects that follow each other, and a chunk ends
    where the hash is less than both its neighbours; so cuts depend on the objects around them only,
    come every three objects or so and never follow each other at once. A chunk that a record has
    several times gets a digest for each, so that joining digests counts it as often as both have it.
    """
    n = len(image)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cells = [np.floor(f / NEAR).astype(np.int64) for f in boxes]
    order = np.lexsort((*reversed(cells), cat, image))
    image, cat, cells = image[order], cat[order], [c[order] for c in cells]
    unit = _mix(cat.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))
    for d, c in enumerate(cells):
        unit = _mix(unit + _cell_hash(d, c))
    first = np.r_[True, image[1:] != image[:-1]]
    start = np.flatnonzero(first)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    rolled = np.r_[top, _mix(unit[:-1] * np.uint64(31) + unit[1:])]
    rolled[first] = top  # a record's first object has none before it
    after = np.r_[rolled[1:], top]
    cut = (rolled < np.r_[top, rolled[:-1]]) & (rolled <= after)
    begin = np.flatnonzero(first | np.r_[False, cut[:-1]])
    length = np.diff(np.r_[begin, n])
    place = np.arange(n) - np.repeat(begin, length)
    digest = np.add.reduceat(_mix(unit * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), begin)
    digest = _mix(digest + length.astype(np.uint64))
    # the how-manieth of its kind in the record
    record = np.searchsorted(start, begin, side="right")
    by = np.lexsort((digest, record))
    same = np.r_[False, (record[by][1:] == record[by][:-1]) & (digest[by][1:] == digest[by][:-1])]
    run = np.arange(len(by)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    times = np.empty(len(by), np.int64)
    times[by] = run
    return order[begin], _mix(digest + times.astype(np.uint64)), length


def list_digests(image: np.ndarray, cat: np.ndarray, boxes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of an object, digest) of whole lists, equal for lists of the very same objects in any order."""
    if not len(image):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    unit = _mix(cat.astype(np.int64).view(np.uint64) + np.uint64(0x2545F491))
    for d, f in enumerate(boxes):
        unit = _mix(unit + _mix((f + 0.0).view(np.uint64) + np.uint64(d)))
    start = np.flatnonzero(np.r_[True, image[1:] != image[:-1]])
    return start, _mix(np.add.reduceat(_mix(unit), start))


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content-defined chunks (length 1 and more) and whole-list digests (length 0) of a partition sorted by image."""
    yield from _per_image(batches, _record_batch)


def _record_batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    image, n, cat, *boxes = cols
    at, digest, length = content_chunks(image, cat, boxes)
    whole, own = list_digests(image, cat, boxes)
    at, digest, length = np.r_[at, whole], np.r_[digest, own], np.r_[length, np.zeros(len(whole), np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(image[at]), pa.array(n[at]), pa.array(digest.view(np.int64)), pa.array(length.astype(np.int32))], names=["image", "n", "digest", "length"])


def _per_image(batches: Iterator[pa.RecordBatch], emit: Callable[[list[np.ndarray]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``emit`` over batches of whole images, of a partition sorted by image; an image cut by a batch border is carried on."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.r_[a, b] for a, b in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
        if cut:
            yield emit([x[:cut] for x in now])
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield emit(held)


def _chunk_rows(grid: float, probe: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of a partition sorted by (image, category, left edge)."""

    def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
        image, n, cat, *boxes = cols
        first, digest = window_chunks(image, cat, boxes, grid, probe)
        return pa.RecordBatch.from_arrays([pa.array(image[first]), pa.array(n[first]), pa.array(first.astype(np.int32)), pa.array(digest.view(np.int64))], names=["image", "n", "at", "digest"])

    return lambda batches: _per_image(batches, emit)


# ---------------------------------------------------------------- exact comparison
def greatest_matching(edges: list[list[int]], need: int | None = None) -> int:
    """Size of a greatest one-to-one matching, or a number on the right side of ``need`` as soon as it is known.

    A greedy matching is improved along augmenting paths, found by depth-first search without recursion.
    """
    mate: dict[int, int] = {}
    right: list[int | None] = [None] * len(edges)
    for i in sorted(range(len(edges)), key=lambda i: len(edges[i])):
        for j in edges[i]:
            if j not in mate:
                mate[j], right[i] = i, j
                break
    size = len(mate)
    free = [i for i in range(len(edges)) if right[i] is None and edges[i]]
    for done, root in enumerate(free):
        if need is not None and (size >= need or size + len(free) - done < need):
            return size
        came: dict[int, int] = {}
        stack, end = [(root, iter(edges[root]))], None
        while stack and end is None:
            i, rest = stack[-1]
            for j in rest:
                if j in came:
                    continue
                came[j] = i
                if j not in mate:
                    end = j
                else:
                    stack.append((mate[j], iter(edges[mate[j]])))
                break
            else:
                stack.pop()
        if end is None:
            continue
        size += 1
        j: int | None = end
        while j is not None:
            i = came[j]
            mate[j], right[i], j = i, j, right[i]
    return size


def matched(a: list[tuple], b: list[tuple]) -> int:
    """Greatest number of objects (category, four numbers) of two lists that match one to one."""
    by_cat: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        by_cat.setdefault(y[0], []).append(j)
    near = NEAR + _SLACK
    return greatest_matching([[j for j in by_cat.get(x[0], ()) if all(abs(p - q) <= near for p, q in zip(x[1:], b[j][1:], strict=True))] for x in a])


def least_matches(n: int) -> int:
    return math.ceil(SHARE * n - 1e-9)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep_a, keep_b = [], []
        for a, b, na, nb, xs, ys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if matched([tuple(x.values()) for x in xs], [tuple(y.values()) for y in ys]) >= least_matches(max(na, nb)):
                keep_a.append(a)
                keep_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["src", "dst"])


# ---------------------------------------------------------------- links
def object_lists(annotations: DataFrame, images: DataFrame) -> tuple[DataFrame, int]:
    """``(image, n, id, cat, fx, fy, fw, fh)`` of images with MIN_OBJECTS or more annotation ids, as a written table; and the number of annotation rows.

    Of a redelivered annotation the latest row counts. Objects without category or with boxes that
    can't be put in shares of the image count in ``n`` but not as rows: nothing matches them.
    Images of a great share of all objects are joined apart from the rest.
    """
    spark = annotations.sparkSession
    total = annotations.count()
    sizes = latest_rows(annotations, "id", "ingested_at", ["id", "image_id"]).filter("image_id is not null").groupBy(F.col("image_id").alias("image")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_OBJECTS)
    frames = images.select(F.col("id").alias("image"), "width", "height").filter("width > 0 and height > 0").join(sizes, "image")
    path = scratch_path(spark, "frames")
    frames.write.parquet(path)
    frames = spark.read.parquet(path)
    boxes = ["box_x_min", "box_y_min", "box_width", "box_height"]
    latest = latest_rows(annotations, "id", "ingested_at", ["id", "image_id", "category_id", *boxes]).filter("category_id is not null and image_id is not null")
    hot = [r[0] for r in frames.filter(F.col("n") > HOT_SHARE * total).select("image").collect()]
    is_hot = F.col("image_id").isin(hot) if hot else F.lit(False)
    on = F.col("image_id") == F.col("image")
    joined = latest.filter(~is_hot).join(frames, on)
    if hot:
        joined = joined.unionByName(latest.filter(is_hot).join(F.broadcast(frames.filter(F.col("image").isin(hot))), on))
    shares = [(F.col(b) / F.col(w)).alias(c) for b, w, c in zip(boxes, ["width", "height", "width", "height"], _BOX, strict=True)]
    shares_ok = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < 1e6" for c in _BOX)
    out = scratch_path(spark, "objects")
    joined.select("image", F.col("n").cast("int").alias("n"), "id", F.col("category_id").cast("int").alias("cat"), *shares).filter(shares_ok).write.parquet(out)
    return spark.read.parquet(out), total


def record_chunks(objects: DataFrame) -> DataFrame:
    """``(image, n, digest, length)`` of every record, as a written table: its content-defined chunks, and with length 0 the digest of its whole list."""
    ready = objects.select("image", "n", "cat", *_BOX).repartition("image").sortWithinPartitions("image")
    path = scratch_path(objects.sparkSession, "chunks")
    ready.mapInArrow(_record_rows, "image bigint, n int, digest bigint, length int").write.parquet(path)
    return objects.sparkSession.read.parquet(path)


def identical_lists(chunks: DataFrame) -> DataFrame:
    """``(src, dst)``: an image and the smallest image that has the very same list, where that is another one; as a written table."""
    whole = chunks.filter("length = 0").withColumn("list", F.xxhash64("digest", "n"))
    least = whole.groupBy("list").agg(F.min("image").alias("least"), F.count(F.lit(1)).alias("__k")).filter(F.col("__k") > 1)
    path = scratch_path(chunks.sparkSession, "copies")
    join_one(whole.select("list", "image"), least, "list").filter("image <> least").select(F.col("image").alias("src"), F.col("least").alias("dst")).write.parquet(path)
    return chunks.sparkSession.read.parquet(path)


def chunk_links(chunks: DataFrame, copies: DataFrame) -> DataFrame:
    """Links that shared chunk lengths prove: three quarters of the longer list lie in chunks that both images have.

    Objects of one chunk digest have one category and lie in the same cells of NEAR, so they match
    one to one. Every digest is compared with its smallest image only, so the work is linear in the
    chunks however many images share one; what that leaves, and what a shift by less than NEAR has
    moved over a cell's border, is found by the windows (``short_list_links``, ``long_list_links``).
    """
    own = chunks.filter("length > 0").join(copies.select(F.col("src").alias("image")), "image", "left_anti")
    least = own.groupBy("digest").agg(F.min("image").alias("least"), F.min_by("n", "image").alias("m"), F.count(F.lit(1)).alias("__k")).filter(F.col("__k") > 1)
    shared = join_one(own, least, "digest").filter("image <> least").groupBy("image", "least", "n", "m").agg(F.sum("length").alias("shared"))
    return shared.filter(F.col("shared") >= F.ceil(F.greatest("n", "m") * SHARE - _SLACK)).select(F.col("image").alias("src"), F.col("least").alias("dst"))


def split_overlap(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """``(image_id, split, source, n_objects, shared_objects, overlap)`` of every valid or eval image with MIN_OBJECTS objects or more, one of them with a usable box at least.

    ``shared_objects`` is the summed length of its chunks that images of the train split have too,
    wherever in the split they are, ``overlap`` its share of the list: 1 means that train holds all
    of the record's chunks. Digests of train are made distinct before the join; null splits take no part.
    """
    now = _latest_images(images)
    objects, _ = object_lists(annotations, now)
    named = now.select(F.col("id").alias("image"), split_name(F.col("split")).alias("split"), F.lower(F.trim("source")).alias("source"))
    chunks = record_chunks(objects).filter("length > 0").join(named.select("image", "split"), "image")
    train = chunks.filter("split = 'train'").select("digest").distinct().withColumn("in_train", F.lit(True))
    held = chunks.filter("split in ('valid', 'eval')").select("image", "digest", "length")
    shared = held.join(train, "digest", "left").groupBy("image").agg(F.sum(F.when(F.col("in_train"), F.col("length")).otherwise(0)).alias("shared"))
    sizes = objects.select("image", "n").distinct()
    return named.filter("split in ('valid', 'eval')").join(sizes, "image").join(shared, "image").select(F.col("image").cast("bigint").alias("image_id"), "split", "source", F.col("n").alias("n_objects"), F.col("shared").alias("shared_objects"), (F.col("shared") / F.col("n")).alias("overlap"))


def _ratio_ok(a: str, b: str) -> Column:
    return F.least(a, b) >= F.ceil(F.greatest(a, b) * SHARE - _SLACK)


def short_list_links(objects: DataFrame, total: int, proven: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` between images of up to LONG_LIST objects; pairs that are ``proven`` are not compared again.

    Two lists of lengths p and q of which m objects match have at least 3 m - p - q - 1 windows of
    two neighbours in common, and that is 1 or more for every m the rule asks for; so joining the
    digests of windows and adding up the shared ones loses no pair. What passes is matched exactly.
    """
    grid = min(0.2, max(0.03, GRID * (max(total, 1) / GRID_ROWS) ** -0.125))
    short = objects.filter(F.col("n") <= LONG_LIST)
    ready = short.select("image", "n", "cat", *_BOX).repartition("image").sortWithinPartitions("image", "cat", "fx")
    schema = "image bigint, n int, at int, digest bigint"
    build = ready.mapInArrow(_chunk_rows(grid, False), schema).alias("b")
    probe = ready.mapInArrow(_chunk_rows(grid, True), schema).select("image", "n", "digest").alias("p")
    met = probe.join(build, (F.col("p.digest") == F.col("b.digest")) & (F.col("p.image") < F.col("b.image")) & _ratio_ok("p.n", "b.n"))
    shared = met.select(F.col("p.image").alias("a"), F.col("b.image").alias("b"), F.col("p.n").alias("na"), F.col("b.n").alias("nb"), "at").distinct().groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("windows"))
    need = F.greatest(F.lit(1), 3 * F.ceil(F.greatest("na", "nb") * SHARE - _SLACK) - F.col("na") - F.col("nb") - 1)
    path = scratch_path(objects.sparkSession, "candidates")
    shared.filter(F.col("windows") >= need).select("a", "b", "na", "nb").write.parquet(path)
    known = proven.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = objects.sparkSession.read.parquet(path).join(known, ["a", "b"], "left_anti")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("image")).distinct()
    lists = short.join(asked, "image", "left_semi").groupBy("image").agg(F.collect_list(F.struct("cat", *_BOX)).alias("objs"))
    one = lists.select(F.col("image").alias("a"), F.col("objs").alias("xs"))
    two = lists.select(F.col("image").alias("b"), F.col("objs").alias("ys"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "xs", "ys").mapInArrow(_verify, "src bigint, dst bigint")


def _single_rows(grid: float, probe: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image, n, ident, cat, *boxes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            owner, digest = _digests(cat, boxes, grid, probe)
            cols = [image[owner], n[owner], ident[owner], digest.view(np.int64), cat[owner], *(f[owner] for f in boxes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["image", "n", "id", "digest", "cat", *_BOX])

    return run


def long_images(objects: DataFrame, classes: DataFrame | None = None) -> DataFrame | None:
    """``(image,)``: images whose lengths allow a match with another where one at least has more than LONG_LIST objects; None if there are none.

    Lengths fall into classes of a hundredth of a power of e; the classes (some thousand at most) are
    set against each other on the driver, never the images. With ``classes`` (``image_id, class_id,
    split``) only images count that could bring a train and a held-out image together: image
    classes are linked with their length classes, and these with each other; where a component so
    joined has no train image, or no valid or eval image, no outcome changes a result across splits.
    """
    spark = objects.sparkSession
    sizes = objects.filter(F.col("n") >= SHARE * LONG_LIST).select("image", "n").distinct().withColumn("length", F.floor(F.log("n") * 100).cast("bigint"))
    path = scratch_path(spark, "long")
    sizes.write.parquet(path)
    sizes = spark.read.parquet(path)
    found = sorted(few_rows(sizes.groupBy("length").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("k")), "classes of list lengths"), key=lambda r: r["length"])
    pairs = [(a["length"], b["length"]) for i, a in enumerate(found) for b in found[i:] if b["high"] > LONG_LIST and a["high"] >= SHARE * b["low"] - _SLACK and (a is not b or a["k"] > 1)]
    if not pairs:
        return None
    meet = sorted({x for p in pairs for x in p})
    wanted = sizes.filter(F.col("length").isin(meet))
    if classes is None:
        return wanted.select("image")
    at = wanted.join(classes.select(F.col("image_id").alias("image"), "class_id", "split"), "image")
    lengths = spark.createDataFrame([(-1 - a, -1 - b) for a, b in pairs], "src bigint, dst bigint")
    parts = connected_components(at.select(F.col("class_id").alias("src"), (-1 - F.col("length")).alias("dst")).distinct().unionByName(lengths))
    whole = classes.join(parts, F.col("class_id") == F.col("node")).groupBy("component").agg(F.bool_or(F.col("split") == "train").alias("t"), F.bool_or(F.col("split").isin("valid", "eval")).alias("h")).filter("t and h")
    mixed = parts.join(whole, "component").select(F.col("node").alias("class_id"))
    path = scratch_path(spark, "matter")
    at.join(mixed, "class_id", "left_semi").select("image").distinct().write.parquet(path)
    out = spark.read.parquet(path)
    return None if out.isEmpty() else out


def long_list_links(objects: DataFrame, images: DataFrame) -> DataFrame | None:
    """Links between ``images`` of which one has more than LONG_LIST objects, by chunks of single objects; None where there is none.

    Of a list of n objects at most a quarter may lack a partner, so among any 30 % of them a
    twentieth of n has one. The objects of the list's rarest categories probe all objects of the
    other. Images that pass are compared by all their objects: the pairs within NEAR are counted
    from both sides (an upper bound) and as pairs without rivals (a lower bound); only where these
    leave it open are the pairs of the two images matched in one task.
    """
    spark = objects.sparkSession
    long = objects.filter(F.col("n") >= SHARE * LONG_LIST)
    long = long.join(images, "image", "left_semi")
    schema = "image bigint, n int, id bigint, digest bigint, cat int, fx double, fy double, fw double, fh double"
    columns = ["image", "n", "id", "cat", *_BOX]
    grid = 0.04
    # the rarest categories of each image that together hold 30 % of its list: a bounded count per (image, category)
    per = long.groupBy("image", "n", "cat").agg(F.count(F.lit(1)).alias("k"))
    rare = per.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("image").orderBy("k", "cat").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < 0.3 * F.col("n"))
    first = long.join(rare.select("image", "cat"), ["image", "cat"], "left_semi")
    build = long.select(*columns).mapInArrow(_single_rows(grid, False), schema)

    def meetings(of: DataFrame, among: DataFrame) -> DataFrame:
        p = of.select(*columns).mapInArrow(_single_rows(grid, True), schema).alias("p")
        close = [F.abs(F.col(f"p.{c}") - F.col(f"b.{c}")) <= NEAR + _SLACK for c in _BOX]
        on = (F.col("p.digest") == F.col("b.digest")) & (F.col("p.cat") == F.col("b.cat")) & (F.col("p.image") < F.col("b.image")) & _ratio_ok("p.n", "b.n") & (F.greatest("p.n", "b.n") > LONG_LIST) & close[0] & close[1] & close[2] & close[3]
        return p.join(among.alias("b"), on).select(F.col("p.image").alias("a"), F.col("b.image").alias("b"), F.col("p.n").alias("na"), F.col("b.n").alias("nb"), F.col("p.id").alias("x"), F.col("b.id").alias("y"))

    tried = rare.groupBy("image").agg(F.sum("k").alias("probes"))
    hits = meetings(first, build).groupBy("a", "b", "na", "nb").agg(F.count_distinct("x").alias("hits"))
    enough = F.col("probes") - (F.col("na") - F.ceil(F.greatest("na", "nb") * SHARE - _SLACK))
    likely = hits.join(tried, F.col("a") == F.col("image")).filter(F.col("hits") >= F.greatest(F.lit(1), enough)).select("a", "b", "na", "nb")
    path = scratch_path(spark, "likely")
    likely.write.parquet(path)
    likely = spark.read.parquet(path)
    if likely.isEmpty():
        return None
    chosen = likely.select(F.explode(F.array("a", "b")).alias("image")).distinct()
    rest = long.join(chosen, "image", "left_semi")
    close = meetings(rest, rest.select(*columns).mapInArrow(_single_rows(grid, False), schema)).join(likely.select("a", "b"), ["a", "b"], "left_semi")
    path = scratch_path(spark, "close")
    close.write.parquet(path)
    close = spark.read.parquet(path)
    x = close.groupBy("a", "b", "na", "nb", "x").agg(F.count(F.lit(1)).alias("dx"))
    y = close.groupBy("a", "b", "y").agg(F.count(F.lit(1)).alias("dy"))
    marked = close.join(x.select("a", "b", "x", "dx"), ["a", "b", "x"]).join(y, ["a", "b", "y"]).select("a", "b", "na", "nb", "x", "y", "dx", "dy")
    path = scratch_path(spark, "marked")
    marked.write.parquet(path)
    marked = spark.read.parquet(path)
    # a pair without rivals belongs to some greatest matching, so the others are matched for what is left to reach
    rivals = F.expr("dx > 1 or dy > 1")
    bound = marked.groupBy("a", "b", "na", "nb").agg(F.sum(1 / F.col("dx")).alias("ux"), F.sum(1 / F.col("dy")).alias("uy"), F.count_if(~rivals).alias("lower"))
    need = F.ceil(F.greatest("na", "nb") * SHARE - _SLACK)
    bound = bound.select("a", "b", F.round("ux").alias("ux"), F.round("uy").alias("uy"), "lower", need.alias("least"))
    open_ = bound.filter((F.least("ux", "uy") >= F.col("least")) & (F.col("lower") < F.col("least"))).select("a", "b", (F.col("least") - F.col("lower")).cast("bigint").alias("need"))
    sure = bound.filter(F.col("lower") >= F.col("least")).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    def settle(pdf):  # noqa: ANN001, ANN202
        edges: dict[int, list[int]] = {}
        for i, j in zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True):
            edges.setdefault(i, []).append(j)
        need = int(pdf["need"].iloc[0])
        ok = greatest_matching(list(edges.values()), need) >= need
        return pdf[["a", "b"]].head(1 if ok else 0).rename(columns={"a": "src", "b": "dst"})

    settled = marked.filter(rivals).select("a", "b", "x", "y").join(open_, ["a", "b"]).groupBy("a", "b").applyInPandas(settle, "src bigint, dst bigint")
    path = scratch_path(spark, "long-links")
    sure.unionByName(settled).write.parquet(path)  # it is read twice, and must be made once
    return spark.read.parquet(path)


def name_keys(images: DataFrame, name: str = "file_name") -> DataFrame:
    """``(id, frame, place, caption)``: what a name says, null where it says nothing."""
    base = images.select("id", frame_key(F.col(name)).alias("frame"), caption_of(F.col(name)).alias("cap"))
    own = F.col("frame").isNull()
    return base.select("id", "frame", F.when(own, F.col("cap.place")).alias("place"), F.when(own, F.col("cap.caption")).alias("caption"))


def name_links(keys: DataFrame) -> DataFrame:
    """Links between images whose names (``name_keys``) give the same frame, or the same place and serial and captions one letter apart.

    Equal frames are linked to the smallest image that has the frame. Captions are compared once
    per distinct (place, caption): the chunks are the caption itself and the caption less one
    letter, so two captions one letter apart share a chunk; what shares one is measured exactly.
    At most 26 times its length plus one captions can share a chunk, however many images do.
    """
    frames = keys.filter("frame is not null").select("id", "frame")
    by_frame = frames.join(frames.groupBy("frame").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "frame").select(F.col("id").alias("src"), F.col("least").alias("dst"))
    captions = keys.filter("place is not null").select("id", "place", "caption")
    classes = captions.groupBy("place", "caption").agg(F.min("id").alias("least"))
    equal = captions.join(classes, ["place", "caption"]).select(F.col("id").alias("src"), F.col("least").alias("dst"))
    less_one = F.transform(F.sequence(F.lit(1), F.length("caption")), lambda i: F.concat(F.substring(F.col("caption"), F.lit(1), i - 1), F.substring(F.col("caption"), i + 1, F.length("caption"))))
    alone = classes.groupBy("place").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("place")
    chunks = classes.join(alone, "place", "left_semi").select("place", "caption", "least", F.explode(F.array_distinct(F.array_append(less_one, F.col("caption")))).alias("chunk"))
    a, b = chunks.alias("a"), chunks.alias("b")
    on = (F.col("a.place") == F.col("b.place")) & (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.caption") < F.col("b.caption"))
    typo = a.join(b, on).filter(F.levenshtein("a.caption", "b.caption", 1) >= 0).select(F.col("a.least").alias("src"), F.col("b.least").alias("dst"))
    return by_frame.unionByName(equal).unionByName(typo).filter("src <> dst")


def picture_classes(images: DataFrame, annotations: DataFrame, across: bool = False) -> DataFrame:
    """``(image_id, class_id, split, source)``: images that hold the same picture share ``class_id``, the smallest image id of the class.

    Same names, same object lists (by shared lengths of content-defined chunks, and by windows and
    exact matching where these do not settle it), and both together through any third image. One row per image id
    (its latest row); images without an id are left out. Images without objects, names that tell
    nothing, null splits and sizes, and empty tables are fine; other columns play no part. Every
    link is found (see the link functions), none is capped. ``across``: for cross-split use only;
    lists of more than LONG_LIST objects are left uncompared where no outcome could bring a train
    and a held-out image together, so that their classes may be incomplete.
    """
    now = _latest_images(images)
    spark = images.sparkSession
    objects, total = object_lists(annotations, now)
    names = scratch_path(spark, "names")
    name_keys(now).write.parquet(names)
    chunks = record_chunks(objects)
    copies = identical_lists(chunks)
    # images of the very same list have the same links: the smallest stands for all
    lists = objects.join(copies.select(F.col("src").alias("image")), "image", "left_anti")
    path = scratch_path(spark, "proven")
    chunk_links(chunks, copies).write.parquet(path)
    proven = spark.read.parquet(path)
    path = scratch_path(spark, "links")
    name_links(spark.read.parquet(names)).unionByName(copies).unionByName(proven).unionByName(short_list_links(lists, total, proven)).distinct().write.parquet(path)
    edges = spark.read.parquet(path)
    classes = _classes(now, edges)
    long = long_images(lists, classes if across else None)
    links = None if long is None else long_list_links(lists, long)
    return classes if links is None else _classes(now, edges.unionByName(links))


def _latest_images(images: DataFrame) -> DataFrame:
    path = scratch_path(images.sparkSession, "images")
    latest_rows(images, "id", "ingested_at", ["id", "file_name", "split", "source", "width", "height"]).write.parquet(path)
    return images.sparkSession.read.parquet(path)


def _classes(images: DataFrame, edges: DataFrame) -> DataFrame:
    parts = connected_components(edges)
    return images.join(parts, F.col("id") == F.col("node"), "left").select(F.col("id").cast("bigint").alias("image_id"), F.coalesce("component", "id").cast("bigint").alias("class_id"), split_name(F.col("split")).alias("split"), F.lower(F.trim("source")).alias("source"))


def cross_split_pairs(classes: DataFrame) -> DataFrame:
    """``(image_id_a, image_id_b)``, a < b: one in train, the other in valid or eval, both of one class."""
    train = classes.filter("split = 'train'").select("class_id", F.col("image_id").alias("t"))
    held = classes.filter("split in ('valid', 'eval')").select("class_id", F.col("image_id").alias("h"))
    return train.join(held, "class_id").select(F.least("t", "h").alias("image_id_a"), F.greatest("t", "h").alias("image_id_b"))


def cross_split_report(classes: DataFrame) -> DataFrame:
    """Per held-out split and source: ``(split, source, n_images, n_in_train, n_pairs)``, counted per class without listing pairs."""
    per = classes.groupBy("class_id").agg(F.count_if(F.col("split") == "train").alias("in_train"))
    held = classes.filter("split in ('valid', 'eval')").groupBy("class_id", "split", "source").agg(F.count(F.lit(1)).alias("n"))
    return held.join(per, "class_id").groupBy("split", "source").agg(F.sum("n").alias("n_images"), F.sum(F.when(F.col("in_train") > 0, F.col("n")).otherwise(0)).alias("n_in_train"), F.sum(F.col("n") * F.col("in_train")).alias("n_pairs"))
