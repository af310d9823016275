"""Train and validation splits: random, kept apart by groups, balanced by histograms."""

from __future__ import annotations

import itertools
import math
import random
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.groups import Group, group_name, with_groups
from framewright.model import Dataset
from framewright.operators.components import connected_components, value_edges
from framewright.operators.histograms import histogram_distance, share_distance
from framewright.operators.numbering import hashed_rank
from framewright.session import cut, few_rows

#: Chunk profiles (size, wanted split and histogram) planned one by one: those of most rows. Chunks of rarer profiles are
#: planned by class (size class and fullest bin), with the exact sums of their histograms.
MAX_PROFILES = 1000
#: Histogram bins a plan may have; more raise an error that says so.
MAX_BINS = 10_000


def check_target(names: list[str], shares: list[float]) -> None:
    if len(names) < 2 or len(names) != len(shares):
        raise ValueError("two or more splits, and a share for each")
    if abs(sum(shares) - 1) > 1e-9 or min(shares) < 0:
        raise ValueError("shares must be non-negative and sum to 1")


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def simple_split(df: DataFrame, names: list[str], shares: list[float], seed: int = 0, split: str = "split") -> DataFrame:
    """Rows without one of the wanted splits draw one, with what is left of the shares; the draw depends on id and seed only."""
    check_target(names, shares)
    has = {r[0]: r[1] for r in df.groupBy(split).count().collect()} if split in df.columns else {None: df.count()}
    total = sum(has.values())
    left = [max(0.0, s * total - has.get(n, 0)) for n, s in zip(names, shares, strict=True)]
    if any(has.get(n, 0) > s * total + 1e-9 for n, s in zip(names, shares, strict=True)):
        warnings.warn("a split is over its target already", stacklevel=2)
    if sum(left) == 0:
        left = list(shares)
    at, pick = np.cumsum(left) / sum(left), F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        pick = F.when(uniform(seed, "id") < float(at[i]), F.lit(names[i])).otherwise(pick)
    kept = F.when(F.col(split).isin(names), F.col(split)).otherwise(pick) if split in df.columns else pick
    return df.withColumn(split, kept)


def _components(ids: DataFrame, edges: DataFrame | None) -> DataFrame:
    """``(id, chunk)`` for all of ``ids``: the smallest id that edges connect it with."""
    if edges is None:
        return ids.withColumn("chunk", F.col("id"))
    parts = connected_components(edges.filter("src <> dst").distinct())
    return ids.join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("chunk"))


def _wanted(chunks: DataFrame, rows: DataFrame, split: str, names: list[str]) -> DataFrame:
    """``chunks`` and ``wanted``: the one split a chunk's rows have among ``names``; null where they have none, or several."""
    mine = rows.select(F.col("id").cast("bigint").alias("id"), F.when(F.col(split).isin(names), F.col(split)).alias("s"))
    per = chunks.join(mine, "id").groupBy("chunk").agg(F.min("s").alias("a"), F.max("s").alias("b")).select("chunk", F.when(F.col("a") == F.col("b"), F.col("a")).alias("wanted"))
    return chunks.join(per, "chunk").select("id", "chunk", "wanted")


def atomic_chunks(df: DataFrame, groups: list[str], split: str | None = None, names: list[str] | None = None) -> DataFrame:
    """``(id, chunk[, wanted])``: rows that share a non-null value in any group column, directly or through others.

    ``chunk`` is the smallest id. ``wanted`` is the one split a chunk's rows have among ``names``;
    null where they have none, or several.
    """
    edges: DataFrame | None = None
    for g in groups:
        one = value_edges(df.select(F.col("id").cast("bigint").alias("id"), F.col(f"`{g}`").alias("v")), "v")
        edges = one if edges is None else edges.unionByName(one)
    ids = df.select(F.col("id").cast("bigint").alias("id"))
    if edges is not None and len(groups) == 1:
        # one column alone makes no chains
        out = ids.join(edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("least")), "id", "left").select("id", F.coalesce("least", "id").alias("chunk"))
    else:
        out = _components(ids, edges)
    return out if split is None else _wanted(out, df, split, names or [])


def choose_split(state: list[np.ndarray], sizes: np.ndarray, add: np.ndarray, size: float, target: np.ndarray, shares: np.ndarray, distance, current: list[float], hist_weight: float, share_weight: float) -> tuple[int, float]:  # noqa: ANN001
    """The split whose histogram and share suffer least when a chunk is added: (its number, its new histogram distance)."""
    k = len(state)
    grown = [distance(target, state[j] + add) for j in range(k)]
    hist = [sum(c for i, c in enumerate(current) if i != j) + grown[j] for j in range(k)]
    share = []
    for j in range(k):
        now = sizes.copy()
        now[j] += size
        share.append(share_distance(shares, now))
    costs = share if not any(math.isfinite(h) for h in hist) else [hist_weight * h + share_weight * s for h, s in zip(hist, share, strict=True)]
    j = min(range(k), key=lambda j: (costs[j], j))
    return j, grown[j]


def _weights(groups: list[Group], weights: list[float] | float | None) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the category groups, and of the continuous ones."""
    if weights is None or isinstance(weights, int | float):
        weights = [1.0 if weights is None else float(weights)] * len(groups)
    if len(weights) != len(groups):
        raise ValueError("one weight for each balanced group")
    pairs = list(zip(groups, weights, strict=True))
    return {g: float(w) for g, w in pairs if isinstance(g, str)}, {group_name(g): float(w) for g, w in pairs if not isinstance(g, str)}


def plan_chunks(
    chunks: DataFrame, cells: DataFrame | None, names: list[str], shares: list[float], keep_balanced: list[Group], seed: int = 0,
    hist_weight: float = 1.0, share_weight: float = 1.0, weights: list[float] | float | None = None, regularization: float = 0.0,
) -> DataFrame:
    """``(chunk, split)`` for ``chunks`` (``chunk, size, wanted``) whose histograms are ``cells`` (``chunk, b0, b1..., n``).

    Chunks of one size, wanted split and histogram are one profile; the MAX_PROFILES profiles of
    most rows are planned as they are. Chunks of rarer profiles are planned by class: by wanted
    split, power-of-two size and fullest bin, with the exact sums of sizes and histograms. So the
    plan's length is bounded, however many chunks there are, and none is left out. Every profile is
    dealt out in proportion to the shares that wanted splits leave, and what whole chunks leave over
    goes, largest first, where histograms and shares suffer least. Members follow a hash.
    """
    cols = [group_name(g) for g in keep_balanced]
    bins = [f"b{i}" for i in range(len(cols))]
    per = chunks
    if cells is not None:
        bin_rows = few_rows(cells.groupBy(*bins).agg(F.sum("n").alias("n")), "histogram bins", MAX_BINS)
        hist = cells.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(*bins, "n"))).alias("hist"), F.max(F.struct("n", *bins)).alias("top"))
        per = per.join(hist, "chunk", "left")
    else:
        bin_rows = []
        per = per.withColumn("hist", F.lit(None).cast("array<struct<n:bigint>>")).withColumn("top", F.lit(None).cast("struct<n:bigint>"))
    exact = F.xxhash64("size", F.coalesce("wanted", F.lit("")), F.to_json(F.struct("hist")))
    top = F.struct(*(F.col(f"top.{b}").alias(b) for b in bins)) if bins and cells is not None else F.lit(0)
    classed = F.xxhash64(F.lit("class"), F.floor(F.log2(F.greatest("size", F.lit(1)))), F.coalesce("wanted", F.lit("")), F.to_json(F.struct(top.alias("x"))))
    per = cut(per.select("chunk", "size", "wanted", "hist", exact.alias("exact"), classed.alias("classed")))
    common = per.groupBy("exact").agg(F.sum("size").alias("rows")).orderBy(F.col("rows").desc(), "exact").limit(MAX_PROFILES).select("exact", F.lit(True).alias("kept"))
    named = cut(per.join(F.broadcast(common), "exact", "left").withColumn("profile", F.when(F.col("kept"), F.col("exact")).otherwise(F.col("classed"))).drop("exact", "classed", "kept"))
    found = sorted(named.groupBy("profile").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("size"), F.first("wanted").alias("wanted")).collect(), key=lambda r: r["profile"])

    cell_of: dict[tuple, int] = {}
    for r in bin_rows:
        cell_of.setdefault(tuple(_plain(v) for v in r[:-1]), len(cell_of))
    cells_list = list(cell_of)
    vectors = {r["profile"]: np.zeros(len(cell_of)) for r in found}
    if cells is not None:
        sums = named.select("profile", F.inline("hist")).groupBy("profile", *bins).agg(F.sum("n").alias("n"))
        for r in sums.collect():
            vectors[r["profile"]][cell_of[tuple(_plain(v) for v in r[1:-1])]] += r["n"]
    category, continuous = _weights(keep_balanced, weights)

    def distance(a: np.ndarray, b: np.ndarray) -> float:
        return histogram_distance(a, b, cells_list, cols, category, continuous, regularization) if cols else 0.0

    target = sum(vectors.values(), np.zeros(len(cell_of)))
    total = sum(r["size"] for r in found)
    state, sizes = [np.zeros(len(cell_of)) for _ in names], np.zeros(len(names))
    plan: dict[int, list[int]] = {r["profile"]: [0] * len(names) for r in found}

    def put(r, j: int, n: int) -> None:  # noqa: ANN001
        state[j] = state[j] + vectors[r["profile"]] * (n / r["k"])
        sizes[j] += r["size"] * n / r["k"]
        plan[r["profile"]][j] += n

    free = []
    for r in found:
        if r["wanted"] in names:
            put(r, names.index(r["wanted"]), r["k"])
        else:
            free.append(r)
    left = np.maximum(0.0, np.asarray(shares, float) * total - sizes)
    part = left / left.sum() if left.sum() else np.asarray(shares, float)
    for r in free:
        for j in range(len(names)):
            if n := math.floor(r["k"] * part[j] + 1e-9):
                put(r, j, n)
    todo = [r for r in free for _ in range(r["k"] - sum(plan[r["profile"]]))]
    random.Random(seed).shuffle(todo)
    todo.sort(key=lambda r: -r["size"] / r["k"])
    current = [distance(target, s) for s in state]
    goal = np.asarray(shares, float)
    for r in todo:
        j, now = choose_split(state, sizes, vectors[r["profile"]] / r["k"], r["size"] / r["k"], target, goal, distance, current, hist_weight, share_weight)
        put(r, j, 1)
        current[j] = now
    ends = chunks.sparkSession.createDataFrame([(p, list(itertools.accumulate(x))) for p, x in plan.items()], "profile bigint, ends array<bigint>")
    # a profile's chunks are alike: a hash tells which of them goes where
    pick = F.lit(names[-1])
    ranked = hashed_rank(named.select("chunk", "profile"), ["profile"], "chunk", seed, "place").join(F.broadcast(ends), "profile")
    for i in reversed(range(len(names) - 1)):
        pick = F.when(F.col("place") <= F.col("ends")[i], F.lit(names[i])).otherwise(pick)
    return ranked.select("chunk", pick.alias("split"))


def _plain(v):  # noqa: ANN001, ANN202
    if hasattr(v, "left"):
        return (v.left + v.right) / 2
    return v if v is not None else ""


def _sizes(chunks: DataFrame, size: Column, has_wanted: bool) -> DataFrame:
    return chunks.groupBy("chunk").agg(size.alias("size"), (F.max("wanted") if has_wanted else F.max(F.lit(None).cast("string"))).alias("wanted"))


def balanced_split(
    data: DataFrame, names: list[str], shares: list[float], keep_separate: list[Group], keep_balanced: list[Group], root: DataFrame | None = None, key: str = "image_id", seed: int = 0,
    hist_weight: float = 1.0, share_weight: float = 1.0, split: str = "split", weights: list[float] | float | None = None, regularization: float = 0.0, at_root_level: bool | None = None,
) -> DataFrame:
    """``(id, chunk, split)`` for every row of ``data``: chunks stay whole, split sizes near the shares, histograms near the whole's.

    Chunks and their histograms are made by joins and aggregations and placed by ``plan_chunks``.
    ``weights`` are those of the balanced groups, ``regularization`` that of the earth mover's
    distance. ``at_root_level`` (by default where there is a ``root``): the size of a chunk is its
    number of distinct root rows, and rows of one root row stay together.
    """
    check_target(names, shares)
    at_root_level = root is not None if at_root_level is None else at_root_level
    cols, apart = [group_name(g) for g in keep_balanced], [group_name(g) for g in keep_separate]
    grouped = with_groups(data, [*keep_balanced, *(g for g in keep_separate if group_name(g) not in cols)], root, key)
    if at_root_level and key not in apart:
        apart = [key, *apart]
    has_split = split in data.columns
    chunks = atomic_chunks(grouped, apart, split if has_split else None, names)
    bins = [f"b{i}" for i in range(len(cols))]
    rows = grouped.select("id", *(F.col(f"`{c}`").alias(b) for b, c in zip(bins, cols, strict=True)), *([F.col(key).alias("rk")] if at_root_level else [])).join(chunks, "id")
    per = _sizes(rows, F.count_distinct("rk") if at_root_level else F.count(F.lit(1)), has_split)
    cells = rows.dropna(subset=bins).groupBy("chunk", *bins).agg(F.count(F.lit(1)).alias("n")) if bins else None
    done = plan_chunks(per, cells, names, shares, keep_balanced, seed, hist_weight, share_weight, weights, regularization)
    return chunks.select("id", "chunk").join(done, "chunk").select("id", "chunk", "split")


def image_chunks(ds: Dataset, keep_separate: list[Group]) -> DataFrame:
    """``(id, chunk)`` of every image, annotated or not: images that share a value of any group, their own or of their annotations, are one chunk.

    A group is looked for among the images' columns first. Null values link nothing.
    """
    edges: DataFrame | None = None
    for g in keep_separate:
        name = group_name(g)
        if name in ds.images.columns:
            rows = with_groups(ds.images, [g]).select(F.col("id").cast("bigint").alias("id"), F.col(f"`{name}`").alias("v"))
        elif name == "image_id":
            continue
        else:
            rows = with_groups(ds.annotations, [g]).select(F.col("image_id").cast("bigint").alias("id"), F.col(f"`{name}`").alias("v")).distinct()
        one = value_edges(rows, "v")
        edges = one if edges is None else edges.unionByName(one)
    return _components(ds.images.select(F.col("id").cast("bigint").alias("id")), edges)


def split_dataset(
    ds: Dataset, names: list[str], shares: list[float], keep_separate: list[Group] = [], keep_balanced: list[Group] = [], seed: int = 0,  # noqa: B006
    hist_weight: float = 1.0, share_weight: float = 1.0, weights: list[float] | float | None = None, regularization: float = 0.0,
) -> Dataset:
    """Images get splits: at random, or whole groups with balanced annotation histograms.

    Groups that must not be parted are chunks of images, whether these have annotations or not, so
    an image without annotations follows its group. The size of a chunk is its number of images, its
    histogram that of its annotations. An image that has one of the wanted splits brings its chunk
    there, if the chunk's images agree; where they do not, the chunk is placed like the others.
    """
    if not keep_separate and not keep_balanced:
        images = simple_split(ds.images, names, shares, seed)
        return Dataset.build(images, ds.annotations.drop("split"), ds.label_map, ds.images_root, ds.dataset_name, booleanized=ds.booleanized)
    check_target(names, shares)
    chunks = cut(image_chunks(ds, keep_separate))
    has_split = "split" in ds.images.columns
    per = _sizes(_wanted(chunks, ds.images, "split", names) if has_split else chunks, F.count(F.lit(1)), has_split)
    cells = None
    if keep_balanced:
        bins = [f"b{i}" for i in range(len(keep_balanced))]
        notes = with_groups(ds.annotations, keep_balanced, ds.images)
        binned = notes.select(F.col("image_id").cast("bigint").alias("id"), *(F.col(f"`{group_name(g)}`").alias(b) for b, g in zip(bins, keep_balanced, strict=True))).dropna(subset=bins)
        # counted per image first, so that an image of very many annotations is one row in the join
        per_image = binned.groupBy("id", *bins).agg(F.count(F.lit(1)).alias("n"))
        cells = per_image.join(chunks, "id").groupBy("chunk", *bins).agg(F.sum("n").alias("n"))
    done = plan_chunks(per, cells, names, shares, keep_balanced, seed, hist_weight, share_weight, weights, regularization)
    at = chunks.join(done, "chunk").select(F.col("id").alias("__i"), F.col("split").alias("__s"))
    images = ds.images.join(at, F.col("id") == F.col("__i"), "left").withColumn("split", F.col("__s")).drop("__i", "__s")
    return Dataset.build(images, ds.annotations.drop("split"), ds.label_map, ds.images_root, ds.dataset_name, booleanized=ds.booleanized)
