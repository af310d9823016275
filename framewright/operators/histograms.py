"""Histograms and distances between them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.flow import Flow


def full_histogram(df: DataFrame, columns: list[str], levels: dict[str, list] | None = None) -> DataFrame:
    """Counts per cell of the product of all levels, empty cells with 0, and each cell's share. Levels are those in the data or given."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).dropna(subset=columns)
    grid: DataFrame | None = None
    for c in columns:
        if levels and c in levels:
            one = df.sparkSession.createDataFrame([(x,) for x in levels[c]], df.select(c).schema)
        else:
            one = counts.select(c).distinct()
        grid = one if grid is None else grid.crossJoin(F.broadcast(one))
    full = grid.join(counts, columns, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("total"))
    return full.crossJoin(F.broadcast(total)).withColumn("share", F.coalesce(F.try_divide("n", "total"), F.lit(0.0))).drop("total")


def share_distance(left: np.ndarray, right: np.ndarray) -> float:
    """1 - sum of minima over sum of maxima of two normalised share vectors."""
    l, r = np.asarray(left, float), np.asarray(right, float)  # noqa: E741
    if l.sum() == 0 or r.sum() == 0:
        return math.inf
    l, r = l / l.sum(), r / r.sum()  # noqa: E741
    return float(1 - np.minimum(l, r).sum() / np.maximum(l, r).sum())


def share_distance_frames(left: DataFrame, right: DataFrame, key: str, weight: str = "n") -> DataFrame:
    """The share distance of two count tables, as one row ``distance``."""
    l = left.groupBy(key).agg(F.sum(weight).alias("l"))  # noqa: E741
    r = right.groupBy(key).agg(F.sum(weight).alias("r"))
    tl, tr = l.agg(F.sum("l").alias("tl")), r.agg(F.sum("r").alias("tr"))
    both = l.join(r, key, "full_outer").crossJoin(F.broadcast(tl)).crossJoin(F.broadcast(tr))
    a, b = F.coalesce(F.try_divide("l", "tl"), F.lit(0.0)), F.coalesce(F.try_divide("r", "tr"), F.lit(0.0))
    return both.select(a.alias("a"), b.alias("b")).agg((1 - F.try_divide(F.sum(F.least("a", "b")), F.sum(F.greatest("a", "b")))).alias("distance"))


def divergence_frames(left: DataFrame, right: DataFrame, key: str, weight: str = "n") -> DataFrame:
    """Kullback-Leibler divergence of two count tables as one row ``divergence``; infinite where the right lacks a class of the left."""
    l = left.groupBy(key).agg(F.sum(weight).alias("l"))  # noqa: E741
    r = right.groupBy(key).agg(F.sum(weight).alias("r"))
    tl, tr = l.agg(F.sum("l").alias("tl")), r.agg(F.sum("r").alias("tr"))
    both = l.filter("l > 0").join(r, key, "left").crossJoin(F.broadcast(tl)).crossJoin(F.broadcast(tr))
    p, q = F.col("l") / F.col("tl"), F.try_divide(F.coalesce("r", F.lit(0)), F.col("tr"))
    return both.agg(F.sum(F.when(q > 0, p * F.log(p / q)).otherwise(F.lit(math.inf))).alias("divergence"))


def earth_mover_1d_frames(left: DataFrame, right: DataFrame, position: str, weight: str = "n") -> DataFrame:
    """Earth mover's distance over one number, as a share of the greatest distance, as one row ``distance``.

    It is the area between the two cumulative shares; tables are histograms, so a window over the bins is small.
    """
    l = left.groupBy(position).agg(F.sum(weight).alias("l"))  # noqa: E741
    r = right.groupBy(position).agg(F.sum(weight).alias("r"))
    both = l.join(r, position, "full_outer").select(position, F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    every = Window.partitionBy(F.lit(0))
    w = every.orderBy(position)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.lead(position).over(w) - F.col(position)
    area = F.abs(F.sum("l").over(up) / F.sum("l").over(every) - F.sum("r").over(up) / F.sum("r").over(every)) * gap
    return both.select(area.alias("area"), F.col(position).alias("p")).agg(F.coalesce(F.try_divide(F.sum("area"), F.max("p") - F.min("p")), F.lit(0.0)).alias("distance"))


def earth_mover(left: np.ndarray, right: np.ndarray, positions: np.ndarray, weights: np.ndarray, sinkhorn: float = 0.0) -> float:
    """Earth mover's distance between histograms over points; city-block cost with weights, as a share of the greatest cost.

    No weights give 0, an empty side infinity. With ``sinkhorn`` > 0 it is the cost of the
    entropy-regularised plan, else exact by min-cost flow; for plans on the driver, with few bins.
    """
    if not len(weights):
        return 0.0
    l, r = np.asarray(left, float), np.asarray(right, float)  # noqa: E741
    if l.sum() == 0 or r.sum() == 0:
        return math.inf
    l, r = l / l.sum(), r / r.sum()  # noqa: E741
    x = np.asarray(positions, float).reshape(len(l), -1) * np.asarray(weights, float)
    cost = np.abs(x[l > 0][:, None, :] - x[r > 0][None, :, :]).sum(-1)
    l, r = l[l > 0], r[r > 0]  # noqa: E741
    if cost.max() == 0:
        return 0.0
    cost /= cost.max()
    if sinkhorn > 0:
        kernel = np.exp(-cost / sinkhorn)
        u, v = np.ones(len(l)) / len(l), np.ones(len(r)) / len(r)
        for _ in range(1000):
            before = u
            v = r / np.maximum(kernel.T @ u, 1e-300)
            u = l / np.maximum(kernel @ v, 1e-300)
            if np.abs(u - before).max() < 1e-12 * max(1.0, np.abs(u).max()):
                break
        return float((u[:, None] * kernel * v[None, :] * cost).sum())
    n, m = cost.shape
    flow = Flow(n + m + 2)
    for i in range(n):
        flow.arc(n + m, i, l[i], 0.0)
        for j in range(m):
            flow.arc(i, n + j, 1.0, float(cost[i, j]))
    for j in range(m):
        flow.arc(n + j, n + m + 1, r[j], 0.0)
    return flow.run(n + m, n + m + 1, 1.0)


def check_groups(columns: list[str], category: list[str], continuous: list[str]) -> None:
    """Category and continuous groups must part the histogram's columns between them."""
    if set(category) & set(continuous) or set(category) | set(continuous) != set(columns):
        raise AssertionError("the groups do not part the histogram's columns")


def histogram_distance(left: np.ndarray, right: np.ndarray, cells: list[tuple], columns: list[str], category_weights: dict[str, float], continuous_weights: dict[str, float], sinkhorn: float = 0.0) -> float:
    """Weighted divergence of the category marginals plus the earth mover's distance within categories.

    ``cells`` are the level tuples of the bins, in the order of ``columns``. Each side is
    scaled by the norm of its weights; the distances of the categories are averaged by the left's
    mass. An empty side gives infinity.
    """
    check_groups(columns, list(category_weights), list(continuous_weights))
    l, r = np.asarray(left, float), np.asarray(right, float)  # noqa: E741
    if l.sum() == 0 or r.sum() == 0:
        return math.inf
    kl = 0.0
    for c, weight in category_weights.items():
        i = columns.index(c)
        levels = sorted({x[i] for x in cells})
        p = np.array([l[[x[i] == v for x in cells]].sum() for v in levels]) / l.sum()
        q = np.array([r[[x[i] == v for x in cells]].sum() for v in levels]) / r.sum()
        with np.errstate(divide="ignore"):
            kl += weight * float(sum(a * np.log(a / b) if b else math.inf for a, b in zip(p, q, strict=True) if a))
    at = [columns.index(c) for c in continuous_weights]
    points = np.array([[x[i] for i in at] for x in cells], float).reshape(len(cells), len(at))
    weights = np.array(list(continuous_weights.values()), float)
    keys = [tuple(x[columns.index(c)] for c in category_weights) for x in cells]
    emd, mass = 0.0, 0.0
    for k in sorted(set(keys)):
        here = [i for i, x in enumerate(keys) if x == k]
        part = l[here].sum()
        if part:
            emd += part * earth_mover(l[here], r[here], points[here], weights, sinkhorn)
            mass += part
    return float(np.linalg.norm(list(category_weights.values())) * kl + np.linalg.norm(weights) * (emd / mass if mass else 0.0))
