"""Group columns: plain attributes and bins of continuous ones."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut


@dataclass(frozen=True)
class ContinuousGroup:
    """Bins of a number: a count or edges, equal widths or quantiles, in plain or log space; named by interval, mid, mean or median."""

    name: str
    bins: int | tuple[float, ...] = 10
    qcut: bool = False
    log: bool = False
    label_type: str = "intervals"

    def __post_init__(self) -> None:
        if self.label_type not in ("intervals", "mid", "mean", "median"):
            raise ValueError("label_type is intervals, mid, mean or median")
        if self.log and not isinstance(self.bins, int):
            raise ValueError("log goes with a number of bins")


Group = str | ContinuousGroup


def group_name(g: Group) -> str:
    return g if isinstance(g, str) else g.name


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Quantiles of a whole column, linear between neighbours; empty for no numbers.

    Distinct values are counted, put in order by ranges and numbered by running counts over the
    ranges' sums, so no task holds them all; only the rows at the wanted places reach the driver.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counted.repartitionByRange("v").sortWithinPartitions("v")).withColumn("__p", F.spark_partition_id())
    sums = sorted((r[0], r[1]) for r in ranged.groupBy("__p").agg(F.sum("n")).collect())
    total = sum(n for _, n in sums)
    if not total:
        return []
    starts, at = [], 0
    for p, n in sums:
        starts.append((p, at))
        at += n
    places = sorted({x for q in shares for x in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
    # only ranges that hold a wanted place are numbered
    wanted = [(p, s, [x for x in places if s <= x < s + n]) for (p, s), (_, n) in zip(starts, sums, strict=True)]
    some = df.sparkSession.createDataFrame([(p, s, x) for p, s, x in wanted if x], "__p int, __start bigint, __want array<bigint>")
    run = F.sum("n").over(Window.partitionBy("__p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    numbered = ranged.join(F.broadcast(some), "__p").withColumn("__end", F.col("__start") + run)
    hits = numbered.filter(F.exists("__want", lambda x: (x < F.col("__end")) & (x >= F.col("__end") - F.col("n")))).select("v", (F.col("__end") - F.col("n")).alias("a"), F.col("__end").alias("b")).collect()
    at_place = {x: r["v"] for x in places for r in hits if r["a"] <= x < r["b"]}
    out = []
    for q in shares:
        t = q * (total - 1)
        lo, hi = at_place[math.floor(t)], at_place[math.ceil(t)]
        out.append(lo + (hi - lo) * (t - math.floor(t)))
    return out


def grouped_quantiles(df: DataFrame, group: str, column: str, shares: list[float]) -> DataFrame:
    """``(group, q0, q1...)``: quantiles of a column in every group, linear between neighbours; groups without numbers have none.

    As in ``exact_quantiles``, distinct values are counted and numbered over ranges, so that no task
    or buffer holds a whole group.
    """
    value = F.col(f"`{column}`").cast("double")
    counted = df.select(F.col(f"`{group}`").alias("g"), value.alias("v")).filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counted.repartitionByRange("g", "v")).withColumn("__p", F.spark_partition_id())
    parts = ranged.groupBy("g", "__p").agg(F.sum("n").alias("m"))
    whole = Window.partitionBy("g")
    starts = parts.select(F.col("g").alias("__g"), F.col("__p").alias("__q"), F.coalesce(F.sum("m").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("m").over(whole).alias("total"))
    run = F.sum("n").over(Window.partitionBy("g", "__p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("run", run).join(starts, F.col("g").eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q"))).withColumn("end", F.col("start") + F.col("run"))
    at = lambda x: F.max(F.when((F.col("end") - F.col("n") <= x) & (x < F.col("end")), F.col("v")))
    ends = [(F.floor(F.lit(float(q)) * (F.col("total") - 1)), F.ceil(F.lit(float(q)) * (F.col("total") - 1))) for q in shares]
    found = placed.groupBy("g").agg(F.max("total").alias("total"), *(x for i, (lo, hi) in enumerate(ends) for x in (at(lo).alias(f"lo{i}"), at(hi).alias(f"hi{i}"))))
    between = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (F.lit(float(q)) * (F.col("total") - 1) - lo) for i, (q, (lo, _)) in enumerate(zip(shares, ends, strict=True))]
    return found.select(F.col("g").alias(group), *(x.alias(f"q{i}") for i, x in enumerate(between)))


def bin_edges(df: DataFrame, g: ContinuousGroup) -> list[float]:
    """The edges; one small aggregation. Equal-width edges start a thousandth of the range lower, so that the least value is in."""
    if not isinstance(g.bins, int):
        return [float(x) for x in g.bins]
    value = F.col(f"`{g.name}`").cast("double")
    if g.log:
        low = df.agg(F.min(value)).first()[0]
        if low is not None and low < 0:
            raise ValueError("no log bins for negative numbers")
        value = F.when(value > 0, F.log(value))
    if g.qcut:
        qs = [i / g.bins for i in range(g.bins + 1)]
        edges = exact_quantiles(df.select(value.alias("v")), "v", qs)
        if len(set(edges)) < len(edges):
            raise ValueError(f"quantiles of {g.name} are equal, so {g.bins} bins can't be told apart")
        if edges:
            edges[0] = math.nextafter(edges[0], -math.inf)
    else:
        lo, hi = df.agg(F.min(value), F.max(value)).first()
        if lo is None:
            edges = []
        elif lo == hi:
            edges = np.linspace(lo - 0.001 * abs(lo), hi + 0.001 * abs(hi), g.bins + 1).tolist()
        else:
            edges = np.linspace(lo, hi, g.bins + 1).tolist()
            edges[0] -= (hi - lo) * 0.001
    return [math.exp(x) for x in edges] if g.log else edges


def label_edges(edges: list[float], digits: int = 3) -> list[float]:
    """Edges as intervals are named by: rounded to so many digits (after the leading zeros of a fraction), more where edges would become equal."""

    def rounded(x: float, d: int) -> float:
        whole, part = math.trunc(x), abs(x) % 1
        if not math.isfinite(x) or part == 0:
            return x
        return round(x, d - 1 - math.floor(math.log10(part)) if whole == 0 else d)

    for d in range(digits, 20):
        out = [rounded(x, d) for x in edges]
        if len(set(out)) == len(set(edges)):
            return out
    return list(edges)


def bin_column(value: Column, edges: list[float]) -> Column:
    """0-based number of the right-closed bin, null outside and for null."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    above = F.array(*(F.lit(float(e)) for e in edges))
    at = F.array_position(F.transform(above, lambda e: value <= e), F.lit(True)).cast("int") - 2
    return F.when((value > edges[0]) & (value <= edges[-1]), at)


def cut_group(df: DataFrame, g: ContinuousGroup, out: str | None = None) -> DataFrame:
    """``df`` and the bin of ``g``: struct(left, right), or a number for mid, mean and median."""
    edges = bin_edges(df, g)
    value = F.col(f"`{g.name}`").cast("double")
    at = bin_column(value, edges)
    out = out or g.name
    shown = label_edges([math.log(x) for x in edges]) if g.log else label_edges(edges)
    shown = [math.exp(x) for x in shown] if g.log else shown
    pairs = list(zip(shown, shown[1:], strict=False))
    if g.label_type in ("intervals", "mid"):
        made = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) if g.label_type == "intervals" else F.lit((a + b) / 2) for a, b in pairs]
        return df.withColumn(out, F.get(F.array(*made), at) if made else F.lit(None))
    binned = df.withColumn("__bin", at)
    if g.label_type == "mean":
        labels = binned.groupBy(F.col("__bin").alias("__b")).agg(F.avg(value).alias("__label"))
    else:
        labels = grouped_quantiles(binned.select("__bin", value.alias("__v")), "__bin", "__v", [0.5]).select(F.col("__bin").alias("__b"), F.col("q0").alias("__label"))
    joined = binned.join(F.broadcast(labels), F.col("__bin").eqNullSafe(F.col("__b")), "left")
    return joined.withColumn(out, F.when(F.col("__bin").isNotNull(), F.col("__label"))).drop("__bin", "__b", "__label")


def with_groups(child: DataFrame, groups: list[Group], root: DataFrame | None = None, key: str = "image_id") -> DataFrame:
    """``child`` with every group column, taken from ``root`` through the key where the child has none, then binned."""
    missing = [group_name(g) for g in groups if group_name(g) not in child.columns]
    if missing:
        if root is None:
            raise ValueError(f"no columns {missing}")
        child = child.join(root.select(F.col("id").alias("__root"), *(F.col(f"`{m}`") for m in missing)), F.col(key) == F.col("__root"), "left").drop("__root")
    for g in groups:
        if isinstance(g, ContinuousGroup):
            child = cut_group(child, g)
    return child
