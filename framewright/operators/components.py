"""Connected components as an iterative DataFrame program (alternating star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import cut

#: A key of more rows than this and than a MAX_HOT-th of all rows is joined apart from the rest; there can be at most MAX_HOT of them.
HOT_ROWS, MAX_HOT = 1_000_000, 2000


def join_one(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``per_key``, which has one row for every ``key`` in them and their number ``__k``, which is dropped.

    Keys of very many rows are looked up in a broadcast of their few ``per_key`` rows, so that no task gets
    them all; the others are joined by a shuffle.
    """
    size = per_key.agg(F.max("__k").alias("most"), F.sum("__k").alias("total")).first()
    limit = max(HOT_ROWS, (size["total"] or 0) // MAX_HOT)
    if (size["most"] or 0) <= limit:
        return rows.join(per_key.drop("__k"), key)
    hot = per_key.filter(F.col("__k") > limit).drop("__k")
    keys = [r[0] for r in hot.select(key).collect()]
    is_hot = F.col(key).isin(keys)
    return rows.filter(is_hot).join(F.broadcast(hot), key).unionByName(rows.filter(~is_hot).join(per_key.filter(~is_hot).drop("__k"), key))


def value_edges(rows: DataFrame, value: str) -> DataFrame:
    """Edges ``(src, dst)`` of ``rows`` (``id`` and a value): every id is linked to the smallest id of its value; null values link nothing.

    The smallest ids are combined before the shuffle, and a value of any share of the rows is no burden (``join_one``).
    """
    has = rows.filter(F.col(value).isNotNull())
    named = has.groupBy(value).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("__k"))
    return join_one(has, named, value).select(F.col("id").alias("src"), F.col("least").alias("dst"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Component of every node that an edge names: ``(node, component)``, component = smallest node.

    ``edges`` holds bigint pairs; nulls are ignored, direction and repetition do not count,
    a loop (a, a) only makes the node appear. No edges give no rows. Each round runs a
    large-star and a small-star step (Kiveris et al., 2014), so the number of rounds grows
    with the logarithm of the longest chain. Edges stay distributed; every round is cut with
    a reliable checkpoint, and only a count and a checksum reach the driver. A hub of very many
    edges is joined apart from the rest (``join_one``).
    """
    pairs = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).dropna()
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    stars = cut(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _checksum(stars)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        stars = cut(_small_star(_large_star(stars)))
        now = _checksum(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("v").alias("node")).filter("node is not null")
    return (
        stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
        .unionByName(nodes.select("node", F.col("node").alias("component")))
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )


def _checksum(stars: DataFrame) -> tuple[int, int]:
    row = stars.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _large_star(stars: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the smallest of u's neighbourhood."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__k"))
    linked = join_one(both.filter("v > u"), least, "u")
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    linked = stars.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
