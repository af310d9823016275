"""Consecutive numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut


def numbered(keys: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``keys`` and their 0-based place in ``order``.

    Rows are range-sorted and materialised; each partition numbers its own rows, and the
    partitions' sizes (one number each) give the offsets. Equal keys take any place among
    themselves, so ``order`` should be total. An empty table stays empty.
    """
    ranged = cut(keys.orderBy(*order)).withColumn("__m", F.monotonically_increasing_id())
    part, at = F.shiftright(F.col("__m"), 33).cast("int"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect()}
    rows, start = [], 0
    for p in sorted(sizes):
        rows.append((p, start))
        start += sizes[p]
    offsets = keys.sparkSession.createDataFrame(rows, "__p int, __start bigint")
    return ranged.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__start") + at).drop("__m", "__p", "__start")


def hashed_rank(df: DataFrame, by: list[str], key: str, seed: int, name: str = "rank", cells: int = 1024) -> DataFrame:
    """``df`` and the 1-based rank of each row among those with equal ``by``, in the order of a hash of ``key``.

    The hash parts every group into cells; a window runs over the cell counts and another inside
    a cell, so that no task ranks a whole group, however large.
    """
    h = df.withColumn("__h", F.xxhash64(key, F.lit(seed))).withColumn("__cell", F.pmod("__h", F.lit(cells)).cast("int"))
    counts = h.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__cell").alias("__c"), F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__h", key))
    on = F.col("__cell") == F.col("__c")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = h.withColumn("__inside", inside).join(starts, on)
    return joined.withColumn(name, F.col("__start") + F.col("__inside")).select(*df.columns, name)
