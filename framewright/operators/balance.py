"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the number that ends the range key. Rows alike in everything else can be cut into so many ranges.
TIES = 65_521

_STATE = "family int, key_id bigint, part int, n bigint, first_at bigint, last_at bigint, max_gap bigint"
_STATE_ARROW = pa.schema([("family", pa.int32()), ("key_id", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("first_at", pa.int64()), ("last_at", pa.int64()), ("max_gap", pa.int64())])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length partial states of a partition sorted by (family, key_id, at).

    A run that goes on into the next batch is carried, so a partition gives one state per key.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        family, key, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        start = np.flatnonzero(np.r_[True, (family[1:] != family[:-1]) | (key[1:] != key[:-1])])
        stop = np.r_[start[1:], len(key)]
        gap = np.r_[0, at[1:] - at[:-1]]
        gap[start] = 0
        f, k, n = family[start], key[start], stop - start
        first, last, most = at[start].copy(), at[stop - 1].copy(), np.maximum.reduceat(gap, start)
        if held is not None:
            if held[0] == f[0] and held[1] == k[0]:
                most[0] = max(most[0], held[5], first[0] - held[4])
                n[0] += held[2]
                first[0] = held[3]
            else:
                yield _rows([[x] for x in held], part)
        if len(f) > 1:
            yield _rows([x[:-1] for x in (f, k, n, first, last, most)], part)
        held = [int(x[-1]) for x in (f, k, n, first, last, most)]
    if held is not None:
        yield _rows([[x] for x in held], part)


def _rows(cols: list, part: int) -> pa.RecordBatch:
    f, k, n, first, last, most = cols
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((f, k, np.full(len(f), part), n, first, last, most), _STATE_ARROW.types, strict=True)], schema=_STATE_ARROW)


def balanced_key_stats(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Count, first and last arrival and longest silence of every key, without a slow task.

    ``rows`` has ``family`` int, ``key_id`` bigint and ``at`` bigint (the secondary order, in
    microseconds). Rows are range-partitioned on the composite (family, key, order) by Spark's
    sampled quantiles, so a key of a third of all rows is cut into as many ranges as its share
    asks for. The range key ends with a row number modulo TIES, so that a key whose order is tied or
    null throughout (a bulk load under one time) is cut as well. Every partition is sorted and folded into one state per key, and the states of a
    key that goes over partition borders are stitched in order: counts are added, and the gap
    between one range's last and the next range's first arrival is taken into account. Only
    states are shuffled a second time: at most one per key and partition.

    ``rows`` should come straight from files (or a checkpoint), as the row number must be the same
    when a lost task is run again. Rows with a null family or key are left out; a null order counts as the earliest. Ties and
    repeated rows count each. No rows give no rows. Result: ``family, key_id, n, first_at,
    last_at, max_gap_us``.
    """
    ready = rows.filter("family is not null and key_id is not null").select("family", "key_id", F.coalesce("at", F.lit(0)).cast("bigint").alias("at"), F.pmod(F.monotonically_increasing_id(), F.lit(TIES)).cast("int").alias("tie"))
    by = ["family", "key_id", "at", "tie"]
    ranged = ready.repartitionByRange(parts, *by) if parts else ready.repartitionByRange(*by)
    states = ranged.select(*by[:3]).sortWithinPartitions(*by[:3]).mapInArrow(_states, _STATE)
    before = F.lag("last_at").over(Window.partitionBy("family", "key_id").orderBy("first_at", "last_at", "part"))
    stitched = states.withColumn("border", F.coalesce(F.col("first_at") - before, F.lit(0)))
    return stitched.groupBy("family", "key_id").agg(
        F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max(F.greatest("max_gap", "border")).alias("max_gap_us")
    )


def long_keys(tables: dict[str, DataFrame], fields: list[str], at: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The key columns of several tables as one long ``(family, key_id, at)`` table; family numbers the (table, field) pairs."""
    names: list[tuple[str, str]] = []
    out: DataFrame | None = None
    for name, df in tables.items():
        first = len(names)
        names += [(name, f) for f in fields]
        pairs = F.array(*(F.struct(F.lit(first + i).alias("family"), F.col(f"`{f}`").cast("bigint").alias("key_id")) for i, f in enumerate(fields)))
        long = df.select(F.unix_micros(F.col(f"`{at}`").cast("timestamp")).alias("at"), F.inline(pairs)).select("family", "key_id", "at")
        out = long if out is None else out.unionByName(long)
    assert out is not None
    return out, names


def heavy_keys(tables: dict[str, DataFrame], fields: list[str], at: str = "ingested_at", share: float = 0.03) -> DataFrame:
    """``(table_name, field_name, key_id, n, total, max_gap_us)`` of the keys that hold more than ``share`` of a table's rows.

    The total counts every row of the table, those with a null key too; null is no key.
    """
    long, names = long_keys(tables, fields, at)
    stats = balanced_key_stats(long)
    spark = long.sparkSession
    labels = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(names)], "family int, table_name string, field_name string")
    totals: DataFrame | None = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("table_name"), "total")
        totals = one if totals is None else totals.unionByName(one)
    named = stats.join(F.broadcast(labels), "family").join(F.broadcast(totals), "table_name")
    return named.filter(F.col("n") > F.lit(share) * F.col("total")).select("table_name", "field_name", "key_id", "n", "total", "max_gap_us")
