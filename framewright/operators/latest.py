"""Redelivered rows: the latest row or the first arrival of every id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Of the rows that share ``key``, the one with the latest ``at``, cut to ``columns``.

    Equal ``at``: the row whose ``columns`` come last in order (nulls first), so every
    run gives the same row. A null ``at`` loses to any other. Rows with a null key are
    dropped. The rank limit is applied before the shuffle as well, so an id delivered
    many times leaves one row per map task.
    """
    rest = [c for c in columns if c not in (key, at)]
    order = [F.col(f"`{at}`").desc_nulls_last(), *(F.col(f"`{c}`").desc_nulls_last() for c in rest)]
    rank = F.row_number().over(Window.partitionBy(F.col(f"`{key}`")).orderBy(*order))
    wanted = list(dict.fromkeys([key, at, *columns]))
    picked = df.filter(F.col(f"`{key}`").isNotNull()).select(*(F.col(f"`{c}`") for c in wanted))
    return picked.withColumn("__rank", rank).filter("__rank = 1").select(*(F.col(f"`{c}`") for c in columns))


def first_arrival(df: DataFrame, key: str, at: str, keep: dict[str, str] | None = None) -> DataFrame:
    """One row per non-null ``key`` with ``first_at``, the smallest ``at``.

    ``keep`` maps an output name to a column; its value is that of the latest row that has
    one (an id keeps its references when redelivered, so any row would do there).
    All buffers are fixed-width, so this is a hash aggregation with map-side combine.
    """
    aggs = [F.min(F.col(f"`{at}`")).alias("first_at")]
    for name, col in (keep or {}).items():
        aggs.append(F.max_by(F.col(f"`{col}`"), F.when(F.col(f"`{col}`").isNotNull(), F.coalesce(F.col(f"`{at}`"), F.lit("0001-01-01").cast("timestamp_ntz").cast(df.schema[at].dataType)))).alias(name))
    return df.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("row_id")).agg(*aggs)
