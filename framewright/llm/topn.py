"""The N best items of every group, by statistics-guided skipping of row groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.latest import latest_rows
from framewright.session import scratch_path

#: Bytes of a row group in memory. Small groups of rows make for finer skipping.
ROW_GROUP_BYTES = 1 << 20

_INDEX = "path string, rg int, lo_a bigint, lo_b bigint, hi_a bigint, hi_b bigint, hi_score double, lo_score double, rows bigint, file_rgs int"


def cluster_by_group(df: DataFrame, group: tuple[str, str], score: str, item: str, path: str) -> DataFrame:
    """Write ``(a, b, score, item)`` to ``path`` clustered by group and return the written files' names.

    Files are ranges of (group, descending score, item) cut at Spark's sampled quantiles, so a
    group of millions lies in several files, best scores first, and no task gets more than its
    share. Within a file rows are sorted the same way; row groups are small and have statistics.
    """
    a, b = group
    rows = df.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"), (-F.col(score)).alias("down"), F.col(item).cast("bigint").alias("item"))
    order = ["a", "b", "down", "item"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("a", "b", (-F.col("down")).alias("score"), "item").write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", ROW_GROUP_BYTES // 8).parquet(path)
    return df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")


def _open(path: str) -> pq.ParquetFile:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    return pq.ParquetFile(fs.open_input_file(inner))


def row_group_index(files: DataFrame) -> DataFrame:
    """The footers' statistics, one row per row group; read by tasks, not by the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                meta = _open(path).metadata
                for g in range(meta.num_row_groups):
                    stats = [meta.row_group(g).column(c).statistics for c in range(3)]
                    (la, ha), (lb, hb), (ls, hs) = ((s.min, s.max) for s in stats)
                    rows.append((path, g, la, lb, ha, hb, hs, ls, meta.row_group(g).num_rows, meta.num_row_groups))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i not in (1, 9) else pa.array(c, pa.int32()) for i, c in enumerate(zip(*rows, strict=True))], names=[x.split()[0] for x in _INDEX.split(", ")])

    return files.repartition(files.sparkSession.sparkContext.defaultParallelism, "path").mapInArrow(run, _INDEX)


def skip_by_statistics(index: DataFrame, n: int) -> DataFrame:
    """Row groups that can hold one of a group's ``n`` best.

    A row group of one group only is left out when other row groups of that group whose lowest
    score is above its highest already hold n rows: it lies strictly below the group's n-th
    score. A row group of several groups holds the head of all but its first group, so it stays.
    """
    single = (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b"))
    ones = index.filter(single)
    w = Window.partitionBy("lo_a", "lo_b").orderBy(F.col("lo_score").desc())
    sure = ones.withColumn("held", F.sum("rows").over(w)).filter(F.col("held") >= n).groupBy(F.col("lo_a").alias("ga"), F.col("lo_b").alias("gb")).agg(F.max("lo_score").alias("nth"))
    judged = ones.join(sure, (F.col("lo_a") == F.col("ga")) & (F.col("lo_b") == F.col("gb")), "left")
    kept = judged.filter("nth is null or hi_score >= nth").drop("ga", "gb", "nth")
    return kept.unionByName(index.filter(~single))


def _best_of(table: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """The n best rows of every group of a batch, in order of group, descending score, item."""
    order = np.lexsort((table["item"], -table["score"], table["b"], table["a"]))
    t = {k: v[order] for k, v in table.items()}
    if not len(order):
        return t
    start = np.r_[True, (t["a"][1:] != t["a"][:-1]) | (t["b"][1:] != t["b"][:-1])]
    first = np.flatnonzero(start)
    rank = np.arange(len(order)) - first[np.cumsum(start) - 1]
    return {k: v[rank < n] for k, v in t.items()}


def read_best(kept: DataFrame, n: int) -> DataFrame:
    """Read the surviving row groups file by file: ``(a, b, score, item, rank, edge)``.

    In a file, row groups are read in descending maximum score. One is skipped when it holds a
    single group whose n-th score so far is strictly above the row group's maximum. ``edge``
    marks the groups that may go on in a neighbouring file: the first and the last one read here.
    """
    out = "a bigint, b bigint, score double, item bigint, rank int, edge boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _read_file(path, groups, n)

    packed = F.collect_list(F.struct("hi_score", "rg", "lo_a", "lo_b", "hi_a", "hi_b"))
    files = kept.groupBy("path").agg(packed.alias("groups"))
    return files.mapInArrow(run, out)


def _read_file(path: str, groups: list[dict], n: int) -> Iterator[pa.RecordBatch]:
    file = _open(path)
    nth: dict[tuple[int, int], float] = {}
    parts: list[dict[str, np.ndarray]] = []
    for g in sorted(groups, key=lambda g: (-g["hi_score"], g["rg"])):
        only = (g["lo_a"], g["lo_b"]) if (g["lo_a"], g["lo_b"]) == (g["hi_a"], g["hi_b"]) else None
        if only and nth.get(only, -np.inf) > g["hi_score"]:
            continue
        t = file.read_row_group(g["rg"])
        top = _best_of({c: t.column(c).to_numpy() for c in ("a", "b", "score", "item")}, n)
        parts.append(top)
        if only and len(top["a"]) == n:
            nth[only] = max(nth.get(only, -np.inf), float(top["score"][-1]))
    best = _best_of({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, n)
    start = np.r_[True, (best["a"][1:] != best["a"][:-1]) | (best["b"][1:] != best["b"][:-1])]
    number = np.cumsum(start) - 1
    rank = np.arange(len(number)) - np.flatnonzero(start)[number] + 1
    edge = (number == 0) | (number == number[-1])
    yield pa.RecordBatch.from_arrays([*(pa.array(best[c]) for c in ("a", "b", "score", "item")), pa.array(rank, pa.int32()), pa.array(edge)], names=["a", "b", "score", "item", "rank", "edge"])


def top_n_per_group(df: DataFrame, group: tuple[str, str], score: str, item: str, n: int = 3, at: str | None = None) -> DataFrame:
    """``(group..., item, score, rank)``: the ``n`` items of highest score of every group; of equal scores the smaller item first.

    ``group`` are two integer columns, ``item`` an integer id. With ``at``, of rows that share an
    item only the one with the latest ``at`` counts (and is dropped when its own group or score is
    null); without, repeated rows count each. Null groups and null or NaN scores are left out. An
    empty table gives no rows; other columns play no part.

    The rows are written clustered by group to the shared folder; row groups that the statistics
    rule out are never read, the others are read best first and skipped against the group's
    current n-th score. Every file gives its n best per group at once; only the groups at a file's
    borders are ranked again together.
    """
    a, b = group
    rows = latest_rows(df, item, at, [item, a, b, score]) if at else df.select(item, a, b, score)
    good = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    path = scratch_path(df.sparkSession, "topn")
    files = cluster_by_group(good, group, score, item, path)
    best = read_best(skip_by_statistics(row_group_index(files), n), n)
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("score").desc(), "item"))
    border = best.filter("edge").withColumn("rank", rank).filter(F.col("rank") <= n)
    kinds = {c: df.schema[c].dataType for c in (a, b, item, score)}
    return best.filter("not edge").unionByName(border).drop("edge").select(
        F.col("a").cast(kinds[a]).alias(a), F.col("b").cast(kinds[b]).alias(b), F.col("item").cast(kinds[item]).alias(item), F.col("score").cast(kinds[score]).alias(score), "rank"
    )
