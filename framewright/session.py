"""Session-level helpers: the shared folder, scratch tables and reliable lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []
atexit.register(lambda: _clean())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that
    setting and the context's own checkpoint folder are both unset is a temporary folder
    made, and only on a local master: on a cluster this raises RuntimeError, as other
    machines would not see the folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="framewright-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it is removed when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a scratch table, and read from it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary_tables() -> Iterator[None]:
    """Scratch tables made inside are removed at its end: ``with temporary_tables(): result.write...``.

    For sessions that run many queries; a result has to be written or collected inside. (Checkpoints
    are Spark's own to clean, see spark.cleaner.referenceTracking.cleanCheckpoints.)
    """
    before = len(_SCRATCH)
    try:
        yield
    finally:
        _remove(_SCRATCH[before:])
        del _SCRATCH[before:]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (checkpoint in the shared folder) and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _clean() -> None:
    _remove(_SCRATCH)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def few_rows(df: DataFrame, what: str, limit: int = 100_000) -> list[Row]:
    """All rows of ``df`` on the driver; more than ``limit`` raise ValueError."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
