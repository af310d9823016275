"""Watched folders: new annotation files as a stream, and differences to what was known."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.model import Dataset
from framewright.operators.setops import diff
from framewright.sources.common import relative_to


def stream_payloads(spark: SparkSession, folder: str, max_files: int = 10_000) -> DataFrame:
    """A stream of ``(path, payload, received_at)`` of the JSON files that come into a folder."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", max_files).format("text").load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("received_at"))


def listing(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """``(path, modified, length)`` of the files below a folder; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def changes(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """``(path, kind, batch)``: files added, changed (another time or length) and deleted since the listing ``before``; ``batch`` is the one that read the file last."""
    if before is None:
        return now.select("path", F.lit("added").alias("kind"), F.lit(None).cast("bigint").alias("batch"))
    both = now.alias("n").join(before.alias("b"), F.col("n.path") == F.col("b.path"), "full_outer")
    same = F.col("n.modified").eqNullSafe(F.col("b.modified")) & F.col("n.length").eqNullSafe(F.col("b.length"))
    kind = F.when(F.col("b.path").isNull(), "added").when(F.col("n.path").isNull(), "deleted").when(~same, "changed")
    return both.select(F.coalesce("n.path", "b.path").alias("path"), kind.alias("kind"), F.col("b.batch").alias("batch")).filter("kind is not null")


def file_stem(path: Column, folder: str) -> Column:
    """A file's path below the folder, without its suffix; the same for a picture's path and that of its annotation file."""
    return F.regexp_replace(relative_to(path, folder), r"\.[^./]+$", "")


class FolderWatch:
    """The files of a folder as they were last seen, what they held, and a stream that looks for changes.

    Kept in ``checkpoint`` are a written listing (path, time and length of every file, and the batch
    that read it) and, batch by batch, the images and annotations read. A look compares the listing
    with the present one; only added and changed files are read, and what they and deleted files held
    before is looked up in the batches that read them. So changed and deleted files are seen, a look
    without changes reads no file, and a new process goes on where the last one stopped. A batch is
    committed after ``push``; if that fails, the next look repeats it.
    """

    def __init__(self, spark: SparkSession, folder: str, read: Callable[[list[str] | None], Dataset], push: Callable[[Dataset, Dataset], None], checkpoint: str, glob: str = "*.json") -> None:
        self.spark, self.folder, self.read, self.push, self.glob = spark, folder.rstrip("/"), read, push, glob
        self.checkpoint = checkpoint.rstrip("/")
        self.lock = threading.Lock()
        self.query: StreamingQuery | None = None
        self.label_map: dict[int, str] = {}
        self.batch = 0
        try:
            last = spark.read.json(f"{self.checkpoint}/done").orderBy(F.col("batch").desc()).first()
        except AnalysisException:
            last = None
        if last is not None:
            self.batch = last["batch"]
            self.label_map = {int(k): v for k, v in json.loads(last["labels"]).items()}

    def _path(self, name: str, batch: int) -> str:
        return f"{self.checkpoint}/{name}/{batch}"

    def check(self) -> dict[str, int]:
        """One look: the number of files added, changed and deleted, after ``push(new, gone)`` if there were any."""
        with self.lock:
            at = self.batch + 1
            now_path = self._path("seen", at)
            listing(self.spark, self.folder, self.glob).write.mode("overwrite").parquet(now_path)
            now = self.spark.read.parquet(now_path)
            before = self.spark.read.parquet(self._path("listing", self.batch)) if self.batch else None
            found_path = self._path("changes", at)
            changes(before, now).write.mode("overwrite").parquet(found_path)
            found = self.spark.read.parquet(found_path)
            counts = {r[0]: r[1] for r in found.groupBy("kind").agg(F.count(F.lit(1))).collect()}
            if not counts:
                return counts
            fresh = self._read_fresh(found, counts, at)
            old = self._held_before(found, fresh)
            gone, new, _ = diff(old, fresh)
            self.push(new, gone)
            kept = now.join(before.select("path", F.col("batch").alias("was")), "path", "left") if before is not None else now.withColumn("was", F.lit(None).cast("bigint"))
            read_now = found.filter("kind <> 'deleted'").select("path", F.lit(at).cast("bigint").alias("is"))
            kept.join(read_now, "path", "left").select("path", "modified", "length", F.coalesce("is", "was").alias("batch")).write.mode("overwrite").parquet(self._path("listing", at))
            self.spark.createDataFrame([(at, json.dumps(self.label_map))], "batch bigint, labels string").coalesce(1).write.mode("append").json(f"{self.checkpoint}/done")
            self.batch = at
            return counts

    def _read_fresh(self, found: DataFrame, counts: dict[str, int], at: int) -> Dataset:
        """The content of added and changed files, read once and kept as this batch's."""
        if self.batch == 0:
            fresh = self.read(None)
        else:
            names = [r[0] for r in found.filter("kind <> 'deleted'").select("path").toLocalIterator()]
            fresh = self.read(names) if names else None
        if fresh is None:
            last = self._kept([self.batch])
            return last.filter_images(F.lit(False))
        self.label_map |= fresh.label_map
        fresh.images.withColumn("__stem", file_stem(F.col("relative_path"), self.folder)).write.mode("overwrite").parquet(self._path("images", at))
        fresh.annotations.write.mode("overwrite").parquet(self._path("annotations", at))
        return self._kept([at])

    def _kept(self, batches: list[int]) -> Dataset:
        there = [b for b in batches if self._exists(self._path("images", b))]
        if not there:
            return Dataset.build(self.spark.createDataFrame([], "id bigint, width int, height int, relative_path string, __stem string"), None, self.label_map)
        load = lambda name: self.spark.read.option("mergeSchema", True).parquet(*(self._path(name, b) for b in there))
        return Dataset(load("images"), load("annotations"), dict(self.label_map), self.folder)

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where))

    def _held_before(self, found: DataFrame, fresh: Dataset) -> Dataset:
        """What changed and deleted files held, from the batches that read them."""
        past = found.filter("kind <> 'added'").select(file_stem(F.col("path"), self.folder).alias("__stem"), F.col("batch").alias("__batch"))
        parts: Dataset | None = None
        for b in [r[0] for r in past.select("__batch").distinct().orderBy("__batch").collect()]:
            kept = self._kept([b])
            stems = past.filter(F.col("__batch") == b).select("__stem")
            images = kept.images.join(stems, "__stem", "left_semi")
            one = kept.with_(images=images, annotations=kept.annotations.join(images.select(F.col("id").alias("__i")), F.col("image_id") == F.col("__i"), "left_semi"))
            parts = one if parts is None else parts.with_(images=parts.images.unionByName(one.images, allowMissingColumns=True), annotations=parts.annotations.unionByName(one.annotations, allowMissingColumns=True))
        return parts if parts is not None else fresh.filter_images(F.lit(False))

    def start(self, cooldown: str = "5 seconds") -> FolderWatch:
        """Look at once, then at most once per ``cooldown``."""
        self.check()
        beat = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        # a failing look ends the stream; `exception` tells why
        self.query = beat.writeStream.foreachBatch(lambda df, n: self.check()).option("checkpointLocation", f"{self.checkpoint}/beat-{uuid.uuid4().hex}").trigger(processingTime=cooldown).start()
        return self

    def processAllAvailable(self) -> None:  # noqa: N802 - named as a streaming query's
        """Look now, and raise what ended the stream, if it ended."""
        if self.query is not None and self.query.exception() is not None:
            raise self.query.exception()
        self.check()

    def awaitTermination(self, timeout: float | None = None) -> bool | None:  # noqa: N802
        return self.query.awaitTermination(timeout) if self.query is not None else True

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    @property
    def isActive(self) -> bool:  # noqa: N802
        return self.query is not None and self.query.isActive

    def exception(self) -> Exception | None:
        return self.query.exception() if self.query is not None else None


def watch(spark: SparkSession, folder: str, read: Callable[[list[str] | None], Dataset], push: Callable[[Dataset, Dataset], None], checkpoint: str, cooldown: str = "5 seconds", once: bool = False) -> FolderWatch:
    """Call ``push(new, gone)`` for what is in ``folder``, and again after files came, changed or went.

    ``read(files)`` reads the given annotation files (None: all). A changed image is in both ``new``
    and ``gone``. ``once``: one look, without a stream.
    """
    w = FolderWatch(spark, folder, read, push, checkpoint)
    if once:
        w.check()
        return w
    return w.start(cooldown)


def windowed_counts(events: DataFrame, at: str = "ts", key: str = "event_type", window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events counted per key and tumbling window, batch or stream; on a stream events later than ``lateness`` are left out."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(at, lateness)
    return timed.groupBy(F.window(at, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
