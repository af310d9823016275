"""python -m framewright.cli FOLDER OUT: viewer documents of a per-image JSON data set, once or kept up to date."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from framewright.model import Dataset
from framewright.session import scratch_path
from framewright.sources import readers, writers
from framewright.streaming.watch import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framewright", description=__doc__)
    p.add_argument("folder", help="data set with Annotations and Images")
    p.add_argument("out", help="folder for the documents")
    p.add_argument("--splits", nargs="*", default=None, help="splits to read, all by default")
    p.add_argument("--schema", default=None, help="JSON Schema to check against, 'default' for the built-in one")
    p.add_argument("--watch", action="store_true", help="stay and follow changes")
    p.add_argument("--once", action="store_true", help="with --watch: take in what changed since --state was written, then stop")
    p.add_argument("--state", default=None, help="folder that keeps what was seen, to go on from in a later run")
    p.add_argument("--cooldown", default="5 seconds", help="least time between two updates")
    return p


def push(new: Dataset, gone: Dataset, out: str) -> None:
    """Write the documents of new and changed images; remove those of images that are no more."""
    name = F.concat(F.regexp_replace("relative_path", r"\.[^./]+$", ""), F.lit(".json"))
    kept = new.images.select("relative_path")
    for r in gone.images.select("relative_path").join(kept, "relative_path", "left_anti").select(name.alias("p")).toLocalIterator():
        path = os.path.join(out, r["p"])
        if os.path.exists(path):
            os.remove(path)
    writers._files_from(writers.sample_documents(new).select(name.alias("path"), "content"), out)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    def read(files: list[str] | None = None) -> Dataset:
        return readers.from_image_json(spark, args.folder, splits_to_read=args.splits, use_schema=args.schema is not None, json_schema=args.schema, files=files)

    if not args.watch:
        first = read()
        push(first, first.filter_images(F.lit(False)), args.out)
        return
    query = watch(spark, f"{args.folder}/Annotations", read, lambda new, gone: push(new, gone, args.out), args.state or scratch_path(spark, "watch"), args.cooldown, args.once)
    query.awaitTermination()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("framewright").getOrCreate(), args)


if __name__ == "__main__":
    main()
