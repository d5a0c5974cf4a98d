"""spark-submit entry: processes the pages of a folder by a mode or transformation, all of its tasks.

    spark-submit scanloom/cli.py --mode orient_skew_crop --input in/ --output out/ [--index-db index/] [--allow-duplicates] [--form png]
        [--workers 64] [--temp shared/] [--rasteriser module:function --pdf-dpi 300] [--no-comparisons]

The result has one row a page or part: path, part, state, outcome, and the file written. Pages that cannot be read, and PDFs without a
rasteriser, have state ``failed`` and no file.
"""

from __future__ import annotations

import argparse
import functools
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.scalars import stem
from scanloom.kernels import page as P
from scanloom.operators import pages
from scanloom.plans import modes, pipeline
from scanloom.plans.workspace import Workspace
from scanloom.sources import files

RESULT = ["path", "part", "state", "outcome", "name", "file", "length", "sha256"]


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Prepares the pages of a folder")
    p.add_argument("--mode", default="full_pipeline", choices=sorted({*modes.MODES, *modes.TRANSFORMATIONS}))
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--index-db", "--index", dest="index", help="folder of the table of pages already taken in")
    p.add_argument("--allow-duplicates", action="store_true")
    p.add_argument("--form", default="png", choices=("png", "tiff", "pdf"))
    p.add_argument("--dpi", type=int, default=250, help="of the A4 page that sizing makes")
    p.add_argument("--workers", type=int, help="tasks the pages are dealt to")
    p.add_argument("--temp", help="folder that all executors share, for intermediate tables")
    p.add_argument("--rasteriser", help="module:function that turns a PDF's bytes (and dpi=) into its pages' BGR arrays")
    p.add_argument("--pdf-dpi", type=int, default=300)
    p.add_argument("--no-comparisons", action="store_true", help="write no images of the pages before and after")
    return p.parse_args(arguments)


def _pages(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(pages with path and image, PDFs that nothing can read)."""
    images = files.read_images(spark, o.input).withColumn("path", F.col("image.origin")).select("path", "image")
    listed = files.list_files(spark, o.input, content=True)
    if o.index and not o.allow_duplicates:
        listed, _ = files.new_files(listed, spark.read.parquet(o.index))
        images = images.join(listed.select("path"), "path", "left_semi")
    pdfs = listed.where("kind = 'pdf'")
    if o.rasteriser:
        module, name = o.rasteriser.split(":")
        turn = functools.partial(getattr(importlib.import_module(module), name), dpi=o.pdf_dpi)
        images = images.unionByName(files.pdf_images(pdfs, turn))
        pdfs = pdfs.limit(0)
    return images.repartition(o.workers) if o.workers else images, pdfs.select("path")


def run(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """Known files are left out first; everything else comes back, one row a page or part."""
    if o.temp:
        spark.conf.set("spark.checkpoint.dir", o.temp)
    images, unread = _pages(spark, o)
    tasks = modes.TRANSFORMATIONS[o.mode].split() if o.mode in modes.TRANSFORMATIONS else modes.plan(o.mode)
    ws = Workspace(spark, "cli")
    done = pipeline.run(images, [t for t in tasks if t != "export"], "path", dpi=o.dpi)
    if not o.no_comparisons:
        done = ws.save(done, "pages")  # read twice
        compared(images.withColumnRenamed("image", "before"), done.where("part = 0"), f"{o.output.rstrip('/')}/comparisons")
    done = pipeline.exported("path", form=o.form)(done)
    if "export" not in tasks:
        done = done.withColumn("outcome", F.map_filter("outcome", lambda k, _: k != "export"))
    rows = ws.save(done.select("path", "part", "state", "outcome", "name", "content"), "outputs")
    written = files.write_files(rows.where("content IS NOT NULL").select("name", "content"), o.output)
    written = written.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("path").alias("file"), "length", "sha256")
    out = rows.drop("content").join(written, "name", "left").select(*RESULT)
    failed = unread.select("path", F.lit(0).alias("part"), F.lit("failed").alias("state"), F.create_map().cast("map<string,string>").alias("outcome"), *[F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("file", "string"), ("length", "bigint"), ("sha256", "string"))])
    return out.unionByName(failed)


def compared(before: DataFrame, after: DataFrame, folder: str) -> None:
    """Writes an image of each page before and after."""
    both = before.join(after.select("path", F.col("image").alias("after")), "path").where("before IS NOT NULL AND after IS NOT NULL")

    def side_by_side(frames):
        for frame in frames:
            kept = [(x, pages.to_array(a), pages.to_array(b)) for x, a, b in zip(frame["path"], frame["before"], frame["after"])]
            kept = [k for k in kept if k[1] is not None and k[2] is not None]
            frame = frame.iloc[: len(kept)][["path"]].copy()
            frame["path"], frame["content"] = [k[0] for k in kept], [files.encode_png(P.shrink(P.comparison(a, b), 1600)) for _, a, b in kept]
            yield frame

    made = both.mapInPandas(side_by_side, "path string, content binary")
    files.write_files(made.select(F.concat(stem(F.col("path")), F.lit("_comparison.png")).alias("name"), "content"), folder).count()


def main() -> None:
    spark = SparkSession.builder.appName("scanloom").getOrCreate()
    done = run(spark, options())
    done.groupBy("state").agg(F.count("*").alias("pages"), F.count("file").alias("files"), F.sum("length").alias("bytes")).show()


if __name__ == "__main__":
    main()
