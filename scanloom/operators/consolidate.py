"""Far too many small files: which to consolidate, into which containers, and how.

``small_files`` finds the small files of a listing that some reference names, once each.
``plan_bins`` gives each a container near the target size and an offset in it, by running
sums within hash slices, so that no task sees the whole listing. The containers' member
index is written by many tasks as many small Parquet files; ``consolidate_parquet``
(``scanloom.sources.parquet_blocks``) copies their encoded column blocks into few files
without decoding and checks schema, block counts and row totals.

Defined cases: null and blank paths name nothing; a file listed more than once is one file
and goes by its smallest id; files of null size, empty files and files of ``limit`` bytes or
more stay where they are; several sizes of one file: it is small if any listed size is;
unreadable JSON names nothing; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.keys import STORE_ROOT, file_path
from scanloom.operators.shred import CATALOG_LAYOUT, adjacency
from scanloom.plans.workspace import Workspace
from scanloom.sources.parquet_blocks import consolidate_parquet

SMALL = 1_048_576
TARGET = 134_217_728


def storage_paths(catalog: DataFrame) -> DataFrame:
    """The paths in readable ``storage_paths``, one row each; spellings as written."""
    layout = {"storage_paths": CATALOG_LAYOUT["storage_paths"]}
    nodes = adjacency(catalog, "id", layout, children_only=True)
    return nodes.where("child = 'path' AND kind = 'string' AND (label = 'path' OR label = child_key)").select(F.col("scalar").alias("path"))


def small_files(listing: DataFrame, references: list[tuple[DataFrame, Column]], *, limit: int = SMALL, root: str = STORE_ROOT) -> DataFrame:
    """Rows (path, file_id, size_bytes) of the referenced small files; ``listing`` has file_id, path, size_bytes.

    Listing and references meet in one aggregation by resolved path, combined before the shuffle: a path named by a
    third of all rows arrives as one row a task, and no join is left to skew.
    """
    small = (F.col("size_bytes") > 0) & (F.col("size_bytes") < limit)
    sides = listing.select(file_path("path", root).alias("path"), F.col("file_id").cast("bigint").alias("file_id"), F.when(small, F.col("size_bytes")).alias("size_bytes"), F.lit(False).alias("named"))
    for df, path in references:
        sides = sides.unionByName(df.select(file_path(path, root).alias("path"), F.lit(None).cast("bigint").alias("file_id"), F.lit(None).cast("bigint").alias("size_bytes"), F.lit(True).alias("named")))
    files = sides.where("path IS NOT NULL").groupBy("path").agg(F.min("file_id").alias("file_id"), F.max("size_bytes").alias("size_bytes"), F.max("named").alias("named"))
    return files.where("named AND file_id IS NOT NULL AND size_bytes IS NOT NULL").drop("named")


def plan_bins(files: DataFrame, *, target: int = TARGET, slices: int | None = None) -> DataFrame:
    """``files`` with ``container`` and ``offset``: containers of ``target`` bytes or a little less, each file in one of them.

    Files are dealt into ``slices`` parts (default: one for each 64 containers that their bytes fill) by a hash of their path, and
    packed in path order within a part; only a part's last container may be far from full.
    """
    slices = slices or int((files.agg(F.sum("size_bytes")).first()[0] or 0) // (64 * target)) + 1
    w = Window.partitionBy("slice").orderBy("path")
    end = F.sum("size_bytes").over(w)
    start = end - F.col("size_bytes")
    placed = files.withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(slices)).cast("int")).withColumn("start", start)
    placed = placed.withColumn("bin", F.floor(F.col("start") / target).cast("int"))
    first = F.min("start").over(Window.partitionBy("slice", "bin"))
    return placed.select("file_id", "path", "size_bytes", F.format_string("container-%03d-%06d", "slice", "bin").alias("container"), (F.col("start") - first).alias("offset"))


def consolidated_index(files: DataFrame, name: str = "p3", *, target: int = TARGET) -> DataFrame:
    """The members of the planned containers (file_id, path, size_bytes, container, offset), read back from consolidated index files.

    Each task writes its part of the index; the parts' blocks are copied into few files. Fails unless each planned file is in there once.
    """
    spark = files.sparkSession
    ws = Workspace(spark, name)
    files = ws.save(files, "files")
    planned = ws.save(plan_bins(files, target=target), "index-parts")
    ws.drop("files")
    report = consolidate_parquet(spark, ws.path("index-parts"), ws.path("index"), target=target)
    expected, got = planned.count(), report.agg(F.sum("rows")).first()[0] or 0
    if expected != got:
        raise ValueError(f"{expected} files planned, {got} in the consolidated index")
    if not got:
        return planned
    index = ws.load("index", planned.schema)
    ws.drop("index-parts")
    return index
