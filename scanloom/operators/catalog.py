"""The catalogue of documents and pages: search, look-ups, joins, upserts, access, retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOWED_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tiff", "tif", "pdf")
LARGEST_UPLOAD = 100 * 1024 * 1024


def by_filename(documents: DataFrame, name: str, *, exact: bool = False) -> DataFrame:
    """Documents whose stored or original file name is ``name``, or contains it (case of ASCII letters aside; % and _ are wildcards)."""
    either = [F.col(c) for c in ("filename", "original_filename")]
    match = [c == name if exact else c.ilike(f"%{name}%") for c in either]
    return documents.where(match[0] | match[1])


def search(documents: DataFrame, *, filename=None, content_hash=None, file_type=None, status=None, transformation_type=None, date_from=None, date_to=None) -> DataFrame:
    """Documents for which every given condition holds; the dates are inclusive. Equality and range predicates reach the scan."""
    out = by_filename(documents, filename) if filename else documents
    for column, value in (("content_hash", content_hash), ("file_type", file_type), ("status", status), ("transformation_type", transformation_type)):
        out = out.where(F.col(column) == value) if value else out
    out = out.where(F.col("created_at") >= F.lit(date_from)) if date_from else out
    return out.where(F.col("created_at") <= F.lit(date_to)) if date_to else out


def newest(documents: DataFrame, *, page: int = 1, page_size: int = 50) -> DataFrame:
    """A page of results, newest first, ids breaking ties: a top-k, not a full sort."""
    return documents.orderBy(F.desc_nulls_last("created_at"), "id").offset((page - 1) * page_size).limit(page_size)


def total_estimate(returned: int, page: int, page_size: int) -> int:
    """The number of results as far as a page tells: exact on a page that is not full."""
    return returned if returned < page_size else page_size * page + 1


def upload_error(name: Column, size: Column) -> Column:
    """Null for a file that may come in, else why not."""
    suffix = F.lower(F.regexp_extract(F.trim(name), r"\.([^.]+)$", 1))
    return F.when(~suffix.isin(*ALLOWED_SUFFIXES) | suffix.isNull(), "unsupported_type").when(size > LARGEST_UPLOAD, "too_large")


def expired(documents: DataFrame, now: datetime, *, hours: int) -> DataFrame:
    return documents.where(F.col("created_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS"))


def with_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Each document with its pages in order, as an array; documents without pages have null."""
    nested = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "id", "processing_status"))).alias("pages"))
    return documents.join(nested.withColumnRenamed("document_id", "id"), "id", "left")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. One aggregation with partial results, so that a key of many rows is no long sort."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("best"))
    return best.select(*keys, "best.*")


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an upsert where the last write wins."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*keys, "best.*")


def patch(base: DataFrame, changes: DataFrame, key: str, *, columns: list[str]) -> DataFrame:
    """``base`` with the non-null values of ``changes`` (one row a key) in ``columns``; rows of new keys are added."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(new, key, "full")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def touch(entries: DataFrame, accesses: DataFrame, key: str) -> DataFrame:
    """Entries with last_accessed and access_count brought up to date by a log of accesses (key, at)."""
    seen = accesses.groupBy(key).agg(F.max("at").alias("last"), F.count("*").alias("n"))
    return entries.join(seen, key, "left").withColumns({"last_accessed": F.greatest("last_accessed", "last"), "access_count": F.col("access_count") + F.coalesce("n", F.lit(0))}).drop("last", "n")


def cache_hits(requests: DataFrame, cache: DataFrame, *, ttl_hours: int = 24) -> DataFrame:
    """Requests (key, at, and others) with ``hit``: an entry (key, created_at) of the key that is not yet expired. One row a request.

    The last entry before a request decides: one union and one window, so that no key's entries are gathered. Requests without a key hit nothing.
    """
    entries = cache.where("key IS NOT NULL AND created_at IS NOT NULL").select("key", F.col("created_at").alias("at")).distinct()
    given = requests.where("key IS NOT NULL")
    both = given.withColumn("_entry", F.lit(False)).unionByName(entries.withColumn("_entry", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("key").orderBy("at", "_entry").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("_entry"), F.col("at"))).over(w)
    oldest = F.col("at") - F.expr(f"INTERVAL {int(ttl_hours)} HOURS")
    found = both.withColumn("_last", last).where("NOT _entry").withColumn("hit", F.coalesce(F.col("_last") >= oldest, F.lit(False)))
    return found.select(*requests.columns, "hit").unionByName(requests.where("key IS NULL").withColumn("hit", F.lit(False)))


def status_now(log: DataFrame, key: str) -> DataFrame:
    """The state machine replayed: last status, first start and last end per key of a log (key, status, at)."""
    ended = F.col("status").isin("completed", "failed")
    return log.groupBy(key).agg(
        F.max_by("status", F.struct("at", "status")).alias("status"),
        F.min(F.when(F.col("status") == "in_progress", F.col("at"))).alias("started_at"),
        F.max(F.when(ended, F.col("at"))).alias("completed_at"),
    )


def integrity(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Two snapshots (key, size, hash) compared: ok, missing, new, size_changed or hash_changed."""
    a, b = before.select(key, F.col("size").alias("s0"), F.col("hash").alias("h0"), F.lit(True).alias("in0")), after.select(key, F.col("size").alias("s1"), F.col("hash").alias("h1"), F.lit(True).alias("in1"))
    verdict = F.when(F.col("in1").isNull(), "missing").when(F.col("in0").isNull(), "new").when(~F.col("s0").eqNullSafe(F.col("s1")), "size_changed").when(~F.col("h0").eqNullSafe(F.col("h1")), "hash_changed").otherwise("ok")
    return a.join(b, key, "full").select(key, verdict.alias("verdict"))


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Deletion: the rows whose key is not in ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def page_image(pages: DataFrame, *, thumbnails: bool = False) -> Column:
    """Which image of a page is served: a thumbnail if wanted and there, else the processed, else the original one."""
    order = (["thumbnail_path"] if thumbnails and "thumbnail_path" in pages.columns else []) + ["processed_image_path", "original_image_path"]
    return F.coalesce(*order)


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\s*$", 1))
    known = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf", "zip": "application/zip", "json": "application/json"}
    out = F.when(suffix.isNull(), None)
    for s, m in known.items():
        out = out.when(suffix == s, m)
    return out.otherwise("application/octet-stream")


def keep_recent(df: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The ``n`` entries used last (a top-k over the keys' last uses)."""
    return df.groupBy(key).agg(F.max(at).alias("last_used")).orderBy(F.desc("last_used"), key).limit(n)


def evict_prefix(df: DataFrame, part: list[str], order: list[str], size: str, to_free: Column) -> DataFrame:
    """Oldest entries first until at least ``to_free`` is freed: those before which less was free. Per ``part``, so that each cache is one sort."""
    w = Window.partitionBy(*part).orderBy(*order)
    before = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("freed_before", F.coalesce(before, F.lit(0))).where(F.col("freed_before") < to_free)


# ---- new rows


def new_documents(files: DataFrame, now: datetime) -> DataFrame:
    """Catalogue rows for files (filename, original_path, file_size, and others): id, lower-case suffix, media type, status pending."""
    suffix = F.lower(F.nullif(F.regexp_extract("filename", r"(\.[^.]+)$", 1), F.lit("")))
    original = F.coalesce("original_filename", "filename") if "original_filename" in files.columns else F.col("filename")
    return files.withColumns(
        {"id": F.uuid(), "original_filename": original, "file_extension": suffix, "mime_type": media_type(F.col("filename")), "status": F.lit("pending"), "created_at": F.lit(now).cast("timestamp_ntz")}
    )


def checksums(files: DataFrame, key: str, name: str = "path", checksum: str = "checksum", size: str = "size_bytes") -> DataFrame:
    """Per key: bytes, and a map of names to checksums. A key's map holds its files; give keys of bounded size (a document, not a store)."""
    pairs = F.map_from_entries(F.sort_array(F.collect_set(F.struct(name, checksum))))
    return files.where(F.col(name).isNotNull()).groupBy(key).agg(F.sum(size).alias("bytes"), pairs.alias("checksums"))


def alive(entries: DataFrame, now: datetime) -> DataFrame:
    """Cache entries (expires_at) that have not expired."""
    return entries.where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))
