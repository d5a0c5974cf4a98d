"""The queries of problems 3, 4 and 6 over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.consolidate import consolidated_index, small_files, storage_paths
from scanloom.operators.orphans import Reference, find_orphans, from_epoch, month
from scanloom.operators.shred import catalog_attributes, catalog_children
from scanloom.tables import table


def _referenced_small(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "document_pages")
    named = pages.select(F.explode(F.array("original_image_path", "processed_image_path")).alias("path"))
    return small_files(table(spark, d, "stored_files"), [(named, F.col("path")), (storage_paths(table(spark, d, "document_catalog")), F.col("path"))])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidated_index(_referenced_small(spark, d)).select("file_id")


def p3_containers(spark: SparkSession, d: str) -> DataFrame:
    """How many files and bytes each container takes."""
    index = consolidated_index(_referenced_small(spark, d))
    return index.groupBy("container").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = [Reference(n, table(spark, d, n), F.col("id"), F.col("document_id"), F.col("created_at")) for n in ("document_pages", "file_metadata")]
    scans = find_orphans(refs, table(spark, d, "document_catalog"), F.col("id"), F.col("created_at"))
    log = [Reference("pages", table(spark, d, "pages"), F.col("ingest_id"), F.col("document_id"), F.col("created_at"))]
    ingested = find_orphans(log, table(spark, d, "ingest_documents"), F.col("document_id"), F.col("created_at"))
    return scans.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).unionByName(ingested.withColumn("created_at", from_epoch(F.col("created_at"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id", "state", month(F.col("created_at")).alias("period"))


def p4_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and state."""
    return p4_found(spark, d).groupBy("table_name", "period", "state").agg(F.count("*").alias("orphans"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_children(spark, d).select("parent_id", "child", "child_key")


def p6_children(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of all child objects with the scalars they have in common; ``p6_attributes`` has every scalar."""
    return catalog_children(table(spark, d, "document_catalog"), table(spark, d, "document_pages"))


def p6_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of all scalars of the child objects, at any depth, linked by (parent_id, child, child_key)."""
    return catalog_attributes(table(spark, d, "document_catalog"), table(spark, d, "document_pages"))


QUERIES = {f.__name__: f for f in (p3_found, p3_containers, p4_found, p4_by_period, p6_found, p6_children, p6_attributes)}

_KEY = "regexp_replace(regexp_replace(lower({0}), '[^0-9a-z]', '', 'g'), '^urnuuid', '')"


def _orphan_part(name: str, row_id: str, parents: str, parent_key: str, stamp: str) -> str:
    period = "strftime(c.created_at, '%Y-%m')" if stamp == "timestamp" else "strftime(make_timestamp((c.created_at * 1000000)::BIGINT), '%Y-%m')"
    return f"""
    SELECT DISTINCT '{name}' AS table_name, c.{row_id}::VARCHAR AS row_id,
           CASE WHEN p.key IS NULL THEN 'missing' ELSE 'early' END AS state, coalesce({period}, '') AS period
    FROM {name} c LEFT JOIN (SELECT {_KEY.format(parent_key)} AS key, min(created_at) AS created FROM {parents} GROUP BY 1) p
      ON p.key = {_KEY.format("c.document_id")}
    WHERE c.document_id IS NOT NULL AND trim(c.document_id) <> '' AND (p.key IS NULL OR p.created > c.created_at)"""


P4_SQL = " UNION ALL ".join(
    _orphan_part(*x)
    for x in (
        ("document_pages", "id", "document_catalog", "id", "timestamp"),
        ("file_metadata", "id", "document_catalog", "id", "timestamp"),
        ("pages", "ingest_id", "ingest_documents", "document_id", "epoch"),
    )
)


def path_sql(x: str) -> str:
    """DuckDB's form of ``file_path``."""
    raw = f"replace(trim({x}, ' ' || chr(9) || chr(10) || chr(13)), '\\', '/')"
    local = f"(CASE WHEN {raw} ILIKE 'file:%' THEN url_decode(regexp_replace(replace({raw}, '+', '%2B'), '^file://', '', 'i')) ELSE {raw} END)"
    absolute = f"(CASE WHEN {local} LIKE '/%' THEN {local} ELSE '/srv/scanstore/' || {local} END)"
    fold = "CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END"
    return f"(CASE WHEN {raw} <> '' THEN list_reduce(string_split({absolute}, '/'), lambda acc, x: {fold}, '') END)"


#: The JSON column's paths by pattern: every quoted path below the store in a valid value, unwrapped by dropping backslashes.
P3_SQL = f"""
WITH named AS (
  SELECT {path_sql("original_image_path")} AS p FROM document_pages
  UNION SELECT {path_sql("processed_image_path")} FROM document_pages
  UNION SELECT {path_sql("path")} FROM (
    SELECT path FROM (SELECT s, unnest(regexp_extract_all(s, '"(?:path|processed|thumbnails|metadata|preview)" *: *"([^"]*)"', 1)) AS path
      FROM (SELECT replace(replace(replace(replace(storage_paths, repeat('\\', 15), ''), repeat('\\', 7), ''), repeat('\\', 3), ''), '\\"', '"') AS s
            FROM document_catalog WHERE json_valid(storage_paths))))
),
files AS (SELECT {path_sql("path")} AS p, min(file_id) AS file_id, bool_or(size_bytes > 0 AND size_bytes < 1048576) AS small FROM stored_files GROUP BY 1)
SELECT file_id FROM files WHERE small AND p IN (SELECT p FROM named WHERE p IS NOT NULL)"""

SQL = {
    "p4_found": P4_SQL,
    "p4_by_period": f"SELECT table_name, period, state, count(*) AS orphans FROM ({P4_SQL}) GROUP BY ALL",
    "p3_found": P3_SQL,
}
