"""Queries of problems 1, 2, 5 and 7 over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.keys import digest
from scanloom.llm import components, seen_keys, segments, survivors
from scanloom.queries_data import path_sql
from scanloom.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Precedences learned from the dated records and the constraints of the fields are ordered; per group and field the latest record by that order."""
    hashes, group, fields, time = table(spark, d, "document_hashes").where("id IS NOT NULL"), survivors.scan_group(), survivors.scan_fields(), survivors.scan_time()
    later = survivors.directions(fields, survivors.learn_directions(hashes, group, fields, time).collect())
    winners = survivors.latest(hashes, group, F.col("id"), fields, time, later)
    return survivors.by_field(winners.where("records = 2"), fields).select(F.col("group").alias("duplicate_group_id"), "field_name", "id")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The fused record of each group, its status by learned precedence."""
    return survivors.survivors(spark, table(spark, d, "document_hashes"))


def p1_precedence(spark: SparkSession, d: str) -> DataFrame:
    """What the data say about which processing status follows which, and about the declared orders of the other fields."""
    hashes, group, status = table(spark, d, "document_hashes").dropDuplicates(["id"]), survivors.scan_group(), survivors.scan_status()
    found = survivors.learn_precedence(hashes, group, status)
    return found.unionByName(survivors.learn_directions(hashes, group, survivors.scan_fields(), status.time))


def _arrivals(spark: SparkSession, d: str) -> list[tuple[str, str, DataFrame, DataFrame]]:
    seen = table(spark, d, "seen_hashes").select("key_kind", F.unhex(digest("digest")).alias("key"))
    tables = (("pages", "page", "page_hash", "ingest_id"), ("documents", "content", "content_hash", "doc_id"))
    return [(t, kind, seen.where(F.col("key_kind") == kind).select("key"), seen_keys.keys_of(table(spark, d, t), digest(c), F.col(i))) for t, kind, c, i in tables]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [seen_keys.seen_before(history, rows, f"p2-{t}").select(F.lit(t).alias("table_name"), F.col("row").cast("string").alias("row_id")) for t, _, history, rows in _arrivals(spark, d)]
    return parts[0].unionByName(parts[1])


def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per table and width in bits: the rows that a hash alone answers wrongly, all of which verification averts."""
    out = None
    for t, _, history, rows in _arrivals(spark, d):
        one = seen_keys.error_rate(history, rows, f"p2-{t}-rate").select(F.lit(t).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.components(components.scan_links(table(spark, d, "document_hashes"), table(spark, d, "hash_matches")), name="p5")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """How many groups have how many members."""
    sizes = p5_found(spark, d).groupBy("group_id").agg(F.count("*").alias("members"))
    return sizes.groupBy("members").agg(F.count("*").alias("group_count"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return segments.repeats(table(spark, d, "document_hashes"), name="p7")


def p7_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """Records and repeats per batch."""
    hashes = table(spark, d, "document_hashes").select(F.col("id").alias("new_id"), "batch_no").distinct()
    joined = hashes.where("batch_no >= 1").join(p7_found(spark, d), "new_id", "left")
    return joined.groupBy("batch_no").agg(F.count("*").alias("record_count"), F.count("seen_id").alias("repeats"))


QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p1_precedence, p2_found, p2_error_rate, p5_found, p5_groups, p7_found, p7_by_batch)}

_DIMS = "'^[^0-9-]*([0-9]{1,9})[^0-9-]+([0-9]{1,9})[^0-9-]*$'"
_GROUP = "regexp_full_match(duplicate_group_id, '[0-9a-fA-F]{16}')"


def _digest(x: str) -> str:
    return f"lower(nullif(regexp_extract({x}, '(?:^|[^0-9a-fA-F])([0-9a-fA-F]{{64}})(?:[^0-9a-fA-F]|$)', 1), ''))"


def _bits(x: str) -> str:
    bare = f"nullif(regexp_extract(lower(trim({x}, ' ' || chr(9) || chr(10))), '^(?:0x)?0*([0-9a-f]{{1,16}})$', 1), '')"
    return f"(('0x' || {bare})::UBIGINT)"


P1_SQL = f"""
WITH r AS (SELECT DISTINCT duplicate_group_id, id, file_size, first_seen,
    regexp_extract(image_dimensions, {_DIMS}, 1) AS w, regexp_extract(image_dimensions, {_DIMS}, 2) AS h
  FROM document_hashes WHERE {_GROUP}),
g AS (SELECT duplicate_group_id FROM r GROUP BY 1 HAVING count(DISTINCT id) > 1),
v AS (
  SELECT duplicate_group_id, 'file_size' AS field_name, id, file_size::DOUBLE AS score FROM r WHERE file_size BETWEEN 1 AND 1073741824
  UNION ALL SELECT duplicate_group_id, 'first_seen', id, -epoch_us(first_seen)::DOUBLE FROM r WHERE year(first_seen) BETWEEN 2020 AND 2025
  UNION ALL SELECT duplicate_group_id, 'image_dimensions', id, w::DOUBLE * h::DOUBLE FROM r WHERE w <> '' AND w::BIGINT > 0 AND h::BIGINT > 0)
SELECT duplicate_group_id, field_name, id FROM v JOIN g USING (duplicate_group_id)
QUALIFY row_number() OVER (PARTITION BY duplicate_group_id, field_name ORDER BY score DESC, id) = 1"""

_RANKS = "CASE WHEN file_size BETWEEN 1 AND 1073741824 THEN file_size::DOUBLE END AS file_size, CASE WHEN year(first_seen) BETWEEN 2020 AND 2025 THEN -epoch_us(first_seen)::DOUBLE END AS first_seen, CASE WHEN w::BIGINT > 0 AND h::BIGINT > 0 THEN w::DOUBLE * h::DOUBLE END AS image_dimensions"

P1_PRECEDENCE_SQL = f"""
WITH r AS (SELECT DISTINCT ON (id) id, duplicate_group_id AS g, processing_status AS v, last_seen AS t, file_size, first_seen,
    nullif(regexp_extract(image_dimensions, {_DIMS}, 1), '') AS w, nullif(regexp_extract(image_dimensions, {_DIMS}, 2), '') AS h FROM document_hashes WHERE {_GROUP}),
s AS (SELECT g, v, min(t) AS first, max(t) AS last FROM r WHERE v IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
c AS (SELECT a.v AS earlier, b.v AS later, count(*) AS support FROM s a JOIN s b ON a.g = b.g AND a.v <> b.v AND a.last < b.first GROUP BY ALL),
x AS (UNPIVOT (SELECT g, t, {_RANKS} FROM r WHERE t IS NOT NULL) ON file_size, first_seen, image_dimensions INTO NAME field VALUE rank),
e AS (SELECT field, g, max(t) FILTER (rank = least) AS last, min(t) FILTER (rank = most) AS first
  FROM (SELECT *, min(rank) OVER w AS least, max(rank) OVER w AS most FROM x WINDOW w AS (PARTITION BY field, g)) WHERE least < most GROUP BY ALL)
SELECT 'processing_status' AS field, c.earlier, c.later, c.support, coalesce(o.support, 0) AS against FROM c LEFT JOIN c o ON o.earlier = c.later AND o.later = c.earlier
UNION ALL SELECT field, 'worst', 'best', count_if(last < first), count_if(last > first) FROM e GROUP BY field"""

P2_SQL = f"""
WITH a AS (SELECT 'pages' AS table_name, 'page' AS kind, ingest_id AS id, {_digest("page_hash")} AS k FROM pages
  UNION ALL SELECT 'documents', 'content', doc_id, {_digest("content_hash")} FROM documents),
s AS (SELECT DISTINCT key_kind AS kind, {_digest("digest")} AS k FROM seen_hashes),
f AS (SELECT kind, k, min(id) AS first FROM a GROUP BY ALL)
SELECT table_name, a.id::VARCHAR AS row_id FROM a JOIN f ON f.kind = a.kind AND f.k = a.k LEFT JOIN s ON s.kind = a.kind AND s.k = a.k
WHERE a.id > f.first OR s.k IS NOT NULL"""

P5_SQL = f"""
WITH RECURSIVE r AS (SELECT DISTINCT id, {path_sql("file_path")} AS p, CASE WHEN {_GROUP} THEN duplicate_group_id END AS g FROM document_hashes),
m AS (SELECT {path_sql("left_path")} AS l, {path_sql("right_path")} AS r FROM hash_matches
  WHERE similarity_score >= 85 OR (similarity_score <= 1 AND similarity_score >= 0.85)),
e AS (SELECT a.id AS a, b.id AS b FROM m JOIN r a ON a.p = m.l JOIN r b ON b.p = m.r WHERE a.id <> b.id
  UNION SELECT id, min(id) OVER (PARTITION BY g) FROM r WHERE g IS NOT NULL),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(v, u) AS (SELECT a, a FROM both_ways UNION SELECT reach.v, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.u)
SELECT min(u) AS group_id, v AS id FROM reach GROUP BY v"""

P7_SQL = f"""
WITH r AS (SELECT DISTINCT id, batch_no, {_digest("content_hash")} AS k, {_bits("perceptual_hash")} AS p FROM document_hashes)
SELECT min(o.id) AS seen_id, n.id AS new_id FROM r n JOIN r o ON o.id < n.id AND (o.k = n.k OR bit_count(xor(o.p, n.p)::BIT) <= 3)
WHERE n.batch_no >= 1 GROUP BY n.id"""

SQL = {
    "p1_found": P1_SQL,
    "p1_precedence": P1_PRECEDENCE_SQL,
    "p2_found": P2_SQL,
    "p5_found": P5_SQL,
    "p5_groups": f"SELECT members, count(*) AS group_count FROM (SELECT group_id, count(*) AS members FROM ({P5_SQL}) GROUP BY 1) GROUP BY 1",
    "p7_found": P7_SQL,
    "p7_by_batch": f"SELECT batch_no, count(*) AS record_count, count(seen_id) AS repeats FROM (SELECT DISTINCT id AS new_id, batch_no FROM document_hashes WHERE batch_no >= 1) LEFT JOIN ({P7_SQL}) USING (new_id) GROUP BY 1",
}
