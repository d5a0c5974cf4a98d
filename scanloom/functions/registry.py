"""The functions for SQL users: temporary SQL functions (bodies that Catalyst inlines) and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SQL_FUNCTIONS = {
    "scan_digest(x STRING) RETURNS STRING": r"lower(nullif(regexp_extract(x, '(?<![0-9a-fA-F])([0-9a-fA-F]{64})(?![0-9a-fA-F])', 1), ''))",
    "scan_document_key(x STRING) RETURNS STRING": r"regexp_replace(regexp_replace(lower(trim(x)), '^urn:uuid:', ''), '[^0-9a-z]', '')",
    "scan_hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "scan_similarity(d INT) RETURNS INT": "greatest(0, 100 - 5 * d)",
    "scan_group_id(x STRING) RETURNS STRING": "substring(md5(x), 1, 16)",
    "scan_quality_level(s INT) RETURNS STRING": "CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 40 THEN 'fair' WHEN s >= 20 THEN 'poor' ELSE 'very_poor' END",
}


@udtf(returnType="child string, child_key string")
class JsonChildren:
    """SQL: ``SELECT * FROM t, LATERAL scan_children(t.processing_metadata, 'tasks')``."""

    def eval(self, text: str, layout: str):
        from scanloom.operators.shred import parse, shred

        value, ok = parse(text)
        found: set[tuple[str, str]] = set()
        if ok:
            shred(layout, value, lambda *node: found.add((node[6], node[7])) if node[6] is not None else None)
        yield from sorted(found)


def register(spark: SparkSession) -> list[str]:
    """Registers all of them; returns their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {_literal(body)}")
    spark.udtf.register("scan_children", JsonChildren)
    return [*(head.split("(")[0] for head in SQL_FUNCTIONS), "scan_children"]


def _literal(body: str) -> str:
    """A body with its backslashes as SQL literals need them."""
    return body.replace("\\", "\\\\")
