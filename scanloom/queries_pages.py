"""Queries of the page operators on synthetic pages (the tables hold no images), and of event sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators import pages as P
from scanloom.plans import pipeline
from scanloom.streaming.state import sessions
from scanloom.tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return P.synthetic_pages(table(spark, d, "supplier").select("s_suppkey").repartition(48), "s_suppkey")


def page_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Measures and decisions of every page."""
    used = "text_density white_share agreed projection hough hough_confidence text text_confidence sharpness contrast brightness noise left right top bottom edge_density text_share width height phash page_hash"
    decided = P.decide(P.measure(_pages(spark, d).select("s_suppkey", "image"), only=used.split()))
    return decided.select("s_suppkey", "status", "is_blank", "rotation", F.round("skew", 1).alias("skew"), "quality_level", "reading_order", "document_type", "orientation", F.hex("measures.phash").alias("phash"), "measures.page_hash")


def page_recovery(spark: SparkSession, d: str) -> DataFrame:
    """How well what was planted is found again: pages, blank ones told apart, skews within half a degree, double pages split."""
    found = P.decide(P.measure(_pages(spark, d), only=("text_density", "white_share", "projection", "pages")))
    ink = ~F.col("planted_blank")
    return found.agg(
        F.count("*").alias("page_total"),
        F.count_if(F.col("is_blank") == F.col("planted_blank")).alias("blank_right"),
        F.count_if(ink & (F.abs(F.col("measures.projection") - F.col("planted_skew")) <= 0.5)).alias("skew_right"),
        F.count_if(ink).alias("with_ink"),
        F.count_if(ink & (F.col("planted_pages") == 2) & (F.size("measures.pages") == 2)).alias("split_right"),
        F.count_if(ink & (F.col("planted_pages") == 2)).alias("double_total"),
    )


def page_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Orientation, skew and crop fused into one pass; the corrected pages' sizes and outcomes."""
    done = P.correct(_pages(spark, d).select("s_suppkey", "image"), ["orientation", "skew", "crop"])
    return done.select("s_suppkey", F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.map_values("outcome").alias("outcomes")).withColumn("outcomes", F.array_join("outcomes", ","))


def page_segments(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every scan, and whether those of double ones are about half as wide as it."""
    scans = _pages(spark, d)
    parts = P.segment(scans.select("s_suppkey", F.when(F.col("planted_blank"), 1).otherwise(F.col("planted_pages")).alias("planted_pages"), F.col("image.width").alias("whole"), "image"))
    return parts.select("s_suppkey", "part", ((F.col("planted_pages") == 1) | F.col("image.width").between(F.col("whole") * 0.35, F.col("whole") * 0.6)).alias("as_planted"))


def page_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All twelve tasks on every page (sized to A4 at 36 dpi, about what the synthetic ones have), some also sent in again: one row a page, part and task with its status."""
    keys = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("page")).repartition(8)
    scans = P.synthetic_pages(keys, "page").select("page", "image")
    again = scans.where("page % 20 = 1").withColumn("page", F.col("page") + 1_000_000)
    texts = F.concat(F.lit("the page number "), F.col("page").cast("string"))
    done = pipeline.run(scans.unionByName(again).withColumn("text", texts), "full_pipeline", "page", text="text", dpi=36)
    return pipeline.log(done, "page")


def page_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags and advice for the outputs, and what overall quality they make."""
    known = pipeline.registry("s_suppkey")
    known.add("metadata", pipeline.described(fields=("flags", "advice", "overall"), keep_image=False))
    done = pipeline.run(_pages(spark, d).select("s_suppkey", "image"), ["metadata"], "s_suppkey", given=known)
    return done.where("metadata IS NOT NULL").select("s_suppkey", "metadata.flags", "metadata.advice", "metadata.overall").select(
        "s_suppkey", F.array_join("flags", ",").alias("flags"), (F.size("advice") == F.size("flags")).alias("advised"), "overall"
    )


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = sessions(table(spark, d, "events").select("user_id", "ts", "value"), "user_id", "ts", "value")
    return found.select("user_id", F.col("begin").cast("timestamp_ntz").alias("session_begin"), "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (page_decisions, page_recovery, page_corrections, page_segments, page_pipeline, page_flags, event_sessions)}

_SCANS = "(SELECT s_suppkey, s_suppkey % 10 = 9 AS blank, s_suppkey % 7 = 0 AS double FROM supplier)"
_TASKS = "dedup orientation skew crop sizing denoise contrast color segment language metadata export".split()

# What was planted must be found: skews within half a degree, double pages in two parts, blank ones told apart.
SQL = {
    "page_recovery": f"""SELECT count(*) AS page_total, count(*) AS blank_right, count_if(NOT blank) AS skew_right, count_if(NOT blank) AS with_ink,
  count_if(double AND NOT blank) AS split_right, count_if(double AND NOT blank) AS double_total FROM {_SCANS}""",
    "page_segments": f"SELECT s_suppkey, unnest(range(CASE WHEN double AND NOT blank THEN 2 ELSE 1 END))::INT AS part, true AS as_planted FROM {_SCANS}",
    "page_pipeline": f"""WITH s AS (SELECT n_nationkey::BIGINT AS page, n_nationkey % 10 = 9 AS blank, n_nationkey % 7 = 0 AS double FROM nation),
  p AS (SELECT *, false AS again FROM s UNION ALL SELECT page + 1000000, blank, double, true FROM s WHERE page % 20 = 1), t AS (SELECT unnest({_TASKS}) AS task)
  SELECT page, unnest(range(CASE WHEN double AND NOT blank AND NOT again THEN 2 ELSE 1 END))::INT AS part, task, CASE WHEN blank OR (again AND task <> 'dedup') THEN 'skipped' ELSE 'completed' END AS status FROM p, t""",
    "event_sessions": """
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_begin, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
}
