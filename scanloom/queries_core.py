"""Queries of the catalogue, statistics, text, rule and sequence operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.functions import rules as R
from scanloom.functions import scalars as Z
from scanloom.functions import text as T
from scanloom.functions.keys import digest, document_key, hash64
from scanloom.operators import catalog as C
from scanloom.operators import dedup as D
from scanloom.operators import sequence as S
from scanloom.plans import modes
from scanloom.streaming.state import windows
from scanloom.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _catalog(s, d):
    return table(s, d, "document_catalog").dropDuplicates(["id"])


def _pages(s, d):
    return table(s, d, "document_pages").dropDuplicates(["id"])


CAT = "(SELECT DISTINCT ON (id) * FROM document_catalog)"
PAG = "(SELECT DISTINCT ON (id) * FROM document_pages)"
META = "(SELECT DISTINCT ON (id) * FROM file_metadata)"
HASH = "(SELECT DISTINCT ON (id) * FROM document_hashes)"
NOW = datetime(2025, 6, 1)

# ---- search and look-ups


@query(f"SELECT id, filename FROM {CAT} WHERE filename ILIKE '%invoice%' OR original_filename ILIKE '%invoice%'")
def search_by_filename(s, d):
    return C.by_filename(table(s, d, "document_catalog"), "invoice").select("id", "filename").dropDuplicates(["id"])


@query(f"SELECT id, filename FROM {CAT} WHERE filename = 'Letter_9331.png' OR original_filename = 'Letter_9331.png'")
def search_exact_filename(s, d):
    return C.by_filename(table(s, d, "document_catalog"), "Letter_9331.png", exact=True).select("id", "filename").dropDuplicates(["id"])


@query(f"SELECT id, content_hash FROM {CAT} WHERE content_hash IN (SELECT min(content_hash) FROM document_catalog)")
def search_by_hash(s, d):
    least = table(s, d, "document_catalog").agg(F.min("content_hash")).scalar()
    return table(s, d, "document_catalog").where(F.col("content_hash") == least).select("id", "content_hash").dropDuplicates(["id"])


@query(f"""SELECT id, filename, created_at FROM {CAT} WHERE file_type = 'pdf' AND status = 'completed'
  AND created_at >= TIMESTAMP '2023-03-01' AND created_at <= TIMESTAMP '2025-03-01'
  ORDER BY created_at DESC NULLS LAST, id OFFSET 20 LIMIT 20""")  # fmt: skip
def search_documents_page(s, d):
    found = C.search(table(s, d, "document_catalog"), file_type="pdf", status="completed", date_from=datetime(2023, 3, 1), date_to=datetime(2025, 3, 1))
    return C.newest(found.select("id", "filename", "created_at").dropDuplicates(["id"]), page=2, page_size=20).select("id", "filename", "created_at")


@query(f"SELECT status, count(*) AS document_count FROM {CAT} GROUP BY status")
def status_breakdown(s, d):
    return _catalog(s, d).groupBy("status").agg(F.count("*").alias("document_count"))


@query(f"SELECT id, status FROM {CAT} WHERE created_at < TIMESTAMP '2025-06-01' - INTERVAL 48 HOUR AND status IN ('completed', 'failed')")
def retention_candidates(s, d):
    return C.expired(table(s, d, "document_catalog"), NOW, hours=48).where(F.col("status").isin("completed", "failed")).select("id", "status").dropDuplicates(["id"])


@query(f"""SELECT coalesce(CASE WHEN suffix IS NULL OR suffix NOT IN ('png','jpg','jpeg','bmp','tiff','tif','pdf') THEN 'unsupported_type'
    WHEN file_size > 104857600 THEN 'too_large' END, 'accepted') AS verdict, count(*) AS document_count
  FROM (SELECT *, CASE WHEN filename IS NOT NULL THEN lower(regexp_extract(trim(filename), '[.]([^.]+)$', 1)) END AS suffix FROM {CAT}) GROUP BY 1""")  # fmt: skip
def upload_validation(s, d):
    verdict = F.coalesce(C.upload_error(F.col("filename"), F.col("file_size")), F.lit("accepted"))
    return _catalog(s, d).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("document_count"))


@query(f"SELECT id, CASE WHEN completed_at IS NOT NULL AND started_at IS NOT NULL THEN round((epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 6) END AS duration, coalesce(original_filename, filename) AS shown_name FROM {CAT}")
def document_responses(s, d):
    seconds = F.timestamp_diff("MICROSECOND", "started_at", "completed_at") / 1e6
    return _catalog(s, d).select("id", r6(seconds).alias("duration"), F.coalesce("original_filename", "filename").alias("shown_name"))


@query(f"""SELECT c.id, count(p.id) AS page_count, coalesce(string_agg(p.page_number::VARCHAR, ',' ORDER BY p.page_number, p.id), '') AS page_numbers
  FROM {CAT} c LEFT JOIN {PAG} p ON p.document_id = c.id GROUP BY c.id""")  # fmt: skip
def document_with_pages(s, d):
    joined = C.with_pages(_catalog(s, d).select("id"), _pages(s, d))
    numbers = F.coalesce(F.array_join(F.transform("pages", lambda p: p["page_number"].cast("string")), ","), F.lit(""))
    return joined.select("id", F.coalesce(F.size("pages").cast("bigint"), F.lit(0)).alias("page_count"), numbers.alias("page_numbers")).withColumn("page_count", F.greatest("page_count", F.lit(0)))


@query(f"""SELECT c.id, m.file_format, m.language_detected FROM {CAT} c LEFT JOIN
  (SELECT document_id, file_format, language_detected FROM {META} WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at NULLS LAST, id) = 1) m ON m.document_id = c.id""")  # fmt: skip
def document_metadata(s, d):
    meta = table(s, d, "file_metadata").where("document_id IS NOT NULL").dropDuplicates(["id"])
    order = [F.col("created_at").isNull(), F.col("created_at"), F.col("id").alias("i")]
    first = C.first_per(meta.select("document_id", "file_format", "language_detected", "created_at", "id"), ["document_id"], order)
    return _catalog(s, d).select("id").join(first.select(F.col("document_id").alias("id"), "file_format", "language_detected"), "id", "left")


_DIG = "lower(nullif(regexp_extract({0}, '(?:^|[^0-9a-fA-F])([0-9a-fA-F]{{64}})(?:[^0-9a-fA-F]|$)', 1), ''))"


@query(f"SELECT id FROM {PAG} WHERE {_DIG.format('page_hash')} IN (SELECT {_DIG.format('page_hash')} FROM pages)")
def indexed_pages(s, d):
    known = table(s, d, "pages").select(digest("page_hash").alias("h")).where("h IS NOT NULL").distinct()
    return _pages(s, d).withColumn("h", digest("page_hash")).join(known, "h", "left_semi").select("id")


@query(f"SELECT p.id FROM (SELECT id, {_DIG.format('page_hash')} AS h FROM {PAG}) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT {_DIG.format('page_hash')} AS h FROM pages) q WHERE q.h = p.h)")
def unindexed_pages(s, d):
    known = table(s, d, "pages").select(digest("page_hash").alias("h")).where("h IS NOT NULL").distinct()
    return _pages(s, d).withColumn("h", digest("page_hash")).join(known, "h", "left_anti").select("id")


@query(f"""WITH c AS (SELECT id, content_hash || ':' || transformation_type AS k, created_at, status FROM {CAT})
  SELECT r.id, coalesce(bool_or(e.created_at < r.created_at AND e.created_at >= r.created_at - INTERVAL 720 HOUR), false) AS hit
  FROM c r LEFT JOIN c e ON e.k = r.k AND e.status = 'completed' GROUP BY r.id""")  # fmt: skip
def cache_lookup(s, d):
    c = _catalog(s, d).select("id", F.concat_ws(":", "content_hash", "transformation_type").alias("key"), F.col("created_at"), "status", "content_hash", "transformation_type")
    c = c.withColumn("key", F.when(F.col("content_hash").isNotNull() & F.col("transformation_type").isNotNull(), F.col("key")))
    return C.cache_hits(c.select("id", "key", F.col("created_at").alias("at")), c.where("status = 'completed'").select("key", "created_at"), ttl_hours=720).select("id", "hit")


@query("""SELECT p.ingest_id, i.document_id AS parent FROM pages p JOIN (SELECT DISTINCT document_id, regexp_extract(source_path, '([^/]+)\\.[pP][dD][fF]$', 1) AS stem FROM ingest_documents) i
  ON i.stem = regexp_extract(p.source_path, '([^/]+)/[^/]+$', 1) WHERE i.stem <> ''""")
def pdf_parents(s, d):
    parents = table(s, d, "ingest_documents").select(F.col("document_id").alias("parent"), F.regexp_extract("source_path", r"([^/]+)\.[pP][dD][fF]$", 1).alias("stem")).where("stem <> ''").distinct()
    children = table(s, d, "pages").select("ingest_id", F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1).alias("stem"))
    return children.join(parents, "stem").select("ingest_id", "parent")


# ---- duplicates


@query(f"""WITH h AS (SELECT id, file_path, {_DIG.format('content_hash')} AS k FROM {HASH})
  SELECT k AS key, min_by(file_path, id) AS master, count(DISTINCT id) AS copies, substr(md5(min_by(file_path, id)), 1, 16) AS group_id FROM h WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT id) > 1""")  # fmt: skip
def exact_duplicates(s, d):
    return D.exact_groups(table(s, d, "document_hashes"), digest("content_hash"), F.col("id"), F.col("file_path"))


_BITS = "(('0x' || nullif(regexp_extract(lower(trim(perceptual_hash, ' ' || chr(9) || chr(10))), '^(?:0x)?0*([0-9a-f]{1,16})$', 1), ''))::UBIGINT)"


@query(f"""WITH h AS (SELECT id, {_BITS} AS p FROM {HASH}),
  x AS (SELECT a.id, b.id AS "match", bit_count(xor(a.p, b.p)::BIT) AS distance FROM h a JOIN h b ON b.id < a.id AND bit_count(xor(a.p, b.p)::BIT) <= 3)
  SELECT id, "match", distance, greatest(0, 100 - 5 * distance) AS similarity FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, "match") = 1""")  # fmt: skip
def perceptual_duplicates(s, d):
    return D.nearest_earlier(table(s, d, "document_hashes").select("id", hash64("perceptual_hash").alias("p")), "id", "p")


@query(f"""SELECT count(*) AS record_count, count_if(processing_status = 'duplicate') AS duplicates, count(DISTINCT CASE WHEN regexp_full_match(duplicate_group_id, '[0-9a-f]{{16}}') THEN duplicate_group_id END) AS group_count,
  round(100.0 * count_if(processing_status = 'duplicate') / count(*), 6) AS percent FROM {HASH}""")  # fmt: skip
def dedup_statistics(s, d):
    h = table(s, d, "document_hashes").dropDuplicates(["id"])
    dup = F.count_if(F.col("processing_status") == "duplicate")
    groups = F.countDistinct(F.when(F.col("duplicate_group_id").rlike("^[0-9a-f]{16}$"), F.col("duplicate_group_id")))
    return h.agg(F.count("*").alias("record_count"), dup.alias("duplicates"), groups.alias("group_count"), r6(100.0 * dup / F.count("*")).alias("percent"))


@query(f"SELECT duplicate_group_id, count(*) AS members FROM {HASH} WHERE regexp_full_match(duplicate_group_id, '[0-9a-f]{{16}}') GROUP BY 1 ORDER BY members DESC, 1 LIMIT 5")
def top_duplicate_groups(s, d):
    h = table(s, d, "document_hashes").dropDuplicates(["id"]).where(F.col("duplicate_group_id").rlike("^[0-9a-f]{16}$"))
    return h.groupBy("duplicate_group_id").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "duplicate_group_id").limit(5)


@query("SELECT page_hash, min(ingest_id) AS first_ingest FROM pages WHERE page_hash IS NOT NULL GROUP BY page_hash")
def first_ingested(s, d):
    """Insert or ignore: the first row of each hash."""
    p = table(s, d, "pages").where("page_hash IS NOT NULL").select("page_hash", "ingest_id")
    return C.first_per(p, ["page_hash"], [F.col("ingest_id").alias("i")]).select("page_hash", F.col("ingest_id").alias("first_ingest"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_upsert(s, d):
    """Insert or replace: the last row of each key."""
    return C.latest_per(table(s, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts").alias("t"), F.col("event_id").alias("e")]).select("user_id", "event_id", "event_type")


# ---- statistics


@query(f"""SELECT document_id, count(*) AS page_total, coalesce(count_if(processing_status = 'completed'), 0) AS processed, coalesce(count_if(is_blank), 0) AS blank,
  round(avg(quality_score), 9) AS mean_quality, round(avg(processing_time), 9) AS mean_seconds FROM {PAG} GROUP BY document_id""")  # fmt: skip
def document_analytics(s, d):
    return _pages(s, d).groupBy("document_id").agg(
        F.count("*").alias("page_total"), F.count_if(F.col("processing_status") == "completed").alias("processed"), F.count_if("is_blank").alias("blank"), F.round(F.avg("quality_score"), 9).alias("mean_quality"), F.round(F.avg("processing_time"), 9).alias("mean_seconds")
    )


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events")
def running_average(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "events").select("event_id", "user_id", r6(F.avg("value").over(w)).alias("running"))


@query(f"SELECT status, count(*) AS document_count, round(avg(processing_time), 6) AS mean_seconds, round(sum(processing_time), 4) AS total_seconds FROM {CAT} GROUP BY status")
def run_summary(s, d):
    return _catalog(s, d).groupBy("status").agg(F.count("*").alias("document_count"), r6(F.avg("processing_time")).alias("mean_seconds"), F.round(F.sum("processing_time"), 4).alias("total_seconds"))


@query(f"""SELECT transformation_type, round(avg(processing_time), 6) AS mean_seconds, round(median(processing_time), 6) AS median_seconds, min(processing_time) AS least_seconds, max(processing_time) AS most_seconds, count(processing_time) AS samples
  FROM {CAT} GROUP BY transformation_type""")  # fmt: skip
def transformation_benchmark(s, d):
    t = "processing_time"
    return _catalog(s, d).groupBy("transformation_type").agg(r6(F.avg(t)).alias("mean_seconds"), r6(F.median(t)).alias("median_seconds"), F.min(t).alias("least_seconds"), F.max(t).alias("most_seconds"), F.count(t).alias("samples"))


_CATEGORY = "CASE WHEN file_size < 1048576 THEN 'small' WHEN file_size < 5242880 THEN 'medium' WHEN file_size < 26214400 THEN 'large' WHEN file_size IS NOT NULL THEN 'very_large' END"


@query(f"SELECT {_CATEGORY} AS category, count(*) AS document_count, round(avg(processing_time), 6) AS mean_seconds, round(max(processing_time) * 1.5, 6) AS timeout FROM {CAT} GROUP BY 1")
def size_categories(s, d):
    return _catalog(s, d).groupBy(R.size_category(F.col("file_size")).alias("category")).agg(F.count("*").alias("document_count"), r6(F.avg("processing_time")).alias("mean_seconds"), r6(F.max("processing_time") * 1.5).alias("timeout"))


@query(f"""SELECT processing_node, count(*) AS document_count, round(100.0 * count_if(status = 'completed') / count(*), 6) AS success_percent, round(count(*) / sum(processing_time), 6) AS documents_a_second FROM {CAT} GROUP BY processing_node""")
def node_throughput(s, d):
    done = F.count_if(F.col("status") == "completed")
    return _catalog(s, d).groupBy("processing_node").agg(F.count("*").alias("document_count"), r6(100.0 * done / F.count("*")).alias("success_percent"), r6(F.try_divide(F.count("*"), F.sum("processing_time"))).alias("documents_a_second"))


@query("""SELECT coalesce(folder, 'all') AS folder, count(*) AS file_count, sum(size_bytes)::BIGINT AS bytes FROM (SELECT DISTINCT ON (file_id) regexp_extract(path, '/(vol[0-9]+)/', 1) AS folder, size_bytes FROM stored_files) GROUP BY ROLLUP (folder)""")
def storage_statistics(s, d):
    f = table(s, d, "stored_files").dropDuplicates(["file_id"]).select(F.coalesce(F.regexp_extract("path", "/(vol[0-9]+)/", 1), F.lit("")).alias("folder"), "size_bytes")
    return f.rollup("folder").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("bytes")).withColumn("folder", F.coalesce("folder", F.lit("all")))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 4) AS variance, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.02), 6) AS p2, round(quantile_cont(value, 0.98), 6) AS p98 FROM events GROUP BY event_type")
def value_moments(s, d):
    v = "value"
    return table(s, d, "events").groupBy("event_type").agg(
        r6(F.avg(v)).alias("mean"), r6(F.stddev_pop(v)).alias("std"), F.round(F.var_pop(v), 4).alias("variance"), F.min(v).alias("least"), F.max(v).alias("most"), r6(F.percentile(v, F.lit(0.02))).alias("p2"), r6(F.percentile(v, F.lit(0.98))).alias("p98")
    )


@query("SELECT floor(value / 10)::INT AS bin, count(*) AS n FROM events GROUP BY 1")
def value_histogram(s, d):
    return table(s, d, "events").groupBy(F.floor(F.col("value") / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN a = b AND b = c AND c = d THEN a ELSE 0 END AS rotation FROM (SELECT event_id,
  90 * (event_id % 4) AS a, 90 * (user_id % 2 * (event_id % 4)) AS b, 90 * (event_id % 4) AS c, 90 * (event_id // 7 % 2 * (event_id % 4)) AS d FROM events)""")  # fmt: skip
def orientation_votes(s, d):
    angle = F.expr("CAST(90 * (event_id % 4) AS BIGINT)")
    votes = F.array(angle, angle * (F.col("user_id") % 2), angle, angle * F.expr("event_id div 7 % 2"))
    return table(s, d, "events").select("event_id", R.agreed_rotation(votes).alias("rotation"))


_SKEW = """SELECT vec_id, e[1] * 40 AS proj, e[2] * 40 AS hough, abs(e[3]) * 80 AS hc, e[4] * 40 AS txt, abs(e[5]) * 40 AS tc FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"""


@query(f"""SELECT vec_id, round(CASE WHEN abs(proj) > 3 AND (abs(hough - proj) < 2 OR abs(txt - proj) < 2) THEN proj WHEN hc > 5 AND abs(hough) > 3 THEN hough WHEN tc > 3 AND abs(txt) > 3 THEN txt
  WHEN (CASE WHEN abs(proj) > 3 THEN 3.0 ELSE 0 END + CASE WHEN hc > 0 THEN 2.0 ELSE 0 END + CASE WHEN tc > 0 THEN 1.5 ELSE 0 END) > 0 THEN
    (CASE WHEN abs(proj) > 3 THEN 3.0 * proj ELSE 0 END + CASE WHEN hc > 0 THEN 2.0 * hough ELSE 0 END + CASE WHEN tc > 0 THEN 1.5 * txt ELSE 0 END) / (CASE WHEN abs(proj) > 3 THEN 3.0 ELSE 0 END + CASE WHEN hc > 0 THEN 2.0 ELSE 0 END + CASE WHEN tc > 0 THEN 1.5 ELSE 0 END)
  ELSE proj END, 6) AS angle FROM ({_SKEW})""")  # fmt: skip
def skew_decisions(s, d):
    e = lambda i: F.element_at("embedding", i).cast("double")
    v = table(s, d, "embeddings")
    return v.select("vec_id", r6(R.skew_angle(e(1) * 40, e(2) * 40, F.abs(e(3)) * 80, e(4) * 40, F.abs(e(5)) * 40)).alias("angle"))


@query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS grouping_level, count(*) AS n, round(sum(l_extendedprice), 2) AS total, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_statistics(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("grouping_level"), F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY event_type")
def approximate_users(s, d):
    near = F.abs(F.approx_count_distinct("user_id", 0.02) / F.countDistinct("user_id") - 1) < 0.1
    return table(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), near.alias("close"))


# ---- text

_V = f"[{T.VIETNAMESE}{T.VIETNAMESE.upper()}]"
_TEXT = "(SELECT doc_id, text, lang FROM documents WHERE text IS NOT NULL)"


def _sql_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def _sql_count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


_MRZ = " OR ".join(f"regexp_matches(text, '{p}', 'm')" for p in ("^[A-Z0-9<]{30,44}$", "^P<[A-Z]{3}[A-Z<]{39}$", "^[ACIV][A-Z0-9<]{30,43}$"))


@query(f"""SELECT doc_id, round({_sql_count('[a-zA-Z]')} / length(text), 6) AS latin, round({_sql_count(_V)} / length(text), 6) AS vietnamese, round({_sql_count('[0-9]')} / length(text), 6) AS numeric_share
  FROM {_TEXT} WHERE length(text) > 0""")  # fmt: skip
def script_shares(s, d):
    t = table(s, d, "documents").where("text IS NOT NULL AND length(text) > 0")
    shares = T.script_shares(F.col("text"))
    return t.select("doc_id", r6(shares["latin"]).alias("latin"), r6(shares["vietnamese"]).alias("vietnamese"), r6(shares["numeric"]).alias("numeric_share"))


@query(f"""SELECT doc_id, round(CASE WHEN v > 0 THEN least(95.0, v / length(text) * 200) END, 6) AS vie, round(CASE WHEN n > 0 THEN least(90.0, e / n * 100) END, 6) AS eng, round(CASE WHEN f > 0 AND n > 0 THEN least(85.0, f / n * 100) END, 6) AS fra
  FROM (SELECT doc_id, text, {_sql_count(_V)} AS v, len(w) AS n, len(list_filter(w, lambda x: x IN {tuple(T.ENGLISH_WORDS.split())})) AS e, len(list_filter(w, lambda x: x IN {tuple(T.FRENCH_WORDS.split())})) AS f
    FROM (SELECT doc_id, text, {_sql_words('text')} AS w FROM {_TEXT}))""")  # fmt: skip
def language_scores(s, d):
    t = T.measured(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), "text")
    return t.select("doc_id", *[r6(F.col(f"score_{n}")).alias(n) for n in ("vie", "eng", "fra")])


_LINES = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_MRZ_PATTERNS = tuple(p.strip("^$") for p in T.MRZ_LINES)
_HAS_MRZ = " OR ".join(f"regexp_matches({_LINES}, '(?m)^{p}$')" for p in _MRZ_PATTERNS)
_LANGUAGE = f"""SELECT doc_id, lang,
    CASE WHEN length(text) = 0 THEN 'unknown' WHEN latin >= greatest(viet, num, mrz) THEN 'latin' WHEN viet >= greatest(num, mrz) THEN 'vietnamese' WHEN num >= mrz THEN 'numeric' ELSE 'mrz' END AS script,
    CASE WHEN greatest(vie, eng, fra) IS NULL THEN 'eng' WHEN vie = greatest(vie, eng, fra) THEN 'vie' WHEN eng = greatest(vie, eng, fra) THEN 'eng' ELSE 'fra' END AS language
  FROM (SELECT *, CASE WHEN v > 0 THEN least(95.0::DOUBLE, v / length(text) * 200) END AS vie, CASE WHEN n > 0 THEN least(90.0::DOUBLE, e / n * 100) END AS eng, CASE WHEN f > 0 AND n > 0 THEN least(85.0::DOUBLE, f / n * 100) END AS fra,
      {_sql_count('[a-zA-Z]')} / length(text) AS latin, v / length(text) AS viet, {_sql_count('[0-9]')} / length(text) AS num, CASE WHEN {_HAS_MRZ} THEN 1.0::DOUBLE ELSE 0.0 END AS mrz
    FROM (SELECT doc_id, lang, text, {_sql_count(_V)} AS v, len(w) AS n, len(list_filter(w, lambda x: x IN {tuple(T.ENGLISH_WORDS.split())})) AS e, len(list_filter(w, lambda x: x IN {tuple(T.FRENCH_WORDS.split())})) AS f
      FROM (SELECT doc_id, lang, text, {_sql_words('text')} AS w FROM {_TEXT})))"""


@query(f"SELECT doc_id, script, language FROM ({_LANGUAGE})")
def dominant_language(s, d):
    return T.detect(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), "text").select("doc_id", "script", "language")


@query(f"SELECT lower(lang) AS lang, language AS detected, count(*) AS document_count FROM ({_LANGUAGE}) GROUP BY ALL")
def language_confusion(s, d):
    t = T.detect(table(s, d, "documents").where("text IS NOT NULL").select("lang", "text"), "text")
    return t.groupBy(F.lower("lang").alias("lang"), F.col("language").alias("detected")).agg(F.count("*").alias("document_count"))


_BLANKS = "[ \\t\\n\\x0b\\f\\r]"


@query(f"""SELECT doc_id, round(CASE WHEN text IS NULL THEN NULL WHEN NOT regexp_matches(text, '[^ \\t\\n\\x0b\\f\\r]') THEN 0.0 ELSE least(95.0::DOUBLE, least(80.0::DOUBLE, length(regexp_replace(text, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')) / 10)
    + CASE WHEN variety > 10 THEN 15 WHEN variety > 5 THEN 10 ELSE 0 END + CASE WHEN coalesce(lower(lang) = 'vi', false) AND regexp_matches(text, '{_V}') THEN 20 ELSE 0 END) END, 6) AS confidence
  FROM (SELECT *, len(list_distinct(regexp_extract_all(lower(text), '(?s).'))) AS variety FROM documents)""")
def text_confidence(s, d):
    return table(s, d, "documents").select("doc_id", r6(T.ocr_confidence(F.col("text"), F.coalesce(F.lower("lang") == "vi", F.lit(False)))).alias("confidence"))


_D1, _D2 = "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}", "[0-9]{2,4}[/-][0-9]{1,2}[/-][0-9]{1,2}"


@query(f"SELECT doc_id, {_sql_count(_D1)} + {_sql_count(_D2)} AS date_count, {_sql_count('[0-9]')} > 0.6 * length(text) AND length(text) > 0 AS numeric_heavy FROM {_TEXT}")
def special_zones(s, d):
    t = table(s, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", T.date_count(F.col("text")).cast("bigint").alias("date_count"), F.coalesce(T.numeric_heavy(F.col("text")), F.lit(False)).alias("numeric_heavy"))


_FITS = " + ".join(f"len(list_filter(lines, lambda x: regexp_full_match(x, '{p}')))" for p in _MRZ_PATTERNS)


@query(f"SELECT doc_id, line_count FROM (SELECT doc_id, ({_FITS})::INT AS line_count FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(translate(x, chr(13) || chr(9), '  '))) AS lines FROM {_TEXT})) WHERE line_count > 0")
def machine_readable(s, d):
    t = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(T.mrz_lines(F.col("text"))).alias("line_count"))
    return t.where("line_count > 0")


# ---- scalar functions


_NEW_SIZE = "file_size * (1 + file_size % 97)"


@query(f"""SELECT id, CASE WHEN n <= 10485760 THEN 'enhanced' WHEN n <= 52428800 THEN 'deskewing' WHEN n IS NOT NULL THEN 'basic' END AS strategy, CASE WHEN n <= 10485760 THEN 60 WHEN n <= 52428800 THEN 120 WHEN n <= 104857600 THEN 180 WHEN n IS NOT NULL THEN 300 END AS timeout,
  coalesce(n > 26214400, false) AS streamed, md5(concat_ws(':', content_hash, transformation_type)) AS cache_key FROM (SELECT *, {_NEW_SIZE} AS n FROM {CAT})""")  # fmt: skip
def size_strategies(s, d):
    n = F.expr(_NEW_SIZE)
    return _catalog(s, d).withColumn("fallback", R.fallback_strategy(n)).select("id", "fallback.strategy", "fallback.timeout", R.streams(n).alias("streamed"), F.md5(F.concat_ws(":", "content_hash", "transformation_type")).alias("cache_key"))


_LOAD = "file_size % 101 AS cpu, file_size % 103 AS memory, file_size % 107 AS disk"


@query(f"""SELECT id, state, CASE WHEN n IS NULL THEN NULL WHEN state IN ('high_cpu_usage', 'high_memory_usage') THEN 'basic' WHEN n < 5242880 THEN 'enhanced' WHEN n < 52428800 THEN 'deskewing' ELSE 'basic' END AS transformation,
  CASE WHEN n IS NOT NULL THEN n < 52428800 END AS caching, CASE WHEN n IS NOT NULL THEN n >= 26214400 END AS batch,
  least(CASE WHEN n < 5242880 THEN 512 WHEN n < 26214400 THEN 1024 WHEN n < 52428800 THEN 2048 WHEN n IS NOT NULL THEN 4096 END, CASE WHEN state = 'high_memory_usage' AND n IS NOT NULL THEN 1024 END)::BIGINT * 1048576 AS memory,
  least(CASE WHEN n < 5242880 THEN 60 WHEN n < 26214400 THEN 120 WHEN n < 52428800 THEN 180 WHEN n IS NOT NULL THEN 300 END, CASE WHEN state = 'high_cpu_usage' AND n IS NOT NULL THEN 180 END) AS timeout
  FROM (SELECT *, CASE WHEN cpu > 80 THEN 'high_cpu_usage' WHEN memory > 85 THEN 'high_memory_usage' WHEN disk > 90 THEN 'low_disk_space' WHEN cpu > 60 OR memory > 70 THEN 'moderate_load' ELSE 'optimal' END AS state
    FROM (SELECT id, {_NEW_SIZE} AS n, {_LOAD} FROM {CAT}))""")  # fmt: skip
def size_plans(s, d):
    loaded = _catalog(s, d).selectExpr("id", f"{_NEW_SIZE} AS n", *_LOAD.split(", ")).withColumn("state", R.resource_state(F.col("cpu"), F.col("memory"), F.col("disk")))
    return loaded.select("id", "state", R.size_plan(F.col("n"), F.col("state")).alias("x")).select("id", "state", "x.*")


@query(f"""SELECT id, CASE WHEN suffix IS NULL THEN NULL WHEN suffix = 'png' THEN 'image/png' WHEN suffix IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN suffix = 'bmp' THEN 'image/bmp' WHEN suffix IN ('tif', 'tiff') THEN 'image/tiff' WHEN suffix = 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS media,
  regexp_replace(filename, '\\.[^.]*$', '') || '_' || substr(sha256(original_path), 1, 8) || '_' || strftime(created_at, '%Y%m%d') AS document_id
  FROM (SELECT *, CASE WHEN filename IS NOT NULL THEN lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)\\s*$', 1)) END AS suffix FROM {CAT})""")  # fmt: skip
def document_ids(s, d):
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    made = F.concat(stem, F.lit("_"), F.substring(F.sha2("original_path", 256), 1, 8), F.lit("_"), F.date_format("created_at", "yyyyMMdd"))
    return _catalog(s, d).select("id", C.media_type(F.col("filename")).alias("media"), made.alias("document_id"))


@query(f"SELECT id, round(CASE WHEN processing_time > 0 THEN file_size / 1048576.0 / processing_time END, 6) AS mb_a_second FROM {CAT}")
def throughput(s, d):
    return _catalog(s, d).select("id", r6(F.when(F.col("processing_time") > 0, F.col("file_size") / 1048576.0 / F.col("processing_time"))).alias("mb_a_second"))


@query("""SELECT p_partkey, floor(w * least(CASE WHEN w > h THEN 2923 ELSE 2079 END / w, CASE WHEN w > h THEN 2079 ELSE 2923 END / h))::INT AS width,
  floor(h * least(CASE WHEN w > h THEN 2923 ELSE 2079 END / w, CASE WHEN w > h THEN 2079 ELSE 2923 END / h))::INT AS height,
  CASE WHEN h > w THEN 'portrait' WHEN w > h THEN 'landscape' ELSE 'square' END AS orientation FROM (SELECT p_partkey, (p_size * 50)::DOUBLE AS w, (p_partkey % 37 * 60 + 400)::DOUBLE AS h FROM part)""")  # fmt: skip
def target_sizes(s, d):
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") * 50).cast("double").alias("w"), (F.col("p_partkey") % 37 * 60 + 400).cast("double").alias("h"))
    width, height = R.target_size(F.col("w"), F.col("h"))
    return p.select("p_partkey", width.alias("width"), height.alias("height"), R.orientation(F.col("w"), F.col("h")).alias("orientation"))


@query(f"SELECT array_to_string(list_sort(list_distinct(list(t))), ',') AS common FROM (SELECT transformation_type AS t FROM {CAT} WHERE status = 'completed' INTERSECT SELECT transformation_type FROM {CAT} WHERE status = 'failed')")
def common_types(s, d):
    c = _catalog(s, d)
    both = c.where("status = 'completed'").select("transformation_type").intersect(c.where("status = 'failed'").select("transformation_type"))
    return both.agg(F.array_join(F.sort_array(F.collect_set("transformation_type")), ",").alias("common"))


# Modes whose chains may run, for the order of their tasks or as standalone.
_VALID = "full_pipeline orient_only orient_and_skew orient_skew_crop with_dpi_standardization with_denoising with_enhancement with_color_handling comprehensive_pipeline production_mode".split()
_ALONE = "skew_only contrast_only segmentation_only color_handling_only deduplication_only language_detection_only metadata_extraction_only output_standardization_only".split()
# Each mode's number of tasks.
_TASKS = {
    "full_pipeline": 12, "orient_only": 1, "skew_only": 1, "crop_only": 1, "orient_and_skew": 2, "orient_skew_crop": 3, "with_dpi_standardization": 4, "noise_only": 1, "with_denoising": 5, "contrast_only": 1,
    "with_enhancement": 6, "segmentation_only": 1, "with_segmentation": 7, "color_handling_only": 1, "with_color_handling": 8, "deduplication_only": 1, "with_deduplication": 9, "language_detection_only": 1,
    "metadata_extraction_only": 1, "output_standardization_only": 1, "comprehensive_pipeline": 12, "production_mode": 3,
}


@query("SELECT mode, tasks, valid FROM (VALUES " + ", ".join(f"('{m}', {n}, {'true' if m in _VALID + _ALONE else 'false'})" for m, n in _TASKS.items()) + ") v(mode, tasks, valid)")
def chain_validity(s, d):
    return modes.relation(s).select("mode", "tasks", "valid")


# ---- rules over measures

_QUALITY = "SELECT id, quality_score * 200 AS sharp, page_size_bytes % 120 AS contrast, page_number % 256 AS bright, processing_time / 100 AS noise FROM"


@query(f"""SELECT id, 100 - 20 * n AS score, CASE WHEN n = 0 THEN 'excellent' WHEN n = 1 THEN 'good' WHEN n = 2 THEN 'fair' ELSE 'poor' END AS overall FROM (SELECT id,
  (coalesce(sharp < 100, false))::INT + (coalesce(contrast < 50, false))::INT + (coalesce(bright < 50, false))::INT + (coalesce(bright > 200, false))::INT + (coalesce(noise > 0.1, false))::INT AS n FROM ({_QUALITY} {PAG}))""")  # fmt: skip
def page_quality(s, d):
    p = _pages(s, d)
    issues = R.quality_issues(F.col("quality_score") * 200, F.col("page_size_bytes") % 120, F.col("page_number") % 256, F.col("processing_time") / 100)
    return p.select("id", issues.alias("issues")).select("id", R.quality_score(F.col("issues")).alias("score"), R.overall_quality(F.col("issues")).alias("overall"))


@query(f"""SELECT id, CASE WHEN white IS NULL OR dense IS NULL THEN true WHEN dense > 0.03 THEN false WHEN white > 0.98 THEN true ELSE dense < 0.005 END AS blank FROM (SELECT id, quality_score AS white, page_number / 5000.0 AS dense FROM {PAG})""")
def blank_rule(s, d):
    return _pages(s, d).select("id", R.is_blank(F.col("page_number") / 5000.0, F.col("quality_score")).alias("blank"))


@query("SELECT g, i, floor(pow(i / 255.0, 1 / g) * 255 + 1e-9)::INT AS level FROM (SELECT unnest([0.8, 0.85, 1.0, 1.2, 1.5])::DOUBLE AS g), range(256) r(i)")
def gamma_levels(s, d):
    g = s.createDataFrame([(0.8,), (0.85,), (1.0,), (1.2,), (1.5,)], "g double")
    return g.select("g", F.posexplode(R.gamma_table(F.col("g"))).alias("i", "level")).select("g", F.col("i").cast("bigint").alias("i"), "level")


@query("""SELECT vec_id, white, trunc(CASE WHEN abs(gap) <= 30 THEN 0 WHEN white THEN greatest(0.0, least(100.0, gap)) WHEN gap > 0 THEN least(50.0, gap) ELSE -least(50.0, -gap) END)::INT AS shift
  FROM (SELECT vec_id, vec_id % 3 = 0 AS white, (180 - (128 + embedding[1]::DOUBLE * 400)) AS gap FROM embeddings)""")
def brightness_shifts(s, d):
    mean = 128 + F.element_at("embedding", 1).cast("double") * 400
    white = F.col("vec_id") % 3 == 0
    return table(s, d, "embeddings").select("vec_id", white.alias("white"), R.brightness_shift(mean, F.lit(180), F.lit(30), white).cast("int").alias("shift"))


@query(f"SELECT id, coalesce(processed_image_path, original_image_path) AS image FROM {PAG} WHERE coalesce(processed_image_path, original_image_path) IS NOT NULL")
def page_images(s, d):
    p = _pages(s, d)
    return p.select("id", C.page_image(p).alias("image")).where("image IS NOT NULL")


# ---- sequences

_PROFILE = "(SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


def _profile(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@query(f"""SELECT vec_id, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS run_length FROM (SELECT vec_id, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS g FROM {_PROFILE} WHERE v > 0.05) GROUP BY vec_id, g HAVING count(*) >= 3""")
def bright_runs(s, d):
    return S.runs(_profile(s, d), "vec_id", "pos", "v", 0.05, 3)


@query(f"""SELECT vec_id, pos FROM (SELECT vec_id, pos, v, max(v) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, avg(v) OVER (PARTITION BY vec_id) + 0.1 * stddev_pop(v) OVER (PARTITION BY vec_id) AS level FROM {_PROFILE}) WHERE v > level AND v = top""")
def profile_peaks(s, d):
    return S.peaks(_profile(s, d), "vec_id", "pos", "v").select("vec_id", "pos")


@query(f"""SELECT vec_id, pos FROM (SELECT vec_id, pos, v, lag(v) OVER w AS a, lead(v) OVER w AS b, 0.3 * avg(v) OVER (PARTITION BY vec_id) AS level FROM {_PROFILE} WINDOW w AS (PARTITION BY vec_id ORDER BY pos)) WHERE v < a AND v < b AND v < level""")
def profile_valleys(s, d):
    return S.valleys(_profile(s, d), "vec_id", "pos", "v").select("vec_id", "pos")


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 6) AS gap FROM events")
def event_gaps(s, d):
    e = table(s, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return S.gaps(e.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), "user_id", ["ts", "event_id"], "at").select("event_id", r6(F.col("gap") / 1e6).alias("gap"))


@query("SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 100")
def lru_entries(s, d):
    return C.keep_recent(table(s, d, "events"), "user_id", "ts", 100)


@query("""SELECT folder, file_id FROM (SELECT folder, file_id, coalesce(sum(size_bytes) OVER (PARTITION BY folder ORDER BY modified_at, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 0.2 * sum(size_bytes) OVER (PARTITION BY folder) AS to_free
  FROM (SELECT DISTINCT ON (file_id) file_id, coalesce(size_bytes, 0) AS size_bytes, modified_at, regexp_extract(path, '/(vol[0-9]+)/', 1) AS folder FROM stored_files WHERE modified_at IS NOT NULL AND path IS NOT NULL)) WHERE before < to_free""")  # fmt: skip
def eviction_prefix(s, d):
    f = table(s, d, "stored_files").where("modified_at IS NOT NULL AND path IS NOT NULL").dropDuplicates(["file_id"])
    f = f.select("file_id", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "modified_at", F.regexp_extract("path", "/(vol[0-9]+)/", 1).alias("folder"))
    f = f.withColumn("to_free", 0.2 * F.sum("size_bytes").over(Window.partitionBy("folder")))
    return C.evict_prefix(f, ["folder"], ["modified_at", "file_id"], "size_bytes", F.col("to_free")).select("folder", "file_id")


@query()
def greedy_batches(s, d):
    docs = _pages(s, d).where("page_number IS NOT NULL AND document_id IS NOT NULL")
    one = docs.groupBy(document_key("document_id").alias("document")).agg(F.sort_array(F.collect_list(F.struct("page_number", "id", "page_size_bytes"))).alias("pages"))
    return one.select("document", F.size(F.array_distinct(S.greedy_batches(F.transform("pages", lambda p: p["page_size_bytes"]), most_size=1_000_000))).alias("batches"))


@query("SELECT e.event_id, (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = e.user_id % 1500 AND o.o_orderdate <= e.ts ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 1) AS order_key FROM events e")
def as_of_join(s, d):
    e = table(s, d, "events").select("event_id", (F.col("user_id") % 1500).alias("k"), F.col("ts").alias("at"))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("order_key"))
    last = o.groupBy("k", "at").agg(F.max("order_key").alias("order_key"))
    return S.as_of(e, last, "k", "at", "order_key").select("event_id", "order_key")


# ---- mutations and lifecycle


@query("""SELECT user_id, arg_max(event_type, (ts, event_type)) AS status, min(CASE WHEN event_type = 'in_progress' THEN ts END) AS started_at, max(CASE WHEN event_type IN ('completed', 'failed') THEN ts END) AS completed_at FROM (SELECT user_id, ts, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END AS event_type FROM events) GROUP BY user_id""")
def status_machine(s, d):
    m = F.col("event_id") % 4
    status = F.when(m == 0, "pending").when(m == 1, "in_progress").when(m == 2, "completed").otherwise("failed")
    return C.status_now(table(s, d, "events").select("user_id", status.alias("status"), F.col("ts").alias("at")), "user_id")


_LISTED = "SELECT path AS key, min_by(size_bytes, file_id) AS s, min_by(checksum, file_id) AS h FROM stored_files WHERE path IS NOT NULL AND modified_at {} TIMESTAMP '2024-07-01' GROUP BY path"


@query(f"""SELECT key, CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'new' WHEN a.s IS DISTINCT FROM b.s THEN 'size_changed' WHEN a.h IS DISTINCT FROM b.h THEN 'hash_changed' ELSE 'ok' END AS verdict
  FROM ({_LISTED.format('<')}) a FULL JOIN ({_LISTED.format('>=')}) b USING (key)""".replace("min_by(size_bytes, file_id)", "arg_min_null(size_bytes, file_id)").replace("min_by(checksum, file_id)", "arg_min_null(checksum, file_id)"))  # fmt: skip
def integrity_check(s, d):
    """The listing before a day against the listing from then on."""
    f = table(s, d, "stored_files").where("path IS NOT NULL")
    first = lambda df: df.groupBy(F.col("path").alias("key")).agg(F.min_by(F.struct("size_bytes", "checksum"), "file_id").alias("x")).select("key", F.col("x.size_bytes").alias("size"), F.col("x.checksum").alias("hash"))
    day = F.lit(datetime(2024, 7, 1)).cast("timestamp_ntz")
    return C.integrity(first(f.where(F.col("modified_at") < day)), first(f.where(F.col("modified_at") >= day)), "key")


@query(f"SELECT c.id, coalesce(m.language_detected, c.file_type) AS file_type FROM {CAT} c LEFT JOIN (SELECT document_id, min(language_detected) AS language_detected FROM {META} WHERE document_id IS NOT NULL GROUP BY 1) m ON m.document_id = c.id")
def patched_documents(s, d):
    c = _catalog(s, d).select("id", "file_type")
    m = table(s, d, "file_metadata").where("document_id IS NOT NULL").groupBy(F.col("document_id").alias("id")).agg(F.min("language_detected").alias("file_type"))
    return C.patch(c, m.join(c, "id", "left_semi"), "id", columns=["file_type"])


@query(f"SELECT c.id, greatest(c.last_accessed, a.at) AS last_accessed, 1 + coalesce(a.n, 0) AS access_count FROM {CAT} c LEFT JOIN (SELECT document_id, max(processed_at) AS at, count(*) AS n FROM {PAG} GROUP BY 1) a ON a.document_id = c.id")
def access_tracking(s, d):
    log = _pages(s, d).select(F.col("document_id").alias("id"), F.col("processed_at").alias("at"))
    return C.touch(_catalog(s, d).select("id", "last_accessed", F.lit(1).cast("bigint").alias("access_count")), log, "id")


@query(f"SELECT p.id FROM {PAG} p WHERE NOT EXISTS (SELECT 1 FROM {CAT} c WHERE c.id = p.document_id AND c.status = 'failed')")
def pages_after_deletion(s, d):
    gone = _catalog(s, d).where("status = 'failed'").select(F.col("id").alias("document_id"))
    return C.without(_pages(s, d).select("id", "document_id"), gone, "document_id").select("id")


# ---- sets, joins by range, more scalar functions


@query(f"""SELECT side, count(*) AS n FROM (
  SELECT 'union' AS side, k FROM (SELECT page_hash AS k FROM {PAG} UNION SELECT page_hash FROM pages)
  UNION ALL SELECT 'intersect', k FROM (SELECT page_hash AS k FROM {PAG} INTERSECT SELECT page_hash FROM pages)
  UNION ALL SELECT 'except', k FROM (SELECT page_hash AS k FROM {PAG} EXCEPT SELECT page_hash FROM pages)) GROUP BY side""")  # fmt: skip
def set_operations(s, d):
    a, b = _pages(s, d).select("page_hash"), table(s, d, "pages").select("page_hash")
    sides = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, df in sides.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")


@query("""SELECT user_id, event_id, event_type, row_number() OVER w AS nth, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS type_rank, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS last_five
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def ranked_events(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.sum("value").over(w.rowsBetween(-4, 0))
    return table(s, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).alias("nth"), F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("type_rank"), r6(last).alias("last_five"))


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour_begin, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def hourly_windows(s, d):
    found = windows(table(s, d, "events").select("event_type", "ts", "value"), "event_type", "ts", "value")
    return found.select("event_type", F.date_format("begin", "yyyy-MM-dd HH").alias("hour_begin"), "n", r6(F.col("mean")).alias("mean"))


@query(f"""SELECT id, round((612 - w * k) / 2, 6) AS x, round((792 - h * k) / 2, 6) AS y FROM (SELECT id, w, h, least(612.0 / w, 792.0 / h) * 0.9 AS k FROM (SELECT id, (page_number % 40 * 50 + 300)::DOUBLE AS w, (page_size_bytes % 3000 + 300)::DOUBLE AS h FROM {PAG}))""")
def pdf_geometry(s, d):
    box = Z.fitted_box((F.col("page_number") % 40 * 50 + 300).cast("double"), (F.col("page_size_bytes") % 3000 + 300).cast("double"))
    return _pages(s, d).select("id", r6(box["x"]).alias("x"), r6(box["y"]).alias("y"))


@query(f"""SELECT folder, count(*) AS file_count, sum(size_bytes)::BIGINT AS bytes, md5(string_agg(checksum, ',' ORDER BY path, checksum)) AS manifest FROM (SELECT DISTINCT path, checksum, size_bytes, regexp_extract(path, '/(vol[0-9]+/[0-9]+/[0-9]+/[0-9a-f-]+)/', 1) AS folder FROM stored_files WHERE path IS NOT NULL AND checksum IS NOT NULL) WHERE folder <> '' GROUP BY folder""")
def folder_manifests(s, d):
    f = table(s, d, "stored_files").where("path IS NOT NULL AND checksum IS NOT NULL").select("path", "checksum", "size_bytes", F.regexp_extract("path", "/(vol[0-9]+/[0-9]+/[0-9]+/[0-9a-f-]+)/", 1).alias("folder")).distinct()
    listed = F.transform(F.sort_array(F.collect_list(F.struct("path", "checksum"))), lambda x: x["checksum"])
    return f.where("folder <> ''").groupBy("folder").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("bytes"), F.md5(F.array_join(listed, ",")).alias("manifest"))


@query(f"SELECT id, regexp_replace(regexp_extract(coalesce(processed_image_path, original_image_path), '([^/]*)$', 1), '\\.[^.]*$', '') || '_result.png' AS result FROM {PAG} WHERE coalesce(processed_image_path, original_image_path) IS NOT NULL")
def result_names(s, d):
    p = _pages(s, d)
    return p.select("id", Z.result_name(C.page_image(p), F.lit(1), F.lit(1)).alias("result")).where("result IS NOT NULL")
