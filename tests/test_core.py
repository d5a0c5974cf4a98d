"""Catalogue, rules, planner, page operators, sources and streams."""

import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import rules as R
from scanloom.functions import text as T
from scanloom.operators import catalog as C
from scanloom.operators import dedup as D
from scanloom.operators import pages as P
from scanloom.operators import sequence as S
from scanloom.plans import modes
from scanloom.sources import files
from scanloom.streaming import state


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# ---- planner


def test_modes():
    invalid = {m for m in modes.MODES if not modes.valid(m)[0]}
    assert len(modes.MODES) == 22 and invalid == {"crop_only", "noise_only", "with_segmentation", "with_deduplication"}
    with pytest.raises(ValueError):
        modes.plan("no such mode")
    with pytest.raises(ValueError):
        modes.plan("crop_only")
    assert modes.plan("no such mode", compat=True) == modes.MODES["full_pipeline"] and modes.plan("crop_only", compat=True) is None
    assert modes.check_chain(["orientation", "what"])[0] is False


def test_chain_runs_in_order(spark):
    registry = modes.Registry()
    registry.add("orientation", lambda df: df.withColumn("a", F.lit(1)))
    registry.add("skew", lambda df: df.withColumn("b", F.col("a") + 1))
    registry.add("own", lambda df: df.withColumn("c", F.col("b") * 10), needs=("skew",))
    assert registry.run(spark.range(1), ["orientation", "skew", "own"]).first()["c"] == 20
    with pytest.raises(ValueError):
        registry.run(spark.range(1), ["skew"])
    registry.enable("own", False)
    assert "c" not in registry.run(spark.range(1), ["orientation", "skew", "own"]).columns
    registry.remove("skew")
    with pytest.raises(ValueError):
        registry.run(spark.range(1), ["orientation", "skew"])


# ---- rules


def test_blank_rule(spark):
    cases = [(0.031, 1.0, False), (0.03, 0.981, True), (0.03, 0.98, False), (0.004, 0.5, True), (0.005, 0.5, False), (None, 0.5, True)]
    for density, white, blank in cases:
        assert one(spark, R.is_blank(F.lit(density).cast("double"), F.lit(white)))[0] is blank


def test_skew_rule(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    for args, angle in (((4, 5, 0, 0, 0), 4), ((4, 9, 6, 0, 0), 9), ((1, 2, 6, 5, 4), 5), ((2, 0, 0, 0, 0), 2), ((4, 8, 2, 8, 1), (12 + 16 + 12) / 6.5)):
        assert one(spark, R.skew_angle(*lit(*args)))[0] == pytest.approx(angle)


def test_votes_and_gamma(spark):
    votes = lambda *v: one(spark, R.agreed_rotation(F.array(*[F.lit(x) for x in v])))[0]
    assert votes(90, 90, 90, 90) == 90 and votes(90, 90, 90, 0) == 0
    table = one(spark, R.gamma_table(F.lit(1.0)))[0]
    assert table == list(range(256))
    assert one(spark, R.optimal_gamma(F.lit(1.9), F.lit(True), F.lit(False), F.lit(False)))[0] == 2.0
    assert one(spark, R.optimal_gamma(F.lit(0.9), F.lit(False), F.lit(True), F.lit(False)))[0] == 0.8


def test_levels(spark):
    assert [one(spark, R.quality_level(F.lit(s)))[0] for s in (80, 60, 40, 20, 19)] == ["excellent", "good", "fair", "poor", "very_poor"]
    assert one(spark, R.reading_order(*[F.lit(x) for x in (1, 1, 4, 1)]))[0] == "top_to_bottom"
    assert one(spark, R.document_type(F.lit(0.3), F.lit(0.2), F.lit(1), F.lit(1)))[0] == "form_or_invoice"
    assert one(spark, R.brightness_shift(F.lit(100.0), F.lit(180.0), F.lit(30.0), F.lit(False)))[0] == 50
    assert one(spark, R.brightness_shift(F.lit(220.0), F.lit(180.0), F.lit(30.0), F.lit(True)))[0] == 0


# ---- text


def test_text_cases(spark):
    df = spark.createDataFrame([(0, ""), (1, "the cat and the dog"), (2, "Đây là một tài liệu tiếng Việt"), (3, "le chat et la souris dans une maison"), (4, "12 34 56"), (5, "P<ABC" + "<" * 39 + "\n" + "A1" * 20), (6, None)], "i int, text string")
    got = {r.i: r for r in T.detect(df, "text").collect()}
    assert [got[i].language for i in (1, 2, 3)] == ["eng", "vie", "fra"]
    assert got[0].script == "unknown" and got[4].script == "numeric" and got[2].script == "latin" and got[5].script == "mrz"
    confidence = {r.i: r.c for r in df.select("i", T.ocr_confidence(F.col("text"), F.lit(True)).alias("c")).collect()}
    assert confidence[0] == 0 and confidence[6] is None and confidence[2] == pytest.approx(3.0 + 15 + 20)
    lines = {r.i: r.n for r in df.select("i", F.size(T.mrz_lines(F.col("text"))).alias("n")).collect()}
    assert lines[5] == 4 and lines[1] == 0
    assert one(spark, T.date_count(F.lit("on 2024-01-05 and 1/2/2024 or 12-12-12")))[0] == 5


# ---- catalogue


DOCS = [
    ("d1", "test_document.pdf", "original_test.pdf", 1024, "pdf", "abc123hash"),
    ("d2", "invoice_2023.pdf", "Invoice_January_2023.pdf", 2048, "pdf", "hash1"),
    ("d3", "receipt_2023.pdf", "Receipt_January_2023.pdf", 1024, "pdf", "hash2"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(DOCS, "id string, filename string, original_filename string, file_size long, file_type string, content_hash string").withColumn("created_at", F.lit(datetime(2023, 1, 1)).cast("timestamp_ntz"))


def test_search(documents):
    assert rows(C.by_filename(documents, "INVOICE"), "id") == [("d2",)]
    assert rows(C.by_filename(documents, "Receipt_January_2023.pdf", exact=True), "id") == [("d3",)]
    assert rows(C.search(documents, filename="2023", file_type="pdf"), "id") == [("d2",), ("d3",)]
    assert rows(C.search(documents, content_hash="hash2"), "id") == [("d3",)]
    assert C.search(documents, date_from=datetime(2023, 1, 1), date_to=datetime(2023, 1, 1)).count() == 3
    assert [r.id for r in C.newest(documents, page=2, page_size=2).collect()] == ["d3"]
    assert C.total_estimate(50, 2, 50) == 101 and C.total_estimate(3, 1, 50) == 3


def test_pages_and_patch(spark, documents):
    pages = spark.createDataFrame([("p2", "d1", 2, "completed"), ("p1", "d1", 1, "pending")], "id string, document_id string, page_number int, processing_status string")
    nested = {r.id: r.pages for r in C.with_pages(documents.select("id"), pages).collect()}
    assert [p.page_number for p in nested["d1"]] == [1, 2] and nested["d2"] is None
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    changes = spark.createDataFrame([("a", None, "z"), ("c", 3, None)], "k string, n int, s string")
    assert rows(C.patch(base, changes, "k", columns=["n", "s"]), "k", "n", "s") == [("a", 1, "z"), ("b", 2, "y"), ("c", 3, None)]


def test_cache_and_access(spark):
    t = datetime(2024, 1, 2)
    cache = spark.createDataFrame([("k", t - timedelta(hours=30)), ("j", t - timedelta(hours=3))], "key string, created_at timestamp")
    asked = spark.createDataFrame([("k", t), ("j", t), (None, t)], "key string, at timestamp")
    assert rows(C.cache_hits(asked, cache), "key", "hit") == [("j", True), ("k", False), (None, False)]
    entries = spark.createDataFrame([("k", t, 1), ("m", None, 0)], "key string, last_accessed timestamp, access_count long")
    log = spark.createDataFrame([("k", t + timedelta(1)), ("k", t)], "key string, at timestamp")
    assert rows(C.touch(entries, log, "key"), "key", "access_count") == [("k", 3), ("m", 0)]


def test_uploads(spark):
    df = spark.createDataFrame([("a.PDF", 5), ("b.exe", 5), ("c", 5), ("d.png", 200 * 1024 * 1024)], "n string, s long")
    assert [r[0] for r in df.select(C.upload_error(F.col("n"), F.col("s"))).collect()] == [None, "unsupported_type", "unsupported_type", "too_large"]


def test_nearest_earlier(spark):
    df = spark.createDataFrame([(1, 0), (2, 0b111), (3, 0b1), (4, 0b1111 << 30), (5, 0), (6, None)], "id long, h long")
    assert rows(D.nearest_earlier(df, "id", "h"), "id", "match", "distance") == [(2, 1, 3), (3, 1, 1), (5, 1, 0)]


# ---- sequences


def test_folds(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    mb = 1024 * 1024
    assert one(spark, S.greedy_batches(arr(*[mb] * 6)))[0] == [0, 0, 0, 0, 0, 1]
    assert one(spark, S.greedy_batches(arr(60 * mb, 60 * mb, 200 * mb, mb)))[0] == [0, 1, 2, 3]
    assert one(spark, S.line_groups(arr(0, 10, 14, 15, 29, 30)))[0] == [0, 0, 0, 1, 1, 2]
    assert one(spark, S.cluster_angles(arr(1.0, 1.4, 2.0, 1.6, 0.4)))[0] == [0, 0, 1, 1, 2]
    assert one(spark, S.merge_close(arr(1, 3, 5, 9, 12, 13)))[0] == [1, 5, 9, 13]
    profile = [0.0] * 40 + [1.0] * 10 + [0.0] * 50
    assert [tuple(p) for p in one(spark, S.page_bounds(arr(*profile)))[0]] == [(0, 40), (50, 100)]
    assert [tuple(p) for p in one(spark, S.page_bounds(arr(*([0.5] * 50))))[0]] == [(0, 50)]


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, at int, i int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 7, "z")], "k string, at int, v string")
    assert rows(S.as_of(left, right, "k", "at", "v"), "i", "v") == [(1, "y"), (2, None), (3, None)]


# ---- pages


def test_pages_in_spark(spark):
    made = P.synthetic_pages(spark.range(1, 15), "id").cache()
    decided = {r.id: r for r in P.decide(P.measure(made)).collect()}
    for i, r in decided.items():
        assert r.is_blank == r.planted_blank and r.status == "completed"
        if not r.planted_blank:
            assert abs(r.measures.projection - r.planted_skew) <= 0.5 and len(r.measures.pages) == r.planted_pages
    parts = rows(P.segment(made.select("id", "image")).groupBy("id").agg(F.count("*").alias("n")), "id", "n")
    assert (7, 2) in parts and (8, 1) in parts
    broken = made.select("id", F.struct(F.lit("x").alias("origin"), F.lit(3).alias("height"), F.lit(3).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.lit(b"ab").alias("data")).alias("image")).limit(1)
    assert P.decide(P.measure(broken)).first()["status"] == "failed"
    done = P.correct(broken.unionByName(made.where("id = 2").select("id", "image")), ["skew", "crop"]).collect()
    assert sorted(str(sorted(r.outcome.items())) for r in done) == ["[('crop', 'completed'), ('skew', 'completed')]", "[('crop', 'skipped'), ('skew', 'skipped')]"]


def test_metadata_by_field(spark):
    """page_flags reads three fields of the metadata."""
    from scanloom.plans import pipeline

    made = P.synthetic_pages(spark.range(7, 10).withColumnRenamed("id", "k"), "k").select("k", "image")
    fields = ("flags", "advice", "overall")
    known = pipeline.registry("k")
    every = pipeline.run(made, ["metadata"], "k", given=known)
    known.add("metadata", pipeline.described(fields=fields, keep_image=False))
    some = pipeline.run(made, ["metadata"], "k", given=known)
    assert some.schema["metadata"].dataType.names == list(fields) and "image" not in some.columns
    read = ("k", "state", *(f"metadata.{n}" for n in fields))
    assert sorted(some.select(*read).collect(), key=lambda r: r.k) == sorted(every.select(*read).collect(), key=lambda r: r.k)


def test_few_measures_make_few_decisions(spark):
    """page_recovery reads four measures: no others are computed, and what is decided by them is what all of them decide."""
    made = P.synthetic_pages(spark.range(7, 11).withColumnRenamed("id", "k"), "k")
    some, every = P.decide(P.measure(made, only=("text_density", "white_share", "projection", "pages"))), P.decide(P.measure(made))
    assert some.schema["measures"].dataType.names == ["white_share", "text_density", "projection", "pages"] and "document_type" not in some.columns
    read = ("k", "is_blank", "status", "measures.projection", "measures.pages")
    assert sorted(some.select(*read).collect()) == sorted(every.select(*read).collect())
    with pytest.raises(ValueError):
        P.measure(made, only=("no_such",))


def test_files_round_trip(spark, tmp_path):
    made = P.synthetic_pages(spark.range(1, 4), "id").select("id", "image")
    named = files.encode(made).select(F.concat(F.lit("page_"), "id", F.lit(".png")).alias("name"), "content")
    out = str(tmp_path / "pages")
    written = files.write_files(named, out).collect()
    assert len(written) == 3
    (tmp_path / "pages" / "note.txt").write_text("x")
    listed = files.list_files(spark, out, content=True)
    assert rows(listed, "kind") == [("image",)] * 3
    index = listed.limit(1).select(F.sha2("content", 256).alias("page_hash"))
    todo, skipped = files.new_files(listed, index)
    assert (todo.count(), skipped.count()) == (2, 1)
    back = {r.image.origin.split("/")[-1]: r.image for r in files.read_images(spark, out).where("image.height > 0").collect()}
    original = {f"page_{r.id}.png": r.image for r in made.collect()}
    for name, image in back.items():
        assert (P.to_array(image) == P.to_array(original[name])).all()
    packed = files.bundle(named.withColumn("doc", F.lit("d")), "doc", most_bytes=10)
    assert packed.count() == 3 and files.bundle(named.withColumn("doc", F.lit("d")), "doc").count() == 1
    expanded = files.expand_pdfs(spark.createDataFrame([("a.pdf", "pdf", b"12"), ("b.png", "image", b"1")], "path string, kind string, content binary"), lambda b: [b[:1], b[1:]])
    assert rows(expanded, "path", "page_number") == [("a.pdf", 1), ("a.pdf", 2)]
    files.append_csv(listed.select("path", "length"), str(tmp_path / "csv"))
    files.append_csv(listed.select("path", "length"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 6
    assert files.report(spark.range(1), "run", "id").first()[0] == "run: id=0" and files.sidecars(spark.range(1), "id").first()[1] == '{"id":0}'


def test_tiff_header(tmp_path):
    import struct

    import numpy as np

    data = files.encode_tiff(np.arange(12, dtype=np.uint8).reshape(3, 4))
    count = struct.unpack("<H", data[8:10])[0]
    tags = {t[0]: t[3] for t in (struct.unpack("<HHII", data[10 + 12 * i : 22 + 12 * i]) for i in range(count))}
    assert tags[256] == 4 and tags[257] == 3 and tags[259] == 8 and zlib.decompress(data[tags[273] : tags[273] + tags[279]]) == bytes(range(12))


# ---- streams


@pytest.fixture
def log(spark, tmp_path):
    events = [(i % 3, ["pending", "in_progress", "completed", "failed"][i % 4], float(i), float(i) if i % 5 else None, datetime(2024, 1, 1) + timedelta(minutes=20 * i)) for i in range(24)]
    df = spark.createDataFrame(events, "k long, status string, at double, v double, ts timestamp_ntz")
    df.repartition(3).write.parquet(str(tmp_path / "log"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_means_equal_batch(spark, log):
    df, stream = log
    got = drain(state.running_means(stream, "k", "v"), "means", "update").groupBy("k").agg(F.max_by("mean", "n").alias("mean"), F.max("n").alias("n"))
    expected = df.groupBy("k").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    assert [(k, pytest.approx(m), n) for k, m, n in rows(got, "k", "mean", "n")] == rows(expected, "k", "mean", "n")


def test_stream_statuses_equal_batch(spark, log):
    df, stream = log
    got = drain(state.statuses(stream, "k"), "statuses", "update").groupBy("k").agg(F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"))
    expected = C.status_now(df.select("k", "status", "at"), "k")
    assert rows(got, "k", "started_at", "completed_at") == rows(expected, "k", "started_at", "completed_at")


def test_stream_ingestion_and_dedup(spark, log, tmp_path):
    df, stream = log
    seen = []
    q = state.ingest(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(seen) == 24 and len(seen) >= 3
    assert drain(state.deduplicated(stream, ["k"], "ts", late="10 days"), "firsts", "append").count() == 3


def test_sessions_and_windows(spark, log):
    df, _ = log
    assert state.sessions(df, "k", "ts", "v", gap="30 minutes").count() == 24
    assert state.sessions(df, "k", "ts", "v", gap="2 hours").count() == 3
    assert state.windows(df, "k", "ts", "v", length="1 hour").count() == 24


# ---- scalars, SQL functions, command line


def test_scalars(spark):
    from scanloom.functions import scalars as Z

    iso = lambda x: one(spark, Z.iso_timestamp(F.lit(x)).cast("string"))[0]
    assert iso("2024-05-01T10:00:00Z") == iso("2024-05-01T12:00:00+02:00") == iso("2024-05-01T10:00:00") == "2024-05-01 10:00:00"
    assert iso("2024-05-01") == "2024-05-01 00:00:00" and iso("soon") is None
    assert one(spark, Z.pdf_date(F.lit("D:20240501101112+02'00'")).cast("string"), Z.pdf_date(F.lit("x")))[0] == "2024-05-01 10:11:12"
    name = lambda *x: one(spark, Z.download_name(*[F.lit(v).cast("string") for v in x]))[0]
    assert name("http://h/a/b.pdf?x=1", None, None) == "b.pdf"
    assert name("http://h/a", 'attachment; filename="c d.png"', "image/png") == "c d.png"
    assert name("http://h/", None, "application/pdf; q=1") == "downloaded_file.pdf" and name("http://h/scan", None, "image/png") == "scan.png"
    assert one(spark, Z.result_name(F.lit("/in/a.b.png"), F.lit(2), F.lit(3)), Z.result_name(F.lit("c"), F.lit(1), F.lit(1))) == ["a.b_result2.png", "c_result.png"]
    df = spark.createDataFrame([(1, None)], "b int, a string")
    assert df.select(Z.parameter_hash("a", "b")).first() == df.select(Z.parameter_hash("b", "a")).first()
    assert '"image_dimensions":"3x4"' in one(spark, Z.audit_fingerprint(F.lit(3), F.lit(4), F.lit(5), F.lit(1.234), F.lit(2.0), F.lit(0.12345), F.lit("n")))[0]
    assert one(spark, Z.hit_rate(F.lit(0), F.lit(0)), Z.hit_rate(F.lit(1), F.lit(3))) == [0.0, 25.0]


def test_sql_functions(spark):
    from scanloom.functions.registry import register

    assert "scan_children" in register(spark)
    digest = "ab" * 32
    got = spark.sql(f"SELECT scan_digest('SHA-256={digest.upper()}') AS a, scan_document_key('{{AB-1}}') AS b, scan_hamming(7, 1) AS c, scan_similarity(30) AS d, scan_quality_level(61) AS e").first()
    assert tuple(got) == (digest, "ab1", 2, 0, "good")
    spark.createDataFrame([("x", '["a",null,"b"]')], "id string, j string").createOrReplaceTempView("steps_view")
    assert rows(spark.sql("SELECT id, c.child_key FROM steps_view, LATERAL scan_children(j, 'steps') c"), "id", "child_key") == [("x", "0"), ("x", "2")]


def test_command_line(spark, tmp_path):
    from scanloom import cli

    made = P.synthetic_pages(spark.createDataFrame([(1,), (2,), (9,)], "id long"), "id", 120, 160).select("id", "image")
    inside, out = str(tmp_path / "in"), str(tmp_path / "out")
    files.write_files(files.encode(made).select(F.concat(F.lit("p"), "id", F.lit(".png")).alias("name"), "content"), inside).collect()
    o = cli.options(["--mode", "orient_skew_crop", "--input", inside, "--output", out])
    written = cli.run(spark, o).collect()
    assert sorted((r.state, r.name) for r in written if r.file) == [("ready", "p1_result.png"), ("ready", "p2_result.png")]
    assert [(r.state, r.file) for r in written if not r.file] == [("blank", None)]
    assert all(set(r.outcome) == {"orientation", "skew", "crop"} for r in written)
    assert sorted(x.name for x in (tmp_path / "out" / "comparisons").glob("*.png")) == ["p1_comparison.png", "p2_comparison.png"]
    # Every task of the mode runs; what nothing can read is a failed row.
    (tmp_path / "in" / "x.pdf").write_bytes(b"This is a test PDF content")
    (tmp_path / "in" / "broken.png").write_bytes(b"no image")
    o = cli.options(["--mode", "full_pipeline", "--input", inside, "--output", str(tmp_path / "all"), "--form", "pdf", "--no-comparisons", "--workers", "2", "--dpi", "30"])
    done = {r.path.split("/")[-1]: r for r in cli.run(spark, o).collect()}
    assert set(done["p1.png"].outcome.values()) == {"completed", "skipped"} and len(done["p1.png"].outcome) == 12 and done["p1.png"].name == "p1_result.pdf"
    assert done["x.pdf"].state == done["broken.png"].state == "failed" and set(done["broken.png"].outcome.values()) == {"failed"}
    (tmp_path / "in" / "x.pdf").unlink()
    (tmp_path / "in" / "broken.png").unlink()
    files.list_files(spark, inside, content=True).limit(3).select(F.sha2("content", 256).alias("page_hash")).write.parquet(str(tmp_path / "index"))
    o = cli.options(["--mode", "orient_only", "--input", inside, "--output", out, "--index", str(tmp_path / "index")])
    assert cli.run(spark, o).count() == 0


def test_pipeline_states(spark):
    from scanloom.plans import pipeline

    scans = P.synthetic_pages(spark.createDataFrame([(1,), (7,), (9,)], "id long"), "id", 120, 160).select("id", "image")
    none = scans.where("id = 1").select(F.lit(5).cast("long").alias("id"), F.lit(None).cast(scans.schema["image"].dataType).alias("image"))
    again = scans.where("id = 1").withColumn("id", F.lit(3).cast("long"))
    done = pipeline.run(scans.unionByName(none).unionByName(again), ["dedup", "contrast", "segment"], "id")
    assert rows(done, "id", "part", "state", "master") == [(1, 0, "ready", 1), (3, 0, "duplicate", 1), (5, 0, "failed", 5), (7, 0, "ready", 7), (7, 1, "ready", 7), (9, 0, "blank", 9)]
    assert {r.id: set(r.outcome.values()) for r in done.collect()} == {1: {"completed"}, 3: {"completed", "skipped"}, 5: {"failed"}, 7: {"completed"}, 9: {"skipped"}}
    bare = modes.Registry()
    with pytest.raises(ValueError):
        pipeline.run(scans, "orient_only", "id", given=bare)
    with pytest.raises(ValueError):
        pipeline.run(scans, "crop_only", "id")
    assert pipeline.run(scans.limit(0), "full_pipeline", "id", dpi=30).count() == 0


def test_pdf_of_a_page():
    page = np.zeros((20, 10, 3), np.uint8)
    made = files.encode_pdf(page, "a (b)")
    assert made.startswith(b"%PDF-1.4") and b"/MediaBox [0 0 612 792]" in made and rb"/Title (a \(b\))" in made
    start = int(made.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert made[start:].startswith(b"xref") and made[int(made[start:].split(b"\n")[3].split()[0]) :].startswith(b"1 0 obj")


def test_flags(spark):
    from scanloom.functions import rules as R

    df = spark.createDataFrame([(True, 10.0, 50.0, 0.5, 3.0), (False, 90.0, 500.0, 0.9, -1.0)], "m boolean, c double, s double, o double, k double")
    got = df.select(R.output_flags(*map(F.col, "mcsok")).alias("f")).select("f", R.recommendations(F.col("f")).alias("a"), R.overall_quality(F.col("f")).alias("q")).collect()
    assert [len(r.f) for r in got] == [5, 0] and [r.q for r in got] == ["poor", "excellent"] and len(got[0].a) == 5 and all(got[0].a)


def test_new_rows(spark):
    df = spark.createDataFrame([("A.PDF", "/in/A.PDF", 5)], "filename string, original_path string, file_size long")
    got = C.new_documents(df, datetime(2024, 1, 1)).first()
    assert (got.file_extension, got.mime_type, got.status, got.original_filename, len(got.id)) == (".pdf", "application/pdf", "pending", "A.PDF", 36)
    f = spark.createDataFrame([("k", "b", "2", 3), ("k", "a", "1", 4), ("k", None, "x", 1)], "k string, path string, checksum string, size_bytes long")
    r = C.checksums(f, "k").first()
    assert (r.bytes, r.checksums) == (7, {"a": "1", "b": "2"})
