from pyspark.sql import functions as F

from scanloom.functions.keys import digest, document_key, file_path, hash64, is_given, width_height

H = "ab12" * 16


def values(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[1] for r in df.select("i", make(F.col("x"))).orderBy("i").collect()]


def test_digest(spark):
    rows = [H, H.upper(), "SHA-256=" + H, "0x" + H, f' "{H}"\t', H + "0", H[1:], "", None, "n/a", "x" * 10_000 + H]
    assert values(spark, rows, digest) == [H] * 5 + [None] * 5 + [H]


def test_document_key(spark):
    key = "03c7e141c80b469ca8a139b126ac865a"
    rows = ["03c7e141-c80b-469c-a8a1-39b126ac865a", "{03C7E141-C80B-469C-A8A1-39B126AC865A}", " urn:uuid:03c7e141-c80b-469c-a8a1-39b126ac865a ", key, "{urn:uuid:03C7E141-c80b-469c-a8a1-39b126ac865a}", "\t urn:uuid:{03c7e141-c80b-469c-a8a1-39b126ac865a}", "?", "", None]
    assert values(spark, rows, document_key) == [key] * 6 + ["", "", None]
    assert values(spark, rows, is_given) == [True] * 7 + [False, False]


def test_hash64(spark):
    rows = ["ffffffffffffffff", "0x1", " 00A ", "8000000000000000", "0", "12345678901234567", "xyz", None, ""]
    assert values(spark, rows, hash64) == [-1, 1, 10, -(2**63), 0, None, None, None, None]


def test_file_path(spark):
    rows = ["/srv/scanstore/a/b", "a/b", "./a/./b", "/srv//scanstore/x/../a/b", "file:///srv/scanstore/%61/b", "\\srv\\scanstore\\a\\b", " /srv/scanstore/a/b \n", "/srv/scanstore/A/b", "/srv/scanstore/a%20b", "file:///a+b", "", " ", None, "/../.."]
    assert values(spark, rows, file_path) == ["/srv/scanstore/a/b"] * 7 + ["/srv/scanstore/A/b", "/srv/scanstore/a%20b", "/a+b", None, None, None, ""]


def test_width_height(spark):
    rows = ["2480x3508", "(1654, 2339)", "w=1;h=2", "4960×7016", "2550X3300px", "2550x", "-1x-1", "unknown", None, "0x10"]
    got = values(spark, rows, lambda x: F.struct(*width_height(x)))
    assert [tuple(r) for r in got] == [(2480, 3508), (1654, 2339), (1, 2), (4960, 7016), (2550, 3300), (None, None), (None, None), (None, None), (None, None), (0, 10)]
